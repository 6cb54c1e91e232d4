"""Edits of token arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(s: Column, t: Column) -> Column:
    """Levenshtein distance of two arrays: a fold over rows of the table."""
    first = F.sequence(F.lit(0), F.size(t))

    def row(prev: Column, sv: Column) -> Column:
        def cell(cur: Column, j: Column) -> Column:
            swap = F.get(prev, j - 1) + F.when(sv != F.get(t, j - 1), 1).otherwise(0)
            return F.concat(cur, F.array(F.least(F.get(cur, j - 1) + 1, F.get(prev, j) + 1, swap)))

        return F.aggregate(F.sequence(F.lit(1), F.size(t)), F.array(F.get(prev, F.lit(0)) + 1), cell)

    return F.when(F.size(t) == 0, F.size(s)).otherwise(F.get(F.aggregate(s, first, row), F.size(t)))


def without(x: Column, i: Column) -> Column:
    """``x`` less its element ``i``, counted from 0."""
    return F.filter(x, lambda _, k: k != i)


def first_gap(longer: Column, shorter: Column, fallback: bool = False) -> Column:
    """The least index whose removal makes the arrays equal; without one null, or if asked for where the shorter one ends."""
    places = F.sequence(F.lit(0), F.size(longer) - 1)
    found = F.get(F.filter(places, lambda i: without(longer, i) == shorter), F.lit(0))
    end = F.least(F.size(shorter), F.size(longer) - 1)
    return F.when(F.size(longer) > 0, F.coalesce(found, end) if fallback else found)


def only_change(a: Column, b: Column) -> Column:
    """Index of the one element in which arrays of one length differ, else null."""
    pairs = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(a, i) != F.get(b, i))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (F.size(pairs) == 1), F.get(pairs, F.lit(0)))


def replaced(x: Column, i: Column, value: Column) -> Column:
    return F.transform(x, lambda v, k: F.when(k == i, value).otherwise(v))
