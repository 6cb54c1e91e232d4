"""Glossaries, rule tables and frequency dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mishear.functions.text import compact_key, spacing_key
from mishear.operators.keys import first_by


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a small text file, in file order, BOM dropped."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("seq", "line"))
    return whole.withColumn("seq", F.col("seq") + 1)


def parse_terms(rows: DataFrame, merge: bool = True) -> DataFrame:
    """(term_key, canonical, seq, lines, confusions) of ``term|confusion|...`` lines (seq, line).

    Blank lines and comments go. With ``merge`` lines of one key become one entry: the first spelling stays, and
    confusions are kept once by key, in order, without the term itself.
    """
    kept = rows.where(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    fields = F.transform(F.split("line", r"\|", -1), lambda x: F.trim(x))
    kept = kept.select("seq", F.get(fields, F.lit(0)).alias("canonical"), F.slice(fields, 2, F.size(fields)).alias("rest"))
    kept = kept.withColumn("term_key", spacing_key(F.col("canonical"))).where("term_key <> ''")
    group = ["term_key"] if merge else ["term_key", "seq"]
    entries = kept.groupBy(*group).agg(
        F.min_by("canonical", "seq").alias("canonical"), F.min("seq").alias("first_seq"), F.array_sort(F.collect_list("seq")).alias("lines")
    )
    pairs = kept.select(*group, F.col("seq").alias("at"), F.posexplode("rest").alias("pos", "confusion"))
    pairs = pairs.withColumn("conf_key", spacing_key(F.col("confusion"))).where("conf_key <> '' AND conf_key <> term_key")
    pairs = first_by(pairs, [*group, "conf_key"], "at", "pos")
    lists = pairs.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("at", "pos", "confusion"))).alias("c"))
    out = entries.join(lists, group, "left")
    none = F.array().cast("array<string>")
    return out.select("term_key", "canonical", F.col("first_seq").alias("seq"), "lines", F.coalesce(F.col("c.confusion"), none).alias("confusions"))


def checked(entries: DataFrame) -> DataFrame:
    """Fails if there are no terms."""
    if entries.isEmpty():
        raise ValueError("the glossary has no terms")
    return entries


def sample_ids(entries: DataFrame, slot: int = 4096) -> DataFrame:
    """Numbers in first-seen order with a digest.

    Lines are numbered within slots of ``slot`` lines, and a sum over the slots before makes that a number: no task
    sorts all entries.
    """
    slots = entries.withColumn("_slot", F.floor(F.col("seq") / F.lit(slot)))
    counts = slots.groupBy("_slot").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))  # one row a slot
    before = counts.select("_slot", F.coalesce(earlier, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_slot").orderBy("seq")) + F.col("_before")
    numbered = slots.join(before, "_slot").withColumn("_number", number)
    return numbered.withColumn("sample_id", F.format_string("gt-%04d-%s", "_number", F.substring(F.sha2("canonical", 256), 1, 10))).drop("_slot", "_before", "_number")


def strict_lines(rows: DataFrame) -> DataFrame:
    """Lines of a glossary; fails, when it runs, on one whose term has no key."""
    term = F.trim(F.get(F.split("line", r"\|", -1), F.lit(0)))
    skipped = F.trim("line").startswith("#") | (F.trim("line") == "")
    ok = F.assert_true(skipped | (spacing_key(term) != ""), F.concat(F.lit("empty term in line "), F.col("seq").cast("string")))
    return rows.where(F.coalesce(ok.isNull(), F.lit(True)))


def lexicon(entries: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(cand_key, spellings) of all terms, confusions and ``extra`` (seq, word), by compact key, spellings as first seen."""
    terms = entries.select(F.lit(0).alias("part"), F.col("seq"), F.lit(0).alias("pos"), F.col("canonical").alias("word"))
    known = entries.select(F.lit(1).alias("part"), F.col("seq"), F.posexplode("confusions").alias("pos", "word"))
    words = terms.unionByName(known)
    if extra is not None:
        words = words.unionByName(extra.select(F.lit(2).alias("part"), F.col("seq"), F.lit(0).alias("pos"), F.trim("word").alias("word")))
    keyed = words.withColumn("cand_key", compact_key(F.col("word"))).where("cand_key <> ''")
    first = keyed.groupBy("cand_key", "word").agg(F.min(F.struct("part", "seq", "pos")).alias("at"))
    lists = first.groupBy("cand_key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return lists.select("cand_key", F.col("w.word").alias("spellings"))


def fuzzy_rules(spark: SparkSession, path: str) -> DataFrame:
    """Syllable rules; the first of each (type, source, target)."""
    own = lines(spark, path).where("trim(line) <> '' AND NOT startswith(trim(line), '#')")
    head = own.orderBy("seq").first()
    names = [n.strip() for n in head["line"].split(",")] if head else []
    if missing := {"type", "source", "target", "level", "origin"} - set(names):
        raise ValueError(f"rule table lacks {sorted(missing)}")
    parts = F.split("line", ",", -1)
    rows = own.where(F.col("seq") > head["seq"]).select("seq", *(F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)))
    rows = rows.where(F.col("type").isin("initial", "final") & (F.col("level").cast("int") >= 1))
    return first_by(rows, ["type", "source", "target"], "seq").drop("seq").withColumn("level", F.col("level").cast("int"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct keys of ``word``, ``word<TAB>n`` or ``word n`` lines."""
    rows = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    words = rows.select(F.regexp_extract("value", r"^\s*(.*?)(?:[\t ]+\d+)?\s*$", 1).alias("key"))
    return words.select(spacing_key(F.col("key")).alias("key")).where("key <> ''").distinct()


def weighted_dictionary(spark: SparkSession, path: str, least: int = 5000) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("word"), F.size(parts).alias("n"), F.element_at(parts, -1).alias("weight"))
    words = rows.where(F.col("n") >= 3).where(F.col("weight").rlike(r"^\d+$")).where(F.col("weight").cast("long") >= least)
    return words.select(spacing_key(F.col("word")).alias("key")).distinct()


def character_frequencies(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("ch"), F.get(parts, F.lit(1)).cast("long").alias("freq"), F.monotonically_increasing_id().alias("seq"))
    return rows.where(F.col("ch").rlike(r"^[\x{4e00}-\x{9fff}]$")).groupBy("ch").agg(F.max_by("freq", "seq").alias("freq"))
