"""What users read: tagged dictionaries, classes of pairs, pronunciations, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mishear.operators.classify import CATEGORIES, PREPROCESSED

#: The first line of a tagged dictionary, and the scope column that an empty report has.
TAGGED_HEADER, EMPTY_REPORT = "#TERM_IMPORT_V2", "scope"
BOM = "﻿"


def in_order(lines: DataFrame, path: str, header: str | None = None) -> None:
    """(n, value) as one text file in the order of n, after a header. For files that people read."""
    if header is not None:
        first = lines.sparkSession.createDataFrame([(-1, header)], "n long, value string")
        lines = first.unionByName(lines.select(F.col("n").cast("long").alias("n"), "value"))
    lines.orderBy("n").select("value").coalesce(1).write.text(path)


def write_tagged(tagged: DataFrame, folder: str) -> None:
    """The tagged dictionary, what was taken out, and both as JSON (see :func:`mishear.operators.ranking.tagged`)."""
    in_order(tagged.select(F.col("line_number").alias("n"), F.col("output_line").alias("value")), f"{folder}/tagged", TAGGED_HEADER)
    in_order(tagged.select(F.col("line_number").alias("n"), F.col("removed_line").alias("value")), f"{folder}/removed")
    tagged.write.json(f"{folder}/detail", ignoreNullFields=False)


def write_classes(pairs: DataFrame, folder: str) -> DataFrame:
    """Pairs (canonical, confusion, category) as text by category, those of which variants are made, and JSON; returns the counts of all categories."""
    line = F.concat_ws("|", "canonical", "confusion").alias("value")
    pairs.select("category", line).write.partitionBy("category").text(f"{folder}/by_category")
    pairs.where(F.col("category").isin(list(PREPROCESSED))).select(line).write.text(f"{folder}/preprocessable")
    pairs.write.json(f"{folder}/classification")
    every = pairs.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counts = pairs.groupBy("category").agg(F.count("*").alias("n"))
    return every.join(counts, "category", "left").fillna(0, ["n"])


def write_pronunciations(samples: DataFrame, unresolved: DataFrame, folder: str) -> None:
    """Sample rows, their structures, and the terms that have none."""
    samples.write.json(f"{folder}/pronunciation-variants")
    samples.select("sample_id", "canonical", "number", "variant_kind", "pronunciation_structure").write.json(f"{folder}/structured-pronunciations")
    unresolved.write.json(f"{folder}/unresolved")


def write_report(df: DataFrame, path: str) -> None:
    """CSV for spreadsheets: a byte order mark, sorted columns, nested values as JSON. A report has one row a group, so it is one file."""
    if df.isEmpty():
        df.sparkSession.createDataFrame([(BOM + EMPTY_REPORT,)], "value string").coalesce(1).write.text(path)
        return
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))}
    columns = [(F.to_json(c) if c in nested else F.col(c)).alias((BOM if k == 0 else "") + c) for k, c in enumerate(sorted(df.columns))]
    df.select(*columns).coalesce(1).write.csv(path, header=True, escape='"')
