"""JSON record files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = ("sample_id", "expected_text", "audio_path", "pronunciation_rule", "variant_kind", "confusion_category", "engine", "voice", "augmentation")
_ASR = T.StructType([T.StructField("status", T.StringType()), T.StructField("text", T.StringType())])
RESULT = T.StructType([*(T.StructField(n, T.StringType()) for n in _TEXT), T.StructField("asr", _ASR)])


def read_records(spark: SparkSession, paths: str | list[str], schema: T.StructType, torn: bool = False) -> DataFrame:
    """One object a line by an explicit schema; ``torn`` drops broken lines, else they fail the read."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED" if torn else "FAILFAST")
    return reader.json(paths)


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def some(df: DataFrame) -> DataFrame:
    """Fails if there are no rows."""
    if df.isEmpty():
        raise ValueError("there are no rows")
    return df


META = T.StructType([T.StructField(n, T.StringType()) for n in ("fingerprint", "sampling", "language", "prompt")])


def read_results(spark: SparkSession, folder: str, schema: T.StructType = RESULT) -> DataFrame:
    """Runs below ``folder`` with their settings: condition and repeat come from the path results/<condition>/run-<n>.jsonl,
    settings from run-<n>.jsonl.meta.json beside it; where that is missing or damaged they are null.
    """
    path = F.col("_metadata.file_path")
    runs = read_records(spark, f"{folder}/results/*/run-*.jsonl", schema).select(
        "*",
        F.regexp_extract(path, r"/results/([^/]+)/run-", 1).alias("condition"),
        F.regexp_extract(path, r"run-(\d+)\.jsonl$", 1).cast("int").alias("repeat"),
    )
    meta = spark.read.schema(META).option("multiLine", True).option("pathGlobFilter", "run-*.jsonl.meta.json").option("recursiveFileLookup", True).json(f"{folder}/results")
    meta = meta.select(
        F.regexp_extract(path, r"/results/([^/]+)/run-", 1).alias("condition"),
        F.regexp_extract(path, r"run-(\d+)\.jsonl\.meta\.json$", 1).cast("int").alias("repeat"),
        *META.fieldNames(),
    )
    return runs.join(meta, ["condition", "repeat"], "left")


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fails, when it runs, on a row that lacks one of ``columns``."""
    missing = F.coalesce(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns))
    return df.where(F.coalesce(F.assert_true(missing.isNull(), F.concat(F.lit("missing field: "), missing)).isNull(), F.lit(True)))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    other = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*other), order).alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in other))


def write_records(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def term_lines(df: DataFrame, term: str = "canonical", candidates: str = "candidates") -> DataFrame:
    """``term|candidate|...`` lines."""
    return df.select(F.concat_ws("|", F.col(term), F.array_join(candidates, "|")).alias("value"))


def write_in_order(df: DataFrame, path: str, order: str) -> None:
    """One object a line in the order of a column, however rows were completed."""
    df.orderBy(order).write.json(path, ignoreNullFields=False)
