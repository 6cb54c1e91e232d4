"""Manifests of jobs: union, gating, expansion and incremental work."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mishear.functions.text import stable_id

READY = ("generated", "cached")


def ready(df: DataFrame) -> DataFrame:
    return df.where(F.col("status").isin(*READY))


def merge(manifests: dict[str, DataFrame]) -> DataFrame:
    """Manifests one after the other, absent columns null, each row with its set unless it names one."""
    def named(name: str, df: DataFrame) -> DataFrame:
        own = F.col("source_set") if "source_set" in df.columns else F.lit(None).cast("string")
        return df.withColumn("source_set", F.coalesce(own, F.lit(name)))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (named(n, d) for n, d in manifests.items()))


def matching(df: DataFrame, text: str | None = None, ready_only: bool = False, expected: int | None = None) -> DataFrame:
    """Rows of one text, or that are ready; fails if they are none, or not as many as expected."""
    if text is not None:
        df = df.where(F.coalesce("text", F.lit("")) == text)
    df = ready(df) if ready_only else df
    n = df.count()
    if not n or expected is not None and n != expected:
        raise ValueError(f"the manifest has {n} rows" + (f" instead of {expected}" if expected is not None else ""))
    return df


def usable(df: DataFrame) -> DataFrame:
    """Fails if no row is ready."""
    if ready(df).isEmpty():
        raise ValueError("no row of the manifest is ready")
    return df


#: The columns of a result that come from its manifest row, renamed or as they are.
RENAMED = {"expected_text": "text", "tts_engine": "engine", "tts_status": "status"}
KEPT = (
    "sample_id", "audio_path", "voice", "instruction", "source_text", "tts_text", "text_source", "pronunciation_processed", "prompt_version", "tts_instruction_group", "tts_instruction_text",
    "canonical_text", "pronunciation_variant_id", "pronunciation_rule", "base_pronunciation", "variant_pronunciation", "tts_renderability", "render_method", "target_confusions",
    "confusion_category", "pronunciation_delta", "variant_kind", "pronunciation_instruction", "phoneme_text", "input_mode", "pronunciation_structure", "source_audio_path",
    "source_manifest_path", "source_tts_status", "augmentation", "benchmark_source_set", "benchmark_source_manifest",
)


def result_columns(df: DataFrame) -> list[Column]:
    """What a result takes from its manifest row, of the columns that there are."""
    own = [F.col(old).alias(new) for new, old in RENAMED.items() if old in df.columns]
    tags = next((c for c in ("sample_tags", "tags") if c in df.columns), None)
    return [*own, *(F.col(c) for c in KEPT if c in df.columns), *([F.col(tags).alias("sample_tags")] if tags else [])]


def of_entries(results: DataFrame, entries: DataFrame) -> DataFrame:
    """Results of entries, with the entry's canonical text."""
    return results.join(entries.select("sample_id", "canonical"), "sample_id")


def summary(df: DataFrame, by: Sequence[str] = (), status: str = "status") -> DataFrame:
    """One row, or one a group: rows, and how many are ready, skipped and failed."""
    s = F.col(status)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(s.isin(*READY)).alias("ready"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "error").alias("errors"))


def distinct_union(*words: DataFrame) -> DataFrame:
    """Keys of several dictionaries, once each."""
    return reduce(lambda a, b: a.unionByName(b), words).distinct()


def gate(path: str = "audio_path", status: str = "status") -> Column:
    """What becomes of a row: skipped, error or transcribe."""
    return F.when(~F.coalesce(F.col(status).isin(*READY), F.lit(False)), "skipped").when(F.col(path).isNull() | (F.col(path) == ""), "error").otherwise("transcribe")


def language(fixed: str | None, column: str = "language") -> Column:
    """A fixed language, else the manifest's unless it is auto or empty."""
    return F.lit(fixed) if fixed else F.when(~F.lower(column).isin("auto", ""), F.col(column))


def origin_in(column: str, allowed: list[str]) -> Column:
    return F.col(column).isin(allowed) | F.regexp_replace(column, r"\+gt$", "").isin(allowed)


#: Settings that a job may be expanded by.
MOST_SPECS = 10_000


def checked_specs(specs: DataFrame) -> DataFrame:
    """``specs`` for a broadcast, after a look that they are at most ``MOST_SPECS``."""
    if specs.limit(MOST_SPECS + 1).count() > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} settings")
    return F.broadcast(specs)


def expand(rows: DataFrame, specs: DataFrame, key: list[str]) -> DataFrame:
    """Every row with every spec (a table of settings, a few rows), and the identity of the job."""
    return rows.crossJoin(checked_specs(specs)).withColumn("job_id", stable_id(*(F.col(c) for c in key)))


def todo(jobs: DataFrame, done: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs without a result of the same identity."""
    return jobs.join(done, key, "left_anti")


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def every_category(df: DataFrame, category: str, all_of: DataFrame) -> DataFrame:
    """Counts of categories, those with none included."""
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    return all_of.join(counts, category, "left").withColumn("n", F.coalesce("n", F.lit(0)))
