"""Transcripts against a glossary: metrics, hits, misses, coverage and breakdowns.

Result rows (see :func:`keyed`) carry term and text as they were, their keys,
status, whether they match, and what they are grouped by; pairs are (term_key,
conf_key, confusion). Keys are computed once, upstream.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mishear.functions import text as t
from mishear.functions.text import rate
from mishear.operators.keys import top

HEARD = ("success", "reused")
#: What stands for no transcript, and for a row of no rule.
NO_TEXT, BASELINE = "(no transcript)", "baseline"


def keyed(results: DataFrame) -> DataFrame:
    """Adds the keys of (term, text): with spaces, compact, and the normal form of the text."""
    return results.withColumns(
        {
            "term_key": t.spacing_key(F.col("term")),
            "target_key": t.compact_key(F.col("term")),
            "out_key": t.spacing_key(F.col("text")),
            "cand_key": t.compact_key(F.col("text")),
            "out_norm": t.normalized(F.col("text")),
        }
    )


# known confusions


def hits(results: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Successful transcripts that are a known confusion of their own term, counted by the term's spelling."""
    own = results.where("status = 'success' AND text IS NOT NULL")
    known = pairs.select(F.col("term_key").alias("_t"), "conf_key", "confusion")
    joined = own.join(known, (own["term_key"] == known["_t"]) & (own["out_key"] == known["conf_key"]))
    return joined.groupBy(*by, "term", "term_key", "conf_key", "confusion").agg(F.count("*").alias("hits"), F.min("seq").alias("first_seq"))


def most_common(found: DataFrame) -> DataFrame:
    """Hits by count, those of equal count as first seen."""
    return found.orderBy(F.desc("hits"), "first_seq")


def misses(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Confusions of terms with results that no result hit."""
    present = pairs.join(results.select("term_key").distinct(), "term_key", "left_semi")
    hit = results.where("status = 'success' AND text IS NOT NULL").select("term_key", F.col("out_key").alias("conf_key"))
    return present.join(hit, ["term_key", "conf_key"], "left_anti")


def coverage(results: DataFrame, pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each group known pairs of present terms, unique hits, hit events, terms with a hit and the rate."""
    sizes = pairs.groupBy("term_key").agg(F.count("*").alias("n"))
    present = results.select(*by, "term_key").distinct().join(sizes, "term_key")
    known = present.groupBy(*by).agg(F.sum("n").alias("known_confusion_total"))
    found = hits(results, pairs, by).groupBy(*by).agg(
        F.count("*").alias("unique"), F.sum("hits").alias("events"), F.countDistinct("term").alias("terms")
    )
    joined = results.select(*by).distinct().join(known, list(by), "left").join(found, list(by), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select(
        *by,
        zero(F.col("known_confusion_total")).alias("known_confusion_total"),
        zero(F.col("unique")).alias("matched_unique_confusion_count"),
        zero(F.col("events")).alias("matched_confusion_event_count"),
        zero(F.col("terms")).alias("terms_with_hit_count"),
        rate(zero(F.col("unique")), zero(F.col("known_confusion_total"))).alias("coverage_rate"),
    )


def prefixed(df: DataFrame, by: Sequence[str], prefix: str = "gt_") -> DataFrame:
    return df.select(*by, *(F.col(c).alias(prefix + c) for c in df.columns if c not in by))


def miss_details(missed: DataFrame, results: DataFrame, n: int = 8) -> DataFrame:
    """For each missed pair its term's counts, categories, rules tried and most frequent outputs."""
    heard = F.col("status").isin(*HEARD)
    rule = F.coalesce(F.nullif("rule", F.lit("")), F.nullif("variant_kind", F.lit("")), F.lit(BASELINE))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    per_term = results.groupBy("term_key").agg(
        F.count("*").alias("asr_sample_count"),
        F.count_if(heard).alias("successful_asr_count"),
        F.count_if(heard & F.coalesce("compact", F.lit(False))).alias("canonical_output_count"),
        listed(rule).alias("rules_tried"),
        listed(F.nullif("category", F.lit(""))).alias("confusion_category"),
    )
    said = results.where(heard).withColumn("said", F.coalesce("text", F.lit(NO_TEXT)))
    counts = said.groupBy("term_key", "said").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = top(counts, ["term_key"], n, F.desc("n"), "first")
    outputs = best.groupBy("term_key").agg(F.array_sort(F.collect_list(F.struct("rank", F.format_string("%s (%d)", "said", "n").alias("t")))).alias("o"))
    joined = missed.join(per_term, "term_key").join(outputs, "term_key", "left")
    return joined.withColumn("top_asr_outputs", F.array_join(F.coalesce(F.col("o.t"), F.array().cast("array<string>")), " | ")).drop("o")


# metrics


def counts() -> list[Column]:
    """Counts and rates of a group; rows that failed count only as such."""
    n, ok = F.count("*"), F.col("status") != "error"
    exact, compact = (F.count_if(ok & F.coalesce(c, F.lit(False))) for c in ("exact", "compact"))
    return [
        n.alias("request_count"),
        F.count_if(~ok).alias("failure_count"),
        exact.alias("exact_match_count"),
        rate(exact, n).alias("exact_match_rate"),
        compact.alias("compact_match_count"),
        rate(compact, n).alias("compact_match_rate"),
        F.countDistinct(F.when(ok, F.col("cand_key"))).alias("distinct_transcript_count"),
    ]


def candidate_hits(results: DataFrame, lexicon: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group the candidates of ``lexicon`` (cand_key, spellings) that were heard, and whether they are a term of the group."""
    own = results.where("status <> 'error' AND text IS NOT NULL").groupBy(*by, "cand_key").agg(F.count("*").alias("hit_count"))
    targets = results.select(*by, F.col("target_key").alias("cand_key"), F.lit(True).alias("target")).distinct()
    found = own.join(lexicon, "cand_key").join(targets, [*by, "cand_key"], "left")
    return found.select(*by, "cand_key", F.get("spellings", F.lit(0)).alias("candidate"), "spellings", "hit_count", F.coalesce("target", F.lit(False)).alias("is_target_alias"))


def metrics(results: DataFrame, lexicon: DataFrame, by: Sequence[str]) -> DataFrame:
    """:func:`counts` of each group, and of the candidates heard that are no term of the group."""
    found = candidate_hits(results, lexicon, by).where("NOT is_target_alias").groupBy(*by)
    found = found.agg(F.count("*").alias("matched_confusion_candidate_count"), F.sum("hit_count").alias("confusion_hit_count"))
    joined = results.groupBy(*by).agg(*counts()).join(found, list(by), "left")
    return joined.fillna(0, ["matched_confusion_candidate_count", "confusion_hit_count"])


def top_errors(results: DataFrame, by: Sequence[str], n: int = 10) -> DataFrame:
    """Most frequent wrong transcripts; ties go to the one seen first."""
    wrong = results.where((F.col("status") != "error") & ~F.coalesce("compact", F.lit(False))).withColumn("transcript", F.coalesce("out_norm", F.lit(NO_TEXT)))
    found = wrong.groupBy(*by, "transcript").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return top(found, list(by), n, F.desc("n"), "first_seq")


def dimensions() -> dict[str, Column]:
    """The columns of a result that reports break down by, with the label of none."""
    of = lambda label, *names: F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names), F.lit(label))
    return {
        "source_set": of("(none)", "source_set", "source_manifest"),
        "prompt_or_voice": of("(none)", "instruction_group", "voice"),
        "augmentation": of("(original)", "augmentation"),
        "confusion_category": of("(canonical/none)", "category"),
        "pronunciation_variant": of("(canonical/none)", "variant_kind"),
        "pronunciation_rule": of("(baseline/none)", "rule"),
        "input_mode": of("text", "input_mode"),
        "carrier_source": of("(canonical/none)", "carrier_source"),
    }


def unpivoted(results: DataFrame, groupers: dict[str, Column]) -> DataFrame:
    """A row for each dimension."""
    values = F.array(*(F.struct(F.lit(n).alias("group_type"), c.alias("group_value")) for n, c in groupers.items()))
    return results.select("*", F.inline(values))


def breakdown(results: DataFrame, lexicon: DataFrame, pairs: DataFrame, groupers: dict[str, Column] | None = None, run: Sequence[str] = ("condition", "repeat")) -> DataFrame:
    """Metrics and coverage of each run by each value of each dimension: one unpivot, one grouping."""
    by = [*run, "group_type", "group_value"]
    rows = unpivoted(results, groupers or dimensions())
    return metrics(rows, lexicon, by).join(prefixed(coverage(rows, pairs, by), by), by)


def report(results: DataFrame, lexicon: DataFrame, pairs: DataFrame) -> DataFrame:
    """Metrics and coverage of each run and of each condition over its runs, told apart by ``scope``.

    Each row goes to its run and to its condition, so that distincts are counted anew and both are one pass.
    """
    by = ["scope", "condition", "repeat"]
    scopes = F.array(F.struct(F.lit("run").alias("scope"), F.col("repeat").cast("int").alias("_r")), F.struct(F.lit("condition").alias("scope"), F.lit(-1).alias("_r")))
    rows = results.select("*", F.inline(scopes)).drop("repeat").withColumnRenamed("_r", "repeat")
    out = metrics(rows, lexicon, by).join(prefixed(coverage(rows, pairs, by), by), by)
    runs = results.groupBy("condition").agg(F.countDistinct("repeat").alias("repeats"))
    return out.join(runs, "condition").withColumn("repeat", F.when(F.col("repeat") >= 0, F.col("repeat")))


def variable_outputs(results: DataFrame, source: str, output: str) -> DataFrame:
    """Sources with more than one distinct output."""
    return results.where(F.col(output).isNotNull()).groupBy(source).agg(F.countDistinct(output).alias("outputs")).where("outputs > 1")


def variable_count(results: DataFrame, by: Sequence[str], source: str, output: str) -> DataFrame:
    """How many sources of a group vary."""
    each = results.where(F.col(output).isNotNull()).groupBy(*by, source).agg(F.countDistinct(output).alias("outputs"))
    return each.groupBy(*by).agg(F.count_if(F.col("outputs") > 1).alias("variable_audio_count"))


def rule_effectiveness(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """What the variants of each rule led to, of those that were heard: the term, a known confusion, or anything else."""
    variants = results.where(F.coalesce("variant_kind", F.lit("")) != BASELINE).withColumn("rule", F.coalesce(F.nullif("rule", F.lit("")), F.lit("(none)")))
    known = pairs.select("term_key", F.col("conf_key").alias("out_key"), F.lit(True).alias("known")).distinct()
    judged = variants.join(known, ["term_key", "out_key"], "left")
    heard = F.col("status").isin(*HEARD) & F.col("text").isNotNull()
    canonical = heard & F.coalesce("compact", F.lit(False))
    hit = heard & ~F.coalesce("compact", F.lit(False)) & F.col("known").isNotNull()
    out = judged.groupBy("rule").agg(
        F.count("*").alias("generated_count"), F.count_if(heard).alias("successful_asr_count"), F.count_if(canonical).alias("canonical_event_count"), F.count_if(hit).alias("gt_hit_event_count")
    )
    rest = F.col("successful_asr_count") - F.col("canonical_event_count") - F.col("gt_hit_event_count")
    rates = {"gt_hit_rate": "gt_hit_event_count", "ineffective_rate": "canonical_event_count", "over_distorted_rate": "over_distorted_count"}
    out = out.withColumn("over_distorted_count", rest)
    return out.withColumns({n: rate(F.col(c), F.col("successful_asr_count")) for n, c in rates.items()})


def outcomes(results: DataFrame, rule: str, cases: dict[str, Column]) -> DataFrame:
    """Of each rule the rows, and how many fall under each case; the first that holds counts."""
    labels = reduce(lambda a, kv: F.when(kv[1], kv[0]).otherwise(a), reversed(list(cases.items())), F.lit("other"))
    own = results.select(F.coalesce(rule, F.lit("(none)")).alias("rule"), labels.alias("_o"))
    return own.groupBy("rule").agg(F.count("*").alias("generated"), *(F.count_if(F.col("_o") == o).alias(o) for o in cases))


# two glossaries


def compare_sets(known: DataFrame, observed: DataFrame, group: str, key: str) -> DataFrame:
    """Per group, how many keys both have, and how many one has alone."""
    a, b = known.select(group, key).distinct().withColumn("a", F.lit(1)), observed.select(group, key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, [group, key], "full")
    return both.groupBy(group).agg(F.count_if(F.expr("a = 1 AND b = 1")).alias("matched"), F.count_if(F.expr("b IS NULL")).alias("known_only"), F.count_if(F.expr("a IS NULL")).alias("observed_only"))


def compare_lists(known: DataFrame, observed: DataFrame) -> DataFrame:
    """Of each term of ``known`` (term_key, seq, conf_key, confusion) what ``observed`` (term_key, conf_key) has and lacks, in order."""
    seen = observed.select("term_key", "conf_key", F.lit(True).alias("seen")).distinct()
    rows = known.join(seen, ["term_key", "conf_key"], "left")
    listed = lambda when: F.array_sort(F.collect_list(F.when(when, F.struct("seq", "confusion"))))["confusion"]
    hit = F.col("seen").isNotNull()
    out = rows.groupBy("term_key").agg(F.count("conf_key").alias("total_count"), F.count_if(hit).alias("matched_count"), listed(hit).alias("matched"), listed(~hit).alias("missing"))
    return out.withColumn("hit_rate", F.when(F.col("total_count") > 0, F.col("matched_count") / F.col("total_count")))


def compare_totals(lists: DataFrame) -> DataFrame:
    total, matched = F.sum("total_count"), F.sum("matched_count")
    return lists.agg(
        F.count("*").alias("term_count"), total.alias("total_confusion_count"), matched.alias("matched_confusion_count"),
        F.when(total > 0, matched / total).alias("hit_rate"), F.count_if(F.col("matched_count") > 0).alias("terms_with_hits"), F.count_if(F.col("matched_count") == 0).alias("terms_without_hits"),
    )
