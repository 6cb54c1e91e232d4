"""Variants that aim at known confusions, fuzzy readings with carriers, and the ways to make samples of a glossary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mishear.functions import text as t
from mishear.operators import classify, syllables
from mishear.operators.keys import first_by, top
from mishear.operators.variants import carriers, fuzzy_mutations

ENGLISH, CROSS, NUMBER, SAME, SINGLE = "english_word_acronym", "cross_language_transliteration", "number_reading_mixed", "zh_same_pinyin", "zh_single_syllable"
#: How many variants a term gets of a category.
LIMITS = {ENGLISH: 4, CROSS: 4, NUMBER: 3}
#: What a speaker is told; {0} is the syllable's number, {1} and {2} what changes into what.
WEAKER = "Keep the text; say syllable {0} short and light, run into its neighbours."
TOLD = {
    "initial_change": ("initial_transition", "Keep the text; blur the initial of syllable {0} between {1} and {2}, keep its final."),
    "final_change": ("final_transition", "Keep the text; blur the final of syllable {0} between {1} and {2}, keep its initial."),
    "syllable_insertion": ("syllable_boundary_reduction", "Keep the text; run quickly through syllable {0}, add no word."),
    "syllable_deletion": ("syllable_boundary_reduction", "Keep the text; run quickly through syllable {0}, leave none out."),
    "syllable_substitution": ("syllable_transition", "Keep the text; say syllable {0} loosely, from {1} a little towards {2}."),
}
CONNECTED, NATURAL = "Run the words together, add nothing.", "Read words as words, not letter by letter."
SWITCHING, ACCENTED = "Read each language as its own, without a pause between.", "Keep the text; read English with a Chinese accent."


def candidates(x: Column) -> dict[str, list[tuple[str, Column, str | None]]]:
    """By category the kinds of reading, their text and instruction, in order."""
    number = lambda reading: t.acronyms_spelled(t.digit_runs_read(x, reading))
    return {
        ENGLISH: [
            ("camelcase_word_split", t.camel_split(x), None),
            ("letter_spelling", t.short_lead_spelled(t.camel_split(x)), None),
            ("connected_word_boundary", F.regexp_replace(x, r"[\s_-]+", ""), CONNECTED),
            ("english_natural_reading", x, NATURAL),
        ],
        CROSS: [
            ("script_boundary_split", t.script_split(x), None),
            ("letter_spelling", t.short_lead_spelled(t.script_split(x)), None),
            ("english_natural_reading", x, SWITCHING),
            ("chinese_accented_english", x, ACCENTED),
        ],
        NUMBER: [
            ("number_chinese_digits", number(t.digits_read), None),
            ("number_chinese_yao", number(lambda d: t.digits_read(d, "幺")), None),
            ("number_chinese_cardinal", number(t.cardinal), None),
        ],
    }


def _filled(template: Column, *values: Column) -> Column:
    for i, v in enumerate(values):
        template = F.replace(template, F.lit(f"{{{i}}}"), F.coalesce(v, F.lit("nothing")))
    return template


def gt_directed(entries: DataFrame, pairs: DataFrame, categories: tuple[str, ...] = classify.PREPROCESSED) -> DataFrame:
    """(sample_id, canonical, category, variant_kind, tts_text, instruction, targets, variant_id) of classified pairs.

    ``entries`` has sample_id and canonical; ``pairs`` sample_id, seq, confusion, category and the readings source and
    target (tone-numbered syllables, null if unknown). A text that spells out a known confusion goes.
    """
    chosen = pairs.where(F.col("category").isin(list(categories)))
    own = chosen.where(F.col("category").isin(list(LIMITS)))
    targets = own.groupBy("sample_id", "category").agg(F.array_sort(F.collect_list(F.struct("seq", "confusion")))["confusion"].alias("targets"))
    terms = targets.join(entries.select("sample_id", "canonical"), "sample_id")
    kinds = candidates(F.col("canonical"))
    none = F.lit(None).cast("string")
    struct = lambda k, x, told: F.struct(F.lit(k).alias("variant_kind"), F.btrim(F.regexp_replace(x, f"{t.SPACE}+", " ")).alias("tts_text"), (none if told is None else F.lit(told)).alias("instruction"))
    made = F.coalesce(*(F.when(F.col("category") == c, F.array(*(struct(*k) for k in ks))) for c, ks in kinds.items()))
    rows = terms.select("*", F.posexplode(made).alias("no", "v")).select("sample_id", "canonical", "category", "targets", "no", "v.*").where("tts_text <> ''")
    rows = rows.withColumns({"_k": t.normalized(F.col("tts_text")), "_told": F.coalesce("instruction", F.lit(""))})
    leaks = own.select("sample_id", "category", t.normalized(F.col("confusion")).alias("_k"))
    rows = first_by(rows.join(leaks, ["sample_id", "category", "_k"], "left_anti"), ["sample_id", "category", "_k", "_told"], "no")
    limit = F.coalesce(*(F.when(F.col("category") == c, F.lit(n)) for c, n in LIMITS.items()))
    readings = top(rows, ["sample_id", "category"], max(LIMITS.values()), "no").where(F.col("rank") <= limit).drop("_k", "_told", "no", "rank")
    out = readings.unionByName(_single(entries, chosen.where(F.col("category") == SINGLE)))
    parts = [t.json_text(F.col(c)) for c in ("canonical", "category", "variant_kind", "tts_text")]
    return out.withColumn("variant_id", t.json_id(*parts, t.json_list(F.transform("targets", t.json_text))))


def _single(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two instructions for each pair one syllable apart."""
    found = syllables.deltas(pairs.where("source IS NOT NULL AND target IS NOT NULL")).join(entries.select("sample_id", "canonical"), "sample_id")
    part = lambda side: (
        F.when(F.col("type") == "initial_change", F.coalesce(F.nullif(f"{side}_initial", F.lit("")), F.lit("none")))
        .when(F.col("type") == "final_change", F.col(f"{side}_final"))
        .otherwise(F.col(f"{side}_syllable"))
    )
    number = (F.col("index") + 1).cast("string")
    kind, told = (F.coalesce(*(F.when(F.col("type") == k, F.lit(v[i])) for k, v in TOLD.items())) for i in (0, 1))
    both = F.array(
        F.struct(F.lit("changed_syllable_weakening").alias("variant_kind"), _filled(F.lit(WEAKER), number).alias("instruction")),
        F.struct(kind.alias("variant_kind"), _filled(told, number, part("source"), part("target")).alias("instruction")),
    )
    return found.select("sample_id", "canonical", "category", F.array("confusion").alias("targets"), F.inline(both), F.col("canonical").alias("tts_text"))


def with_homophones(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Canonical rows with the confusions that sound the same, where there are any."""
    same = pairs.where(F.col("category") == SAME).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("seq", "confusion")))["confusion"].alias("target_confusions"))
    out = rows.join(same, "sample_id", "left")
    has = F.col("target_confusions").isNotNull()
    return out.withColumns({"confusion_category": F.when(has, SAME), "variant_kind": F.when(has, "canonical_homophone_baseline")})


# fuzzy readings


def observed_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(type, source, target) of rules that a pair of readings of one length shows: one syllable differs, tone included, in that part alone."""
    a, b = F.col("source"), F.col("target")
    differ = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(a, i) != F.get(b, i))
    one = pairs.where((F.size(a) == F.size(b)) & (F.size(a) > 0)).withColumn("_d", differ).where(F.size("_d") == 1)
    i = F.get("_d", F.lit(0))
    p, q = t.pinyin_parts(F.get(a, i)), t.pinyin_parts(F.get(b, i))
    part = lambda kind, other: F.when(p[other] == q[other], F.struct(F.lit(kind).alias("type"), p[kind].alias("source"), q[kind].alias("target")))
    shown = one.select(F.explode(F.array_compact(F.array(part("initial", "final"), part("final", "initial")))).alias("r")).select("r.*").distinct()
    return rules.select("type", "source", "target").distinct().join(shown, ["type", "source", "target"], "left_semi")


def fuzzy_variants(
    entries: DataFrame, rules: DataFrame, lexicon: DataFrame, pairs: DataFrame, most_level: int = 3, per_reading: int = 3, per_term: int = 30, derive: bool = False, target_tones: bool = False, leave_out_known: bool = False
) -> DataFrame:
    """Words that carry the readings one rule away from a term's: (term, rank, word, ...) with what was changed.

    ``entries`` has term and syllables, ``pairs`` term, confusion and the readings source and target. Mutations go by
    place and then level, type, source and target of their rule; with ``derive`` those that pairs show follow. A term
    gets at most ``per_term`` rows, in the order of mutations and carriers.
    """
    if most_level not in (1, 2, 3) or min(per_reading, per_term) < 1:
        raise ValueError("levels are 1 to 3, limits positive")
    active = rules.where(F.col("level") <= most_level)
    columns = ["term", "i", "part", "level", "type", "source", "target", "origin", "variant"]
    made = fuzzy_mutations(entries.where(F.size("syllables") > 0), active).join(active.select("type", "source", "target", "origin").distinct(), ["type", "source", "target"])
    made = made.withColumn("part", F.lit(0)).select(*columns)
    if derive:
        shown = syllables.target_mutations(pairs, target_tones=target_tones)
        origin = F.when(F.col("type").endswith("_change"), "gt_target_component_tone" if target_tones else "gt_target_component").otherwise("gt_syllable_edit")
        shown = shown.withColumns({"part": F.when(F.col("type").endswith("_change"), 1).otherwise(2), "level": F.lit(1), "origin": origin})
        made = made.unionByName(shown.withColumn("type", F.regexp_replace("type", "_change$", "")).select(*columns))
    order = Window.partitionBy("term").orderBy("part", "i", "level", "type", "source", "target")
    ranked = first_by(made.withColumn("mutation", F.row_number().over(order)), ["term", "variant"], "mutation")
    found = carriers(ranked, lexicon, per_reading)
    if leave_out_known:
        found = found.join(pairs.select("term", F.col("confusion").alias("word")).distinct(), ["term", "word"], "left_anti")
    found = top(found.withColumnRenamed("rank", "carrier_rank"), ["term"], per_term, "mutation", "carrier_rank")
    seen = observed_rules(pairs, active).withColumn("observed_in_gt", F.lit(True))
    out = found.join(seen, ["type", "source", "target"], "left").withColumn("observed_in_gt", F.coalesce("observed_in_gt", F.lit(False)))
    name = F.concat_ws("_", F.lit("fuzzy"), "type", "source", F.lit("to"), "target")
    origin = F.when(F.col("observed_in_gt"), F.concat("origin", F.lit("+gt"))).otherwise(F.col("origin"))
    return out.withColumns({"variant_kind": name, "pronunciation_rule": F.concat(F.lit("zh."), name), "origin": origin})


def fuzzy_summary(entries: DataFrame, variants: DataFrame) -> DataFrame:
    """One row of counts: terms, those without syllables, variants, terms with a carrier."""
    return entries.agg(F.count("*").alias("term_count"), F.count_if(F.coalesce(F.size("syllables"), F.lit(0)) <= 0).alias("skipped_non_chinese_count")).join(
        variants.agg(F.count("*").alias("variant_count"), F.countDistinct("term").alias("terms_with_carrier_count"))
    )


# samples


def canonical_rows(entries: DataFrame, language: str = "Auto") -> DataFrame:
    """The terms themselves as samples."""
    none = F.lit(None).cast("string")
    return entries.select(
        "sample_id", "canonical", F.col("canonical").alias("tts_text"), F.lit("canonical").alias("text_source"), F.lit(False).alias("pronunciation_processed"),
        none.alias("pronunciation_rule"), none.alias("pronunciation_variant_id"), F.lit(language).alias("language"),
    )


#: The ways to make variants; a caller gives a function of the entries for each that it uses.
MODES = ("rule_based", "gt_directed", "fuzzy_pinyin", "english_reading", "english_cmu")


def samples(entries: DataFrame, mode: str, makers: dict[str, Callable[[DataFrame], DataFrame]], canonical: bool = True, origins: list[str] | None = None, language: str = "Auto") -> DataFrame:
    """Canonical rows and the variants of a mode, if wanted only those of some origins (with or without ``+gt``).

    The rows of english_cmu hold their own baselines, so no canonical ones are added.
    """
    if mode not in MODES or mode not in makers:
        raise ValueError(f"unknown mode {mode!r}")
    made = makers[mode](entries)
    if origins is not None:
        if not [o for o in origins if o.strip()]:
            raise ValueError("no origin is named")
        made = made.where(F.col("origin").isin(origins) | F.regexp_replace("origin", r"\+gt$", "").isin(origins))
    if mode == "english_cmu" or not canonical:
        return made
    return canonical_rows(entries, language).unionByName(made, allowMissingColumns=True)
