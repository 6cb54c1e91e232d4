"""Pronunciation and reading variants: one row in, many out.

Phoneme rules are arrays of structs that are exploded; rule tables meet
syllables in equi-joins. Duplicates and caps go by the order of rules and
positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mishear.functions import text as t
from mishear.functions.arrays import replaced, without
from mishear.operators.keys import first_by, top
from mishear.operators.syllables import character_words, reading_key

# Devoicing at the end of a word, and consonants that are taken for each other.
DEVOICED = {"B": "P", "D": "T", "G": "K", "V": "F", "Z": "S", "JH": "CH", "DH": "TH"}
SWAPPED = {"B": "P", "P": "B", "D": "T", "T": "D", "R": "L", "L": "R"}
FLATTENED = {"zh": "z", "ch": "c", "sh": "s"}
NASAL = (("ing", "in"), ("eng", "en"), ("ang", "an"), ("in", "ing"), ("en", "eng"), ("an", "ang"))
VOWEL = r"\d$"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def _variant(rule: str, phones: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), phones.alias("phones"))


def english_variants(df: DataFrame, phones: str = "phones", key: str = "word") -> DataFrame:
    """Variants of phoneme arrays by single rules; equal ones and the base itself go."""
    p = F.col(phones)
    places = F.sequence(F.lit(0), F.size(p) - 1)
    vowel = lambda x: x.rlike(VOWEL)

    def at(rule: str, which, change) -> Column:
        return F.transform(F.filter(places, which), lambda i: _variant(rule, change(i)))

    last = F.element_at(p, -1)
    nuclei = F.filter(places, lambda i: vowel(F.get(p, i)))
    rules = [
        at("vowel_reduction", lambda i: F.get(p, i).rlike("0$") & (F.get(p, i) != "AH0"), lambda i: replaced(p, i, F.lit("AH0"))),
        at("h_deletion", lambda i: F.get(p, i) == "HH", lambda i: without(p, i)),
        F.when(~vowel(last) & (F.size(p) > 1), F.array(_variant("final_deletion", F.slice(p, 1, F.size(p) - 1)))),
        F.when(last.isin(list(DEVOICED)), F.array(_variant("final_devoicing", replaced(p, F.size(p) - 1, _map(DEVOICED)[last])))),
        at("substitution", lambda i: F.get(p, i).isin(list(SWAPPED)), lambda i: replaced(p, i, _map(SWAPPED)[F.get(p, i)])),
        F.when(
            F.size(nuclei) > 1,
            F.transform(
                F.filter(F.sequence(F.lit(0), F.size(nuclei) - 1), lambda k: F.get(p, F.get(nuclei, k)).rlike("0$")),
                lambda k: _variant(
                    "syllable_deletion",
                    F.filter(p, lambda _, i: (i > F.get(nuclei, k)) | (i <= F.when(k > 0, F.get(nuclei, k - 1)).otherwise(F.lit(-1)))),
                ),
            ),
        ),
    ]
    none = F.array().cast("array<struct<rule:string,phones:array<string>>>")
    every = F.concat(*(F.coalesce(r, none) for r in rules))
    rows = df.where(F.size(p) > 0).select(key, p.alias("base"), F.posexplode(every).alias("seq", "v")).select(key, "seq", "v.rule", F.col("v.phones").alias("variant"), "base")
    return first_by(rows.where("variant <> base"), [key, "variant"], "seq").drop("base")


def serialized(phones: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(phones, "]["), F.lit("]"))


def pinyin_variants(df: DataFrame, key: str = "term", syllables: str = "syllables") -> DataFrame:
    """Variants of tone-numbered syllables by single rules."""
    s = F.col(syllables)
    rows = df.select(key, s.alias("base"), F.posexplode(s).alias("i", "syllable")).withColumn("parts", t.pinyin_parts(F.col("syllable")))
    ini, fin, tone = F.col("parts.initial"), F.col("parts.final"), F.col("parts.tone")
    nasal = F.coalesce(*(F.when(fin.endswith(a), F.concat(F.regexp_replace(fin, f"{a}$", ""), F.lit(b))) for a, b in NASAL))
    weak = F.regexp_replace(fin, "ng?$", "")
    one = lambda rule, when, value: F.when(when, F.array(F.struct(F.lit(rule).alias("rule"), value.alias("to"))))
    tones = F.transform(F.filter(F.array(*map(F.lit, "1234")), lambda x: x != tone), lambda x: F.struct(F.lit("tone_substitution").alias("rule"), F.concat(ini, fin, x).alias("to")))
    rules = [
        one("n_l", ini.isin("n", "l"), F.concat(F.translate(ini, "nl", "ln"), fin, tone)),
        one("retroflex", ini.isin(list(FLATTENED)), F.concat(_map(FLATTENED)[ini], fin, tone)),
        one("nasal", nasal.isNotNull(), F.concat(ini, nasal, tone)),
        one("nasal_weakening", (weak != fin) & (weak != ""), F.concat(ini, weak, tone)),
        one("tone_neutralization", tone.isin(*"1234"), F.concat(ini, fin, F.lit("5"))),
        F.when(tone.isin(*"1234"), tones),
        one("syllable_deletion", F.size("base") > 1, F.lit(None).cast("string")),
    ]
    none = F.array().cast("array<struct<rule:string,to:string>>")
    made = rows.select(key, "base", "i", F.inline(F.concat(*(F.coalesce(r, none) for r in rules))))
    return made.select(key, "i", "rule", F.when(F.col("to").isNull(), without(F.col("base"), F.col("i"))).otherwise(replaced(F.col("base"), F.col("i"), F.col("to"))).alias("variant"))


def fuzzy_mutations(df: DataFrame, rules: DataFrame, key: str = "term", syllables: str = "syllables") -> DataFrame:
    """One syllable changed by one rule of (type, source, target, level): parts meet rules in one equi-join."""
    parts = df.select(key, F.col(syllables).alias("base"), F.posexplode(syllables).alias("i", "syllable"))
    p = t.pinyin_parts(F.col("syllable"))
    kinds = F.array(*(F.struct(F.lit(k).alias("type"), p[k].alias("source")) for k in ("initial", "final")))
    parts = parts.select("*", p.alias("p"), F.inline(kinds))
    joined = parts.join(rules, ["type", "source"])  # a rule table has some dozens of rows, which Spark sees and broadcasts
    made = F.when(F.col("type") == "initial", F.concat("target", "p.final", "p.tone")).otherwise(F.concat("p.initial", "target", "p.tone"))
    return joined.select(key, "i", "level", "type", "source", "target", replaced(F.col("base"), F.col("i"), made).alias("variant"))


def carriers(mutations: DataFrame, lexicon: DataFrame, n: int, key: str = "term") -> DataFrame:
    """The best lexicon words that are read as each mutation, tones included: one score a text, then by score and text.

    A mutation with fewer than ``n`` words also gets one put together of single characters, after the others.
    """
    group = [key, "i", "rule_id"] if "rule_id" in mutations.columns else [key, "i", "type", "source", "target"]
    m = mutations.withColumn("_r", reading_key(F.col("variant")))
    words = lexicon.withColumn("_r", reading_key(F.col("syllables"))).join(m.select("_r").distinct(), "_r", "left_semi").groupBy("_r", "word").agg(F.max("weight").alias("score"))
    built = character_words(mutations, lexicon).withColumn("_r", reading_key(F.col("variant"))).select("_r", "word", "score")
    every = words.withColumn("last", F.lit(0)).unionByName(built.withColumn("last", F.lit(1)))
    every = first_by(every, ["_r", "word"], "last")
    return top(m.join(every, "_r").where(F.col("word") != F.col(key)), group, n, "last", F.desc("score"), "word").drop("last", "_r")


def readings(df: DataFrame, term: str = "term", cap: int = 6) -> DataFrame:
    """Ways to read an English term; none depends on what it is confused with. Terms without Latin letters have none."""
    x = F.trim(F.col(term))
    split = t.camel_split(x)
    words = F.size(F.filter(F.split(split, " "), lambda w: w.rlike("^[A-Za-z]+$")))
    kinds = {
        "camel_alnum_split": split,
        "separator_collapsed": t.separators_collapsed(x),
        "all_letters_spelled": t.latin_spelled(x),
        "uppercase_runs_spelled": t.upper_runs_spelled(x),
        "camel_prefix_spelled": F.when(words > 1, t.word_spelled(split, F.lit(0))),
        "camel_suffix_spelled": F.when(words > 1, t.word_spelled(split, words - 1)),
    }
    made = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("reading")) for k, v in kinds.items()))
    key = lambda c: t.casefold(F.trim(F.regexp_replace(c, r"\s+", " ")))
    rows = df.where(x.rlike("[A-Za-z]")).select(term, F.posexplode(made).alias("seq", "v")).select(term, "seq", "v.kind", "v.reading")
    rows = rows.where(F.col("reading").isNotNull() & (F.col("reading") != "")).withColumn("_k", key(F.col("reading")))
    return top(first_by(rows.where(F.col("_k") != key(x)), [term, "_k"], "seq"), [term], cap, "seq").drop("_k")


def without_leaks(variants: DataFrame, targets: DataFrame, term: str, text: str) -> DataFrame:
    """Variants that spell out a known confusion of their term go."""
    own = targets.select(term, t.normalized(F.col("confusion")).alias("_t"))
    keyed = variants.withColumn("_t", t.normalized(F.col(text)))
    return keyed.join(own, [term, "_t"], "left_anti").drop("_t")
