"""Edits between the syllables of terms and of what they are confused with, and words that carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mishear.functions import text as t
from mishear.functions.arrays import first_gap, only_change, replaced, without
from mishear.operators.keys import first_by

#: Separates syllables in a key: no syllable has it.
MARK = " "


def _plain(x: Column) -> Column:
    return F.transform(x, t.toneless)


def _edit(a: Column, b: Column) -> Column:
    """What one edit of toneless syllables makes b of a, and where; null if none does."""
    i = only_change(_plain(a), _plain(b))
    p, q = t.pinyin_parts(F.get(a, i)), t.pinyin_parts(F.get(b, i))
    same_initial, same_final = p["initial"] == q["initial"], p["final"] == q["final"]
    kind = F.when(~same_initial & same_final, "initial_change").when(same_initial & ~same_final, "final_change").otherwise("syllable_substitution")
    gap = lambda x, y: F.when(F.size(x) == F.size(y) + 1, first_gap(_plain(x), _plain(y)))
    deleted, inserted = gap(a, b), gap(b, a)
    edit = lambda kind, i: F.struct(kind.alias("type"), i.alias("index"))
    return (
        F.when(i.isNotNull(), edit(kind, i))
        .when(deleted.isNotNull(), edit(F.lit("syllable_deletion"), deleted))
        .when(inserted.isNotNull(), edit(F.lit("syllable_insertion"), inserted))
    )


def deltas(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Pairs of readings (arrays of tone-numbered syllables) one syllable apart, with that edit."""
    a, b = F.col(source), F.col(target)
    found = pairs.withColumn("_e", _edit(a, b)).where("_e IS NOT NULL").select("*", "_e.type", "_e.index").drop("_e")
    found = found.withColumns(
        {
            "source_syllable": F.when(F.col("type") != "syllable_insertion", F.get(a, F.col("index"))),
            "target_syllable": F.when(F.col("type") != "syllable_deletion", F.get(b, F.col("index"))),
        }
    )
    parts = {f"{side}_{part}": t.pinyin_parts(F.col(f"{side}_syllable"))[part] for side in ("source", "target") for part in ("initial", "final", "tone")}
    both = F.col("source_syllable").isNotNull() & F.col("target_syllable").isNotNull()
    return found.withColumns({name: F.when(both, part) for name, part in parts.items()})


def target_mutations(pairs: DataFrame, key: str = "term", target_tones: bool = False) -> DataFrame:
    """Syllables of terms with the one edit that a known confusion shows: (key, type, source, target, i, variant).

    ``pairs`` has the key and both readings (source, target). Initials and finals change alone, the tone stays the
    term's unless ``target_tones``; whole syllables are only inserted or deleted.
    """
    d = deltas(pairs.select(key, F.col("source").alias("_a"), F.col("target").alias("_b")), "_a", "_b").where("type <> 'syllable_substitution'")
    a, b, i = F.col("_a"), F.col("_b"), F.col("index")
    initial = F.when(F.col("type") == "initial_change", F.col("target_initial")).otherwise(F.col("source_initial"))
    final = F.when(F.col("type") == "final_change", F.col("target_final")).otherwise(F.col("source_final"))
    changed = replaced(a, i, F.concat(initial, final, F.col("target_tone" if target_tones else "source_tone")))
    inserted = F.concat(F.slice(a, 1, i), F.array("target_syllable"), F.slice(a, i + 1, F.size(a)))
    moved = {"syllable_deletion": b if target_tones else without(a, i), "syllable_insertion": b if target_tones else inserted}
    variant = F.when(F.col("type").endswith("_change"), changed)
    for kind, value in moved.items():
        variant = variant.when(F.col("type") == kind, value)
    part = lambda side: (
        F.when(F.col("type") == "initial_change", F.col(f"{side}_initial")).when(F.col("type") == "final_change", F.col(f"{side}_final")).otherwise(F.coalesce(t.toneless(F.col(f"{side}_syllable")), F.lit("")))
    )
    return d.select(key, "type", part("source").alias("source"), part("target").alias("target"), i.alias("i"), variant.alias("variant")).distinct()


def reading_key(syllables: Column) -> Column:
    return F.array_join(syllables, MARK)


def character_words(wanted: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(variant, word, score) for readings put together of single characters.

    Each syllable takes its best character of that tone; a reading with a syllable that has none, or whose characters
    together are a word that is read otherwise, gives no row. The score is the least of its characters'.
    """
    need = wanted.select("variant").distinct()
    places = need.select("variant", F.posexplode("variant").alias("pos", "syllable"))
    single = lexicon.where((F.length("word") == 1) & (F.size("syllables") == 1)).select(F.get("syllables", F.lit(0)).alias("syllable"), "word", "weight")
    best = first_by(single, ["syllable"], F.desc("weight"), "word")
    built = places.join(best, "syllable").groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("c"), F.min("weight").alias("score"))
    built = built.where(F.size("c") == F.size("variant")).select("variant", F.array_join("c.word", "").alias("word"), "score")
    read = lexicon.where(F.length("word") > 1).select("word", F.col("syllables").alias("_read")).distinct()
    # a word of several readings is kept if one of them is the wanted one
    agrees = read.groupBy("word").agg(F.collect_set("_read").alias("_reads"))
    return built.join(agrees, "word", "left").where(F.col("_reads").isNull() | F.array_contains("_reads", F.col("variant"))).select("variant", "word", "score")


def resolve_phones(tokens: DataFrame, overrides: DataFrame, dictionary: DataFrame, letters: dict[str, list[str]], digits: dict[str, list[str]], token: str = "token") -> DataFrame:
    """Phones of each token and the source they are from: override, acronym, digit, dictionary or unresolved.

    ``overrides`` (token, phones) and ``dictionary`` (token, seq, phones) are matched without regard to case; the
    dictionary's first entry counts. Letters and digits are tables of fixed size.
    """
    low = F.lower(token)
    first = first_by(dictionary.withColumn("_k", F.lower("token")), ["_k"], "seq").select("_k", F.col("phones").alias("_entry"))
    own = overrides.groupBy(F.lower("token").alias("_k")).agg(F.min("phones").alias("_own"))
    table = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    spelled = F.when(F.col(token).rlike("^[A-Z]+$"), F.flatten(F.transform(F.regexp_extract_all(token, F.lit("([A-Z])"), F.lit(1)), lambda c: F.element_at(table(letters), c))))
    digit = F.when(F.col(token).rlike("^[0-9]$"), F.element_at(table(digits), F.col(token)))
    joined = tokens.withColumn("_k", low).join(own, "_k", "left").join(first, "_k", "left")
    ways = {"override": F.col("_own"), "acronym": spelled, "digit": digit, "dictionary": F.col("_entry")}
    source = F.coalesce(*(F.when(v.isNotNull(), k) for k, v in ways.items()), F.lit("unresolved"))
    return joined.withColumns({"phones": F.coalesce(*ways.values()), "source": source}).drop("_k", "_own", "_entry")
