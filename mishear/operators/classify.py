"""Classes of (canonical, confusion) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mishear.functions import text as t
from mishear.functions.arrays import edit_distance

#: All categories, in the order of reports.
CATEGORIES = (
    "normalization_alias",
    "number_reading_mixed",
    "cross_language_transliteration",
    "english_word_acronym",
    "zh_same_pinyin",
    "zh_single_syllable",
    "zh_multi_syllable_near",
    "zh_distant_semantic",
    "other_review",
)
#: Those of which variants are made.
PREPROCESSED = ("number_reading_mixed", "cross_language_transliteration", "english_word_acronym", "zh_same_pinyin", "zh_single_syllable")


def category(a: Column, b: Column, s: Column, u: Column) -> Column:
    """The first rule that holds; s and u are the readings of a and b as toneless syllables, null if unknown."""
    distance = edit_distance(s, u)
    profile = t.script_profile(a)
    english = ~profile["han"] & ~t.script_profile(b)["han"] & profile["latin"]
    han = t.all_han(a, True) & t.all_han(b, True) & s.isNotNull() & u.isNotNull()
    return (
        F.when(t.compact_key(a) == t.compact_key(b), CATEGORIES[0])
        .when(t.number_reading(a, b), CATEGORIES[1])
        .when(t.cross_language(a, b), CATEGORIES[2])
        .when(english, CATEGORIES[3])
        .when(han & (distance == 0), CATEGORIES[4])
        .when(han & (distance == 1), CATEGORIES[5])
        .when(han & (distance / F.greatest(F.size(s), F.size(u)) <= 0.75), CATEGORIES[6])
        .when(han, CATEGORIES[7])
        .otherwise(CATEGORIES[8])
    )


def classify(pairs: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """Adds ``category`` to (canonical, confusion); readings: (text, syllables)."""
    if readings is None:
        none = F.lit(None).cast("array<string>")
        return pairs.withColumn("category", category(F.col("canonical"), F.col("confusion"), none, none))
    plain = readings.select("text", F.transform("syllables", t.toneless).alias("s"))
    out = pairs.join(plain.select(F.col("text").alias("canonical"), F.col("s").alias("_s")), "canonical", "left")
    out = out.join(plain.select(F.col("text").alias("confusion"), F.col("s").alias("_u")), "confusion", "left")
    return out.withColumn("category", category(F.col("canonical"), F.col("confusion"), F.col("_s"), F.col("_u"))).drop("_s", "_u")
