"""Candidates of terms: ranking, dictionary tags and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mishear.functions.text import all_han, reply_json, spacing_key
from mishear.operators.evaluate import HEARD


def confusions(results: DataFrame) -> DataFrame:
    """Heard transcripts other than the term, by count and then first seen; the first spelling is shown."""
    own = results.where(F.col("status").isin(*HEARD) & (F.col("out_key") != F.col("term_key")) & (F.col("out_key") != ""))
    counts = own.groupBy("term_key", "out_key").agg(F.count("*").alias("n"), F.min_by("output", "seq").alias("display"), F.min("seq").alias("first_seq"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("term_key").orderBy(F.desc("n"), "first_seq")))


def term_summary(ranked: DataFrame, pairs: DataFrame, results: DataFrame) -> DataFrame:
    """Of each term with known or heard confusions: transcripts heard, what was heard, and the share of known ones among it (null if none is known)."""
    known = pairs.select("term_key", F.col("conf_key").alias("out_key")).distinct()
    heard = results.where(F.col("status").isin(*HEARD)).groupBy("term_key").agg(F.count("*").alias("successful_asr_count"))
    own = ranked.groupBy("term_key").agg(F.count("*").alias("generated_count"), F.array_sort(F.collect_list(F.struct("rank", "display", "n"))).alias("_g"))
    both = known.join(ranked.select("term_key", "out_key", F.lit(1).alias("hit")), ["term_key", "out_key"], "left")
    sizes = both.groupBy("term_key").agg(F.count("*").alias("known_count"), F.count("hit").alias("matched_count"))
    out = sizes.join(own, "term_key", "full").join(heard, "term_key", "left").fillna(0, ["known_count", "matched_count", "generated_count", "successful_asr_count"])
    said = F.array_join(F.transform(F.coalesce("_g", F.array().cast("array<struct<rank:int,display:string,n:bigint>>")), lambda g: F.format_string("%s (%d)", g["display"], g["n"])), " | ")
    return out.withColumns({"generated": said, "known_coverage": F.when(F.col("known_count") > 0, F.col("matched_count") / F.col("known_count"))}).drop("_g")


def overall(summary: DataFrame) -> DataFrame:
    known, matched = F.sum("known_count"), F.sum("matched_count")
    return summary.agg(
        F.count("*").alias("term_count"), F.sum("generated_count").alias("generated_confusion_count"), known.alias("known_confusion_count"),
        matched.alias("matched_known_confusion_count"), F.when(known > 0, matched / known).alias("known_coverage"),
    )


def with_known(ranked: DataFrame, known: DataFrame) -> DataFrame:
    """Known confusions that were not heard follow the ranked ones."""
    unheard = known.join(ranked, ["term_key", "out_key"], "left_anti").withColumns({"n": F.lit(0).cast("long"), "rank": F.lit(None).cast("int")})
    return ranked.select("term_key", "out_key", "n", "rank").unionByName(unheard.select("term_key", "out_key", "n", "rank"))


def tag(candidates: DataFrame, dictionary: DataFrame, english: DataFrame, key: str = "key") -> DataFrame:
    """HIGH if the key is in the dictionary, or is a Latin word of the English one; else LOW."""
    d = dictionary.select(F.col("key").alias("_d")).distinct()
    e = english.select(F.col("key").alias("_e")).distinct()
    joined = candidates.join(d, candidates[key] == d["_d"], "left").join(e, (candidates[key] == e["_e"]) & candidates[key].rlike("^[a-z]+$"), "left")
    return joined.withColumn("tag", F.when(F.col("_d").isNotNull() | F.col("_e").isNotNull(), "HIGH").otherwise("LOW")).drop("_d", "_e")


def frequent_characters(candidates: DataFrame, frequencies: DataFrame, least: int = 200_000, key: str = "key") -> DataFrame:
    """Han candidates of two characters or more, each of which is frequent."""
    own = candidates.where((F.length(key) >= 2) & all_han(F.col(key))).select(key).distinct()
    chars = own.select(key, F.explode(F.split(key, "")).alias("ch")).where("ch <> ''")
    return chars.join(frequencies, "ch", "left").groupBy(key).agg(F.bool_and(F.coalesce("freq", F.lit(0)) >= least).alias("frequent")).where("frequent").select(key)


def tagged(lines: DataFrame, dictionary: DataFrame, english: DataFrame, frequencies: DataFrame, least: int = 200_000) -> DataFrame:
    """Lines (line_number, canonical, candidates) with their candidates tagged, and those of one character taken out.

    Adds removed, tagged (word, frequency, dictionary_matched, character_combination_matched), output_line and removed_line.
    """
    words = lines.select("line_number", F.posexplode("candidates").alias("pos", "word")).withColumn("key", spacing_key(F.col("word")))
    keys = words.select("key").distinct()
    in_dictionary = tag(keys, dictionary, english).select("key", (F.col("tag") == "HIGH").alias("dictionary_matched"))
    combined = frequent_characters(keys, frequencies, least).withColumn("combined", F.lit(True))
    judged = words.join(in_dictionary, "key", "left").join(combined, "key", "left")
    row = F.struct(
        "pos", "word", F.when(F.col("dictionary_matched") | F.col("combined").isNotNull(), "HIGH").otherwise("LOW").alias("frequency"),
        "dictionary_matched", F.col("combined").isNotNull().alias("character_combination_matched"), (F.length("key") == 1).alias("single"),
    )
    lists = judged.groupBy("line_number").agg(F.array_sort(F.collect_list(row)).alias("all"))
    out = lines.join(lists, "line_number", "left")
    every = F.coalesce("all", F.array().cast(lists.schema["all"].dataType))
    out = out.withColumns({"removed": F.transform(F.filter(every, lambda x: x["single"]), lambda x: x["word"]), "_kept": F.filter(every, lambda x: ~x["single"])})
    kept = F.transform("_kept", lambda x: F.struct(*(x[n].alias(n) for n in ("word", "frequency", "dictionary_matched", "character_combination_matched"))))
    fields = F.flatten(F.transform("_kept", lambda x: F.array(x["word"], x["frequency"])))
    line = lambda items: F.array_join(F.concat(F.array("canonical"), items), "|")
    return out.withColumns({"tagged": kept, "output_line": line(fields), "removed_line": line(F.col("removed"))}).drop("all", "_kept")


def decide(candidates: DataFrame, drop: DataFrame, keep: DataFrame, default: str = "keep", key: str = "key") -> DataFrame:
    """A drop beats a keep, a keep beats the default."""
    d, k = drop.select(F.col(key).alias("_d")).distinct(), keep.select(F.col(key).alias("_k")).distinct()
    joined = candidates.join(d, candidates[key] == d["_d"], "left").join(k, candidates[key] == k["_k"], "left")
    return joined.withColumn("decision", F.when(F.col("_d").isNotNull(), "drop").when(F.col("_k").isNotNull(), "keep").otherwise(default)).drop("_d", "_k")


def reply_decisions(replies: DataFrame, key: str = "canonical", reply: str = "reply") -> DataFrame:
    """(key, word_key, decision, reason) that model replies name: ``{"drop": [...], "keep": [...]}`` or a list of what to drop.

    Items are words, or objects with word (or candidate, or text) and reason. A word that is dropped and kept is dropped.
    """
    parsed = F.from_json(reply_json(F.col(reply)), "drop array<string>, keep array<string>")
    rows = replies.select(key, parsed.alias("_p"))
    none = F.array().cast("array<string>")
    each = lambda d: rows.select(key, F.lit(d).alias("decision"), F.explode(F.coalesce(F.col(f"_p.{d}"), none)).alias("item"))
    items = each("drop").unionByName(each("keep"))
    is_object = F.col("item").startswith("{")
    word = F.when(is_object, F.coalesce(*(F.get_json_object("item", f"$.{n}") for n in ("word", "candidate", "text")))).otherwise(F.col("item"))
    items = items.select(key, "decision", spacing_key(word).alias("word_key"), F.when(is_object, F.coalesce(F.get_json_object("item", "$.reason"), F.lit(""))).alias("reason"))
    return items.where("word_key <> ''").groupBy(key, "word_key").agg(F.min("decision").alias("decision"), F.min_by("reason", "decision").alias("reason"))


def apply_decisions(candidates: DataFrame, decisions: DataFrame, key: str = "canonical", missing: str = "keep") -> DataFrame:
    """Candidates (key, word, ...) with the decision on each; those not named are kept, or dropped if ``missing`` says so."""
    joined = candidates.withColumn("word_key", spacing_key(F.col("word"))).join(decisions, [key, "word_key"], "left")
    return joined.withColumns({"decided": F.col("decision").isNotNull(), "decision": F.coalesce("decision", F.lit(missing))}).drop("word_key")
