"""Rule-based variants of whole terms: tokens with phones and the boundaries between them.

A term is (key, tokens, boundaries, text): tokens are structs of a text and its
phones. Rules are applied singly, and in pairs if asked for; a variant that
equals its base or an earlier one goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mishear.functions import text as t
from mishear.functions.arrays import replaced, without
from mishear.operators.cmu import letter_phones
from mishear.operators.keys import first_by
from mishear.operators.variants import DEVOICED, SWAPPED, _map, pinyin_variants

#: The English rules in order, and whether a variant can be rendered from its text alone.
ENGLISH = {
    "en.unstressed_vowel_reduction": "phoneme_required",
    "en.h_deletion": "text_approximation",
    "en.final_consonant_deletion": "phoneme_required",
    "en.final_stop_devoicing": "text_approximation",
    "en.consonant_substitution": "phoneme_required",
    "en.connected_boundary": "text_approximation",
    "en.letter_spelling": "text_approximation",
    "en.unstressed_syllable_deletion": "phoneme_required",
}
#: Fixed value: the name of two rules in a row.
COMPOSED = "composed.2"
TOKENS = "array<struct<text:string,phones:array<string>>>"
VOWEL, TONED = r"^[A-Z]+[012]$", r"^[a-zü]+[1-5]$"


# bases


def english_base(terms: DataFrame, dictionary: DataFrame, key: str = "term") -> tuple[DataFrame, DataFrame]:
    """(key, tokens, boundaries, text) of English terms, and (key, word) of words that have no phones.

    ``terms`` has the key, text, hints (words to use instead of the text's) and given (tokens with phones, which go
    first). Of ``dictionary`` (word, seq, phones) the first entry counts; capitals that it lacks are spelled.
    """
    given = terms.where("given IS NOT NULL").select(key, F.col("given").cast(TOKENS).alias("tokens"), "text")
    rest = terms.where("given IS NULL").select(key, "text", F.posexplode_outer(F.coalesce("hints", t.english_words(F.col("text")))).alias("pos", "word"))
    entries = first_by(dictionary.withColumn("_k", F.lower("word")), ["_k"], "seq").select("_k", F.col("phones").alias("_entry"))
    joined = rest.withColumn("_k", F.lower("word")).join(entries, "_k", "left")
    phones = F.coalesce("_entry", F.when(F.col("word").rlike("^[A-Z]+$"), letter_phones(F.col("word"))))
    joined = joined.withColumn("phones", phones)
    token = F.struct("pos", F.struct(F.col("word").alias("text"), "phones").alias("token"))
    lists = joined.groupBy(key, "text").agg(F.array_sort(F.collect_list(token))["token"].alias("tokens"), F.count_if(F.col("phones").isNull()).alias("missing"))
    known = given.unionByName(lists.where("missing = 0").select(key, "tokens", "text"))
    base = known.select(key, F.col("tokens").cast(TOKENS).alias("tokens"), F.array_repeat(F.lit("word"), F.size("tokens") - 1).alias("boundaries"), "text")
    return base, joined.where("phones IS NULL").select(key, "word")


def chinese_base(terms: DataFrame, readings: DataFrame, key: str = "term") -> tuple[DataFrame, DataFrame]:
    """(key, syllables, text) of Chinese terms, and (key, reason) of those without one reading.

    ``terms`` has the key, text and syllables (null if not given); ``readings`` (ch, syllable) has all of a character.
    """
    han = F.filter(F.split("text", ""), lambda c: t.all_han(c))
    given = terms.where("syllables IS NOT NULL").select(key, "text", F.transform("syllables", t.normal_tone).alias("syllables"), F.size(han).alias("n"))
    chars = terms.where("syllables IS NULL").select(key, "text", F.posexplode_outer(han).alias("pos", "ch"))
    own = readings.groupBy("ch").agg(F.array_sort(F.collect_set(t.normal_tone(F.col("syllable")))).alias("all"))
    read = chars.join(own, "ch", "left").groupBy(key, "text").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.get("all", F.lit(0)).alias("s"))))["s"].alias("syllables"), F.count("ch").alias("n"), F.count_if(F.size("all") > 1).alias("several")
    )
    every = given.withColumn("several", F.lit(0).cast("long")).unionByName(read.withColumn("n", F.col("n").cast("int")))
    reason = (
        F.when(F.col("n") == 0, "no Chinese characters")
        .when(F.col("several") > 0, "ambiguous pronunciation")
        .when(F.size("syllables") != F.col("n"), "syllables do not match the characters")
        .when(F.exists("syllables", lambda s: s.isNull() | ~s.rlike(TONED)), "invalid or unknown syllable")
    )
    judged = every.withColumn("reason", reason)
    return judged.where("reason IS NULL").select(key, "syllables", "text"), judged.where("reason IS NOT NULL").select(key, "reason")


# one rule


def _change(j: Column, phones: Column, word: Column | None = None) -> Column:
    return F.struct(j.cast("int").alias("j"), phones.alias("phones"), (F.lit(None).cast("string") if word is None else word).alias("word"))


def _token_rules(p: Column, word: Column) -> dict[str, Column]:
    """Changes of a token by rule; a word that is given takes its place in the display."""
    places = F.sequence(F.lit(0), F.size(p) - 1)
    vowel = lambda x: x.rlike(VOWEL)
    last, end = F.element_at(p, -1), F.size(p) - 1
    nuclei = F.filter(places, lambda i: vowel(F.get(p, i)))
    start = lambda k: F.when(k > 0, F.get(nuclei, k - 1) + 1).otherwise(F.lit(0))
    trimmed = F.regexp_replace(word, "^[hH]", "")
    devoiced = F.when(last == "B", F.regexp_replace(word, "[bB]$", "p")).otherwise(word)
    letters = F.regexp_replace(word, r"[^\p{L}]", "")
    spelled = letter_phones(letters)
    return {
        "en.unstressed_vowel_reduction": F.transform(F.filter(places, lambda i: F.get(p, i).rlike("0$") & vowel(F.get(p, i)) & (F.get(p, i) != "AH0")), lambda i: _change(i, replaced(p, i, F.lit("AH0")))),
        "en.h_deletion": F.transform(F.filter(places, lambda i: F.get(p, i) == "HH"), lambda i: _change(i, without(p, i), trimmed)),
        "en.final_consonant_deletion": F.when(~vowel(last) & (F.size(p) > 1), F.array(_change(end, F.slice(p, 1, F.size(p) - 1)))),
        "en.final_stop_devoicing": F.when(last.isin(list(DEVOICED)), F.array(_change(end, replaced(p, end, _map(DEVOICED)[last]), devoiced))),
        "en.consonant_substitution": F.transform(F.filter(places, lambda i: F.get(p, i).isin(list(SWAPPED))), lambda i: _change(i, replaced(p, i, _map(SWAPPED)[F.get(p, i)]))),
        "en.letter_spelling": F.when(spelled.isNotNull(), F.array(_change(F.lit(0), spelled, F.regexp_replace(F.upper(letters), "(.)(?=.)", "$1 ")))),
        "en.unstressed_syllable_deletion": F.when(
            F.size(nuclei) > 1,
            F.transform(
                F.filter(F.sequence(F.lit(0), F.size(nuclei) - 1), lambda k: F.get(p, F.get(nuclei, k)).rlike("0$")),
                lambda k: _change(start(k), F.filter(p, lambda _, i: (i > F.get(nuclei, k)) | (i < start(k)))),
            ),
        ),
    }


def english_rules(df: DataFrame, key: str) -> DataFrame:
    """(key, rule, no, i, j, tokens, boundaries, text, display): each rule at each place."""
    order = {r: k for k, r in enumerate(ENGLISH)}
    rows = df.select(key, "tokens", "boundaries", "text", F.posexplode("tokens").alias("i", "tok"))
    p, word = F.col("tok.phones"), F.col("tok.text")
    kind = "array<struct<j:int,phones:array<string>,word:string>>"

    def of(rule: str, changes: Column) -> Column:
        some = F.coalesce(changes.cast(kind), F.array().cast(kind))
        return F.transform(some, lambda x: F.struct(F.lit(rule).alias("rule"), F.lit(order[rule]).alias("no"), x.alias("x")))

    named = [of(r, c) for r, c in _token_rules(p, word).items()]
    made = rows.where(F.size(p) > 0).select(key, "tokens", "boundaries", "text", "i", "tok", F.inline(F.concat(*named))).where(F.size("x.phones") > 0)
    words = F.transform("tokens", lambda w, k: F.when(k == F.col("i"), F.coalesce("x.word", w["text"])).otherwise(w["text"]))
    changed = F.transform("tokens", lambda w, k: F.when(k == F.col("i"), F.struct(w["text"].alias("text"), F.col("x.phones").alias("phones"))).otherwise(w)).cast(TOKENS)
    shown = F.when(F.col("x.word").isNull(), F.col("text")).otherwise(F.array_join(words, " "))
    tokens = made.select(key, "rule", "no", "i", F.col("x.j").alias("j"), changed.alias("tokens"), "boundaries", "text", shown.alias("display"))
    at = df.select(key, "tokens", "boundaries", "text", F.posexplode("boundaries").alias("i", "b")).where("b = 'word'")
    joined = F.transform("boundaries", lambda b, k: F.when(k == F.col("i"), F.lit("connected")).otherwise(b))
    connected = at.select(
        key, F.lit("en.connected_boundary").alias("rule"), F.lit(order["en.connected_boundary"]).alias("no"), "i", F.lit(0).alias("j"),
        F.col("tokens").cast(TOKENS).alias("tokens"), joined.alias("boundaries"), "text", F.array_join(F.transform("tokens", lambda w: w["text"]), "").alias("display"),
    )
    return tokens.unionByName(connected)


#: The Chinese rules in order.
CHINESE = ("n_l", "retroflex", "nasal", "nasal_weakening", "tone_substitution", "tone_neutralization", "syllable_deletion")


def chinese_rules(df: DataFrame, key: str) -> DataFrame:
    """(key, rule, no, i, j, syllables, text, display): each rule at each place."""
    made = pinyin_variants(df, key, "syllables").join(df.select(key, "text"), key)
    no = F.coalesce(*(F.when(F.col("rule") == r, F.lit(k)) for k, r in enumerate(CHINESE)))
    tone = F.when(F.col("rule") == "tone_substitution", F.substring(F.get("variant", F.col("i")), -1, 1).cast("int")).otherwise(F.lit(0))
    return made.select(key, "rule", no.alias("no"), "i", tone.alias("j"), F.col("variant").alias("syllables"), "text", F.array_join("variant", " ").alias("display"))


# all variants


def generated(base: DataFrame, apply: Callable[[DataFrame, str], DataFrame], state: list[str], key: str = "term", depth: int = 1) -> DataFrame:
    """(key, number, rule, steps, display, state...) of the variants of ``base`` by single rules, and by pairs at depth 2.

    Numbers go by the order of rules and places, those of pairs after all others.
    """
    if depth not in (1, 2):
        raise ValueError("depth is 1 or 2")
    place, form = F.array(F.lit(1), "no", "i", "j"), F.to_json(F.struct(*state))
    original = base.select(key, form.alias("_base"))
    first = apply(base, key).withColumns({"at": place, "steps": F.array("rule"), "_form": form})
    every = first.select(key, "at", "steps", "rule", "display", "_form", *state)
    if depth == 2:
        again = first.select(F.struct(key, "at", "rule", F.col("_form").alias("form")).alias("_id"), *state, "text")
        pairs = apply(again, "_id").withColumn("_form", form).where("_form <> _id.form")
        at = F.concat(F.array(F.lit(2)), "_id.at", F.array("no", "i", "j"))
        pairs = pairs.select(F.col(f"_id.{key}").alias(key), at.alias("at"), F.array("_id.rule", "rule").alias("steps"), F.lit(COMPOSED).alias("rule"), "display", "_form", *state)
        every = every.unionByName(pairs)
    every = first_by(every.join(original, key).where("_form <> _base"), [key, "_form"], "at")
    number = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return every.withColumn("number", number).select(key, "number", "rule", "steps", "display", *state)


def english_generated(base: DataFrame, key: str = "term", depth: int = 1) -> DataFrame:
    """English variants with how they can be rendered and their phones as text."""
    made = generated(base, english_rules, ["tokens", "boundaries"], key, depth)
    required = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in ENGLISH.items()), F.lit("phoneme_required"))
    return made.withColumns({"renderability": required, "phonemes": token_phones(F.col("tokens"))})


def token_phones(tokens: Column) -> Column:
    """``[P][H]`` for each token, separated by spaces."""
    return F.array_join(F.transform(tokens, lambda w: F.concat(F.lit("["), F.upper(F.array_join(w["phones"], "][")), F.lit("]"))), " ")


def rule_counts(variants: DataFrame) -> DataFrame:
    """How many variants each rule gave, over all terms."""
    return variants.groupBy("rule").agg(F.count("*").alias("n"))
