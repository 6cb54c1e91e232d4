"""Keys and readings of terms and transcripts as Column expressions.

``casefold`` is lower case with sharp s spelled out, which is what case folding
does to Latin script. All keys are of compatibility forms (NFKC): strings that
these may change, and only they, leave the JVM for one Arrow-batched function.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]"
HAN = r"\x{3400}-\x{9fff}"
#: Strings with none of these characters are their own compatibility form.
CHANGED = r"[\x{a0}\x{a8}\x{aa}\x{af}\x{b2}-\x{b5}\x{b8}-\x{ba}\x{bc}-\x{be}\x{100}-\x{10ffff}]"
#: Readings of digits, and units of places.
DIGITS, READ, YAO = "0123456789", "零一二三四五六七八九", "零幺二三四五六七八九"
UNITS = ("", "十", "百", "千", "万", "十", "百", "千")
#: Characters and words that are numerals.
HAN_NUMERALS = "零〇一二两三四五六七八九十百千万亿幺"
NUMBER_WORDS = (
    "zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million",
)
NUMERALS = rf"^(\p{{Nd}}+|[{HAN_NUMERALS}]|{'|'.join(NUMBER_WORDS)})$"


@F.pandas_udf(T.StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def compatible(x: Column) -> Column:
    """``x`` in NFKC."""
    return F.coalesce(_nfkc(F.when(x.rlike(CHANGED), x)), x)


def casefold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def normalized(x: Column) -> Column:
    """Stripped and case-folded: equality of spellings."""
    return casefold(F.regexp_replace(compatible(x), f"^{SPACE}+|{SPACE}+$", ""))


def cleaned(x: Column) -> Column:
    """Without punctuation, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(compatible(x), r"\p{P}", ""), f"{SPACE}+", " ")
    return F.btrim(bare, F.lit(" "))


def spacing_key(x: Column) -> Column:
    """Keeps the spaces between words."""
    return casefold(cleaned(x))


def compact_key(x: Column) -> Column:
    """Letters and numbers only."""
    return F.regexp_replace(normalized(x), r"[^\p{L}\p{N}]", "")


def compare(expected: Column, actual: Column) -> Column:
    """Both normal forms and whether they match exactly and compactly."""
    return F.struct(
        normalized(expected).alias("expected_normalized"),
        normalized(actual).alias("actual_normalized"),
        (normalized(expected) == normalized(actual)).alias("exact_match"),
        (compact_key(expected) == compact_key(actual)).alias("compact_match"),
    )


def unwrapped(x: Column) -> Column:
    """A transcript without the language marker that a service may put before it."""
    return F.trim(F.regexp_replace(x, r"(?i)^\s*(?:language\s*[:=]?\s*[^<\r\n]+)?<asr_text>\s*", ""))


def camel_split(x: Column) -> Column:
    """Words at case changes and between letters and digits, separated by spaces."""
    y = F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    y = F.regexp_replace(y, "([a-z])([A-Z])", "$1 $2")
    y = F.regexp_replace(y, "([A-Za-z])([0-9])", "$1 $2")
    y = F.regexp_replace(y, "([0-9])([A-Za-z])", "$1 $2")
    return F.trim(F.regexp_replace(y, r"\s+", " "))


def script_split(x: Column) -> Column:
    """:func:`camel_split`, and between Han and Latin or digits."""
    y = F.regexp_replace(x, rf"([A-Za-z0-9])([{HAN}])", "$1 $2")
    return camel_split(F.regexp_replace(y, rf"([{HAN}])([A-Za-z0-9])", "$1 $2"))


def _spaced(x: Column) -> Column:
    return F.regexp_replace(x, "(.)(?=.)", "$1 ")


def _each_run(x: Column, change) -> Column:
    """Runs of Latin letters changed by ``change(run, number of such runs before)``, the rest as it is."""
    runs = F.regexp_extract_all(x, F.lit("(?s)([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    latin = lambda r: r.rlike("^[A-Za-z]")
    before = lambda k: F.size(F.filter(F.slice(runs, 1, k), latin))
    return F.array_join(F.transform(runs, lambda r, k: F.when(latin(r), change(r, before(k))).otherwise(r)), "")


def latin_spelled(x: Column) -> Column:
    """Every Latin word letter by letter in upper case."""
    return _each_run(x, lambda r, k: _spaced(F.upper(r)))


def word_spelled(x: Column, n: Column) -> Column:
    """The Latin word number ``n``, from 0, letter by letter."""
    return _each_run(x, lambda r, k: F.when(k == n, _spaced(F.upper(r))).otherwise(r))


def acronyms_spelled(x: Column) -> Column:
    return _each_run(x, lambda r, k: F.when(r.rlike("^[A-Z]{2,}$"), _spaced(r)).otherwise(r))


def short_lead_spelled(x: Column, most: int = 4) -> Column:
    """Acronyms are spelled, and a first word of at most ``most`` letters that is not all capitals."""
    y = acronyms_spelled(x)
    short = lambda r: (F.length(r) <= most) & ~r.rlike("^[A-Z]+$")
    return _each_run(y, lambda r, k: F.when((k == 0) & short(r), _spaced(F.upper(r))).otherwise(r))


def spelled(x: Column) -> Column:
    """Letters one by one in upper case."""
    return F.trim(F.regexp_replace(F.upper(F.regexp_replace(x, "[^A-Za-z0-9]", "")), "(.)", "$1 "))


def upper_runs_spelled(x: Column) -> Column:
    """Words of capitals are spelled, others stay."""
    return acronyms_spelled(camel_split(x))


def separators_collapsed(x: Column) -> Column:
    return F.regexp_replace(x, r"[\s_\-#.]+", "")


def digits_read(x: Column, one: str = "一") -> Column:
    """Digits by their names; one: the name of 1, for the telephone reading."""
    return F.translate(x, DIGITS, READ if one == "一" else YAO)


def cardinal(x: Column) -> Column:
    """The number that a run of digits names; one of nine digits or more is read digit by digit.

    The fifth place bears the ten thousands' unit alone, so 100000 reads as its ten.
    """
    v = F.regexp_replace(x, "^0+", "")
    n = F.length(v)
    places = F.filter(F.split(v, ""), lambda c: c != "")
    unit = lambda i: F.get(F.array(*map(F.lit, UNITS)), n - i - 1)
    named = F.transform(places, lambda c, i: F.when(c == "0", c).otherwise(F.concat(F.translate(c, DIGITS, READ), unit(i))))
    whole = F.regexp_replace(F.regexp_replace(F.array_join(named, ""), "0+$", ""), "0+", READ[0])
    return F.when(v == "", READ[0]).when(n > 8, digits_read(x)).otherwise(F.regexp_replace(whole, "^一十", "十"))


def digit_runs_read(x: Column, reading) -> Column:
    """Each run of digits by ``reading``, set off by spaces."""
    runs = F.transform(F.regexp_extract_all(x, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1)), lambda r: F.when(r.rlike("^[0-9]"), reading(r)).otherwise(r))
    return F.trim(F.regexp_replace(F.array_join(runs, " "), f"{SPACE}+", " "))


def number_skeleton(x: Column) -> Column:
    """Numeral runs as #; other marks are dropped but end a run."""
    tokens = F.regexp_extract_all(normalized(x), F.lit(rf"([a-z]+|\p{{Nd}}+|[{HAN}]|.)"), F.lit(1))
    marked = F.transform(
        tokens, lambda t: F.when(t.rlike(NUMERALS), "#").when(t.rlike(r"^[\p{L}\p{N}]+$"), t).otherwise("\u0001")
    )
    joined = F.array_join(marked, "\u0002")
    return F.translate(F.regexp_replace(joined, "#(\u0002#)+", "#"), "\u0001\u0002", "")


def pinyin_parts(x: Column) -> Column:
    """Initial, final and tone of a syllable."""
    pattern = r"^(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(.*?)([1-5])?$"
    return F.struct(*(F.regexp_extract(x, pattern, i).alias(n) for i, n in enumerate(("initial", "final", "tone"), 1)))


def toneless(x: Column) -> Column:
    return F.regexp_replace(x, "[1-5]$", "")


def normal_tone(x: Column) -> Column:
    return F.replace(F.replace(F.lower(x), F.lit("u:"), F.lit("v")), F.lit("ü"), F.lit("v"))


def safe_name(x: Column, empty: str = "item") -> Column:
    name = F.btrim(F.regexp_replace(x, "[^A-Za-z0-9._-]+", "-"), F.lit(".-"))
    return F.when(name == "", empty).otherwise(name)


def stable_id(*parts: Column, length: int = 16) -> Column:
    """A prefix of the SHA-256 of parts; a null differs from an empty part."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts)), 256), 1, length)


def json_text(x: Column) -> Column:
    """A string as JSON, null as ``null``."""
    return F.coalesce(F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", "$1"), F.lit("null"))


def json_list(items: Column) -> Column:
    """An array of JSON texts as one, with a space after each comma."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def json_id(*parts: Column, length: int = 16) -> Column:
    """A prefix of the SHA-256 of a JSON list of strings and of lists of them."""
    return F.substring(F.sha2(json_list(F.array(*parts)), 256), 1, length)


def rate(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, 6))


def script_profile(x: Column) -> Column:
    """Which kinds of letters and digits occur."""
    other = F.regexp_replace(x, rf"[{HAN}A-Za-z0-9]", "")
    return F.struct(
        x.rlike(f"[{HAN}]").alias("han"), x.rlike("[A-Za-z]").alias("latin"), x.rlike("[0-9]").alias("digit"), other.rlike(r"[\p{L}\p{N}]").alias("other_alnum")
    )


def all_han(x: Column, ignore_marks: bool = False) -> Column:
    y = F.regexp_replace(x, r"[^\p{L}\p{N}]", "") if ignore_marks else x
    return y.rlike(f"^[{HAN}]+$")


def cross_language(a: Column, b: Column) -> Column:
    p, q = script_profile(a), script_profile(b)
    return (p["han"] != q["han"]) | ((p["han"] & p["latin"]) != (q["han"] & q["latin"]))


def number_reading(a: Column, b: Column) -> Column:
    s, t = number_skeleton(a), number_skeleton(b)
    return (a.rlike(r"\p{Nd}") | b.rlike(r"\p{Nd}")) & (s == t) & s.contains("#")


def language(x: Column, text: Column) -> Column:
    """english or chinese; ``auto`` goes by the text; anything else is null."""
    y = F.lower(F.trim(x))
    return (
        F.when(y.startswith("en"), "english")
        .when(y.startswith("zh") | y.isin("chinese", "mandarin"), "chinese")
        .when(y == "auto", F.when(text.rlike(f"[{HAN}]"), "chinese").otherwise("english"))
    )


def english_words(x: Column) -> Column:
    return F.regexp_extract_all(camel_split(x), F.lit(r"([A-Za-z]+('[A-Za-z]+)?)"), F.lit(1))


def instruction(preset: Column, suffix: Column) -> Column:
    return F.nullif(F.concat_ws(" ", F.nullif(preset, F.lit("")), F.nullif(suffix, F.lit(""))), F.lit(""))


def with_end_mark(x: Column, mark: str = "<|endofprompt|>") -> Column:
    return F.when(x.contains(mark), x).otherwise(F.concat(x, F.lit(mark)))


def xml_escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def voice_locale(voice: Column) -> Column:
    """The first two parts of a voice's name."""
    return F.coalesce(F.nullif(F.regexp_extract(voice, "^([^-]*-[^-]*)", 1), F.lit("")), F.lit("en-US"))


def ssml(template: Column, x: Column, voice: Column) -> Column:
    """A template with ``{text}``, ``{voice}`` and ``{locale}`` filled in, escaped; the text may hold braces."""
    out = F.replace(F.replace(template, F.lit("{voice}"), xml_escaped(voice)), F.lit("{locale}"), xml_escaped(voice_locale(voice)))
    return F.replace(out, F.lit("{text}"), xml_escaped(x))


def reply_json(x: Column) -> Column:
    """The JSON object of a reply: code fences and talk around it go, and a list is one of what to drop."""
    y = F.regexp_replace(F.regexp_replace(x, r"^\s*(?:```(?:json)?\s*)?", ""), r"\s*(?:```\s*)?$", "")
    return F.when(y.startswith("["), F.concat(F.lit('{"drop":'), y, F.lit("}"))).otherwise(json_object(y))


def json_object(x: Column) -> Column:
    """The outermost object in a reply, code fences and talk around it dropped."""
    return F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))
