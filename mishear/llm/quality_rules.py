"""Quality rules: a threshold table compiled into one Spark projection.

A word is a maximal run of characters other than ASCII space and U+0009 to
U+000D. Every statistic is a built-in expression over the row, so the operator
needs no shuffle, no user function and no state: it scales with the number of
input splits only.

Defined cases: a null or empty text has no words (all statistics 0, base rule
fails, not kept); very long texts are judged whole, with arrays of some hundred
bytes a word; repeated rows are judged one by one; an empty table gives an
empty result; other columns of the input pass through :func:`judge` untouched
unless they carry a name of the output, in which case the output wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mishear.llm._cluster import unused

#: White space, symbols and stop words.
SPACE_CLASS = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
STOP_WORDS = {
    "en": "the of and to in is that it for was with as be on by are this at from or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas sur".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
}


@dataclass(frozen=True)
class Rule:
    """A row is rejected if ``scale * metric`` lies below ``low * per`` or above ``high * per``.

    Comparisons are between integers, so that any engine gives the same verdict.
    """

    metric: str
    per: str
    low: int | None = None
    high: int | None = None
    scale: int = 100


#: The threshold table. `one` is the number 1.
BASE_RULES = (
    Rule("n_words", "one", low=50, scale=1),
    Rule("n_repeat_words", "n_words", high=50),
)
RULES = (
    Rule("word_chars", "n_words", low=200, high=1400),
    Rule("n_symbols", "n_words", high=30),
    Rule("n_shouts", "n_words", high=30),
    Rule("n_stop_words", "n_words", low=3),
    Rule("n_dup_lines", "n_lines", high=50),
)


def passes(rules: tuple[Rule, ...]) -> Column:
    """The conjunction of a threshold table as one boolean expression."""
    out = F.lit(True)
    for r in rules:
        value, per = F.lit(r.scale) * F.col(r.metric), F.lit(1) if r.per == "one" else F.col(r.per)
        if r.low is not None:
            out = out & (value >= F.lit(r.low) * per)
        if r.high is not None:
            out = out & (value <= F.lit(r.high) * per)
    return out


def _without(chars: str, text: Column, other: str = "") -> Column:
    """Chained replacements of single characters: several times as fast as translate or a pattern."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(other))
    return text


def _chars_in(chars: str, text: Column) -> Column:
    return (F.length(text) - F.length(_without(chars, text))).cast("long")


def _repeat_words(words: str, windows: str) -> Column:
    """Words in 3-word windows found twice or more.

    Windows are sorted by (hash, position); a window repeats if a neighbour in
    that order has its hash and its three words. The words covered by the
    repeating windows are then counted once each: O(n log n) in a text's words.
    """

    def same(x: Column, other: Column) -> Column:
        return (x["h"] == other["h"]) & F.forall(
            F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.get(words, x["i"] + k) == F.get(words, other["i"] + k)
        )

    repeats = F.filter(windows, lambda x, j: same(x, F.get(windows, j + 1)) | same(x, F.get(windows, j - 1)))
    covered = F.flatten(F.transform(repeats, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    # most texts have no equal hashes at all: then nothing is sorted
    return F.when(F.size(windows) > 0, F.size(F.array_distinct(covered))).otherwise(0).cast("long")


def _windows(hashes: Column) -> Column:
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")
    )


def _window_hashes(words: str) -> Column:
    n = F.size(words)
    return F.when(
        n >= 4,
        F.transform(
            F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the statistics, ``base_failed`` and ``kept`` to ``docs``."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    whole, words, lines, hashes, windows = unused(docs, "whole_text", "words", "lines", "hashes", "windows")
    x = F.col(whole)
    line = F.split(x, "\n", -1)
    has_word = f"[^{SPACE_CLASS}]"
    out = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({words: F.array_remove(F.split(_without(SPACES[1:], x, " "), " ", -1), ""), lines: F.filter(line, lambda x: x.rlike(has_word))})
    out = out.withColumn(hashes, _window_hashes(words))
    out = out.withColumn(windows, _windows(F.col(hashes)))
    stats = {
        "n_words": F.size(words).cast("long"),
        "word_chars": (F.length(x) - _chars_in(SPACES, x)).cast("long"),
        "n_symbols": _chars_in(SYMBOLS, x),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(words, windows),
        "n_lines": F.size(lines).cast("long"),
        "n_shouts": _chars_in("!", x),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stop))).cast("long"),
    }
    # a generator of one row: else a filter on the result would move below and evaluate the arrays once an element
    given = [f"`{c}`" for c in docs.columns if c.lower() not in {*stats, "base_failed", "kept"}]
    out = out.select(*given, F.inline(F.array(F.struct(*(v.alias(n) for n, v in stats.items())))))
    out = out.withColumn("base_failed", ~passes(BASE_RULES))
    return out.withColumn("kept", ~F.col("base_failed") & passes(rules))


def oracle(table: str = "documents") -> str:
    """The same in DuckDB's SQL, by grouping windows instead of sorting them."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    syms = "[#*$%&|<>]"

    def sql(rules: tuple[Rule, ...]) -> str:
        parts = []
        for r in rules:
            per = "1" if r.per == "one" else r.per
            parts += [f"{r.scale} * {r.metric} >= {r.low} * {per}"] if r.low is not None else []
            parts += [f"{r.scale} * {r.metric} <= {r.high} * {per}"] if r.high is not None else []
        return " AND ".join(parts)

    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM {table}),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT r, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM g) WHERE k > 1),
n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS p FROM d) GROUP BY r),
s AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(x) - length(regexp_replace(x, '{syms}', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n.n, 0)::BIGINT AS n_repeat_words,
        len(l)::BIGINT AS n_lines,
        (length(x) - length(replace(x, '!', '')))::BIGINT AS n_shouts,
        len(list_filter(w, lambda v: v IN ({stop})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN n ON n.r = w.r),
b AS (SELECT *, NOT ({sql(BASE_RULES)}) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND ({sql(RULES)}) AS kept FROM b"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = oracle()
