"""Pronunciations of English terms as nodes, and their variants by single rules.

A term is parsed into tokens (words, acronyms, digits) and the boundaries
between them; tokens take their phones from overrides, letter names, digit
names or a dictionary, which is an input. Rules are a table that users extend:
each names an operation of :data:`OPERATIONS`, which gives the places of a
token that it changes as expressions over its phones.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mishear.functions.arrays import replaced, without
from mishear.operators.keys import first_by, top

#: Names of letters and digits, and what a phone looks like.
LETTERS = {
    "A": "EY1", "B": "B IY1", "C": "S IY1", "D": "D IY1", "E": "IY1", "F": "EH1 F", "G": "JH IY1", "H": "EY1 CH", "I": "AY1", "J": "JH EY1", "K": "K EY1",
    "L": "EH1 L", "M": "EH1 M", "N": "EH1 N", "O": "OW1", "P": "P IY1", "Q": "K Y UW1", "R": "AA1 R", "S": "EH1 S", "T": "T IY1", "U": "Y UW1",
    "V": "V IY1", "W": "D AH1 B AH0 L Y UW0", "X": "EH1 K S", "Y": "W AY1", "Z": "Z IY1",
}
NUMBERS = {
    "0": "Z IH1 R OW0", "1": "W AH1 N", "2": "T UW1", "3": "TH R IY1", "4": "F AO1 R", "5": "F AY1 V", "6": "S IH1 K S", "7": "S EH1 V AH0 N", "8": "EY1 T", "9": "N AY1 N",
}
PHONE, VOWEL = r"^[A-Z]{1,3}[012]?$", r"^[A-Z]+[012]$"
#: The rules that come with the engine, as (id, level, operation, source, target).
RULES = (
    ("en.final_schwa_deletion", "phoneme", "final_schwa_deletion", None, None),
    ("en.final_cluster_delete_penultimate", "phoneme", "final_cluster_delete_penultimate", None, None),
    ("en.final_stop_devoicing.b_to_p", "phoneme", "final_substitution", "B", "P"),
    ("en.final_stop_devoicing.d_to_t", "phoneme", "final_substitution", "D", "T"),
    ("en.final_stop_devoicing.g_to_k", "phoneme", "final_substitution", "G", "K"),
    ("en.vowel_reduction.ae0_to_ah0", "phoneme", "substitution", "AE0", "AH0"),
    ("en.vowel_reduction.eh0_to_ah0", "phoneme", "substitution", "EH0", "AH0"),
    ("en.vowel_reduction.ih0_to_ah0", "phoneme", "substitution", "IH0", "AH0"),
    ("en.vowel_reduction.iy0_to_ih0", "phoneme", "substitution", "IY0", "IH0"),
    ("en.h_deletion", "phoneme", "initial_deletion", "HH", None),
    ("en.consonant.v_to_w", "phoneme", "substitution", "V", "W"),
    ("en.consonant.th_to_s", "phoneme", "substitution", "TH", "S"),
    ("en.consonant.th_to_t", "phoneme", "substitution", "TH", "T"),
    ("en.consonant.dh_to_d", "phoneme", "substitution", "DH", "D"),
    ("en.consonant.r_to_l", "phoneme", "substitution", "R", "L"),
    ("en.consonant.l_to_r", "phoneme", "substitution", "L", "R"),
    ("en.consonant.b_to_p", "phoneme", "substitution", "B", "P"),
    ("en.consonant.d_to_t", "phoneme", "substitution", "D", "T"),
    ("en.letter_spelling", "reading_mode", "letter_spelling", None, None),
    ("en.connected_boundary", "boundary", "connected_boundary", None, None),
)
PARTS = re.compile(r"[A-Za-z]+|\d+|\s+|.", re.S)
CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z]|$)|[A-Z]?[a-z]+|[A-Z]+")
NODE = T.StructType(
    [T.StructField(n, T.ArrayType(T.StringType()) if n in ("letters", "phones") else T.StringType()) for n in ("kind", "text", "token_type", "letters", "phones", "source", "boundary", "mode")]
)


# terms


def nodes_of(text: str) -> list[tuple]:
    """Tokens and the boundaries between them; of boundaries that meet the first counts, none is at an end."""
    out: list[tuple] = []
    held = None

    def token(word: str, kind: str) -> None:
        nonlocal held
        if out:
            out.append(("boundary", None, None, None, None, None, held or "alnum", "default"))
        out.append(("token", word, kind, list(word) if kind == "acronym" else None, None, None, None, None))
        held = None

    for part in PARTS.findall(text):
        if part.isascii() and part.isalpha():
            for k, fragment in enumerate(CAMEL.findall(part) or [part]):
                held = "camel_case" if k else held
                token(fragment, "acronym" if fragment.isupper() else "word")
        elif part.isdigit():
            for digit in part:
                token(digit, "number")
        elif out:
            held = held or ("space" if part.isspace() else "hyphen" if part == "-" else "symbol")
    return out


@F.pandas_udf(T.ArrayType(NODE))
def _parsed(x: pd.Series) -> pd.Series:
    names = NODE.fieldNames()
    return x.map(lambda v: None if v is None else [dict(zip(names, n)) for n in nodes_of(v)])


def parse(terms: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``nodes``. The parser keeps state from part to part, so it is one Arrow-batched function."""
    return terms.withColumn("nodes", _parsed(F.col(text)))


def boundary_modes(terms: DataFrame, modes: Mapping[str, str]) -> DataFrame:
    """Sets the mode of boundaries by their type."""
    if unknown := set(modes.values()) - {"default", "connected"}:
        raise ValueError(f"unsupported boundary modes {sorted(unknown)}")
    if not modes:
        return terms
    table = _table(modes)
    return terms.withColumn("nodes", F.transform("nodes", lambda n: n.withField("mode", F.coalesce(F.element_at(table, n["boundary"]), n["mode"]))))


def _table(values: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def letter_phones(word: Column) -> Column:
    """Phones of the letters' names; null if a character has none."""
    letters = F.filter(F.split(F.upper(word), ""), lambda c: c != "")
    return F.when(word.rlike("^[A-Za-z]+$"), F.flatten(F.transform(letters, lambda c: F.split(F.element_at(_table(LETTERS), c), " "))))


def overrides(table: Mapping[str, list[str]]) -> list[tuple[str, list[str]]]:
    """A checked table of (token in lower case, phones)."""
    out = {}
    for token, phones in table.items():
        own = [str(p).upper().strip() for p in phones] if isinstance(phones, (list, tuple)) else []
        if not token.strip() or not own or not all(re.match(PHONE, p) for p in own):
            raise ValueError(f"invalid phones of {token!r}: {phones!r}")
        out[token.strip().casefold()] = own
    return sorted(out.items())


def resolve(terms: DataFrame, key: str, own: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Fills the phones of tokens and adds ``unresolved``, (text, token_type, reason) of those that have none.

    ``own`` (token, phones) goes before letter and digit names and these before ``dictionary`` (token, seq, phones),
    of which the first entry of a token counts. A word outside the dictionary stays unresolved.
    """
    rows = terms.select(key, F.posexplode("nodes").alias("pos", "n"))
    token = F.lower(F.col("n.text"))
    first = first_by(dictionary.withColumn("_k", F.lower("token")), ["_k"], "seq").select("_k", F.col("phones").alias("_entry"))
    mine = own.groupBy(F.lower("token").alias("_k")).agg(F.min("phones").alias("_own"))
    joined = rows.withColumn("_k", token).join(mine, "_k", "left").join(first, "_k", "left")
    kind = F.col("n.token_type")
    ways = {
        "manual_override": F.col("_own"),
        "letter_names": F.when(kind == "acronym", letter_phones(F.col("n.text"))),
        "number_normalizer": F.when(kind == "number", F.split(F.element_at(_table(NUMBERS), F.col("n.text")), " ")),
        "dictionary": F.when(kind == "word", F.col("_entry")),
    }
    phones, source = F.coalesce(*ways.values()), F.coalesce(*(F.when(v.isNotNull(), F.lit(k)) for k, v in ways.items()))
    is_token = F.col("n.kind") == "token"
    reason = F.when(kind == "number", "unsupported_number").when(kind == "acronym", "unsupported_acronym_letter").otherwise("g2p_failed")
    missing = F.when(is_token & phones.isNull(), F.struct(F.col("n.text").alias("text"), kind.alias("token_type"), reason.alias("reason")))
    filled = F.col("n").withField("phones", phones).withField("source", source)
    made = joined.select(key, F.struct("pos", filled.alias("n")).alias("p"), F.struct("pos", missing.alias("m")).alias("m"))
    lists = made.groupBy(key).agg(F.array_sort(F.collect_list("p"))["n"].alias("nodes"), F.filter(F.array_sort(F.collect_list("m")), lambda x: x["m"].isNotNull())["m"].alias("unresolved"))
    none = F.array(F.struct(F.lit("").alias("text"), F.lit("none").alias("token_type"), F.lit("no_supported_english_tokens").alias("reason")))
    out = terms.drop("nodes").join(lists, key, "left")
    return out.withColumn("unresolved", F.when(F.col("nodes").isNull(), none).otherwise(F.col("unresolved")))


def audited(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms that are ready, and those that are not."""
    ready = F.size("unresolved") == 0
    return resolved.where(ready), resolved.where(~ready)


def serialized(nodes: Column) -> Column:
    """``[P][H]`` for each token; a default boundary is a space, a connected one nothing. Anything else fails."""
    start = F.struct(F.lit("").alias("out"), F.lit(" ").alias("gap"), F.lit(False).alias("some"))

    def step(a: Column, n: Column) -> Column:
        gap = F.when(n["mode"] == "connected", F.lit("")).when(n["mode"] == "default", F.lit(" ")).otherwise(F.raise_error(F.concat(F.lit("boundary mode "), F.coalesce(n["mode"], F.lit("none")))).cast("string"))
        bad = n["phones"].isNull() | (F.size(n["phones"]) == 0) | F.exists(n["phones"], lambda p: ~F.upper(p).rlike(PHONE))
        own = F.when(bad, F.raise_error(F.lit("a token has no ARPAbet phones")).cast("string")).otherwise(F.concat(F.lit("["), F.upper(F.array_join(n["phones"], "][")), F.lit("]")))
        at_token = F.struct(F.concat(a["out"], F.when(a["some"], a["gap"]).otherwise(F.lit("")), own).alias("out"), F.lit(" ").alias("gap"), F.lit(True).alias("some"))
        return F.when(n["kind"] == "boundary", F.struct(a["out"].alias("out"), gap.alias("gap"), a["some"].alias("some"))).otherwise(at_token)

    return F.when(F.exists(nodes, lambda n: n["kind"] == "token"), F.aggregate(nodes, start, step, lambda a: a["out"]))


# variants


CHANGE = "struct<i:int,phones:array<string>,source:string>"


def _places(p: Column) -> Column:
    return F.sequence(F.lit(0), F.size(p) - 1)


def _one(when: Column, i: Column, phones: Column) -> Column:
    return F.when(when, F.array(F.struct(i.cast("int").alias("i"), phones.alias("phones"), F.lit(None).cast("string").alias("source"))))


def _vowel(x: Column) -> Column:
    return x.rlike(VOWEL)


#: Operation: the changes of a token (phones, text, type) by a rule, an array of (place, phones, source).
OPERATIONS = {
    "final_schwa_deletion": lambda p, n, r: _one((F.element_at(p, -1) == "AH0") & F.exists(F.slice(p, 1, F.size(p) - 1), _vowel), F.size(p) - 1, F.slice(p, 1, F.size(p) - 1)),
    "final_cluster_delete_penultimate": lambda p, n, r: _one((F.size(p) >= 3) & ~_vowel(F.element_at(p, -1)) & ~_vowel(F.get(p, F.size(p) - 2)), F.size(p) - 2, without(p, F.size(p) - 2)),
    "final_substitution": lambda p, n, r: _one(F.element_at(p, -1) == r["source"], F.size(p) - 1, replaced(p, F.size(p) - 1, F.lit(r["target"]))),
    "substitution": lambda p, n, r: F.transform(F.filter(_places(p), lambda i: F.get(p, i) == r["source"]), lambda i: F.struct(i.cast("int").alias("i"), replaced(p, i, F.lit(r["target"])).alias("phones"), F.lit(None).cast("string").alias("source"))),
    "initial_deletion": lambda p, n, r: _one((F.get(p, F.lit(0)) == r["source"]) & (F.size(p) > 1), F.lit(0), F.slice(p, 2, F.size(p))),
    "letter_spelling": lambda p, n, r: F.when((n["token_type"] == "word") & letter_phones(n["text"]).isNotNull(), F.array(F.struct(F.lit(-1).alias("i"), letter_phones(n["text"]).alias("phones"), F.lit("letter_names").alias("source")))),
}
BOUNDARY_OPERATIONS = ("connected_boundary",)


def rules(table: Iterable[Mapping | tuple] = RULES) -> list[dict]:
    """A checked rule table: ids are given and differ, operations are known."""
    names = ("rule_id", "level", "operation", "source", "target")
    out = [dict(zip(names, r)) if isinstance(r, tuple) else {n: r.get(n) for n in names} for r in table]
    ids = [r["rule_id"] for r in out]
    if not out or len(set(ids)) < len(ids) or not all(ids):
        raise ValueError("a rule table needs rules with ids that differ")
    for r in out:
        if r["operation"] not in OPERATIONS and r["operation"] not in BOUNDARY_OPERATIONS:
            raise ValueError(f"unknown operation {r['operation']!r}")
    return out


def read_rules(path: str) -> list[dict]:
    """A JSON array of rules on the driver."""
    with open(path, encoding="utf-8") as f:
        payload = json.load(f)
    if not isinstance(payload, list):
        raise ValueError("a rule table is a JSON array")
    return rules(payload)


def chosen(table: list[dict], wanted: Iterable[str] | None) -> list[dict]:
    """The rules that are wanted; one that is not known fails."""
    if wanted is None:
        return table
    if unknown := set(wanted) - {r["rule_id"] for r in table}:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    return [r for r in table if r["rule_id"] in set(wanted)]


def variants(ready: DataFrame, key: str, table: list[dict] | None = None, boundaries: bool = False, cap: int = 32) -> DataFrame:
    """(key, number, rule, node, place, nodes, phoneme_text): the term as it is, then each rule at each place, equal ones once."""
    table = [r for r in (rules() if table is None else table) if boundaries or r["level"] != "boundary"]
    base = ready.select(key, "nodes")
    rows = base.select(key, "nodes", F.posexplode("nodes").alias("node", "n"))
    changes = []
    p, n = F.col("n.phones"), F.col("n")
    for k, r in enumerate(table):
        if r["operation"] in BOUNDARY_OPERATIONS:
            made = F.when(F.col("n.kind") == "boundary", F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("array<string>").alias("phones"), F.lit("connected").alias("source"))))
        else:
            made = F.when((F.col("n.kind") == "token") & (F.size(p) > 0), OPERATIONS[r["operation"]](p, n, r))
        made = F.coalesce(made.cast(f"array<{CHANGE}>"), F.array().cast(f"array<{CHANGE}>"))
        changes.append(_named(made, k, r["rule_id"]))
    if changes:
        each = rows.select(key, "nodes", "node", "n", F.inline(F.concat(*changes)))
        new = F.when(F.col("n.kind") == "boundary", n.withField("mode", F.col("c.source"))).otherwise(n.withField("phones", F.col("c.phones")).withField("source", F.coalesce("c.source", "n.source")))
        each = each.withColumn("nodes", F.transform("nodes", lambda x, i: F.when(i == F.col("node"), new).otherwise(x)))
        each = each.select(key, "k", "rule", "node", F.col("c.i").alias("place"), "nodes")
        first = base.select(key, F.lit(-1).alias("k"), F.lit("baseline").alias("rule"), F.lit(-1).alias("node"), F.lit(-1).alias("place"), "nodes")
        each = first.unionByName(each)
    else:
        each = base.select(key, F.lit(-1).alias("k"), F.lit("baseline").alias("rule"), F.lit(-1).alias("node"), F.lit(-1).alias("place"), "nodes")
    each = first_by(each.withColumn("_s", F.to_json("nodes")), [key, "_s"], "k", "node", "place").drop("_s")
    return top(each, [key], cap, "k", "node", "place", rank="number").withColumn("phoneme_text", serialized(F.col("nodes"))).drop("k")


def _named(changes: Column, k: int, rule: str) -> Column:
    return F.transform(changes, lambda c: F.struct(F.lit(k).alias("k"), F.lit(rule).alias("rule"), c.alias("c")))


def samples(entries: DataFrame, own: DataFrame, dictionary: DataFrame, table: list[dict] | None = None, text_baseline: bool = False, **settings) -> tuple[DataFrame, DataFrame]:
    """Sample rows of entries (sample_id, canonical), and the audit of those with unresolved tokens."""
    modes = settings.pop("boundary_modes", {})
    ready, open_ = audited(resolve(boundary_modes(parse(entries, "canonical"), modes), "sample_id", own, dictionary))
    made = variants(ready, "sample_id", table, **settings)
    base = F.col("rule") == "baseline"
    rows = made.join(entries, "sample_id").select(
        "sample_id", "canonical", F.when(~base, F.col("rule")).alias("pronunciation_rule"), F.col("rule").alias("variant_kind"), F.when(base, "canonical_cmu").otherwise("english_cmu_variant").alias("text_source"),
        F.lit("phoneme").alias("input_mode"), "number", "phoneme_text", F.to_json("nodes").alias("pronunciation_structure"),
    )
    if text_baseline:
        none = F.lit(None).cast("string")
        plain = ready.select(
            "sample_id", "canonical", none.alias("pronunciation_rule"), F.lit("text_baseline").alias("variant_kind"), F.lit("canonical_text").alias("text_source"),
            F.lit("text").alias("input_mode"), F.lit(0).alias("number"), none.alias("phoneme_text"), F.to_json("nodes").alias("pronunciation_structure"),
        )
        rows = plain.unionByName(rows)
    return rows, open_.select("sample_id", "canonical", "unresolved")


def summary(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """One row: terms, resolved and not, baselines and variants."""
    made = rows.agg(F.countDistinct("sample_id").alias("resolved_term_count"), F.count_if(F.col("variant_kind") == "baseline").alias("baseline_count"), F.count("*").alias("variant_count"))
    return made.join(open_.agg(F.count("*").alias("unresolved_term_count"))).withColumn("term_count", F.col("resolved_term_count") + F.col("unresolved_term_count"))
