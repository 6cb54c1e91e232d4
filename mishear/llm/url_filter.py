"""URL filters: host-suffix and path-prefix expressions joined to rules by hash.

Each distinct (host, path) is expanded into the expressions that could be a
rule: a host suffix at a label boundary followed by a prefix of the path. Only
the label counts and path lengths that occur among the rules are expanded, so a
URL gives at most |label counts| x |path lengths| expressions however long it
is. Expressions meet rules in an equi-join on the first 4 bytes of their
SHA-256 digest; the full digests then confirm a match, and the rule with the
longest host, then the longest path, wins (block before allow on a tie).

Defined cases: a null URL or one without ``://`` has an empty host and path and
gets the default verdict; an empty host matches nothing; a very long URL is
expanded no further than the rules are long; repeated URLs are judged alike, and
those of one host and path, if they are a large share of the rows, are looked up
by broadcast; an empty table gives an empty result; further columns are kept by
:func:`judge` unless they are named like an output, which then wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mishear.llm._cluster import lookup, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the digest that the equi-join compares, and the most rules that are broadcast.
SHORT_BYTES, BROADCAST_RULES = 4, 100_000
OUTPUTS = ("host", "path", "rule", "verdict")

#: (verdict, host, path): the rules of the query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules with their digests; of equal expressions, a block wins."""
    schema = "rule_verdict string, rule_host string, rule_path string"
    rows = spark.createDataFrame(list(rules), schema)
    full = F.sha2(F.concat("rule_host", "rule_path"), 256)
    return (
        rows.withColumn("rule_host", F.translate("rule_host", UPPER, LOWER))
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))  # block > allow
        .select(
            F.substring(full, 1, 2 * SHORT_BYTES).alias("short"),
            full.alias("full"),
            F.size(F.split("rule_host", r"\.")).alias("rule_labels"),
            F.length("rule_path").alias("rule_length"),
            F.concat("rule_host", "rule_path").alias("rule"),
            "rule_verdict",
        )
    )


def expressions(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Array of (labels, length, expression), by the label counts and path lengths of the rules."""
    parts = F.split(host, r"\.")
    made = []
    for k in labels:
        suffix = F.array_join(F.slice(parts, -k, k), ".")
        for n in lengths:
            fits = (F.size(parts) >= k) & (F.length(path) >= n) & (host != "")
            made.append(
                F.when(fits, F.struct(F.lit(k).alias("labels"), F.lit(n).alias("length"), F.concat(suffix, F.substring(path, 1, n)).alias("expr")))
            )
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def judge(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages``."""
    found, given = unused(pages, "found_verdict", "given_url")
    rows = pages.withColumn(given, F.col(url)).drop("host", "path", "rule", "verdict")
    host, path = split_url(F.col(given))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.select(*(F.col(f"`{c}`") for c in pages.columns if c.lower() not in OUTPUTS), "host", "path")
    if not rules:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    table = rule_table(spark, rules)
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    labels = sorted({len(h.split(".")) for _, h, _ in rules})
    lengths = sorted({len(p) for *_, p in rules})
    made = (
        rows.select("host", "path")
        .where(F.col("host") != "")
        .distinct()
        .select("host", "path", F.inline(expressions(F.col("host"), F.col("path"), labels, lengths)))
        .withColumn("digest", F.sha2("expr", 256))
        .withColumn("short", F.substring("digest", 1, 2 * SHORT_BYTES))
    )
    best = (
        made.join(table, "short")
        .where((F.col("digest") == F.col("full")) & (F.col("labels") == F.col("rule_labels")) & (F.col("length") == F.col("rule_length")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule") - F.col("rule_length"), "rule_length", "rule", "rule_verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias(found))
    )
    with_host = lookup(rows.where(F.col("host") != ""), best, ["host", "path"])
    without = rows.where(F.col("host") == "").withColumns({"rule": F.lit(None).cast("string"), found: F.lit(None).cast("string")})
    return with_host.unionByName(without).withColumn("verdict", F.coalesce(found, F.lit(default))).drop(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(spark, pages).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH p AS (SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path,
    (SELECT h || r.p FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) ORDER BY length(h) DESC, length(r.p) DESC LIMIT 1) AS rule,
    coalesce((SELECT verdict FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) ORDER BY length(h) DESC, length(r.p) DESC LIMIT 1), 'allow') AS verdict
FROM p"""
