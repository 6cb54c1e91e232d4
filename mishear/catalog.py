"""Every query over the common tables, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishear.functions import arrays as ar
from mishear.functions import text as t
from mishear.operators import audio, classify, cmu, directed, evaluate, manifest, pronounce, ranking, segments, services, syllables, variants
from mishear.operators.keys import first_by
from mishear.sources.glossary import lexicon, parse_terms

FLAGSHIP = "gt_hits"
QUERIES: dict = {}
SQL: dict[str, str] = {}

# SQL forms of the keys
_SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]"


def norm_sql(x: str) -> str:
    return rf"replace(lower(regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')), 'ß', 'ss')"


def spacing_sql(x: str) -> str:
    return rf"replace(lower(trim(regexp_replace(regexp_replace({x}, '\p{{P}}', '', 'g'), '{_SPACE}+', ' ', 'g'))), 'ß', 'ss')"


def compact_sql(x: str) -> str:
    return rf"regexp_replace({norm_sql(x)}, '[^\p{{L}}\p{{N}}]', '', 'g')"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else "[" + ", ".join(map(lit, v)) + "]" if isinstance(v, list) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


# keys and comparisons


@query("text_keys", f"SELECT doc_id, {norm_sql('text')} AS normalized, {spacing_sql('text')} AS spacing_key, {compact_sql('text')} AS compact_key FROM documents")
def text_keys(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", t.normalized(x).alias("normalized"), t.spacing_key(x).alias("spacing_key"), t.compact_key(x).alias("compact_key"))


@query(
    "compare_text",
    f"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, {norm_sql('before')} = {norm_sql('text')} AS exact_match, {compact_sql('before')} = {compact_sql('text')} AS compact_match FROM c WHERE before IS NOT NULL""",
)
def compare_text(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").select("conv_id", "turn", t.compatible(F.col("text")).alias("text")).withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    c = c.withColumn("c", t.compare(F.col("before"), F.col("text")))
    return c.select("conv_id", "turn", "c.exact_match", "c.compact_match")


@query("compact_match", f"WITH k AS (SELECT doc_id, {compact_sql('text')} AS k FROM documents) SELECT k.doc_id, n AS same FROM k JOIN (SELECT k, count(*) AS n FROM k GROUP BY k HAVING count(*) > 1) USING (k)")
def compact_match(spark, d):
    """Documents whose compact key others share: a count for each key's digest joins back, pairs are never listed."""
    keys = table(spark, d, "documents").select("doc_id", F.sha2(t.compact_key(F.col("text")), 256).alias("k"))
    return keys.join(keys.groupBy("k").agg(F.count("*").alias("same")).where("same > 1"), "k").select("doc_id", "same")


# glossary

_LINES = "SELECT p_partkey AS seq, p_brand || '|' || p_name || '| ' || upper(p_name) || '|' || p_type AS line FROM part"


@query(
    "gt_parse_merge",
    f"""WITH l AS ({_LINES}), f AS (SELECT seq, list_transform(string_split(line, '|'), lambda x: trim(x)) AS f FROM l),
k AS (SELECT seq, f, {spacing_sql('f[1]')} AS term_key FROM f),
p AS (SELECT term_key, seq, i, f[i] AS c, {spacing_sql('f[i]')} AS ck FROM (SELECT term_key, seq, f, unnest(range(2, len(f) + 1)) AS i FROM k)),
q AS (SELECT * FROM p WHERE ck <> '' AND ck <> term_key QUALIFY row_number() OVER (PARTITION BY term_key, ck ORDER BY seq, i) = 1),
e AS (SELECT term_key, arg_min(f[1], seq) AS canonical, min(seq) AS seq, count(*) AS n_lines FROM k GROUP BY term_key)
SELECT e.term_key, canonical, e.seq, n_lines, (SELECT string_agg(c, '|' ORDER BY q.seq, i) FROM q WHERE q.term_key = e.term_key) AS confusions FROM e""",
)
def gt_parse_merge(spark, d):
    line = F.concat(F.col("p_brand"), F.lit("|"), F.col("p_name"), F.lit("| "), F.upper("p_name"), F.lit("|"), F.col("p_type"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), line.alias("line"))
    return parse_terms(rows).select("term_key", "canonical", "seq", F.size("lines").cast("long").alias("n_lines"), F.array_join("confusions", "|").alias("confusions"))


PAIRS = [
    ("IdeaHub", "Idea Hub"), ("鹭兴", "陆星"), ("周清", "周星"), ("CloudRSE", "CloudRCE"), ("Nexent", "南盛的"), ("TR6", "TR六"), ("Box", "Pox"),
    ("陈赵", "陈照"), ("12号", "十二号"), ("志伟", "市委"), ("A-1", "a1"), ("!!", "??"),
]
_HAN = "㐀-鿿"
_WORDS = "|".join(t.NUMBER_WORDS)


def skeleton_sql(x: str) -> str:
    """Numeral runs as #, other marks dropped."""
    token = f"CASE WHEN regexp_full_match(k, '[0-9]+|[{t.HAN_NUMERALS}]|{_WORDS}') THEN '#' WHEN regexp_full_match(k, '[\\p{{L}}\\p{{N}}]+') THEN k ELSE chr(1) END"
    joined = f"array_to_string(list_transform(regexp_extract_all({norm_sql(x)}, '[a-z]+|[0-9]+|[{_HAN}]|.'), lambda k: {token}), chr(2))"
    return f"replace(replace(regexp_replace({joined}, '#(\x02#)+', '#', 'g'), chr(2), ''), chr(1), '')"


READINGS = [("鹭兴", ["lu4", "xing1"]), ("陆星", ["lu4", "xing1"]), ("周清", ["zhou1", "qing1"]), ("周星", ["zhou1", "xing1"]), ("志伟", ["zhi4", "wei3"]), ("市委", ["shi4", "wei3"])]


@query(
    "pair_classify",
    f"""WITH p(a, b) AS ({sql_values(PAIRS)}), k("text", s) AS ({sql_values(READINGS)}),
q AS (SELECT a, b, list_transform(x.s, lambda v: regexp_replace(v, '[1-5]$', '')) AS s, list_transform(y.s, lambda v: regexp_replace(v, '[1-5]$', '')) AS u, regexp_matches(a, '[{_HAN}]') AS ha, regexp_matches(b, '[{_HAN}]') AS hb, regexp_matches(a, '[A-Za-z]') AS la, regexp_matches(b, '[A-Za-z]') AS lb,
  regexp_full_match(regexp_replace(a, '[^\\p{{L}}\\p{{N}}]', '', 'g'), '[{_HAN}]+') AND regexp_full_match(regexp_replace(b, '[^\\p{{L}}\\p{{N}}]', '', 'g'), '[{_HAN}]+') AS han FROM p LEFT JOIN k x ON x.text = a LEFT JOIN k y ON y.text = b),
d AS (SELECT *, len(list_filter(range(1, len(s) + 1), lambda i: s[i] <> u[i])) AS n FROM q)
SELECT a AS canonical, b AS confusion, CASE WHEN {compact_sql('a')} = {compact_sql('b')} THEN 'normalization_alias' WHEN regexp_matches(a || b, '[0-9]') AND {skeleton_sql('a')} = {skeleton_sql('b')} AND contains({skeleton_sql('a')}, '#') THEN 'number_reading_mixed'
  WHEN ha <> hb OR (ha AND la) <> (hb AND lb) THEN 'cross_language_transliteration' WHEN NOT ha AND NOT hb AND la THEN 'english_word_acronym' WHEN han AND n = 0 THEN 'zh_same_pinyin' WHEN han AND n = 1 THEN 'zh_single_syllable'
  WHEN han AND n / greatest(len(s), len(u)) <= 0.75 THEN 'zh_multi_syllable_near' WHEN han AND n IS NOT NULL THEN 'zh_distant_semantic' ELSE 'other_review' END AS category FROM d""",
)
def pair_classify(spark, d):
    pairs = values(spark, PAIRS, "canonical string, confusion string")
    return classify.classify(pairs, values(spark, READINGS, "text string, syllables array<string>"))


@query(
    "category_counts",
    """WITH c AS (SELECT CASE WHEN value < 30 THEN 'low' WHEN value < 60 THEN 'middle' ELSE 'high' END AS category FROM events)
SELECT a.category, count(c.category) AS n FROM (VALUES ('low'), ('middle'), ('high'), ('never')) a(category) LEFT JOIN c USING (category) GROUP BY a.category""",
)
def category_counts(spark, d):
    label = F.when(F.col("value") < 30, "low").when(F.col("value") < 60, "middle").otherwise("high")
    known = values(spark, [("low",), ("middle",), ("high",), ("never",)], "category string")
    return manifest.every_category(table(spark, d, "events").select(label.alias("category")), "category", known)


# results: an order is a transcript, its customer's segment the term, its priority what was heard

_RAW = """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 13 = 0 THEN '2-HIGH' ELSE c_mktsegment END AS term, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS text,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'reused' ELSE 'error' END AS status, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(year(o_orderdate) AS VARCHAR) END AS rule,
  CASE WHEN o_orderkey % 5 = 0 THEN 'baseline' WHEN o_orderkey % 5 > 1 THEN 'kind ' || (o_orderkey % 5) END AS variant_kind, CASE WHEN o_orderkey % 3 <> 0 THEN 'c' || (c_nationkey % 4) END AS category,
  c_nationkey AS condition, o_orderkey % 3 AS repeat, o_totalprice < 20000 AS exact, o_totalprice < 50000 AS compact, CASE WHEN o_orderkey % 2 = 0 THEN 's' || (o_orderkey % 4) END AS source_set,
  CASE WHEN o_orderkey % 9 <> 1 THEN 'm' END AS source_manifest, CASE WHEN o_orderkey % 8 = 0 THEN 'slow' END AS instruction_group, CASE WHEN o_orderkey % 10 <> 3 THEN 'v' || (c_nationkey % 3) END AS voice,
  CASE WHEN o_orderkey % 6 > 2 THEN 'noise' END AS augmentation, CASE WHEN o_orderkey % 4 = 3 THEN 'phoneme' END AS input_mode, CASE WHEN o_orderkey % 17 = 0 THEN 'lexicon' END AS carrier_source
FROM orders JOIN customer ON o_custkey = c_custkey"""
_CONFUSIONS, _OTHERS = ["1-URGENT", "2-HIGH", "9-NEVER"], ["5-LOW"]
_BASE = f"""WITH raw AS ({_RAW}), r AS (SELECT *, {spacing_sql('term')} AS term_key, {compact_sql('term')} AS target_key, {spacing_sql('text')} AS out_key, {compact_sql('text')} AS cand_key, {norm_sql('text')} AS out_norm FROM raw),
g AS (SELECT DISTINCT {spacing_sql('c_mktsegment')} AS term_key, {spacing_sql('p')} AS conf_key, p AS confusion FROM customer, ({sql_values([(c,) for c in _CONFUSIONS])}) v(p)),
x AS (SELECT DISTINCT {compact_sql('w')} AS cand_key FROM (SELECT c_mktsegment AS w FROM customer UNION {sql_values([(c,) for c in _CONFUSIONS + _OTHERS])}) v(w)) """


def results(spark, d) -> DataFrame:
    k, nation = F.col("o_orderkey"), F.col("c_nationkey")
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("seq"),
        F.when(k % 13 == 0, "2-HIGH").otherwise(F.col("c_mktsegment")).alias("term"),
        F.when(k % 11 != 0, F.col("o_orderpriority")).alias("text"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "reused").otherwise("error").alias("status"),
        F.when(k % 7 != 0, F.year("o_orderdate").cast("string")).alias("rule"),
        F.when(k % 5 == 0, "baseline").when(k % 5 > 1, F.concat(F.lit("kind "), (k % 5).cast("string"))).alias("variant_kind"),
        F.when(k % 3 != 0, F.concat(F.lit("c"), (nation % 4).cast("string"))).alias("category"),
        nation.alias("condition"),
        (k % 3).alias("repeat"),
        (F.col("o_totalprice") < 20000).alias("exact"),
        (F.col("o_totalprice") < 50000).alias("compact"),
        F.when(k % 2 == 0, F.concat(F.lit("s"), (k % 4).cast("string"))).alias("source_set"),
        F.when(k % 9 != 1, "m").alias("source_manifest"),
        F.when(k % 8 == 0, "slow").alias("instruction_group"),
        F.when(k % 10 != 3, F.concat(F.lit("v"), (nation % 3).cast("string"))).alias("voice"),
        F.when(k % 6 > 2, "noise").alias("augmentation"),
        F.when(k % 4 == 3, "phoneme").alias("input_mode"),
        F.when(k % 17 == 0, "lexicon").alias("carrier_source"),
    )
    return evaluate.keyed(rows).withColumn("output", F.col("text"))


def entries(spark, d) -> DataFrame:
    """The segments as glossary entries, numbered by name."""
    segments = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("canonical")).agg(F.min("c_custkey").alias("seq"))
    return segments.select("seq", "canonical", F.array(*map(F.lit, _CONFUSIONS)).alias("confusions"))


def pairs(spark, d) -> DataFrame:
    own = entries(spark, d).select(F.col("canonical"), F.posexplode("confusions").alias("seq", "confusion"))
    return own.select(t.spacing_key(F.col("canonical")).alias("term_key"), t.spacing_key(F.col("confusion")).alias("conf_key"), "confusion", "seq")


def candidates(spark, d) -> DataFrame:
    return lexicon(entries(spark, d), values(spark, list(enumerate(_OTHERS)), "seq long, word string"))


def metrics_sql(by: str, rows: str = "r") -> str:
    """CTEs m (metrics) and k (coverage) of ``rows`` by columns."""
    ok = "status <> 'error'"
    return f"""h AS (SELECT {by}, cand_key, count(*) AS n FROM {rows} SEMI JOIN x USING (cand_key) WHERE {ok} AND text IS NOT NULL GROUP BY ALL),
c AS (SELECT {by}, count(*) AS nc, sum(n) AS nh FROM h ANTI JOIN (SELECT DISTINCT {by}, target_key AS cand_key FROM {rows}) USING ({by}, cand_key) GROUP BY ALL),
b AS (SELECT {by}, count(*) AS request_count, count(*) FILTER (NOT {ok}) AS failure_count, count(*) FILTER ({ok} AND exact) AS exact_match_count, count(*) FILTER ({ok} AND compact) AS compact_match_count,
  count(DISTINCT cand_key) FILTER ({ok}) AS distinct_transcript_count FROM {rows} GROUP BY ALL),
m AS (SELECT b.*, round(exact_match_count / request_count, 6) AS exact_match_rate, round(compact_match_count / request_count, 6) AS compact_match_rate, coalesce(nc, 0)::BIGINT AS matched_confusion_candidate_count, coalesce(nh, 0)::BIGINT AS confusion_hit_count FROM b LEFT JOIN c USING ({by})),
kn AS (SELECT {by}, sum(n) AS known FROM (SELECT DISTINCT {by}, term_key FROM {rows}) JOIN (SELECT term_key, count(*) AS n FROM g GROUP BY 1) USING (term_key) GROUP BY ALL),
f AS (SELECT {by}, term, confusion, count(*) AS n FROM {rows} JOIN g ON {rows}.term_key = g.term_key AND out_key = conf_key WHERE status = 'success' GROUP BY ALL),
ff AS (SELECT {by}, count(*) AS u, sum(n) AS e, count(DISTINCT term) AS t FROM f GROUP BY ALL),
k AS (SELECT {by}, coalesce(known, 0)::BIGINT AS known_confusion_total, coalesce(u, 0)::BIGINT AS matched_unique_confusion_count, coalesce(e, 0)::BIGINT AS matched_confusion_event_count, coalesce(t, 0)::BIGINT AS terms_with_hit_count,
  CASE WHEN coalesce(known, 0) = 0 THEN 0.0 ELSE round(coalesce(u, 0) / known, 6) END AS coverage_rate FROM (SELECT DISTINCT {by} FROM {rows}) LEFT JOIN kn USING ({by}) LEFT JOIN ff USING ({by}))"""


_GT = "known_confusion_total AS gt_known_confusion_total, matched_unique_confusion_count AS gt_matched_unique_confusion_count, matched_confusion_event_count AS gt_matched_confusion_event_count, terms_with_hit_count AS gt_terms_with_hit_count, coverage_rate AS gt_coverage_rate"


@query("gt_hits", _BASE + "SELECT term, g.term_key, conf_key, confusion, count(*) AS hits, min(seq) AS first_seq FROM r JOIN g ON r.term_key = g.term_key AND out_key = conf_key WHERE status = 'success' GROUP BY ALL")
def gt_hits(spark, d):
    return evaluate.most_common(evaluate.hits(results(spark, d), pairs(spark, d)))


@query(
    "gt_misses",
    _BASE + """, h AS (SELECT DISTINCT term_key, out_key AS conf_key FROM r WHERE status = 'success' AND text IS NOT NULL),
q AS (SELECT g.* FROM g SEMI JOIN r USING (term_key) ANTI JOIN h USING (term_key, conf_key)),
s AS (SELECT term_key, count(*) AS asr_sample_count, count(*) FILTER (status <> 'error') AS successful_asr_count, count(*) FILTER (status <> 'error' AND compact) AS canonical_output_count,
  string_agg(DISTINCT coalesce(rule, variant_kind, 'baseline'), ' | ' ORDER BY coalesce(rule, variant_kind, 'baseline')) AS rules_tried, string_agg(DISTINCT category, ' | ' ORDER BY category) AS confusion_category FROM r GROUP BY term_key),
o AS (SELECT term_key, coalesce(text, '(no transcript)') AS said, count(*) AS n, min(seq) AS f FROM r WHERE status <> 'error' GROUP BY term_key, coalesce(text, '(no transcript)') QUALIFY row_number() OVER (PARTITION BY term_key ORDER BY count(*) DESC, min(seq)) <= 8)
SELECT q.term_key, conf_key, confusion, asr_sample_count, successful_asr_count, canonical_output_count, rules_tried, confusion_category,
  (SELECT string_agg(said || ' (' || n || ')', ' | ' ORDER BY n DESC, f) FROM o WHERE o.term_key = q.term_key) AS top_asr_outputs FROM q JOIN s USING (term_key)""",
)
def gt_misses(spark, d):
    r = results(spark, d)
    return evaluate.miss_details(evaluate.misses(r, pairs(spark, d)), r).drop("seq")


@query("gt_coverage", _BASE + ", " + metrics_sql("scope", "z").replace("h AS (", "z AS (SELECT *, 'all' AS scope FROM r), h AS (", 1) + " SELECT * FROM k")
def gt_coverage(spark, d):
    return evaluate.coverage(results(spark, d).withColumn("scope", F.lit("all")), pairs(spark, d), ["scope"])


@query("asr_metrics", _BASE + ", " + metrics_sql("condition, repeat") + " SELECT * FROM m")
def asr_metrics(spark, d):
    return evaluate.metrics(results(spark, d), candidates(spark, d), ["condition", "repeat"])


@query(
    "candidate_hits",
    _BASE + """, h AS (SELECT condition, cand_key, count(*) AS hit_count FROM r SEMI JOIN x USING (cand_key) WHERE status <> 'error' AND text IS NOT NULL GROUP BY ALL), t AS (SELECT DISTINCT condition, target_key AS cand_key, true AS hit FROM r)
SELECT condition, cand_key, hit_count, coalesce(hit, false) AS is_target_alias FROM h LEFT JOIN t USING (condition, cand_key)""",
)
def candidate_hits(spark, d):
    return evaluate.candidate_hits(results(spark, d), candidates(spark, d), ["condition"]).drop("candidate", "spellings")


_DIMENSIONS = """unnest([('source_set', coalesce(source_set, source_manifest, '(none)')), ('prompt_or_voice', coalesce(instruction_group, voice, '(none)')), ('augmentation', coalesce(augmentation, '(original)')),
('confusion_category', coalesce(category, '(canonical/none)')), ('pronunciation_variant', coalesce(variant_kind, '(canonical/none)')), ('pronunciation_rule', coalesce(rule, '(baseline/none)')), ('input_mode', coalesce(input_mode, 'text')),
('carrier_source', coalesce(carrier_source, '(canonical/none)'))])"""
_GROUP = "condition, repeat, group_type, group_value"


@query(
    "group_breakdown",
    _BASE + f", u AS (SELECT *, {_DIMENSIONS} AS d FROM r), z AS (SELECT *, d[1] AS group_type, d[2] AS group_value FROM u), " + metrics_sql(_GROUP, "z") + f" SELECT m.*, {_GT} FROM m JOIN k USING ({_GROUP})",
)
def group_breakdown(spark, d):
    return evaluate.breakdown(results(spark, d), candidates(spark, d), pairs(spark, d))


@query(
    "condition_rollup",
    _BASE + ", z AS (SELECT * REPLACE (s[2] AS repeat), s[1] AS scope FROM (SELECT *, unnest([('run', repeat), ('condition', -1)]) AS s FROM r)), " + metrics_sql("scope, condition, repeat", "z")
    + f" SELECT m.* REPLACE (CASE WHEN repeat >= 0 THEN repeat END AS repeat), {_GT}, repeats FROM m JOIN k USING (scope, condition, repeat) JOIN (SELECT condition, count(DISTINCT repeat) AS repeats FROM r GROUP BY 1) USING (condition)",
)
def condition_rollup(spark, d):
    return evaluate.report(results(spark, d), candidates(spark, d), pairs(spark, d))


@query(
    "top_error_transcripts",
    _BASE + """SELECT condition, coalesce(out_norm, '(no transcript)') AS transcript, count(*) AS n, min(seq) AS first_seq, row_number() OVER (PARTITION BY condition ORDER BY count(*) DESC, min(seq)) AS rank
FROM r WHERE status <> 'error' AND NOT compact GROUP BY condition, coalesce(out_norm, '(no transcript)') QUALIFY rank <= 10""",
)
def top_error_transcripts(spark, d):
    return evaluate.top_errors(results(spark, d), ["condition"])


@query("variable_audio", _BASE + "SELECT condition, count(*) FILTER (n > 1) AS variable_audio_count FROM (SELECT condition, term, count(DISTINCT out_norm) AS n FROM r WHERE out_norm IS NOT NULL GROUP BY ALL) GROUP BY condition")
def variable_audio(spark, d):
    return evaluate.variable_count(results(spark, d), ["condition"], "term", "out_norm")


@query("variable_outputs", "SELECT l_partkey, count(DISTINCT l_returnflag) AS outputs FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1")
def variable_outputs(spark, d):
    return evaluate.variable_outputs(table(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query(
    "rule_effectiveness",
    _BASE + """, j AS (SELECT coalesce(rule, '(none)') AS rule, status <> 'error' AND text IS NOT NULL AS ok, compact, EXISTS (SELECT 1 FROM g WHERE g.term_key = r.term_key AND conf_key = out_key) AS known FROM r WHERE coalesce(variant_kind, '') <> 'baseline'),
e AS (SELECT rule, count(*) AS generated_count, count(*) FILTER (ok) AS successful_asr_count, count(*) FILTER (ok AND compact) AS canonical_event_count, count(*) FILTER (ok AND NOT compact AND known) AS gt_hit_event_count, count(*) FILTER (ok AND NOT compact AND NOT known) AS over_distorted_count FROM j GROUP BY rule)
SELECT *, CASE WHEN successful_asr_count = 0 THEN 0.0 ELSE round(gt_hit_event_count / successful_asr_count, 6) END AS gt_hit_rate, CASE WHEN successful_asr_count = 0 THEN 0.0 ELSE round(canonical_event_count / successful_asr_count, 6) END AS ineffective_rate,
  CASE WHEN successful_asr_count = 0 THEN 0.0 ELSE round(over_distorted_count / successful_asr_count, 6) END AS over_distorted_rate FROM e""",
)
def rule_effectiveness(spark, d):
    return evaluate.rule_effectiveness(results(spark, d), pairs(spark, d)).orderBy("rule")


@query(
    "outcomes",
    "SELECT event_type AS rule, count(*) AS generated, count(*) FILTER (value < 20) AS canonical, count(*) FILTER (value >= 20 AND value < 50) AS gt_hit, count(*) FILTER (value >= 50) AS over_distorted FROM events GROUP BY event_type",
)
def outcomes(spark, d):
    v = F.col("value")
    return evaluate.outcomes(table(spark, d, "events"), "event_type", {"canonical": v < 20, "gt_hit": v < 50, "over_distorted": v >= 50})


@query(
    "compare_sets",
    """WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity < 25), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity >= 25)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, count(*) FILTER (a.l_partkey IS NOT NULL AND b.l_partkey IS NOT NULL) AS matched, count(*) FILTER (b.l_partkey IS NULL) AS known_only, count(*) FILTER (a.l_partkey IS NULL) AS observed_only
FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey GROUP BY 1""",
)
def compare_sets(spark, d):
    x = table(spark, d, "lineitem")
    return evaluate.compare_sets(x.where("l_quantity < 25"), x.where("l_quantity >= 25"), "l_suppkey", "l_partkey")


@query(
    "compare_lists",
    """WITH a AS (SELECT DISTINCT l_suppkey::VARCHAR AS term_key, l_partkey AS seq FROM lineitem WHERE l_quantity < 25), b AS (SELECT DISTINCT l_suppkey::VARCHAR AS term_key, l_partkey AS seq, true AS hit FROM lineitem WHERE l_quantity >= 25)
SELECT term_key, count(*) AS total_count, count(hit) AS matched_count, count(hit) / count(*) AS hit_rate, coalesce(string_agg('p' || seq, '|' ORDER BY seq) FILTER (hit), '') AS matched, coalesce(string_agg('p' || seq, '|' ORDER BY seq) FILTER (hit IS NULL), '') AS missing FROM a LEFT JOIN b USING (term_key, seq) GROUP BY term_key""",
)
def compare_lists(spark, d):
    x = table(spark, d, "lineitem").withColumns({"term_key": F.col("l_suppkey").cast("string"), "confusion": F.concat(F.lit("p"), "l_partkey"), "conf_key": F.concat(F.lit("p"), "l_partkey"), "seq": F.col("l_partkey")})
    side = lambda when: x.where(when).select("term_key", "seq", "conf_key", "confusion").distinct()
    lists = evaluate.compare_lists(side("l_quantity < 25"), side("l_quantity >= 25"))
    return lists.withColumns({c: F.array_join(c, "|") for c in ("matched", "missing")})


@query(
    "confusion_ranking",
    _BASE + ", c AS (SELECT term_key, out_key, count(*) AS n, arg_min(text, seq) AS display, min(seq) AS first_seq FROM r WHERE status <> 'error' AND out_key <> term_key GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY term_key ORDER BY n DESC, first_seq) AS rank FROM c",
)
def confusion_ranking(spark, d):
    return ranking.confusions(results(spark, d))


@query(
    "ranking_with_known",
    _BASE + ", c AS (SELECT term_key, out_key, count(*) AS n, min(seq) AS f FROM r WHERE status <> 'error' AND out_key <> term_key GROUP BY ALL), k AS (SELECT term_key, out_key, n, row_number() OVER (PARTITION BY term_key ORDER BY n DESC, f) AS rank FROM c) SELECT * FROM k UNION ALL SELECT g.term_key, g.conf_key, 0, 0 FROM g WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.term_key = g.term_key AND k.out_key = g.conf_key)",
)
def ranking_with_known(spark, d):
    return ranking.with_known(ranking.confusions(results(spark, d)), pairs(spark, d).withColumnRenamed("conf_key", "out_key")).fillna(0, ["rank"])


_TERMS = """, c AS (SELECT term_key, out_key, count(*) AS n, arg_min(text, seq) AS display, min(seq) AS f FROM r WHERE status <> 'error' AND out_key <> term_key GROUP BY ALL), k AS (SELECT term_key, count(*) AS known_count, count(c.out_key) AS matched_count FROM g LEFT JOIN c ON c.term_key = g.term_key AND c.out_key = conf_key GROUP BY ALL),
o AS (SELECT term_key, count(*) AS generated_count, string_agg(display || ' (' || n || ')', ' | ' ORDER BY n DESC, f) AS generated FROM c GROUP BY ALL), a AS (SELECT term_key, count(*) AS successful_asr_count FROM r WHERE status <> 'error' GROUP BY ALL),
s AS (SELECT term_key, coalesce(known_count, 0) AS known_count, coalesce(matched_count, 0) AS matched_count, coalesce(generated_count, 0) AS generated_count, coalesce(successful_asr_count, 0) AS successful_asr_count, coalesce(generated, '') AS generated,
  CASE WHEN known_count > 0 THEN matched_count / known_count END AS known_coverage FROM k FULL JOIN o USING (term_key) LEFT JOIN a USING (term_key))"""


@query("term_coverage", (_BASE + _TERMS).replace("count(*) AS known_count, count(c.out_key)", "count(*) AS known_count, count(c.out_key)").replace("SELECT term_key, count(*) AS known_count", "SELECT g.term_key, count(*) AS known_count") + " SELECT * FROM s")
def term_coverage(spark, d):
    r = results(spark, d)
    return ranking.term_summary(ranking.confusions(r), pairs(spark, d), r)


@query(
    "overall_coverage",
    (_BASE + _TERMS).replace("SELECT term_key, count(*) AS known_count", "SELECT g.term_key, count(*) AS known_count")
    + " SELECT count(*) AS term_count, sum(generated_count)::BIGINT AS generated_confusion_count, sum(known_count)::BIGINT AS known_confusion_count, sum(matched_count)::BIGINT AS matched_known_confusion_count, sum(matched_count) / sum(known_count) AS known_coverage FROM s",
)
def overall_coverage(spark, d):
    r = results(spark, d)
    return ranking.overall(ranking.term_summary(ranking.confusions(r), pairs(spark, d), r))


@query(
    "candidate_lexicon",
    f"""WITH w AS (SELECT p_partkey AS seq, p_name AS word FROM part UNION ALL SELECT p_partkey + 1000000, upper(p_name) FROM part), k AS (SELECT {compact_sql('word')} AS cand_key, word, min(seq) AS f FROM w GROUP BY ALL)
SELECT cand_key, string_agg(word, '|' ORDER BY f) AS spellings FROM k GROUP BY cand_key""",
)
def candidate_lexicon(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("canonical"), F.array(F.upper("p_name")).alias("confusions"))
    return lexicon(p).withColumn("spellings", F.array_join("spellings", "|"))


_WORDS = "SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS key FROM {0}"


@query(
    "dictionary_tags",
    f"WITH c AS ({_WORDS.format('documents')}), b AS (SELECT key, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS key FROM benchmark) GROUP BY key), e AS ({_WORDS.format('conversations')}) SELECT key, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.key = c.key AND n >= 3) OR regexp_full_match(key, '[a-z]+') AND EXISTS (SELECT 1 FROM e WHERE e.key = c.key) THEN 'HIGH' ELSE 'LOW' END AS tag FROM c",
)
def dictionary_tags(spark, d):
    words = lambda n: table(spark, d, n).select(F.explode(F.split(F.lower("text"), " ", -1)).alias("key"))
    frequent = words("benchmark").groupBy("key").count().where("count >= 3").select("key")
    return ranking.tag(words("documents").distinct(), frequent, words("conversations"))


@query(
    "tagged_lines",
    f"""WITH l AS (SELECT p_partkey AS n, p_name AS term, string_split(p_name || ' x ' || p_type, ' ') AS w FROM part), b AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS k FROM part WHERE p_size < 10), e AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS k FROM part WHERE p_size > 40),
c AS (SELECT n, term, i, w[i] AS word, {spacing_sql('w[i]')} AS k FROM (SELECT n, term, w, unnest(range(1, len(w) + 1)) AS i FROM l)),
j AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.k = c.k) OR regexp_full_match(c.k, '[a-z]+') AND EXISTS (SELECT 1 FROM e WHERE e.k = c.k) THEN 'HIGH' ELSE 'LOW' END AS f FROM c)
SELECT n AS line_number, term || coalesce('|' || string_agg(word || '|' || f, '|' ORDER BY i) FILTER (length(k) <> 1), '') AS output_line, term || coalesce('|' || string_agg(word, '|' ORDER BY i) FILTER (length(k) = 1), '') AS removed_line FROM j GROUP BY n, term""",
)
def tagged_lines(spark, d):
    p = table(spark, d, "part")
    lines = p.select(F.col("p_partkey").alias("line_number"), F.col("p_name").alias("canonical"), F.split(F.concat("p_name", F.lit(" x "), "p_type"), " ").alias("candidates"))
    words = lambda rows, c: rows.select(F.explode(F.split(c, " ")).alias("key"))
    none = values(spark, [], "ch string, freq long")
    return ranking.tagged(lines, words(p.where("p_size < 10"), F.lower("p_type")), words(p.where("p_size > 40"), F.col("p_name")), none).select("line_number", "output_line", "removed_line")


@query(
    "reply_decisions",
    """WITH c AS (SELECT p_partkey AS canonical, i, string_split(p_name, ' ')[i] AS word, p_size FROM (SELECT *, unnest([1, 2]) AS i FROM part))
SELECT canonical, i - 1 AS pos, word, CASE WHEN i = 1 AND p_size < 10 THEN 'drop' WHEN i = 2 AND p_size % 3 = 0 THEN 'drop' ELSE 'keep' END AS decision, i = 1 AND p_size < 10 OR i = 2 AND p_size % 3 = 0 AS decided FROM c""",
)
def reply_decisions(spark, d):
    p = table(spark, d, "part").withColumn("words", F.split("p_name", " "))
    one, two = F.get("words", F.lit(0)), F.get("words", F.lit(1))
    items = F.array_join(F.array_compact(F.array(F.when(F.col("p_size") < 10, F.concat(F.lit('"'), one, F.lit('"'))), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('{"word": "'), two, F.lit('", "reason": "r"}'))))), ", ")
    reply = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("```json\n["), items, F.lit("]\n```"))).otherwise(F.concat(F.lit('so: {"drop": ['), items, F.lit("]} done")))
    rows = p.select(F.col("p_partkey").alias("canonical"), "words", reply.alias("reply"))
    candidates = rows.select("canonical", F.posexplode("words").alias("pos", "word"))
    return ranking.apply_decisions(candidates, ranking.reply_decisions(rows)).select("canonical", "pos", "word", "decision", "decided")


@query("decisions", "SELECT p_partkey AS key, CASE WHEN p_size < 10 THEN 'drop' WHEN p_size < 30 THEN 'keep' ELSE 'review' END AS decision FROM part")
def decisions(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_size")
    return ranking.decide(p.select("key"), p.where("p_size < 10"), p.where("p_size < 30"), "review")


# manifests


@query(
    "manifest_union",
    "SELECT source_set, status, count(*) AS n FROM (SELECT 'orders' AS source_set, o_orderstatus AS status FROM orders UNION ALL SELECT 'lines', l_linestatus FROM lineitem UNION ALL SELECT 'parts', NULL FROM part) GROUP BY ALL",
)
def manifest_union(spark, d):
    parts = {
        "orders": table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")),
        "lines": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("status")),
        "parts": table(spark, d, "part").select(F.col("p_partkey").alias("id")),
    }
    return manifest.merge(parts).groupBy("source_set", "status").agg(F.count("*").alias("n"))


@query(
    "asr_gate",
    "SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'skipped' WHEN value < 10 THEN 'error' ELSE 'transcribe' END AS action FROM events",
)
def asr_gate(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "click", "generated").when(F.col("event_type") == "view", "cached").otherwise("pending")
    e = e.select("event_id", status.alias("status"), F.when(F.col("value") >= 10, "x").alias("audio_path"))
    return e.select("event_id", manifest.gate().alias("action"))


_SPECS = [("plain", 1.0), ("fast", 1.1), ("slow", 0.9)]


@query(
    "job_expansion",
    f"SELECT p_partkey, name, factor, substr(sha256(p_partkey::VARCHAR || chr(31) || name), 1, 16) AS job_id FROM part, ({sql_values(_SPECS)}) v(name, factor)",
)
def job_expansion(spark, d):
    specs = values(spark, _SPECS, "name string, factor double")
    return manifest.expand(table(spark, d, "part").select("p_partkey"), specs, ["p_partkey", "name"])


@query("incremental_todo", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY o_custkey")
def incremental_todo(spark, d):
    done = table(spark, d, "lineitem").where("l_quantity > 45").select(t.stable_id(F.col("l_orderkey")).alias("job_id"))
    jobs = table(spark, d, "orders").withColumn("job_id", t.stable_id(F.col("o_orderkey")))
    return manifest.todo(jobs, done).groupBy("o_custkey").agg(F.count("*").alias("n"))


# segments: seconds of events as frames of a user's track

_VAD = """WITH f AS (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT AS s FROM events WHERE value >= 20),
g AS (SELECT *, CASE WHEN s - (lag(s) OVER (PARTITION BY user_id ORDER BY s) + 1) < 3600 THEN 0 ELSE 1 END AS fresh FROM f),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s) AS island FROM g)"""


@query("vad_sessions", _VAD + " SELECT user_id, island::BIGINT AS island, min(s) AS \"start\", max(s) + 1 AS \"end\", count(*) AS frames FROM i GROUP BY user_id, island")
def vad_sessions(spark, d):
    frames = table(spark, d, "events").where("value >= 20").select("user_id", F.unix_timestamp("ts").alias("start")).distinct().withColumn("end", F.col("start") + 1)
    return segments.islands(frames, "user_id", "start", "end", 3600)


@query(
    "merge_ranges",
    """WITH r AS (SELECT l_suppkey, epoch(l_shipdate)::BIGINT // 86400 AS s, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS e FROM lineitem),
g AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT l_suppkey, island::BIGINT AS island, min(s) AS "start", max(e) AS "end", count(*) AS parts FROM i GROUP BY l_suppkey, island""",
)
def merge_ranges(spark, d):
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400)
    r = table(spark, d, "lineitem").select("l_suppkey", day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"))
    return segments.merge(r, "l_suppkey", 2)


# readings and variants


@query(
    "camel_reading",
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_brand, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), '\s+', ' ', 'g')) AS camel,
trim(regexp_replace(upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), '(.)', '\1 ', 'g')) AS spelled, translate(p_brand, '0123456789', '零一二三四五六七八九') AS digits, translate(p_brand, '0123456789', '零幺二三四五六七八九') AS yao, trim(regexp_replace(p_brand, '[^A-Za-z0-9._-]+', '-', 'g'), '.-') AS safe FROM part""",
)
def camel_reading(spark, d):
    x = F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", t.camel_split(x).alias("camel"), t.spelled(x).alias("spelled"), t.digits_read(x).alias("digits"), t.digits_read(x, "幺").alias("yao"), t.safe_name(x).alias("safe"))


@query(
    "number_readings",
    f"""WITH v AS (SELECT p_partkey, n, ltrim(n, '0') AS v FROM (SELECT p_partkey, (p_partkey * 7919)::VARCHAR AS n FROM part)),
r AS (SELECT p_partkey, v, array_to_string(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN v[i] = '0' THEN '0' ELSE translate(v[i], '{t.DIGITS}', '{t.READ}') || ({list(t.UNITS)})[len(v) - i + 1] END), '') AS named FROM v)
SELECT p_partkey, 'no. ' || CASE WHEN v = '' THEN '零' WHEN len(v) > 8 THEN translate(v, '{t.DIGITS}', '{t.READ}') ELSE regexp_replace(regexp_replace(regexp_replace(named, '0+$', ''), '0+', '零', 'g'), '^一十', '十') END || ' b' AS reading FROM r""",
)
def number_readings(spark, d):
    x = F.concat(F.lit("no."), (F.col("p_partkey") * 7919).cast("string"), F.lit("b"))
    return table(spark, d, "part").select("p_partkey", t.digit_runs_read(x, t.cardinal).alias("reading"))


def camel_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), '\s+', ' ', 'g'))"


def each_run_sql(x: str, change: str) -> str:
    """Latin runs ``r[j]`` of ``x`` changed, ``n`` of which come before."""
    runs = f"regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+')"
    change = change.replace("{run}", "r[j]").replace("{n}", "len(list_filter(r[1:j - 1], lambda y: regexp_matches(y, '^[A-Za-z]')))")
    return f"(SELECT array_to_string(list_transform(range(1, len(r) + 1), lambda j: CASE WHEN regexp_matches(r[j], '^[A-Za-z]') THEN {change} ELSE r[j] END), '') FROM (SELECT {runs} AS r))"


_SPACED = "array_to_string(string_split(upper({run}), ''), ' ')"
_CAPITALS = f"CASE WHEN regexp_full_match({{run}}, '[A-Z][A-Z]+') THEN {_SPACED} ELSE {{run}} END"
_TERMS_SQL = "SELECT regexp_replace(s_name, '#0*', 'HubX', 'g') AS term FROM supplier UNION ALL VALUES ('IdeaHub'), ('ASR'), ('CloudRSE')"


@query(
    "english_readings",
    rf"""WITH t AS (SELECT term, {camel_sql('term')} AS c FROM ({_TERMS_SQL}) v(term)), n AS (SELECT *, len(list_filter(string_split(c, ' '), lambda w: regexp_full_match(w, '[A-Za-z]+'))) AS n FROM t),
k AS (SELECT term, unnest([(0, 'camel_alnum_split', c), (1, 'separator_collapsed', regexp_replace(term, '[\s_\-#.]+', '', 'g')), (2, 'all_letters_spelled', {each_run_sql('term', _SPACED)}), (3, 'uppercase_runs_spelled', {each_run_sql('c', _CAPITALS)}),
  (4, 'camel_prefix_spelled', CASE WHEN n > 1 THEN {each_run_sql('c', 'CASE WHEN {n} = 0 THEN ' + _SPACED + ' ELSE {run} END')} END), (5, 'camel_suffix_spelled', CASE WHEN n > 1 THEN {each_run_sql('c', 'CASE WHEN {n} = n - 1 THEN ' + _SPACED + ' ELSE {run} END')} END)]) AS k FROM n),
d AS (SELECT term, k[1] AS seq, k[2] AS kind, k[3] AS reading FROM k WHERE k[3] <> '' AND lower(k[3]) <> lower(term) QUALIFY row_number() OVER (PARTITION BY term, lower(k[3]) ORDER BY k[1]) = 1)
SELECT *, row_number() OVER (PARTITION BY term ORDER BY seq) AS rank FROM d QUALIFY rank <= 6""",
)
def english_readings(spark, d):
    terms = table(spark, d, "supplier").select(F.regexp_replace("s_name", "#0*", "HubX").alias("term")).unionByName(values(spark, [("IdeaHub",), ("ASR",), ("CloudRSE",)], "term string"))
    return variants.readings(terms)


_SHORT = f"CASE WHEN {{n}} = 0 AND length({{run}}) <= 4 AND NOT regexp_full_match({{run}}, '[A-Z]+') OR regexp_full_match({{run}}, '[A-Z][A-Z]+') THEN {_SPACED} ELSE {{run}} END"


@query(
    "directed_readings",
    rf"""WITH t AS (SELECT p_partkey AS sample_id, 'TR' || p_brand AS x, p_name AS confusion FROM part), c AS (SELECT *, {camel_sql('x')} AS c FROM t),
k AS (SELECT sample_id, unnest([(0, 'camelcase_word_split', c, ''), (1, 'letter_spelling', {each_run_sql('c', _SHORT)}, ''), (2, 'connected_word_boundary', regexp_replace(x, '[\s_-]+', '', 'g'), '{directed.CONNECTED}'), (3, 'english_natural_reading', x, '{directed.NATURAL}')]) AS k FROM c)
SELECT sample_id, k[2] AS variant_kind, k[3] AS tts_text, nullif(k[4], '') AS instruction FROM k QUALIFY row_number() OVER (PARTITION BY sample_id, lower(k[3]), k[4] ORDER BY k[1]) = 1""",
)
def directed_readings(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.concat(F.lit("TR"), "p_brand").alias("canonical"), "p_name")
    none = F.lit(None).cast("array<string>")
    known = p.select("sample_id", F.lit(0).alias("seq"), F.col("p_name").alias("confusion"), F.lit(directed.ENGLISH).alias("category"), none.alias("source"), none.alias("target"))
    return directed.gt_directed(p, known).select("sample_id", "variant_kind", "tts_text", "instruction")


@query("syllable_distance", "SELECT a.p_partkey, levenshtein(lpad(a.p_size::VARCHAR, 2, '0'), lpad(b.p_size::VARCHAR, 2, '0')) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def syllable_distance(spark, d):
    chars = F.filter(F.split(F.lpad(F.col("p_size").cast("string"), 2, "0"), ""), lambda c: c != "")
    p = table(spark, d, "part").select("p_partkey", chars.alias("s"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("s").alias("t"))
    return p.join(q, "p_partkey").select("p_partkey", ar.edit_distance(F.col("s"), F.col("t")).cast("long").alias("distance"))


SYLLABLES = [("志伟", ["zhi4", "wei3"]), ("鹭兴", ["lu4", "xing1"]), ("内嵌", ["nei4", "qian4"]), ("周清", ["zhou1", "qing1"]), ("女", ["nv3"])]
FUZZY = [("initial", "zh", "z", 1), ("initial", "n", "l", 1), ("initial", "l", "n", 1), ("final", "ing", "in", 1), ("final", "ei", "ui", 2), ("final", "ian", "iang", 3)]


@query(
    "fuzzy_mutations",
    f"""WITH t(term, s) AS ({sql_values(SYLLABLES)}), r("type", source, target, level) AS ({sql_values(FUZZY)}),
p AS (SELECT term, s, i - 1 AS i, regexp_extract(s[i], '^(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(.*?)([1-5])?$', 1) AS ini, regexp_extract(s[i], '^(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(.*?)([1-5])?$', 2) AS fin, regexp_extract(s[i], '([1-5])$', 1) AS tone FROM (SELECT term, s, unnest(range(1, len(s) + 1)) AS i FROM t))
SELECT term, i, level, "type", source, target, array_to_string(list_transform(s, lambda v, k: CASE WHEN k = i + 1 THEN CASE WHEN "type" = 'initial' THEN target || fin || tone ELSE ini || target || tone END ELSE v END), ' ') AS variant
FROM p JOIN r ON ("type" = 'initial' AND source = ini) OR ("type" = 'final' AND source = fin)""",
)
def fuzzy_mutations(spark, d):
    rules = values(spark, FUZZY, "type string, source string, target string, level int")
    made = variants.fuzzy_mutations(values(spark, SYLLABLES, "term string, syllables array<string>"), rules)
    return made.withColumn("variant", F.array_join("variant", " "))


def _readings_of_pairs(spark) -> DataFrame:
    known = values(spark, READINGS, "text string, syllables array<string>")
    named = lambda text, syllables: known.select(F.col("text").alias(text), F.col("syllables").alias(syllables))
    return values(spark, PAIRS, "term string, confusion string").join(named("term", "source"), "term").join(named("confusion", "target"), "confusion")


_PARTS = "'^(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(.*?)([1-5])?$'"
_READ_PAIRS = f"""WITH p(term, confusion) AS ({sql_values(PAIRS)}), k("text", s) AS ({sql_values(READINGS)}), j AS (SELECT term, confusion, x.s AS a, y.s AS b FROM p JOIN k x ON x.text = term JOIN k y ON y.text = confusion),
c AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: regexp_replace(a[i], '[1-5]$', '') <> regexp_replace(b[i], '[1-5]$', '')) AS dq FROM j WHERE len(a) = len(b)),
e AS (SELECT *, dq[1] - 1 AS "index", a[dq[1]] AS source_syllable, b[dq[1]] AS target_syllable, {', '.join(f"regexp_extract({x}[dq[1]], {_PARTS}, {i}) AS {side}_{part}" for x, side in (('a', 'source'), ('b', 'target')) for i, part in ((1, 'initial'), (2, 'final'), (3, 'tone')))} FROM c WHERE len(dq) = 1),
f AS (SELECT *, CASE WHEN source_initial <> target_initial AND source_final = target_final THEN 'initial_change' WHEN source_initial = target_initial AND source_final <> target_final THEN 'final_change' ELSE 'syllable_substitution' END AS type FROM e)"""


@query("syllable_deltas", _READ_PAIRS + " SELECT * EXCLUDE (a, b, dq), array_to_string(a, ' ') AS source, array_to_string(b, ' ') AS target FROM f")
def syllable_deltas(spark, d):
    return syllables.deltas(_readings_of_pairs(spark)).withColumns({c: F.array_join(c, " ") for c in ("source", "target")})


@query(
    "target_mutations",
    _READ_PAIRS + """ SELECT term, type, CASE type WHEN 'initial_change' THEN source_initial ELSE source_final END AS source, CASE type WHEN 'initial_change' THEN target_initial ELSE target_final END AS target, "index" AS i,
  array_to_string(list_transform(a, lambda v, k: CASE WHEN k = dq[1] THEN CASE type WHEN 'initial_change' THEN target_initial || source_final ELSE source_initial || target_final END || source_tone ELSE v END), ' ') AS variant FROM f WHERE type <> 'syllable_substitution'""",
)
def target_mutations(spark, d):
    return syllables.target_mutations(_readings_of_pairs(spark)).withColumn("variant", F.array_join("variant", " "))


LEXICON = [("露西", ["lu4", "xi1"], 10), ("路行", ["lu4", "xin1"], 30), ("陆新", ["lu4", "xin1"], 20), ("子维", ["zi4", "wei3"], 5), ("自卫", ["zi4", "wei4"], 50)]


@query(
    "carrier_topn",
    f"WITH m AS ({SQL['fuzzy_mutations']}), l(word, s, weight) AS ({sql_values(LEXICON)}) SELECT m.*, word, max(weight) AS score, row_number() OVER (PARTITION BY term, i, type, source, target ORDER BY max(weight) DESC, word) AS rank"
    " FROM m JOIN l ON variant = array_to_string(s, ' ') WHERE word <> term GROUP BY term, i, level, type, source, target, variant, word QUALIFY rank <= 2",
)
def carrier_topn(spark, d):
    rules = values(spark, FUZZY, "type string, source string, target string, level int")
    made = variants.fuzzy_mutations(values(spark, SYLLABLES, "term string, syllables array<string>"), rules)
    return variants.carriers(made, values(spark, LEXICON, "word string, syllables array<string>, weight int"), 2).withColumn("variant", F.array_join("variant", " "))


# phones

#: Fixture values: readings of some words of the tables and of the tests; all others stay unresolved.
READ = {
    "small": "S M AO1 L", "large": "L AA1 R JH", "red": "R EH1 D", "blue": "B L UW1", "ring": "R IH1 NG", "rod": "R AA1 D", "widget": "W IH1 JH AH0 T", "bolt": "B OW1 L T",
    "idea": "AY0 D IY1 AH0", "hub": "HH AH1 B", "box": "B AA1 K S", "cloud": "K L AW1 D",
}
TOKENS = [("Idea",), ("hub",), ("ASR",), ("2",), ("box",), ("zzyx",)]
_MARKED = lambda ph: f"'[' || array_to_string({ph}, '][') || ']'"
_VOWEL = "regexp_full_match({}, '[A-Z]+[012]')"


def read_words(spark) -> DataFrame:
    return values(spark, [(w, i, p.split()) for i, (w, p) in enumerate(READ.items())], "token string, seq int, phones array<string>")


def phones_sql(names: dict[str, str]) -> str:
    return sql_values([(w, p.split()) for w, p in names.items()])


def map_sql(names: dict[str, str]) -> str:
    lists = "[" + ", ".join("'" + v + "'" for v in names.values()) + "]"
    return f"map([{', '.join(repr(k) for k in names)}], {lists})"


def letters_sql(word: str) -> str:
    return f"flatten(list_transform(string_split(upper({word}), ''), lambda c: string_split({map_sql(cmu.LETTERS)}[c], ' ')))"


def replaced_sql(ph: str, at: str, value: str) -> str:
    return f"list_transform(range(1, len({ph}) + 1), lambda z: CASE WHEN z = {at} THEN {value} ELSE {ph}[z] END)"


@query(
    "phone_resolution",
    f"""WITH t(token) AS ({sql_values(TOKENS)}), d(word, phones) AS ({phones_sql(READ)})
SELECT token, CASE WHEN lower(token) = 'box' THEN 'B AO1 K S' WHEN regexp_full_match(token, '[A-Z]+') THEN array_to_string({letters_sql('token')}, ' ') WHEN regexp_full_match(token, '[0-9]') THEN {map_sql(cmu.NUMBERS)}[token] ELSE array_to_string(phones, ' ') END AS phones,
  CASE WHEN lower(token) = 'box' THEN 'override' WHEN regexp_full_match(token, '[A-Z]+') THEN 'acronym' WHEN regexp_full_match(token, '[0-9]') THEN 'digit' WHEN phones IS NOT NULL THEN 'dictionary' ELSE 'unresolved' END AS source FROM t LEFT JOIN d ON word = lower(token)""",
)
def phone_resolution(spark, d):
    own = values(spark, [("BOX", ["B", "AO1", "K", "S"])], "token string, phones array<string>")
    tables = ({k: v.split() for k, v in names.items()} for names in (cmu.LETTERS, cmu.NUMBERS))
    return syllables.resolve_phones(values(spark, TOKENS, "token string"), own, read_words(spark), *tables).withColumn("phones", F.array_join("phones", " "))


# terms of the parts: two words, a hyphen and a number

_CMU_TOKENS = f"""d(word, ph) AS ({phones_sql(READ)}), n(word, ph) AS ({phones_sql(cmu.NUMBERS)}), w AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), string_split(p_size::VARCHAR, '')) AS w FROM part),
k AS (SELECT p_partkey, i, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)), p AS (SELECT p_partkey, i, k.word, coalesce(d.ph, n.ph) AS ph, n.ph IS NULL AS is_word FROM k LEFT JOIN d USING (word) LEFT JOIN n USING (word)),
t AS (SELECT * FROM p SEMI JOIN (SELECT p_partkey FROM p GROUP BY 1 HAVING count(ph) = count(*)) USING (p_partkey)), s AS (SELECT p_partkey, list({_MARKED('ph')} ORDER BY i) AS s FROM t GROUP BY 1)"""


def cmu_rule_sql(k: int, rule: tuple) -> str:
    """Rows (p_partkey, k, rule, node, place, phoneme_text, mark) of a rule."""
    name, _, op, source, target = rule
    rows, place, vowel, last = "t", "len(ph) - 1", _VOWEL, "ph[len(ph)]"
    new = {
        "final_schwa_deletion": "ph[1:len(ph) - 1]", "final_cluster_delete_penultimate": "list_concat(ph[1:len(ph) - 2], ph[len(ph):len(ph)])", "initial_deletion": "ph[2:len(ph)]",
        "final_substitution": replaced_sql("ph", "len(ph)", f"'{target}'"), "substitution": replaced_sql("ph", "q", f"'{target}'"), "letter_spelling": letters_sql("word"),
    }.get(op)
    when = {
        "final_schwa_deletion": f"{last} = 'AH0' AND len(list_filter(ph[1:len(ph) - 1], lambda v: {vowel.format('v')})) > 0",
        "final_cluster_delete_penultimate": f"len(ph) >= 3 AND NOT {vowel.format(last)} AND NOT {vowel.format('ph[len(ph) - 1]')}",
        "final_substitution": f"{last} = '{source}'", "substitution": f"ph[q] = '{source}'", "initial_deletion": f"ph[1] = '{source}' AND len(ph) > 1", "letter_spelling": "is_word",
    }.get(op)
    if op == "connected_boundary":
        return f"SELECT p_partkey, {k}, '{name}', 2 * i - 1, -1, array_to_string(s[1:i], ' ') || array_to_string(s[i + 1:len(s)], ' '), 'c' || i FROM t JOIN s USING (p_partkey) WHERE i < len(s)"
    if op == "substitution":
        rows, place = "(SELECT *, unnest(range(1, len(ph) + 1)) AS q FROM t)", "q - 1"
    place = {"final_cluster_delete_penultimate": "len(ph) - 2", "initial_deletion": "0", "letter_spelling": "-1"}.get(op, place)
    text = f"array_to_string(list_transform(range(1, len(s) + 1), lambda j: CASE WHEN j = i THEN {_MARKED('new')} ELSE s[j] END), ' ')"
    mark = "'l' || i" if op == "letter_spelling" else "''"
    return f"SELECT p_partkey, {k}, '{name}', 2 * (i - 1), place, {text}, {mark} FROM (SELECT *, {new} AS new, {place} AS place FROM {rows} WHERE {when}) JOIN s USING (p_partkey)"


_CMU_ROWS = " UNION ALL ".join(["SELECT p_partkey, -1 AS k, 'baseline' AS rule, -1 AS node, -1 AS place, array_to_string(s, ' ') AS phoneme_text, '' AS mark FROM s", *(cmu_rule_sql(k, r) for k, r in enumerate(cmu.RULES))])


def cmu_terms(spark, d) -> tuple[DataFrame, DataFrame]:
    terms = table(spark, d, "part").select("p_partkey", F.concat_ws("-", "p_name", "p_size").alias("text"))
    return cmu.audited(cmu.resolve(cmu.parse(terms), "p_partkey", values(spark, [], "token string, phones array<string>"), read_words(spark)))


@query(
    "cmu_variants",
    f"WITH {_CMU_TOKENS}, v AS ({_CMU_ROWS}), u AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY p_partkey, phoneme_text, mark ORDER BY k, node, place) = 1) SELECT p_partkey, rule, node, place, phoneme_text, row_number() OVER (PARTITION BY p_partkey ORDER BY k, node, place) AS number FROM u QUALIFY number <= 32",
)
def cmu_variants(spark, d):
    return cmu.variants(cmu_terms(spark, d)[0], "p_partkey", boundaries=True).drop("nodes")


@query("cmu_unresolved", f"WITH {_CMU_TOKENS} SELECT p_partkey, string_agg(word || ': g2p_failed', ' | ' ORDER BY i) AS unresolved FROM p WHERE ph IS NULL GROUP BY p_partkey")
def cmu_unresolved(spark, d):
    said = F.transform("unresolved", lambda u: F.concat_ws(": ", u["text"], u["reason"]))
    return cmu_terms(spark, d)[1].select("p_partkey", F.array_join(said, " | ").alias("unresolved"))


_NUCLEI = f"list_filter(range(1, len(ph) + 1), lambda z: {_VOWEL.format('ph[z]')})"
_EACH = "(SELECT *, unnest(range(1, len(ph) + 1)) AS q FROM t)"
_LAST = "ph[len(ph)]"
_DEVOICED, _SWAPPED = (f"map({list(m)}, {list(m.values())})" for m in (variants.DEVOICED, variants.SWAPPED))


def english_rules_sql() -> list[tuple[str, str, str, str, str]]:
    """(rule, rows, condition, new phones, new word or '') in order, but for connected boundaries."""
    cut = "(SELECT *, nu[g] AS nc, CASE WHEN g > 1 THEN nu[g - 1] + 1 ELSE 1 END AS st, g AS q FROM (SELECT *, unnest(range(1, len(nu) + 1)) AS g FROM (SELECT *, " + _NUCLEI + " AS nu FROM t)) WHERE len(nu) > 1)"
    one = "(SELECT *, 1 AS q FROM t)"
    return [
        ("en.unstressed_vowel_reduction", _EACH, f"{_VOWEL.format('ph[q]')} AND ends_with(ph[q], '0') AND ph[q] <> 'AH0'", replaced_sql("ph", "q", "'AH0'"), "''"),
        ("en.h_deletion", _EACH, "ph[q] = 'HH'", "list_concat(ph[1:q - 1], ph[q + 1:len(ph)])", "regexp_replace(word, '^[hH]', '')"),
        ("en.final_consonant_deletion", one, f"NOT {_VOWEL.format(_LAST)} AND len(ph) > 1", "ph[1:len(ph) - 1]", "''"),
        ("en.final_stop_devoicing", one, f"{_LAST} IN {tuple(variants.DEVOICED)}", replaced_sql("ph", "len(ph)", f"{_DEVOICED}[{_LAST}]"), f"CASE WHEN {_LAST} = 'B' THEN regexp_replace(word, '[bB]$', 'p') ELSE word END"),
        ("en.consonant_substitution", _EACH, f"ph[q] IN {tuple(variants.SWAPPED)}", replaced_sql("ph", "q", f"{_SWAPPED}[ph[q]]"), "''"),
        ("en.connected_boundary", "", "", "", ""),
        ("en.letter_spelling", one, "true", letters_sql("word"), "array_to_string(string_split(upper(word), ''), ' ')"),
        ("en.unstressed_syllable_deletion", cut, "ends_with(ph[nc], '0')", "list_concat(ph[1:st - 1], ph[nc + 1:len(ph)])", "''"),
    ]


def _english_sql() -> str:
    marked, shown = f"list_transform(range(1, len(s) + 1), lambda j: CASE WHEN j = i THEN {_MARKED('new')} ELSE s[j] END)", "list_transform(range(1, len(ws) + 1), lambda j: CASE WHEN j = i THEN said ELSE ws[j] END)"
    parts = []
    for no, (rule, rows, when, new, word) in enumerate(english_rules_sql()):
        if not rows:
            parts.append(f"SELECT p_partkey, {no} AS no, '{rule}' AS rule, 0 AS i, 0 AS j, array_to_string(s, ' ') AS phonemes, array_to_string(ws, '') AS display, 'c' AS mark FROM s WHERE len(s) > 1")
        else:
            place = "st" if "syllable" in rule else "q"
            parts.append(f"SELECT p_partkey, {no}, '{rule}', i, j, array_to_string({marked}, ' '), CASE WHEN said = '' THEN array_to_string(ws, ' ') ELSE array_to_string({shown}, ' ') END, '' FROM (SELECT p_partkey, i, {place} AS j, {new} AS new, {word} AS said FROM {rows} WHERE {when}) JOIN s USING (p_partkey) WHERE len(new) > 0")
    return " UNION ALL ".join(parts)


@query(
    "phone_variants",
    f"""WITH d(word, ph) AS ({phones_sql(READ)}), k AS (SELECT p_partkey, i, string_split(p_name, ' ')[i] AS word FROM (SELECT *, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)), p AS (SELECT p_partkey, i, k.word, ph FROM k LEFT JOIN d USING (word)),
t AS (SELECT * FROM p SEMI JOIN (SELECT p_partkey FROM p GROUP BY 1 HAVING count(ph) = count(*)) USING (p_partkey)), s AS (SELECT p_partkey, list({_MARKED('ph')} ORDER BY i) AS s, list(word ORDER BY i) AS ws FROM t GROUP BY 1), v(p_partkey, no, rule, i, j, phonemes, display, mark) AS ({_english_sql()}),
u AS (SELECT v.* FROM v JOIN s USING (p_partkey) WHERE NOT (phonemes = array_to_string(s, ' ') AND mark = '') QUALIFY row_number() OVER (PARTITION BY p_partkey, phonemes, mark ORDER BY no, i, j) = 1)
SELECT p_partkey, rule, phonemes, display, row_number() OVER (PARTITION BY p_partkey ORDER BY no, i, j) AS number FROM u""",
)
def phone_variants(spark, d):
    base, _ = english_terms(spark, d)
    return pronounce.english_generated(base, "p_partkey").select("p_partkey", "rule", "phonemes", "display", "number")


def english_terms(spark, d) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None)
    terms = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), none.cast("array<string>").alias("hints"), none.cast(pronounce.TOKENS).alias("given"))
    return pronounce.english_base(terms, read_words(spark).withColumnRenamed("token", "word"), "p_partkey")


@query("phone_pairs")
def phone_pairs(spark, d):
    base, _ = english_terms(spark, d)
    return pronounce.english_generated(base, "p_partkey", 2).select("p_partkey", "rule", F.array_join("steps", "+").alias("steps"), "phonemes", "number")


@query(
    "phone_rules",
    f"""WITH d(word, ph) AS ({phones_sql(READ)}), t AS (SELECT d.* FROM d SEMI JOIN (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) USING (word)),
v AS ({' UNION ALL '.join(f"SELECT word, {no} AS no, {'st' if 'syllable' in r[0] else 'q'} AS j, '{n}' AS rule, {r[3]} AS new FROM {r[1]} WHERE {r[2]}" for no, (n, r) in enumerate(zip(('vowel_reduction', 'h_deletion', 'final_deletion', 'final_devoicing', 'substitution', 'syllable_deletion'), [r for r in english_rules_sql() if r[0] not in ('en.connected_boundary', 'en.letter_spelling')])))}),
q AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY no, j) - 1 AS seq FROM v)
SELECT word, seq, rule, {_MARKED('new')} AS variant FROM q JOIN d USING (word) WHERE new <> ph QUALIFY row_number() OVER (PARTITION BY word, new ORDER BY seq) = 1""",
)
def phone_rules(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    read = words.join(read_words(spark).select(F.col("token").alias("word"), "phones"), "word")
    return variants.english_variants(read).withColumn("variant", variants.serialized(F.col("variant")))


def _pinyin_sql() -> str:
    nasal = "CASE " + " ".join(f"WHEN ends_with(fin, '{a}') THEN regexp_replace(fin, '{a}$', '{b}')" for a, b in variants.NASAL) + " END"
    flat = f"map({list(variants.FLATTENED)}, {list(variants.FLATTENED.values())})"
    made = {
        "n_l": ("ini IN ('n', 'l')", "translate(ini, 'nl', 'ln') || fin || tone"),
        "retroflex": (f"ini IN {tuple(variants.FLATTENED)}", f"{flat}[ini] || fin || tone"),
        "nasal": (f"{nasal} IS NOT NULL", f"ini || {nasal} || tone"),
        "nasal_weakening": ("regexp_replace(fin, 'ng?$', '') NOT IN (fin, '')", "ini || regexp_replace(fin, 'ng?$', '') || tone"),
        "tone_neutralization": ("tone IN ('1', '2', '3', '4')", "ini || fin || '5'"),
    }
    rows = [f"SELECT term, s, i, '{r}' AS rule, {to} AS v FROM p WHERE {when}" for r, (when, to) in made.items()]
    rows.append("SELECT term, s, i, 'tone_substitution', ini || fin || x FROM p, (VALUES ('1'), ('2'), ('3'), ('4')) w(x) WHERE tone IN ('1', '2', '3', '4') AND x <> tone")
    rows.append("SELECT term, s, i, 'syllable_deletion', NULL FROM p WHERE len(s) > 1")
    return " UNION ALL ".join(rows)


@query(
    "pinyin_rules",
    f"""WITH t(term, s) AS ({sql_values(SYLLABLES)}), p AS (SELECT term, s, i - 1 AS i, regexp_extract(s[i], {_PARTS}, 1) AS ini, regexp_extract(s[i], {_PARTS}, 2) AS fin, regexp_extract(s[i], '([1-5])$', 1) AS tone FROM (SELECT term, s, unnest(range(1, len(s) + 1)) AS i FROM t)), v AS ({_pinyin_sql()})
SELECT term, i, rule, array_to_string(CASE WHEN v IS NULL THEN list_concat(s[1:i], s[i + 2:len(s)]) ELSE list_transform(s, lambda x, k: CASE WHEN k = i + 1 THEN v ELSE x END) END, ' ') AS variant FROM v""",
)
def pinyin_rules(spark, d):
    made = variants.pinyin_variants(values(spark, SYLLABLES, "term string, syllables array<string>"))
    return made.withColumn("variant", F.array_join("variant", " "))


# services, by fakes


@query(
    "transcription",
    """WITH r AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 50 = 0 THEN 'fail/' WHEN o_orderkey % 41 <> 0 THEN 'a/' END || (o_custkey % 300) AS audio_path, CASE o_orderstatus WHEN 'F' THEN 'generated' WHEN 'O' THEN 'cached' ELSE 'pending' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'auto' END AS language FROM orders),
a AS (SELECT *, CASE WHEN status = 'pending' THEN 'skipped' WHEN audio_path IS NULL THEN 'error' ELSE 'transcribe' END AS action, nullif(language, 'auto') AS l FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY audio_path, l, action ORDER BY seq) AS n FROM a)
SELECT seq, CASE WHEN action <> 'transcribe' THEN action WHEN starts_with(audio_path, 'fail') THEN 'error' WHEN n = 1 THEN 'success' ELSE 'reused' END AS asr_status, CASE WHEN action = 'transcribe' AND NOT starts_with(audio_path, 'fail') THEN substr(sha256(audio_path || '|' || coalesce(l, 'None') || '|None'), 1, 8) END AS asr_text FROM b""",
)
def transcription(spark, d):
    k = F.col("o_orderkey")
    path = F.when(k % 50 == 0, "fail/").when(k % 41 != 0, "a/")
    status = F.when(F.col("o_orderstatus") == "F", "generated").when(F.col("o_orderstatus") == "O", "cached").otherwise("pending")
    rows = table(spark, d, "orders").select(
        k.alias("seq"), F.concat(path, (F.col("o_custkey") % 300).cast("string")).alias("audio_path"), status.alias("status"), F.when(k % 3 == 0, "en").when(k % 3 == 1, "auto").alias("language"), F.col("o_orderpriority").alias("text")
    )
    return services.transcribed(rows, services.FakeTranscriber()).select("seq", F.col("asr.status").alias("asr_status"), F.col("asr.text").alias("asr_text"))


_VOICES, _TOLD = ["calm", "quick"], ["plain", "slow"]


@query(
    "speech_jobs",
    f"SELECT p_partkey, voice, instruction, CASE WHEN p_size < 5 THEN 'cached' ELSE 'generated' END AS status, CASE WHEN p_size >= 5 THEN length(p_name) * 10 END AS duration_ms FROM part, ({sql_values([(v,) for v in _VOICES])}) v(voice), ({sql_values([(v,) for v in _TOLD])}) t(instruction)",
)
def speech_jobs(spark, d):
    none = F.lit(None).cast("string")
    own = F.concat_ws(" ", "p_name").alias("tts_text")
    p = table(spark, d, "part").select("p_partkey", "p_size", own, F.lit("English").alias("language"), F.col("p_partkey").cast("string").alias("phoneme_text"), none.alias("pronunciation_instruction"))
    voices = values(spark, [(v,) for v in _VOICES], "voice string")
    told = values(spark, [(v, f"Say it {v}.") for v in _TOLD], "instruction string, instruct string")
    work = services.jobs(p, voices, told, "fake", {"api_key": "x", "rate": 1})
    done = work.where("p_size < 5").select("cache_key")
    return services.spoken(work, services.FakeSynthesizer(), done).select("p_partkey", "voice", "instruction", "status", "duration_ms")


@query(
    "model_filter",
    """WITH c AS (SELECT p_partkey AS canonical, i - 1 AS pos, string_split(p_name || ' ' || p_size, ' ')[i] AS word FROM (SELECT *, unnest([1, 2, 3]) AS i FROM part))
SELECT canonical, pos, word, CASE WHEN regexp_matches(word, '[0-9]') THEN 'drop' ELSE 'keep' END AS decision FROM c""",
)
def model_filter(spark, d):
    words = F.split(F.concat_ws(" ", "p_name", "p_size"), " ")
    candidates = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("canonical"), F.posexplode(words).alias("pos", "word"))
    return services.filtered(candidates, services.FakeModel()).select(F.col("canonical").cast("long").alias("canonical"), "pos", "word", "decision")


@query("wav_files", "SELECT doc_id, 16000 AS sample_rate, greatest(1, octet_length(encode(text)) // 2 * 2) AS frames, round_even(octet_length(encode(text)) // 2 / 8, 0)::INTEGER AS duration_ms FROM documents WHERE octet_length(encode(text)) > 1")
def wav_files(spark, d):
    pcm = table(spark, d, "documents").where("octet_length(text) > 1").select("doc_id", F.encode("text", "UTF-8").alias("pcm"), F.lit(8000).alias("sample_rate"))
    read = audio.read_wav(audio.write_wav(pcm).select("doc_id", "content"), strict=True)
    return read.select("doc_id", "wav.sample_rate", "wav.frames", "wav.duration_ms")


@query("speech_ranges")
def speech_ranges(spark, d):
    pcm = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("pcm"))
    return segments.speech(audio.frames(pcm, "doc_id"), "doc_id", 0.72, 60, 40, 10, 20)


@query(
    "manifest_summary",
    "SELECT event_type, count(*) AS rows, count(*) FILTER (value >= 50) AS ready, count(*) FILTER (value < 10) AS skipped, count(*) FILTER (value >= 10 AND value < 50) AS errors FROM events GROUP BY event_type",
)
def manifest_summary(spark, d):
    status = F.when(F.col("value") >= 50, "generated").when(F.col("value") < 10, "skipped").otherwise("error")
    e = table(spark, d, "events").select("event_type", status.alias("status"))
    return manifest.summary(e, ["event_type"])


@query(
    "result_rows",
    "SELECT o_orderkey AS sample_id, o_orderpriority AS expected_text, o_orderstatus AS tts_status, CASE WHEN o_orderkey % 2 = 0 THEN 'r' END AS pronunciation_rule, c_mktsegment AS canonical FROM orders JOIN customer ON o_custkey = c_custkey",
)
def result_rows(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), "o_custkey", F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "r").alias("pronunciation_rule"), F.lit("x").alias("unknown"))
    ids = o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("sample_id", F.col("c_mktsegment").alias("canonical"))
    return manifest.of_entries(o.select(*manifest.result_columns(o)), ids)


@query("run_fingerprints")
def run_fingerprints(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 7).alias("condition"), F.col("o_orderkey").alias("seq"), "o_orderpriority", "o_totalprice")
    return services.fingerprint(rows, {"temperature": 0}, ["condition"])


# arrays as sample vectors


@query(
    "pcm_stats",
    "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms, round(list_sum(list_transform(embedding, lambda x: greatest(-0.05, least(0.05, x::DOUBLE)) / 0.05)), 5) AS clipped FROM embeddings",
)
def pcm_stats(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(audio.energy(x), 6).alias("rms"), F.round(F.aggregate(audio.hard_clip(F.col("embedding"), 0.05), F.lit(0.0), lambda a, v: a + v), 5).alias("clipped")
    )


@query("first_wins", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1")
def first_wins(spark, d):
    """Of rows that tie, the first in the table wins, as in DuckDB on one thread."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *place)
    return first_by(rows, ["l_orderkey"], F.asc_nulls_last("l_linenumber"), "file", "at").drop("file", "at")
