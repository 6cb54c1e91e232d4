import numpy as np
import pytest
from pyspark.sql import functions as F

from mishear import catalog
from mishear.functions import arrays, text
from mishear.operators import audio, classify, evaluate, keys, manifest, ranking, segments, syllables, variants
from mishear.sources import glossary, records

SMALL = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_glossary_merges_lines_of_one_key(spark, tmp_path):
    path = tmp_path / "gt.txt"
    path.write_text("﻿# comment\n\nIdeaHub|ID Hub|Idea hot|IDEAHub\n志伟|周也\n志伟|市委|周也\nIdea Hub\n", "utf-8")
    rows = glossary.sample_ids(glossary.parse_terms(glossary.lines(spark, str(path)))).orderBy("seq").collect()
    assert [(r.canonical, r.confusions, r.lines) for r in rows] == [("IdeaHub", ["ID Hub", "Idea hot"], [3]), ("志伟", ["周也", "市委"], [4, 5]), ("Idea Hub", [], [6])]
    assert rows[0].sample_id.startswith("gt-0001-")
    apart = glossary.parse_terms(glossary.lines(spark, str(path)), merge=False)
    assert apart.where("canonical = '志伟'").count() == 2


def test_keys(spark):
    assert one(spark, text.spacing_key(F.lit(" Idea,  HUB! "))) == "idea hub"
    assert one(spark, text.compact_key(F.lit(" Idea-HUB 2 "))) == "ideahub2"
    assert one(spark, text.unwrapped(F.lit("language English<asr_text> Box"))) == "Box"
    assert one(spark, text.number_skeleton(F.lit("TR六"))) == one(spark, text.number_skeleton(F.lit("TR6"))) == "tr#"
    assert one(spark, text.json_object(F.lit('```json\n{"a": 1}\n``` ok'))) == '{"a": 1}'
    df = spark.createDataFrame([("ＩＤ ﬁx",), ("plain",), (None,)], "x string")
    assert {r.x for r in keys.compatible(df, "x").collect()} == {"ID fix", "plain", None}


@pytest.mark.parametrize("a,b,n", [("kitten", "sitting", 3), ("", "abc", 3), ("abc", "", 3), ("same", "same", 0)])
def test_edit_distance(spark, a, b, n):
    arr = lambda s: F.array(*map(F.lit, s)).cast("array<string>")
    assert one(spark, arrays.edit_distance(arr(a), arr(b))) == n


def test_first_gap(spark):
    arr = lambda s: F.array(*map(F.lit, s))
    assert one(spark, arrays.first_gap(arr("abc"), arr("ac"))) == 1
    assert one(spark, arrays.first_gap(arr("abc"), arr("xy"))) is None


def test_classification(spark):
    rows = {(r.canonical, r.confusion): r.category for r in catalog.QUERIES["pair_classify"](spark, SMALL).collect()}
    assert rows["IdeaHub", "Idea Hub"] == "normalization_alias"
    assert rows["鹭兴", "陆星"] == "zh_same_pinyin"
    assert rows["周清", "周星"] == "zh_single_syllable"
    assert rows["CloudRSE", "CloudRCE"] == "english_word_acronym"
    assert rows["Nexent", "南盛的"] == "cross_language_transliteration"
    assert rows["TR6", "TR六"] == "number_reading_mixed"
    assert len(classify.CATEGORIES) == 9


def test_ranking_counts_then_first_seen(spark):
    heard = ["陈照", "陈照", "陈赵", "陈兆"]
    rows = spark.createDataFrame([(i, "陈赵", h, h, "success") for i, h in enumerate(heard)], "seq long, term_key string, out_key string, output string, status string")
    assert [(r.out_key, r.n) for r in ranking.confusions(rows).orderBy("rank").collect()] == [("陈照", 2), ("陈兆", 1)]


def test_tags_and_frequent_characters(spark):
    words = spark.createDataFrame([("怎样",), ("森牙",), ("when",), ("q w e n",)], "key string")
    tags = ranking.tag(words, spark.createDataFrame([("怎样",)], "key string"), spark.createDataFrame([("when",), ("q w e n",)], "key string"))
    assert {r.key: r.tag for r in tags.collect()} == {"怎样": "HIGH", "森牙": "LOW", "when": "HIGH", "q w e n": "LOW"}
    chars = spark.createDataFrame([("怎", 300_000), ("样", 200_000), ("森", 5)], "ch string, freq long")
    assert [r.key for r in ranking.frequent_characters(words, chars).collect()] == ["怎样"]


def test_islands_match_a_state_machine(spark):
    rng = np.random.default_rng(3)
    frames = [(int(k), int(s) * 20, int(s) * 20 + 20) for k in range(5) for s in sorted(set(rng.integers(0, 300, 60)))]
    got = {(r.track, r.start, r.end) for r in segments.islands(spark.createDataFrame(frames, "track long, start long, end long"), "track", "start", "end", 100).collect()}
    want = set()
    for k in range(5):
        now = None
        for t, a, b in (f for f in frames if f[0] == k):
            if now and a - now[1] < 100:
                now[1] = b
            else:
                if now:
                    want.add((k, *now))
                now = [a, b]
        want.add((k, *now))
    assert got == want


def test_variants(spark):
    phones = spark.createDataFrame([("hub", ["HH", "AH1", "B"]), ("none", [])], "word string, phones array<string>")
    got = {(r.rule, tuple(r.variant)) for r in variants.english_variants(phones).collect()}
    assert got == {("h_deletion", ("AH1", "B")), ("final_deletion", ("HH", "AH1")), ("final_devoicing", ("HH", "AH1", "P"))}
    zh = spark.createDataFrame([("内", ["nei4"])], "term string, syllables array<string>")
    got = {(r.rule, tuple(r.variant)) for r in variants.pinyin_variants(zh).collect()}
    assert ("n_l", ("lei4",)) in got and ("tone_neutralization", ("nei5",)) in got and ("tone_substitution", ("nei1",)) in got
    terms = spark.createDataFrame([("IdeaHub",), ("ASR",)], "term string")
    readings = {(r.term, r.reading) for r in variants.readings(terms).collect()}
    assert {("IdeaHub", x) for x in ("Idea Hub", "I D E A H U B", "I D E A Hub", "Idea H U B")} <= readings and ("ASR", "A S R") in readings


def read_cardinal(digits):  # the state machine over places
    if int(digits) == 0:
        return "零"
    if int(digits) >= 10**8:
        return "".join("零一二三四五六七八九"[int(c)] for c in digits)
    out, pending, places = [], False, str(int(digits))
    for k, c in enumerate(places):
        if c == "0":
            pending = True
        else:
            out += ["零"] * pending + ["零一二三四五六七八九"[int(c)], ["", "十", "百", "千", "万", "十", "百", "千"][len(places) - k - 1]]
            pending = False
    said = "".join(out)
    return said[1:] if said.startswith("一十") else said


def test_cardinals(spark):
    numbers = ["0", "000", "7", "10", "12", "100", "105", "1010", "10010", "100000", "120034", "99999999", "100000000", "007"]
    df = spark.createDataFrame([(n,) for n in [*numbers, None]], "x string")
    got = {r.x: r.y for r in df.select("x", text.cardinal(F.col("x")).alias("y")).collect()}
    assert got == {n: read_cardinal(n) for n in numbers} | {None: None}
    assert one(spark, text.digit_runs_read(F.lit("TR12  v3"), text.cardinal)) == "TR 十二 v 三"
    assert one(spark, text.digit_runs_read(F.lit(""), text.cardinal)) == ""


PAIRS = [
    ("周清", ["zhou1", "qing1"], ["zhou1", "xing1"]), ("志伟", ["zhi4", "wei3"], ["shi4", "wei4"]), ("a", ["lu4"], ["lu4", "xi1"]),
    ("b", ["lu4", "xi1"], ["xi1"]), ("c", ["lu4"], ["lu3"]), ("d", ["ma1", "li4"], ["ba1", "lu4"]), ("e", ["ma1"], ["bi2"]), ("f", None, ["bi2"]), ("g", [], []),
]


def test_syllable_edits(spark):
    pairs = spark.createDataFrame(PAIRS, "term string, source array<string>, target array<string>")
    got = {r.term: (r.type, r["index"], r.source_syllable, r.target_syllable) for r in syllables.deltas(pairs).collect()}
    assert got == {
        "周清": ("initial_change", 1, "qing1", "xing1"), "志伟": ("initial_change", 0, "zhi4", "shi4"), "a": ("syllable_insertion", 1, None, "xi1"),
        "b": ("syllable_deletion", 0, "lu4", None), "e": ("syllable_substitution", 0, "ma1", "bi2"),
    }
    made = {r.term: (r.source, r.target, r.variant) for r in syllables.target_mutations(pairs).collect()}
    assert made == {"周清": ("q", "x", ["zhou1", "xing1"]), "志伟": ("zh", "sh", ["shi4", "wei3"]), "a": ("", "xi", ["lu4", "xi1"]), "b": ("lu", "", ["xi1"])}


def test_carriers_agree_in_tone_and_fall_back_to_characters(spark):
    mutations = spark.createDataFrame([("t", 0, "initial", "n", "l", ["lu4", "xi1"]), ("t", 1, "initial", "n", "l", ["ma1", "li4"])], "term string, i int, type string, source string, target string, variant array<string>")
    lexicon = [("露西", ["lu4", "xi1"], 10), ("陆西", ["lu4", "xi1"], 5), ("鲁西", ["lu3", "xi1"], 99), ("路", ["lu4"], 7), ("西", ["xi1"], 9), ("妈", ["ma1"], 3), ("路西", ["lu4", "xi2"], 1)]
    words = spark.createDataFrame(lexicon, "word string, syllables array<string>, weight int")
    got = sorted((r.i, r["rank"], r.word, r.score) for r in variants.carriers(mutations, words, 3).collect())
    assert got == [(0, 1, "露西", 10), (0, 2, "陆西", 5)]  # 路西 is read otherwise, and no character is read li4
    built = syllables.character_words(mutations, words.where("word <> '路西'")).collect()
    assert [(r.word, r.score) for r in built] == [("路西", 7)]
    assert variants.carriers(mutations, words.where("word <> '路西'"), 2).count() == 2


def test_phones_by_source(spark):
    got = {r.token: (r.phones, r.source) for r in catalog.QUERIES["phone_resolution"](spark, SMALL).collect()}
    assert got["ASR"] == ("EY1 EH1 S AA1 R", "acronym") and got["box"] == ("B AO1 K S", "override") and got["zzyx"] == (None, "unresolved")
    assert got["Idea"] == ("AY0 D IY1 AH0", "dictionary") and got["2"] == ("T UW1", "digit")


def test_audio(spark):
    tone = audio.quantized(0.2 * np.sin(2 * np.pi * 440 * np.arange(1600) / 16000))
    df = spark.createDataFrame([("a", bytearray(tone)), ("b", None)], "sample_id string, pcm binary")
    for spec in ({"type": "speed", "factor": 1.25}, {"type": "white_noise", "snr_db": 20}, {"type": "low_pass", "cutoff_hz": 3000}, {"type": "chain", "steps": [{"type": "hard_clip", "threshold": 0.1}, {"type": "white_noise", "snr_db": 10}]}):
        first, again = ({r.sample_id: r.pcm for r in audio.augment(d, spec, 7).collect()} for d in (df, df.repartition(3)))
        assert first == again and first["b"] is None and first["a"] != tone
    with pytest.raises(ValueError):
        audio.validate({"type": "chain", "steps": [{"type": "speed", "factor": 1}]})


def test_records(spark, tmp_path):
    folder = tmp_path / "results" / "base"
    folder.mkdir(parents=True)
    (folder / "run-02.jsonl").write_text('{"sample_id": "a", "asr": {"status": "success", "text": "x"}}\n')
    row = records.read_results(spark, str(tmp_path)).first()
    assert (row.condition, row.repeat, row.asr.text) == ("base", 2, "x")
    with pytest.raises(Exception, match="missing field"):
        records.required(spark.createDataFrame([(None,)], "a string"), ["a"]).collect()


def test_gate_and_todo(spark):
    rows = spark.createDataFrame([("generated", "p"), ("pending", "p"), ("cached", None), (None, "p")], "status string, audio_path string")
    assert [r.g for r in rows.select(manifest.gate().alias("g")).collect()] == ["transcribe", "skipped", "error", "skipped"]
    assert evaluate.HEARD == ("success", "reused")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).columns


def test_keys_see_through_compatibility_forms(spark, tmp_path):
    spark.createDataFrame([(1, 1, "u", "ＩｄｅａＨｕｂ"), (1, 2, "u", "IdeaHub"), (1, 3, "u", "ﬁx-1")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "ＩｄｅａＨｕｂ"), (2, "Idea Hub!"), (3, "ﬁx"), (4, "fix")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Ｂｏｘ", "ＡＢ", "t"), (2, "Box", "ab", "ｔ")], "p_partkey long, p_brand string, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r.turn, r.exact_match, r.compact_match) for r in run("compare_text")} == {(2, True, True), (3, False, False)}
    assert {(r.doc_id, r.same) for r in run("compact_match")} == {(1, 2), (2, 2), (3, 2), (4, 2)}
    assert [(r.term_key, r.canonical, r.n_lines, r.confusions) for r in run("gt_parse_merge")] == [("box", "Ｂｏｘ", 2, "ＡＢ|t")]
    pairs = spark.createDataFrame([("ＩｄｅａＨｕｂ", "Idea Hub"), ("ＴＲ６", "TR六")], "canonical string, confusion string")
    assert {r.canonical: r.category for r in classify.classify(pairs).collect()} == {"ＩｄｅａＨｕｂ": "normalization_alias", "ＴＲ６": "number_reading_mixed"}
    (tmp_path / "words.txt").write_text("Ｂｏｘ 12\nbox\n", "utf-8")
    (tmp_path / "weighted.txt").write_text("Ｂｏｘ b 9000\n", "utf-8")
    assert [r.key for r in glossary.dictionary(spark, f"{tmp_path}/words.txt").collect()] == ["box"]
    assert [r.key for r in glossary.weighted_dictionary(spark, f"{tmp_path}/weighted.txt").collect()] == ["box"]
    made = spark.createDataFrame([("a", "Ｐｏｘ"), ("a", "Fox")], "term string, text string")
    targets = spark.createDataFrame([("a", "pox")], "term string, confusion string")
    assert [r.text for r in variants.without_leaks(made, targets, "term", "text").collect()] == ["Fox"]


def test_first_wins_by_place_in_the_table(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    for k, n in enumerate((300, 40_000, 9_000)):  # Spark reads large files first
        ids = spark.range(0, n, 1, 1)
        number = F.when(F.col("id") % 11 < 9, (F.col("id") % 3).cast("int"))  # with nulls
        key = F.when(F.col("id") % 3001 > 0, F.pmod(F.xxhash64("id"), F.lit(3000)))
        rows = ids.select(key.alias("l_orderkey"), (F.col("id") + k * 1_000_000).alias("l_partkey"), number.alias("l_linenumber"))
        rows.union(rows.where("id < 200").select("l_orderkey", "l_partkey", F.lit(None).cast("int").alias("l_linenumber"))).coalesce(1).write.parquet(str(tmp_path / f"made-{k}"))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / f"made-{k}").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{k}.parquet")
    base = duckdb.connect()
    base.execute("SET threads = 1")
    base.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = base.execute(catalog.SQL["first_wins"]).fetchall()
    got = [tuple(x) for x in catalog.QUERIES["first_wins"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
