import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mishear.functions import text
from mishear.operators import audio, cmu, directed, evaluate, manifest, pronounce, ranking, segments, services, settings
from mishear.sources import glossary, records, sinks

RESULT = "seq long, term string, text string, status string, rule string, variant_kind string, category string, exact boolean, compact boolean, condition string, repeat int"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def box(spark, *more):
    rows = [(0, "Box", "Pox", "success", "en.consonant.b_to_p", "v", None, False, False, "c", 1), (1, "Box", "Box", "success", None, "baseline", None, True, True, "c", 1), *more]
    pairs = spark.createDataFrame([("box", "pox", "Pox", 0), ("box", "fox", "Fox", 1)], "term_key string, conf_key string, confusion string, seq int")
    lex = spark.createDataFrame([("box", ["Box"]), ("pox", ["Pox"]), ("fox", ["Fox"])], "cand_key string, spellings array<string>")
    return evaluate.keyed(spark.createDataFrame(rows, RESULT)), pairs, lex


def test_misses_tell_rules_and_outputs(spark):
    results, pairs, _ = box(spark)
    (miss,) = evaluate.miss_details(evaluate.misses(results, pairs), results).collect()
    assert (miss.confusion, miss.asr_sample_count, miss.successful_asr_count, miss.canonical_output_count) == ("Fox", 2, 2, 1)
    assert (miss.rules_tried, miss.top_asr_outputs) == ("baseline | en.consonant.b_to_p", "Pox (1) | Box (1)")


def test_metrics_leave_out_failures_and_targets(spark):
    failed = (2, "Box", "Fox", "error", None, None, None, True, True, "c", 1)
    silent = (3, "Box", None, "skipped", None, None, None, None, None, "c", 1)
    full = (4, "Fox", "Ｐｏｘ!", "reused", None, None, None, False, False, "d", 1)
    results, pairs, lex = box(spark, failed, silent, full)
    rows = {r.condition: r for r in evaluate.metrics(results, lex, ["condition"]).collect()}
    c, d = rows["c"], rows["d"]
    assert (c.request_count, c.failure_count, c.exact_match_count, c.exact_match_rate, c.distinct_transcript_count) == (4, 1, 1, 0.25, 2)
    assert (c.matched_confusion_candidate_count, c.confusion_hit_count) == (1, 1)  # Box is a target
    assert (d.matched_confusion_candidate_count, d.confusion_hit_count) == (1, 1)  # full width is seen through
    wrong = [(r.transcript, r.n) for r in evaluate.top_errors(results, ["condition"]).where("condition = 'c'").orderBy("rank").collect()]
    assert wrong == [("pox", 1), ("(no transcript)", 1)]
    (hit,) = evaluate.hits(results, pairs).collect()  # only successes count, reused ones do not
    assert (hit.confusion, hit.hits) == ("Pox", 1)
    report = {(r.scope, r.condition, r.repeat): r for r in evaluate.report(results, lex, pairs).collect()}
    assert report["condition", "c", None].gt_coverage_rate == report["run", "c", 1].gt_coverage_rate == 0.5 and report["run", "d", 1].gt_known_confusion_total == 0
    (rule,) = evaluate.rule_effectiveness(results.where("rule IS NOT NULL"), pairs).collect()
    assert (rule.generated_count, rule.gt_hit_event_count, rule.gt_hit_rate, rule.over_distorted_count) == (1, 1, 1.0, 0)


def test_numerals_and_spelling(spark):
    skeleton = lambda x: one(spark, text.number_skeleton(F.lit(x)))
    assert skeleton("TR six") == skeleton("TR6") == skeleton("ＴＲ六") == "tr#" and skeleton("3亿") == "#" and skeleton("twenty-one") == "##"
    assert one(spark, text.short_lead_spelled(F.lit("Tr ABC on"))) == "T R A B C on" and one(spark, text.short_lead_spelled(F.lit("Cloud on"))) == "Cloud on"
    assert one(spark, text.script_split(F.lit("用IdeaHub2播"))) == "用 Idea Hub 2 播"
    assert one(spark, text.ssml(F.lit("<s l='{locale}' v='{voice}'>{text}</s>"), F.lit("a<{voice}"), F.lit("en-GB-X"))) == "<s l='en-GB' v='en-GB-X'>a&lt;{voice}</s>"
    import hashlib

    want = hashlib.sha256(json.dumps(['a"b', "ü\n", ["x", "y"], None], ensure_ascii=False).encode()).hexdigest()[:16]
    items = F.transform(F.array(F.lit("x"), F.lit("y")), text.json_text)
    assert one(spark, text.json_id(text.json_text(F.lit('a"b')), text.json_text(F.lit("ü\n")), text.json_list(items), text.json_text(F.lit(None).cast("string")))) == want


def test_term_nodes():
    kinds = lambda x: [(n[1] or n[6]) for n in cmu.nodes_of(x)]
    assert kinds("IdeaHub") == ["Idea", "camel_case", "Hub"]
    assert kinds("ASR-12 v#") == ["ASR", "hyphen", "1", "alnum", "2", "space", "v"]
    assert kinds(" -A  -b") == ["A", "space", "b"] and kinds("TR6x") == ["TR", "alnum", "6", "alnum", "x"] and kinds("中文") == []
    assert [n[2] for n in cmu.nodes_of("XMLFile")] == ["acronym", None, "word"]


PHONES = [("idea", 0, ["AY0", "D", "IY1", "AH0"]), ("hub", 1, ["HH", "AH1", "B"]), ("hub", 2, ["X"]), ("box", 3, ["B", "AA1", "K", "S"])]


def test_cmu_samples(spark, tmp_path):
    entries = spark.createDataFrame([("s1", "IdeaHub"), ("s2", "zzyx 1"), ("s3", "中文"), ("s4", "BOX")], "sample_id string, canonical string")
    own = spark.createDataFrame(cmu.overrides({"Box": ["b", "AA1", "K", "S"]}), "token string, phones array<string>")
    dictionary = spark.createDataFrame(PHONES, "token string, seq int, phones array<string>")
    rows, open_ = cmu.samples(entries, own, dictionary, boundaries=True, text_baseline=True)
    got = {(r.sample_id, r.variant_kind): r.phoneme_text for r in rows.collect()}
    assert got["s1", "baseline"] == "[AY0][D][IY1][AH0] [HH][AH1][B]" and got["s1", "en.connected_boundary"] == "[AY0][D][IY1][AH0][HH][AH1][B]"
    assert got["s1", "en.final_schwa_deletion"] == "[AY0][D][IY1] [HH][AH1][B]" and got["s1", "en.h_deletion"] == "[AY0][D][IY1][AH0] [AH1][B]"
    assert got["s1", "text_baseline"] is None and got["s4", "en.final_cluster_delete_penultimate"] == "[B][AA1][S]"
    assert {(r.sample_id, r.unresolved[0].reason) for r in open_.collect()} == {("s2", "g2p_failed"), ("s3", "no_supported_english_tokens")}
    counts = cmu.summary(rows, open_).first()
    assert (counts.term_count, counts.resolved_term_count, counts.unresolved_term_count, counts.baseline_count) == (4, 2, 2, 2)
    few, _ = cmu.samples(entries, own, dictionary, cmu.chosen(cmu.rules(), ["en.h_deletion"]), boundary_modes={"camel_case": "connected"})
    assert {r.phoneme_text for r in few.where("sample_id = 's1'").collect()} == {"[AY0][D][IY1][AH0][HH][AH1][B]", "[AY0][D][IY1][AH0][AH1][B]"}
    sinks.write_pronunciations(rows, open_, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "unresolved")).count() == 2
    for bad in (lambda: cmu.chosen(cmu.rules(), ["none"]), lambda: cmu.rules([]), lambda: cmu.rules([cmu.RULES[0], cmu.RULES[0]]), lambda: cmu.overrides({"a": ["?"]}), lambda: cmu.boundary_modes(entries, {"space": "pause"})):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "rules.json").write_text(json.dumps([{"rule_id": "x", "operation": "substitution", "source": "B", "target": "P", "level": "phoneme"}]))
    assert cmu.read_rules(str(tmp_path / "rules.json"))[0]["target"] == "P"
    broken = spark.createDataFrame([([{"kind": "token", "phones": ["b?"]}],)], T.StructType().add("nodes", T.ArrayType(cmu.NODE)))
    with pytest.raises(Exception, match="ARPAbet"):
        broken.select(cmu.serialized(F.col("nodes"))).collect()


def python_rules(tokens, boundaries):
    """(order, tokens, boundaries) of each English rule at each place, by loops."""
    vowel = lambda p: p[-1] in "012"
    for i, (word, ph) in enumerate(tokens):
        put = lambda new: tuple((w, tuple(new)) if k == i else (w, p) for k, (w, p) in enumerate(tokens))
        for j, p in enumerate(ph):
            if vowel(p) and p.endswith("0") and p != "AH0":
                yield (0, i, j), put([*ph[:j], "AH0", *ph[j + 1 :]]), boundaries
            if p == "HH":
                yield (1, i, j), put([*ph[:j], *ph[j + 1 :]]), boundaries
            if p in "BPDTRL" and len(p) == 1:
                yield (4, i, j), put([*ph[:j], dict(B="P", P="B", D="T", T="D", R="L", L="R")[p], *ph[j + 1 :]]), boundaries
        if ph and not vowel(ph[-1]) and len(ph) > 1:
            yield (2, i, len(ph) - 1), put(ph[:-1]), boundaries
        if ph and (new := dict(B="P", D="T", G="K", V="F", Z="S", JH="CH", DH="TH").get(ph[-1])):
            yield (3, i, len(ph) - 1), put([*ph[:-1], new]), boundaries
        if ph:
            yield (6, i, 0), put([p for c in word.upper() for p in cmu.LETTERS[c].split()]), boundaries
        nuclei = [j for j, p in enumerate(ph) if vowel(p)]
        for k, j in enumerate(nuclei):
            start = nuclei[k - 1] + 1 if k else 0
            if len(nuclei) > 1 and ph[j].endswith("0") and len(ph) > j + 1 - start:
                yield (7, i, start), put([*ph[:start], *ph[j + 1 :]]), boundaries
    for b, kind in enumerate(boundaries):
        if kind == "word":
            yield (5, b, 0), tokens, tuple("connected" if k == b else x for k, x in enumerate(boundaries))


@pytest.mark.parametrize("depth", [1, 2])
def test_english_variants_against_loops(spark, depth):
    base = (("idea", ("AY0", "D", "IY1", "AH0")), ("hub", ("HH", "AH1", "B"))), ("word",)
    seen, want = {base}, []
    first = sorted(python_rules(*base))
    for order, tokens, boundaries in first:
        if (tokens, boundaries) not in seen:
            seen.add((tokens, boundaries))
            want.append((tokens, boundaries))
    for _, tokens, boundaries in first if depth == 2 else ():
        for _, t2, b2 in sorted(python_rules(tokens, boundaries)):
            if (t2, b2) != (tokens, boundaries) and (t2, b2) not in seen:
                seen.add((t2, b2))
                want.append((t2, b2))
    terms = spark.createDataFrame([("t", "idea hub", None, None)], f"term string, text string, hints array<string>, given {pronounce.TOKENS}")
    ready, missing = pronounce.english_base(terms, spark.createDataFrame(PHONES, "word string, seq int, phones array<string>"))
    assert missing.count() == 0
    made = pronounce.english_generated(ready, depth=depth).orderBy("number").collect()
    assert [(tuple((w.text, tuple(w.phones)) for w in r.tokens), tuple(r.boundaries)) for r in made] == want
    assert {r.renderability for r in made if r.rule == pronounce.COMPOSED} <= {"phoneme_required"}
    by_rule = {r.rule: r.display for r in made if len(r.steps) == 1}
    assert by_rule["en.h_deletion"] == "idea ub" and by_rule["en.final_stop_devoicing"] == "idea hup" and by_rule["en.connected_boundary"] == "ideahub"
    assert services.renderable(pronounce.english_generated(ready), ["text_approximation"]).count() < len(want)


def test_bases_that_cannot_be_read(spark):
    terms = spark.createDataFrame([("a", "Foo XYZ", None, None), ("b", "x", ["hub"], None), ("c", "y", None, [("q", ["K"])])], f"term string, text string, hints array<string>, given {pronounce.TOKENS}")
    ready, missing = pronounce.english_base(terms, spark.createDataFrame(PHONES, "word string, seq int, phones array<string>"))
    assert {r.term: [w.text for w in r.tokens] for r in ready.collect()} == {"b": ["hub"], "c": ["q"]}
    assert [(r.term, r.word) for r in missing.collect()] == [("a", "Foo")]
    zh = spark.createDataFrame([("a", "内嵌", None), ("b", "行", None), ("c", "志伟", ["zhi4"]), ("d", "abc", None), ("e", "女x", ["nu:3"]), ("f", "缺", None)], "term string, text string, syllables array<string>")
    readings = spark.createDataFrame([("内", "nei4"), ("嵌", "qian4"), ("行", "xing2"), ("行", "hang2")], "ch string, syllable string")
    ready, bad = pronounce.chinese_base(zh, readings)
    assert {r.term: r.syllables for r in ready.collect()} == {"a": ["nei4", "qian4"], "e": ["nv3"]}
    assert {r.term: r.reason.split()[0] for r in bad.collect()} == {"b": "ambiguous", "c": "syllables", "d": "no", "f": "invalid"}
    made = pronounce.generated(ready, pronounce.chinese_rules, ["syllables"])
    assert made.where("term = 'a' AND rule = 'n_l'").first().syllables == ["lei4", "qian4"]
    assert made.groupBy("term", "syllables").count().where("count > 1").count() == 0
    assert pronounce.generated(ready, pronounce.chinese_rules, ["syllables"], depth=2).where("rule = 'composed.2'").count() > 0


def test_directed_variants(spark):
    entries = spark.createDataFrame([("s", "IdeaHub"), ("n", "TR12"), ("z", "周清")], "sample_id string, canonical string")
    rows = [("s", 0, "Idea Hub", "english_word_acronym", None, None), ("n", 0, "TR 一二", "number_reading_mixed", None, None), ("z", 0, "周星", "zh_single_syllable", ["zhou1", "qing1"], ["zhou1", "xing1"]), ("z", 1, "粥清", "zh_same_pinyin", None, None)]
    pairs = spark.createDataFrame(rows, "sample_id string, seq int, confusion string, category string, source array<string>, target array<string>")
    made = directed.gt_directed(entries, pairs).collect()
    got = {(r.sample_id, r.variant_kind): r.tts_text for r in made}
    assert ("s", "camelcase_word_split") not in got  # spells out the known confusion
    assert got["s", "letter_spelling"] == "I D E A Hub" and got["s", "english_natural_reading"] == got["s", "connected_word_boundary"] == "IdeaHub"
    assert {k: v for k, v in got.items() if k[0] == "n"} == {("n", "number_chinese_digits"): "T R 一二", ("n", "number_chinese_yao"): "T R 幺二", ("n", "number_chinese_cardinal"): "T R 十二"}
    told = {r.variant_kind: r.instruction for r in made if r.sample_id == "z"}
    assert set(told) == {"changed_syllable_weakening", "initial_transition"} and "syllable 2" in told["initial_transition"] and "between q and x" in told["initial_transition"]
    assert len({r.variant_id for r in made}) == len(made)
    same = directed.with_homophones(directed.canonical_rows(entries), pairs)
    assert {r.sample_id: r.target_confusions for r in same.collect()} == {"s": None, "n": None, "z": ["粥清"]}
    both = directed.samples(entries, "gt_directed", {"gt_directed": lambda e: directed.gt_directed(e, pairs)})
    assert both.count() == 3 + len(made)
    with pytest.raises(ValueError):
        directed.samples(entries, "english_mandarin_transfer", {})


def test_fuzzy_assembly(spark):
    entries = spark.createDataFrame([("鹭兴", ["lu4", "xing1"]), ("abc", [])], "term string, syllables array<string>")
    rules = spark.createDataFrame([("initial", "l", "n", 1, "static"), ("final", "ing", "in", 1, "static"), ("final", "u", "v", 3, "static")], "type string, source string, target string, level int, origin string")
    pairs = spark.createDataFrame([("鹭兴", "路新", ["lu4", "xing1"], ["lu4", "xin1"])], "term string, confusion string, source array<string>, target array<string>")
    lexicon = spark.createDataFrame([("路新", ["lu4", "xin1"], 9), ("陆新", ["lu4", "xin1"], 5), ("怒星", ["nu4", "xing1"], 3), ("绿星", ["lv4", "xing1"], 3)], "word string, syllables array<string>, weight int")
    made = directed.fuzzy_variants(entries, rules, lexicon, pairs, most_level=1).orderBy("rank").collect()
    assert [(r.word, r.origin, r.pronunciation_rule) for r in made] == [("怒星", "static", "zh.fuzzy_initial_l_to_n"), ("路新", "static+gt", "zh.fuzzy_final_ing_to_in"), ("陆新", "static+gt", "zh.fuzzy_final_ing_to_in")]
    assert [r.word for r in directed.fuzzy_variants(entries, rules, lexicon, pairs, per_term=2, leave_out_known=True).orderBy("rank").collect()] == ["怒星", "绿星"]
    counts = directed.fuzzy_summary(entries, directed.fuzzy_variants(entries, rules, lexicon, pairs)).first()
    assert (counts.term_count, counts.skipped_non_chinese_count, counts.variant_count) == (2, 1, 4)
    derived = directed.fuzzy_variants(entries, rules.where("level = 3"), lexicon, pairs, most_level=1, derive=True).collect()
    assert {(r.word, r.origin) for r in derived} == {("路新", "gt_target_component"), ("陆新", "gt_target_component")}


def test_tagged_dictionary(spark, tmp_path):
    words = "森|怎样|生涯|也说|是这|森牙|when|Q W E N".split("|")
    lines = spark.createDataFrame([(1, "森伢", words), (2, "空", [])], "line_number int, canonical string, candidates array<string>")
    key = lambda *w: spark.createDataFrame([(x,) for x in w], "key string")
    chars = spark.createDataFrame([(c, 300_000) for c in "也说是这"] + [("森", 5)], "ch string, freq long")
    tagged = ranking.tagged(lines, manifest.distinct_union(key("怎样"), key("生涯", "怎样")), key("when", "q w e n"), chars)
    first, second = tagged.orderBy("line_number").collect()
    assert first.output_line == "森伢|怎样|HIGH|生涯|HIGH|也说|HIGH|是这|HIGH|森牙|LOW|when|HIGH|Q W E N|LOW" and first.removed_line == "森伢|森"
    assert (second.output_line, second.removed_line) == ("空", "空")
    sinks.write_tagged(tagged, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t" / "tagged"), wholetext=True).collect()][0].split("\n")[:2] == ["#TERM_IMPORT_V2", first.output_line]
    pairs = spark.createDataFrame([("a", "b", "other_review"), ("a", "c", "english_word_acronym")], "canonical string, confusion string, category string")
    assert {r.category: r.n for r in sinks.write_classes(pairs, str(tmp_path / "k")).collect() if r.n} == {"other_review": 1, "english_word_acronym": 1}
    assert [r.value for r in spark.read.text(str(tmp_path / "k" / "preprocessable")).collect()] == ["a|c"]
    sinks.write_report(spark.createDataFrame([(1, ["x"])], "b int, a array<string>"), str(tmp_path / "r"))
    (csv,) = [p.read_text("utf-8") for p in (tmp_path / "r").glob("part-*.csv")]
    assert csv == '\ufeffa,b\n"[""x""]",1\n'
    sinks.write_report(spark.createDataFrame([], "b int"), str(tmp_path / "e"))
    assert "".join(p.read_text("utf-8") for p in (tmp_path / "e").glob("part-*.txt")) == "\ufeffscope\n"


def test_glossary_checks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "IdeaHub|x"), (2, "ＩｄｅａＨｕｂ|y|X"), (3, "#c"), (4, "z|" + "|".join(f"w{k}" for k in range(10_050)))], "seq int, line string")
    entries = glossary.parse_terms(glossary.strict_lines(rows))
    assert {r.canonical: r.confusions[:3] for r in entries.collect()} == {"IdeaHub": ["x", "y"], "z": ["w0", "w1", "w2"]}
    assert entries.where("canonical = 'z'").select(F.size("confusions")).first()[0] == 10_050
    assert [r.sample_id[:8] for r in glossary.sample_ids(entries, 2).orderBy("seq").collect()] == ["gt-0001-", "gt-0002-"]
    words = {r.cand_key: r.spellings for r in glossary.lexicon(entries, spark.createDataFrame([(0, "IDEA-HUB")], "seq int, word string")).collect()}
    assert words["ideahub"] == ["IdeaHub", "IDEA-HUB"] and words["x"] == ["x"]
    with pytest.raises(Exception, match="empty term"):
        glossary.strict_lines(spark.createDataFrame([(1, " ! | b")], "seq int, line string")).collect()
    with pytest.raises(ValueError):
        glossary.checked(entries.limit(0))
    (tmp_path / "rules.csv").write_text("# c\ntype,source,target,level,origin\ninitial,zh,z,1,a\ninitial,zh,z,2,b\nvowel,a,b,1,a\nfinal,ing,in,0,a\n")
    assert [(r.source, r.origin) for r in glossary.fuzzy_rules(spark, str(tmp_path / "rules.csv")).collect()] == [("zh", "a")]
    (tmp_path / "short.csv").write_text("type,source\n")
    with pytest.raises(ValueError, match="lacks"):
        glossary.fuzzy_rules(spark, str(tmp_path / "short.csv"))


def test_results_with_their_settings(spark, tmp_path):
    for k in (1, 2):
        folder = tmp_path / "results" / "base"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"run-0{k}.jsonl").write_text('{"sample_id": "a", "asr": {"status": "success", "text": "x"}}\n')
    (folder / "run-01.jsonl.meta.json").write_text('{"fingerprint": "f", "language": "en",\n "sampling": {"temperature": 0}}')
    rows = {r.repeat: r for r in records.read_results(spark, str(tmp_path)).collect()}
    assert (rows[1].fingerprint, rows[1].language, json.loads(rows[1].sampling)) == ("f", "en", {"temperature": 0}) and rows[2].fingerprint is None
    records.write_in_order(spark.createDataFrame([(2, "b"), (1, "a")], "n int, x string"), str(tmp_path / "o"), "n")
    assert [json.loads(x)["n"] for p in sorted((tmp_path / "o").glob("part-*")) for x in p.read_text().split()] == [1, 2]
    with pytest.raises(ValueError):
        records.some(spark.createDataFrame([], "a int"))


def wav(samples, rate, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(rate)
        f.writeframes(samples)
    return bytearray(out.getvalue())


def test_wav_files(spark):
    tone = (np.sin(np.arange(8000) / 5) * 9000).astype("<i2")
    stereo = np.column_stack([tone, np.zeros(8000, "<i2")]).astype("<i2").tobytes()
    files = [("a", wav(tone.tobytes(), 8000)), ("b", wav(stereo, 8000, 2)), ("c", bytearray(b"RIFF")), ("d", None), ("e", wav(bytes(100), 8000, 1, 1))]
    df = spark.createDataFrame(files, "id string, content binary")
    loose = {r.id: r.wav for r in audio.read_wav(df).collect()}
    assert loose["a"].pcm == tone.tobytes() and loose["a"].duration_ms == 1000 and loose["b"].channels == 2
    assert np.abs(np.frombuffer(loose["b"].pcm, "<i2") - tone / 2).max() <= 1 and loose["c"].error and loose["d"].error and loose["e"].error
    assert all(r.wav.error for r in audio.read_wav(df, strict=True).collect())
    pcm = spark.createDataFrame([("a", bytearray(tone.tobytes()), 8000), ("n", None, 8000)], "id string, pcm binary, sample_rate int")
    back = {r.id: r.wav for r in audio.read_wav(audio.write_wav(pcm).where("content IS NOT NULL"), strict=True).collect()}
    assert (back["a"].frames, back["a"].sample_rate, back["a"].error) == (16_000, 16_000, None)
    assert np.allclose(audio.mono(np.array([[1000, 2000], [3000, 4000]], np.int16)), np.array([2000, 3000]) / 32768) and audio.mono(np.array([2.0, -4.0]))[0] == np.float32(2 / 32768)
    with pytest.raises(ValueError):
        audio.resampled(np.zeros(3, np.float32), 0)


def test_speech_against_a_state_machine(spark):
    r = np.random.default_rng(4)
    tracks = {k: np.concatenate([r.integers(-9000, 9000, n) if loud else np.zeros(n, int) for loud, n in zip([1, 0] * 8, r.integers(200, 9000, 16))]).astype("<i2") for k in range(6)}
    df = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in tracks.items()], "track int, pcm binary")
    got = sorted((x.track, x.start, x.end) for x in segments.speech(audio.frames(df, "track"), "track", 0.3, 200, 60, 30, 50).collect())
    want = []
    for k, x in tracks.items():
        now, silent, ranges, total = None, 0, [], round(len(x) / 16)
        for at in range(0, len(x), 320):
            a, b = round(at / 16), round(min(at + 320, len(x)) / 16)
            if min(1.0, np.abs(x[at : at + 320].astype(int)).mean() / (32768 * 0.2)) >= 0.3:
                now, silent = [now[0] if now else a, b], 0
            elif now:
                silent += b - a
                if silent >= 200:
                    ranges.append(now)
                    now, silent = None, 0
        merged = []
        for a, b in ([max(0, a - 30), min(total, b + 30)] for a, b in [*ranges, *([now] if now else [])] if b - a >= 60):
            if merged and a - merged[-1][1] <= 50:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want += [(k, a, b) for a, b in merged]
    assert got == sorted(want) and got


def test_rendering_and_cache(spark):
    tone = audio.quantized(0.2 * np.sin(np.arange(1600) / 9))
    df = spark.createDataFrame([("a", bytearray(tone), 16_000, "generated"), ("b", bytearray(tone), 16_000, "pending"), ("c", None, 16_000, "cached")], "sample_id string, pcm binary, sample_rate int, status string")
    specs = [{"name": "clip", "type": "hard_clip", "threshold": 0.1}, {"name": "noise", "type": "white_noise", "snr_db": 20}]
    first = {(r.sample_id, r.name): r for r in audio.render(df, specs, seed=3).collect()}
    again = {(r.sample_id, r.name): r for r in audio.render(df.repartition(3), specs, seed=3).collect()}
    assert {k: (r.status, r.pcm) for k, r in first.items()} == {k: (r.status, r.pcm) for k, r in again.items()}
    assert [first[k, "clip"].status for k in "abc"] == ["generated", "skipped", "error"] and first["a", "clip"].duration_ms == 100
    done = spark.createDataFrame([(first["a", "clip"].cache_key,)], "cache_key string")
    assert {r.name: r.status for r in audio.render(df, specs, done, seed=3).where("sample_id = 'a'").collect()} == {"clip": "cached", "noise": "generated"}
    with pytest.raises(ValueError):
        audio.render(df, [specs[0], specs[0]])


class Flaky:
    def __init__(self, folder):
        self.folder = folder

    def reply(self, canonical, candidates):
        mark = self.folder / canonical
        if not mark.exists():
            mark.write_text("")
            raise OSError("try again")
        return '["b"]'


def test_services(spark, tmp_path):
    rows = [(0, "p", "generated", "en", "X"), (1, "p", "cached", "en", "p"), (2, "p", "generated", None, "X"), (3, "fail", "generated", "en", "X"), (4, "q", "pending", "en", "X"), (5, None, "cached", "en", "X")]
    df = spark.createDataFrame(rows, "seq int, audio_path string, status string, language string, text string")
    fake = services.FakeTranscriber({"p": "language English<asr_text> X"})
    got = {r.seq: r for r in services.transcribed(df, fake).collect()}
    assert [got[k].asr.status for k in range(6)] == ["success", "reused", "success", "error", "skipped", "error"]
    assert got[0].comparison.exact_match and not got[1].comparison.exact_match and got[3].comparison is None and "no audio" in got[3].asr.error
    assert {r.asr.status for r in services.transcribed_in_parallel(df.where("audio_path = 'p'"), fake, 2).collect()} == {"success"}
    candidates = spark.createDataFrame([("t", 0, "a"), ("t", 1, "b"), ("u", 0, "b")], "canonical string, pos int, word string")
    done = spark.createDataFrame([("u", '{"keep": ["b"]}')], "canonical string, reply string")
    decided = {(r.canonical, r.word): r.decision for r in services.filtered(candidates, Flaky(tmp_path), done, missing="keep", retries=1).collect()}
    assert decided == {("t", "a"): "keep", ("t", "b"): "drop", ("u", "b"): "keep"}

    class Up:
        def __init__(self):
            self.log, self.left = [], 2

        def start(self):
            self.log.append("start")

        def ready(self):
            self.left -= 1
            return self.left < 0

        def stop(self):
            self.log.append("stop")

    with services.managed(Up(), pause=0) as service:
        assert service.log == ["start"]
    assert service.log == ["start", "stop"]
    runs = spark.createDataFrame([("a", 1, "success", "f"), ("a", 2, "error", "f"), ("b", 1, "success", "old")], "condition string, repeat int, status string, fingerprint string")
    expected = spark.createDataFrame([("a", 1, 1, "f"), ("a", 2, 1, "f"), ("b", 1, 1, "f"), ("c", 1, 1, "f")], "condition string, repeat int, rows int, fingerprint string")
    assert {(r.condition, r.repeat) for r in services.stale(runs, expected).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    prints = lambda d: {r.g: r.fingerprint for r in services.fingerprint(d, {"t": 0}, ["g"]).collect()}
    base = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "x")], "g int, seq int, v string")
    assert prints(base) == prints(base.repartition(3)) and prints(base)[1] != prints(base.where("seq = 0"))[1]
    with pytest.raises(ValueError):
        manifest.matching(df, expected=5)
    assert manifest.matching(df, text="X", ready_only=True, expected=4).count() == 4 and services.merged({"s": df}).first().source_set == "s"
    with pytest.raises(ValueError):
        manifest.usable(df.where("status = 'pending'"))


def test_settings():
    assert settings.of_condition({"a": 1}, {"a": None}, "a") is None and settings.of_condition({"a": 1}, {}, "a") == 1
    assert settings.substituted("x:\n  top_p: 1 # c\n  seed: 3", {"top_p": 0.5, "seed": None}) == "x:\n  top_p: 0.5\n  seed: null"
    with pytest.raises(ValueError):
        settings.substituted("a: 1", {"b": 2})
    with pytest.raises(ValueError):
        settings.sampling({"top_p": 2})
    log = "engine temperature=0.50, top_p=1.0, top_k=0, min_p=0.0, seed=None"
    assert settings.in_log(log, settings.sampling({"temperature": 0.5})) and not settings.in_log(log, settings.sampling({"temperature": 0.6}))
    assert [settings.duration(x) for x in (65, 3725)] == ["01:05", "1:02:05"] and settings.duration(3725, True) == "1h02m05s"
    assert {settings.endpoint(u) for u in ("http://h", "http://h/v1/", "http://h/v1/chat/completions")} == {"http://h/v1/chat/completions"}
    assert settings.rebased("../audio/a.wav", "/r/x/m/m.jsonl", "/r", lambda p: p == "/r/x/m/../audio/a.wav") == "x/audio/a.wav" and settings.rebased("a", "/m", "/r", lambda p: False) == "a"
    config = {"engine": "Azure", "voices": [{"name": "v"}], "instructions": [{"name": "i", "ssml_template": "{text}"}]}
    assert settings.engine(config).instructions[0].parameters == {"ssml_template": "{text}"}
    for bad in ({"engine": "x"}, config | {"voices": []}, config | {"instructions": [{"name": "i", "instruct": "x"}]}, config | {"instructions": [{"name": "i"}, {"name": "i"}]}, {"engine": "qwen3-tts", "mode": "voice_design", "instructions": [{"name": "i"}]}):
        with pytest.raises(ValueError):
            settings.engine(bad)
    assert services.identity({"api_key": 1, "workers": 2, "rate": 3}) == {"rate": 3}
