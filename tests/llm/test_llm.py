import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from mishear.llm import html_text, ngram_join, packing, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, tiff, toxicity, url_filter
from mishear.llm._components import components

ODD = [None, "", " ", "a", "word " * 3000, "x" * 5000, "same text of some words here", "same text of some words here", "é😀\n\n ß\x00", "the of and " * 40]


def docs_of(spark, texts):
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")


def passages(seed=0, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 7)))
    base = [" ".join(word() for _ in range(r.randint(5, 120))) for _ in range(12)]
    out = []
    for _ in range(n):
        t = r.choice(base) + " " + r.choice(base)
        if r.random() < 0.5:
            w = t.split()
            w[r.randrange(len(w))] = word()
            t = " ".join(w)
        out.append(t)
    return out + ["é" * 80 + "x", "y" + "é" * 80, "z" * 300, "z" * 150, "", None]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_codec_agrees_with_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for t in ODD + passages()] + ["  two  spaces ", "日本語 テスト\n\tx", "<s> </s> <0x0A>", "don't, (stop)."]
    ids, at = codec.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t) for t in texts]
    assert [x.decode() for x in codec.decode(ids, at)] == texts


def test_codec_searches_unigram_models():
    codec = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    codec.kind = sentencepiece_codec.UNIGRAM
    word = "▁therein"
    (got,) = codec.search([word])

    def best(s):  # all segmentations
        found = [(codec.scores[codec.ids[s]], [codec.ids[s]])] if s in codec.ids else []
        return max(found + [(codec.scores[codec.ids[s[:i]]] + best(s[i:])[0], [codec.ids[s[:i]], *best(s[i:])[1]]) for i in range(1, len(s)) if s[:i] in codec.ids])

    assert np.frombuffer(got, "<u4").tolist() == best(word)[1]


def test_encode_and_decode(spark, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_codec.encode(docs_of(spark, ODD), path)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(coded, path).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert sentencepiece_codec.encode(empty, path).count() == 0


def brute_dedup(texts):
    seen, out = {}, {}
    data = {i: (t or "").encode() for i, t in enumerate(texts)}
    for i, b in sorted(data.items()):
        for s in range(len(b) - 99):
            seen.setdefault(b[s : s + 100], (i, s))
    for i, b in data.items():
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if seen[b[s : s + 100]] < (i, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 0])
def test_suffix_dedup(spark, empty, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = passages(1) + ODD
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs_of(spark, texts)).collect()}
    assert got == brute_dedup(texts)
    assert suffix_dedup.dedup(empty).count() == 0


def test_loser_tree_merges_sorted_runs():
    r = random.Random(5)
    items = [[bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 30))] for _ in range(7)]
    items = [sorted(x) for x in items]
    runs = [(x, suffix_dedup.sorted_run(x)[1]) for x in items]
    order, prefix = suffix_dedup.merged(runs)
    flat = [s for x in items for s in x]
    out = [flat[i] for i in order]
    assert out == sorted(flat)
    assert prefix.tolist() == [suffix_dedup.common(a, b) for a, b in zip([b"", *out], out)]


PAGE = """<html><head><title>t</title><script>var a="</p>"</script></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, sorry.</div>
<article><h1>Head &amp; more</h1><p>First  block,
with text.<p><b>Second, <i>one</b>.<br>Line.</p><div class="ad">Buy, now.</div><ul><li>One item, here<li>Two</ul></article>
<section id="comments"><p>Great, read. I, agree.</p></section><form>Name <input></form><footer>&copy; x</footer>"""


def test_html_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "u", "<p>only &lt;this&gt;"), (5, "u", "<div><nav>x</nav>"), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()]
    text = "Head & more\n\nFirst block, with text.\n\nSecond, one. Line.\n\nOne item, here\n\nTwo"
    assert got == [(1, text, len(text)), (2, "", 0), (3, "", 0), (4, "only <this>", 11), (5, "", 0), (1, text, len(text))]


def test_url_filter(spark):
    urls = ["http://a.NET/x", "https://m.example.net/en/1", "http://example.com/de/2?q", "http://example.com/fr", "http://x.org/fr/#a", "http://notexample.com/de/", "no scheme", None, "http://net", "x://y.net?/", "http://example.com/dex"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark, pages).collect()}
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": list(range(len(urls))), "url": urls}))
    assert got == {r[0]: r[1:] for r in con.execute(url_filter.SQL).fetchall()}
    assert got[0][2:] == ("net/", "block") and got[1][2:] == ("example.net/en/", "allow") and got[7] == ("", "", None, "allow")


def test_packing(spark, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = passages(2) + ODD + ["ΑΣ. it's <|endoftext|> 12\x0bfoo\x85bar"]
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    rows = packing.pack(docs_of(spark, texts), path).collect()
    used, parts = {}, {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.setdefault(r.doc_id, []).append(r.piece)
    assert {d: len(x) for d, x in want.items()} == {d: sum(r.length for r in rows if r.doc_id == d) for d in want}
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert all(sorted(p) == list(range(len(p))) for p in parts.values())
    assert packing.pack(empty, path).count() == 0


def test_best_fit_equals_best_fit_over_pieces():
    r = random.Random(4)
    for _ in range(20):
        lengths = [r.randint(1, 50) for _ in range(r.randint(1, 200))]
        slots = packing.best_fit(Counter(lengths), 50)
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = min((k for k, room in enumerate(bins) if room >= n), key=lambda k: bins[k], default=None)
            if fit is None:
                bins.append(50)
                fit = len(bins) - 1
            bins[fit] -= n
        used: Counter = Counter()
        ranges = sorted(slots)
        for k, (n, rank, first, per, _) in enumerate(ranges):
            end = ranges[k + 1][1] if k + 1 < len(ranges) and ranges[k + 1][0] == n else lengths.count(n)
            for i in range(end - rank):
                used[first + i // per] += n
        assert sum(used.values()) == sum(lengths) and max(used.values()) <= 50
        assert sorted(used.values()) == sorted(50 - room for room in bins)


def graded(n, grades, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        g = r.randrange(grades)
        words = [r.choice(["plain", "words", "go", "here"]) + ("$$" if r.random() > g / (grades - 1) else "") for _ in range(60)]
        rows.append((i, " ".join(words), g))
    return rows


def test_ordinal_grades(spark, empty):
    rows = graded(400, 4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:300]] + [(5, None), (10**6, 1)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    got = {r.doc_id: r.expected_grade for r in quality_classifier.score(docs, model, wanted=2).collect()}
    error = np.mean([abs(got[i] - g) for i, _, g in rows[300:]])
    assert error < 0.5
    odd = quality_classifier.score(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and [r.text for r in odd] == ODD
    assert quality_classifier.score(empty, model).count() == 0
    none = quality_classifier.train(docs, labels.limit(0))
    assert quality_classifier.score(docs, none).where("not kept").count() == 0


def test_toxicity_chain(spark, empty):
    r = random.Random(1)
    rows = []
    for i in range(600):
        toxic, junk = r.random() < 0.3, r.random() < 0.2
        words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(50)] + (["nasty"] if toxic else []) + (["$$$"] * 5 if junk else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), int(not junk), int(toxic)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2], x[3]) for x in rows[:450]], "doc_id long, quality int, toxic int")
    links = toxicity.train(docs, labels)
    assert len(links[1].earlier) == 1
    got = {x.doc_id: x.toxic for x in toxicity.score(docs, links, ["low_quality", "toxic"]).collect()}
    assert np.mean([got[x[0]] == bool(x[3]) for x in rows[450:]]) > 0.97
    assert toxicity.score(docs_of(spark, ODD), links, ["low_quality", "toxic"]).count() == len(ODD)
    assert toxicity.score(empty, links, ["low_quality", "toxic"]).count() == 0


def test_quality_rules(spark, empty):
    texts = ODD + passages(3) + ["a b c a b c\na b c\n\na b c\n" + "w " * 60, "One | two | three | " * 30]
    got = quality_rules.judge(docs_of(spark, texts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(quality_rules.SQL).fetchall())
    assert quality_rules.judge(empty).where("kept").count() == 0


def test_tiff_round_trips(spark):
    r = random.Random(1)
    for n in (0, 1, 2, 3, 127, 128, 129, 5000):
        for alphabet in (1, 2, 256):
            data = bytes(r.randrange(alphabet) for _ in range(n))
            assert tiff.unpack_bits(tiff.pack_bits(data), n) == data
            assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
    payload = tiff.payload_of(bytes(r.randrange(256) for _ in range(900_000)))
    stored = tiff.write(payload)
    files = [(1, bytearray(stored)), (2, None), (3, bytearray(b"no image")), (4, bytearray(stored[: len(stored) // 2])), (1, bytearray(stored))]
    rows = tiff.pages(spark.createDataFrame(files, "media_id long, content binary")).collect()
    own = [x for x in rows if x.media_id == 1]
    assert len(own) == 4 and b"".join(bytes(x.pixels) for x in own[:2]) == payload
    assert all(x.error for x in rows if x.media_id in (2, 3, 4) and not x.pixels)
    (none,) = tiff.digests(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([7]), "text": pa.array([None], pa.string())})]))
    assert none.to_pylist()[0]["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest()


def brute_links(texts):
    sets = []
    for t in texts:
        w = (t or "").replace("\x00", "\x00").split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(sets)
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (root(i), links[i]) for i in range(n)}


@pytest.mark.parametrize("most", [ngram_join.GROUP_DOCS, 2])
def test_ngram_join(spark, empty, most, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_DOCS", most)
    texts = passages(4) + ODD
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(docs_of(spark, texts)).collect()}
    assert got == brute_links(texts)
    assert ngram_join.join(empty).count() == 0


def test_banding_reaches_the_recall():
    bands, rows = ngram_join.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= ngram_join.MOST_HASHES


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {k: 100 for k in range(100, 140)}


def test_pipeline_stages_act_on_what_is_left(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    kept = pipeline.apply_rules(spark, docs, sf)
    assert kept.columns == docs.columns
    near = pipeline.drop_near_copies(spark, kept, sf).cache()
    texts = [r.text for r in kept.orderBy("doc_id").collect()]
    ids = [r.doc_id for r in kept.orderBy("doc_id").collect()]
    assert sorted(r.doc_id for r in near.collect()) == sorted({ids[v[0]] for v in brute_links(texts).values()})
    packed = pipeline.run(spark, sf)
    assert packed.count() > 0 and packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "un deux trois quatre cinq six")
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b), (4, c), (5, c + " sept"), (5, a), (5, a), (6, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = pipeline.drop_near_copies(spark, docs, "")
    assert near.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in near.collect()) == [(1, a), (3, b), (4, c), (5, c + " sept"), (6, "")]
    twice = pipeline.drop_near_copies(spark, docs.unionByName(docs), "")
    assert twice.count() == 5
    single = pipeline.drop_near_copies(spark, docs.where("doc_id in (2, 4)"), "")
    assert sorted(r.doc_id for r in single.collect()) == [2, 4]


def test_all_of_a_long_token_is_hashed():
    from mishear.llm import _hashed

    shape = lambda *texts: _hashed.Tokens(pa.array(list(texts)))
    a, b = "a.b;" * 20 + "x=1", "a.b;" * 20 + "X=$"
    one, other = shape(a), shape(b)
    assert len(one.shape) == 7 and one.shape[:6].tolist() == other.shape[:6].tolist() and one.shape[6] != other.shape[6]
    features = [dict(zip(*quality_classifier.frequencies(pa.array([x]))[1:])) for x in (a, b)]
    assert features[0] != features[1]
    mixed, short = shape("be " + a + " " + a + " it", "", "to be"), shape("be it", "to be")
    assert mixed.offsets.tolist() == [0, 16, 16, 18] and np.diff(mixed.rows()).tolist() == [0] * 15 + [2, 0]
    assert (mixed.shape[0], mixed.word[0], mixed.word[15]) == (short.shape[0], short.word[0], short.word[1])
    again = mixed.pairs()[1]
    assert again[8] == again[14] != again[1] == again[7] == again[15]
    assert short.again is None and short.shape.tolist() == mixed.shape[[0, 15, 16, 17]].tolist()
