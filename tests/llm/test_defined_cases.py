"""Nulls, repeats, long texts, empty tables and columns whose names clash, for operators over documents."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from mishear.llm import ngram_join, packing, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, toxicity, url_filter
from mishear.llm._arrow import SLICE_BYTES

LONG = " ".join(f"word{k % 9973} of, a Straße." for k in range(160_000))  # beyond the bound of a slice
ROWS = [(1, LONG), (1, LONG), (None, LONG + " end"), (2, None), (2, None), (None, ""), (3, "short one"), (3, "other text"), (4, "short one")]
CLASH = "whole_text words lines hashes windows chunk copies part N_WORDS kept digest root grp salt rank piece index bands expected_grade toxic Rule verdict found_verdict host".split()


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG.encode()) > SLICE_BYTES
    rows = spark.createDataFrame([(i, t, *(f"{c}!" for c in CLASH)) for i, t in ROWS], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH))
    return rows.cache()


def kept(df, outputs):
    """Columns that are no output stay as they were."""
    own = [c for c in CLASH if c.lower() not in {o.lower() for o in outputs}]
    assert all(row[c] == f"{c}!" for row in df.select(*(f"`{c}`" for c in own)).collect() for c in own), own


def test_quality_rules(spark, docs):
    got = quality_rules.judge(docs)
    kept(got, ["n_words", "kept"])
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in ROWS], "text": [t for _, t in ROWS]}))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, con.execute(quality_rules.SQL).fetchall()))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in {t for _, t in ROWS}}
    want = sorted((str(i), p, min(2048, len(ids[t]) - p * 2048), zlib.crc32(np.array(ids[t][p * 2048 : p * 2048 + 2048], "<u4").tobytes())) for i, t in ROWS for p in range(-(-len(ids[t]) // 2048)))
    rows = packing.pack(docs, path).collect()
    assert sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in rows) == want
    assert not packing.tokenizer_of(path).whole and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_codec(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_codec.encode(docs, path).collect()
    want = {t: library.encode(t or "") for t in {t for _, t in ROWS}}
    assert sorted(str((r.doc_id, zlib.crc32(str(r.ids).encode()))) for r in got) == sorted(str((i, zlib.crc32(str(want[t]).encode()))) for i, t in ROWS)
    odd = spark.createDataFrame([(1, [5, -1, 10**6, None]), (2, None), (2, None)], "doc_id long, ids array<int>")
    assert [r.text.count("\u2047") for r in sentencepiece_codec.decode(odd, path).orderBy("doc_id").collect()] == [3, 0, 0]
    codec = sentencepiece_codec.Codec(path)
    texts = ["a\x00b c", "plain words here", "x" * 20_000, "\x01\x02"]
    ids, at = codec.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t) for t in texts]


def test_classifiers(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 1), (3, 1, 1), (3, None, 1), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    scored = quality_classifier.score(docs, quality_classifier.train(docs, labels))
    kept(scored, ["expected_grade", "kept"])
    assert scored.count() == len(ROWS) and len({r.expected_grade for r in scored.where("text IS NULL OR text = ''").collect()}) == 1
    links = toxicity.train(docs, labels)
    rows = toxicity.score(docs, links, ["low_quality", "toxic"]).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.p_toxic <= 1 for r in rows)
    assert len({r.p_toxic for r in rows if r.doc_id == 2}) == 1


def test_url_filter(spark):
    url = "http://a.net/" + "x" * 100_000
    rows = [(1, "http://a.net/x", "k"), (1, "http://a.net/x", "k"), (None, None, "k"), (None, None, "k"), (2, url, "k"), (3, "http://b.org/fr/", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, found_verdict string")
    got = url_filter.judge(spark, pages)
    assert sorted((str(r.page_id), len(r.url or ""), r.rule, r.verdict, r.found_verdict) for r in got.collect()) == sorted((str(i), len(u or ""), None if u is None else "org/fr/" if i == 3 else "net/", "allow" if u is None or i == 3 else "block", k) for i, u, k in rows)
    assert url_filter.judge(spark, pages.limit(0)).count() == 0
    named = pages.withColumn("Rule", pages.found_verdict)
    assert url_filter.judge(spark, named).where("rule = 'k'").count() == 0
    assert url_filter.judge(spark, pages, [("block", "b.org", "/"), ("allow", "b.org", "/")]).where("page_id = 3").first().verdict == "block"


def test_long_copies(spark, docs):
    cut = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.dedup(docs).collect()}
    n = len(LONG.encode())
    assert cut[None, n + 4] < n and cut[1, n] == n  # the null id is the least
    rows = ngram_join.join(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in rows) == sorted([("1", "1", 2), ("1", "1", 2), ("None", "1", 2), ("2", "2", 2), ("2", "2", 2), ("None", "2", 2), ("3", "3", 1), ("3", "3", 0), ("4", "3", 1)])
