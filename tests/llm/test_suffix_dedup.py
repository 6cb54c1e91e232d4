import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from mishear.llm import _arrow, ngram_join, suffix_dedup
from tests.llm.test_llm import ODD, passages


def brute(rows):
    """By place: (id, start) of a string's first; a null id is the least."""
    seen = {}
    data = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - 99):
            seen[b[s : s + 100]] = min(seen.get(b[s : s + 100], (i, s)), (i, s))
    out = []
    for (own, _), (i, b) in zip(rows, data):
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if seen[b[s : s + 100]] < (i, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((own, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan,part_bytes,hot", [(1024, 16 << 20, 20_000), (2, 2000, 20_000), (3, 1000, 3)])
def test_ids_that_are_null_or_repeat(spark, monkeypatch, fan, part_bytes, hot):
    monkeypatch.setattr(suffix_dedup, "FAN", fan)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part_bytes)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(fan)
    texts = passages(fan, 25) + ODD[:4] + ODD[6:9]
    rows = [(r.choice([None, *range(40)]), t) for t in texts] + [(None, texts[0]), (5, texts[1]), (5, texts[1]), (6, texts[1] + texts[2] * 2)]
    rows += [(None, texts[3])] * 50 + [(k, texts[4]) for k in range(100, 130)]
    docs = spark.createDataFrame([(i, t, "a", "b", 3) for i, t in rows], "doc_id long, text string, chunk string, copies string, N_bytes_ int")
    got = suffix_dedup.dedup(docs)
    assert {"chunk", "copies", "N_bytes_"} <= set(got.columns) and got.where("chunk <> 'a' or copies <> 'b'").count() == 0
    found = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()]
    assert sorted(found, key=str) == brute(rows)


def test_levels_cover_the_parts():
    assert suffix_dedup.split_in(1, 4) == [1] and suffix_dedup.split_in(4, 4) == [4]
    for parts in (5, 17, 100, 4097):
        levels = suffix_dedup.split_in(parts, 4)
        assert max(levels) <= 4 and parts <= int(__import__("math").prod(levels))


def made_chunk(size):
    r = random.Random(size)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    texts = [" ".join(r.choice(words) for _ in range(400)) for _ in range(size // 2800)]
    texts = [t + texts[0][:300] if k % 3 else t for k, t in enumerate(texts)]
    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "chunk": pa.array([0] * len(texts), pa.int32())})


def test_a_chunk_takes_few_bytes_of_memory_a_byte():
    table = made_chunk(4 << 20)
    size = sum(map(len, table["text"].to_pylist()))
    hashes = suffix_dedup.hashes_of_chunk(2)(table)
    told = suffix_dedup.answers(pa.concat_tables([hashes, hashes.set_column(1, "chunk", pa.array([1] * len(hashes), pa.int32()))]).filter(pc.field("part") == 0))
    ranges = suffix_dedup.merge_part(suffix_dedup.runs_of_chunk(2, [2])(table, told))
    for most, step, other in ((8, suffix_dedup.remove(["doc_id", "text"], True), ranges), (10, suffix_dedup.runs_of_chunk(2, [2]), hashes.slice(0, 0))):
        tracemalloc.start()
        try:
            step(table, other)
            assert tracemalloc.get_traced_memory()[1] < most * size
        finally:
            tracemalloc.stop()


def test_ranges_that_overlap_touch_or_repeat():
    r = np.random.default_rng(3)
    for n in (0, 1, 5, 60):
        first = r.integers(0, 800, n)
        end = first + r.choice([1, 3, 100, 400], n)
        want = np.zeros(1200, bool)
        for a, b in zip(first, end):
            want[a:b] = True
        assert (suffix_dedup.covered(1200, first, end) == want).all()


def test_a_worker_forgets_what_another_module_remembered():
    _arrow.begin("one")
    ngram_join._word("kept")
    _arrow.begin("one")
    assert ngram_join._word.cache_info().currsize == 1
    _arrow.begin("two")
    assert all(f.cache_info().currsize == 0 for f in _arrow.REMEMBERED) and len(_arrow.REMEMBERED) >= 3
