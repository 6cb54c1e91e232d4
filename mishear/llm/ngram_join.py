"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

A document's n-grams are the runs of five white-space-separated words of its
whole text (a shorter text is one n-gram), as 64-bit hashes: of m n-grams that
are compared, two different ones are taken for equal with a chance of m^2 / 2^65.
Documents with equal sets are copies; one row for each set, known by a 128-bit
digest, goes on.

1. Bands: rows for each band and their number are chosen for a target recall at
   the threshold (:func:`banding`). Within each input partition the sets of
   a bucket first link to their least digest, so that the shuffle on band hashes has
   at most one row for each bucket and task, however large the bucket.
2. Candidates: the connected components of bucket links. A component within
   ``GROUP_DOCS`` and ``GROUP_GRAMS`` is verified in one group. A larger one is
   split: a pair that shares a bucket within these bounds, and none beyond, is
   verified in the first such bucket. Sets that buckets beyond the bounds
   connect form a core, which is dealt out over blocks; each pair of blocks is
   a group.
3. Verification: sets are shipped as hashes. In a group, n-grams of two or more
   sets become columns of a bit matrix, and a set is compared with all
   candidates of higher number by counting common bits. Pairs are counted,
   never emitted as rows: a group gives, for each set, its number of links and
   the least digest it reaches.

The result has one row for each document: class_id (least id of its connected
component of links), copy_id (least id with the same n-grams), n_links (the
documents at or above the threshold, copies included), n_grams, digest (of its
n-gram set) and root (the least digest of its component).

Defined cases: null, empty and blank texts have the empty set, so they are
copies of each other and link to nothing else; a repeated row is a copy of
itself; rows of one id with different texts are different documents, so an id
may have several rows and classes; null ids link like others, and a class or
copy id is null only if all ids of it are; a very long text is one task's work;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mishear.llm._arrow import list_array, remembered, slices, tidy
from mishear.llm._cluster import checkpointed
from mishear.llm._components import components

WORDS, THRESHOLD = 5, 0.8
#: Recall of a pair at the threshold, and hash functions that may be spent on it.
RECALL, MOST_HASHES = 0.9999, 128
#: What one verification group holds at most, sets and n-grams.
GROUP_DOCS, GROUP_GRAMS = 256, 2_000_000
#: Blocks that a core is dealt out over at least, if it is large enough, and sets of a block at most.
CORE_BLOCKS, BLOCK_DOCS = 32, 2048
#: N-grams whose hashes are minimized at once, to stay in the cache, and bytes of a bit matrix.
BLOCK, MATRIX_BYTES = 1 << 15, 1 << 26
ODD = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which the bands that the recall needs fit ``most`` hashes."""
    best = (0, 0)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _multipliers(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * ODD) | np.uint64(1)


@remembered(100_000)
def _word(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def grams(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after the other, and where each text's begin."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words = parts.flatten()
    offsets = parts.offsets.to_numpy()
    offsets = offsets - offsets[0]
    some = pc.not_equal(words, "")
    offsets = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))[offsets]
    coded = words.filter(some).dictionary_encode()
    own = np.array(list(map(_word, coded.dictionary.to_pylist())), np.uint64)
    word = own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.empty(0, np.uint64)
    counts = np.diff(offsets)
    total = len(word)
    rolled = np.zeros(total, np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    left = offsets[1:][row] - np.arange(total)  # words from here to the end of the text
    with np.errstate(over="ignore"):
        for k in range(n):
            # a text of fewer than n words is one n-gram of all of them
            ahead = np.arange(k, total + k)
            ahead[ahead >= total] = 0
            rolled = rolled * ODD + np.where(left > k, word[ahead] if total else word, np.uint64(k + 1))
        rolled = _mixed(rolled)
    starts = (left >= n) | (np.arange(total) == offsets[:-1][row])
    row, rolled = row[starts], rolled[starts]
    order = np.lexsort((rolled, row))
    row, rolled = row[order], rolled[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (rolled[1:] != rolled[:-1])
    row, rolled = row[fresh], rolled[fresh]
    return rolled, np.append(0, np.cumsum(np.bincount(row, minlength=len(counts))))


def signatures(hashes: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (text, band) of texts; those of an empty set are 0."""
    counts = np.diff(offsets)
    out = np.zeros((len(counts), bands), np.uint64)
    some = np.flatnonzero(counts)
    multipliers = _multipliers(bands * rows)
    least = np.empty((bands * rows, len(some)), np.uint64)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(some):
            stop = max(first + 1, int(np.searchsorted(offsets[some], offsets[some[first]] + BLOCK)))
            own = hashes[offsets[some[first]] : offsets[some[stop - 1] + 1]]
            at = offsets[some[first:stop]] - offsets[some[first]]
            for j, m in enumerate(multipliers):
                least[j, first:stop] = np.minimum.reduceat(own * m, at)
            first = stop
        for b in range(bands):
            key = np.full(len(some), b + 1, np.uint64)
            for j in range(b * rows, (b + 1) * rows):
                key = _mixed(key * ODD + least[j])
            out[some, b] = key
    return out


def sign(bands: int, rows: int, n: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, offsets = grams(part.column("text"), n)
                keys = signatures(hashes, offsets, bands, rows).view(np.int64)
                digests = digests_of(hashes, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(np.diff(offsets)), list_array(keys.reshape(-1), np.arange(len(keys) + 1) * bands, pa.int64())],
                    names=["doc_id", "digest", "n_grams", "bands"],
                )

    return run


def digests_of(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    data = memoryview(np.ascontiguousarray(hashes)).cast("B")
    at = (8 * offsets).tolist()
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(at, at[1:])]


def digested(docs: DataFrame, text: str = "text", n: int = WORDS) -> DataFrame:
    """Adds ``digest``, that of the n-gram set of each row."""
    rows = docs.withColumn(text, F.col(text).cast("string"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch, text):
                digests = digests_of(*grams(part.column(text), n))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, part.num_rows).columns, pa.array(digests, pa.binary())], names=[*batch.schema.names, "digest"])
                at += part.num_rows

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("digest", T.BinaryType())]))


def _ranked(digests: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Each digest's number in the order of the distinct ones, and these."""
    coded = pa.chunked_array(digests, pa.binary()).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy(zero_copy_only=False)] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(order)


def _least_by(keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and ranks sorted, and the least rank of each key."""
    order = np.lexsort((ranks, keys))
    keys, ranks = keys[order], ranks[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys, ranks, ranks[first][np.cumsum(first) - 1] if len(ranks) else ranks


def _edges(u: np.ndarray, v: np.ndarray, own: pa.Array) -> pa.RecordBatch:
    pairs = np.unique((u * max(1, len(own)) + v)[u != v])
    u, v = np.divmod(pairs, max(1, len(own)))
    return pa.RecordBatch.from_arrays([own.take(pa.array(u)), own.take(pa.array(v))], names=["u", "v"])


def _stacked(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
    """Band keys and ranks of all rows of a partition, and the digests."""
    keys, counts, digests = [], [], []
    for batch in batches:
        own = batch.column("bands")
        keys.append(own.flatten().to_numpy(zero_copy_only=False))
        counts.append(pc.list_value_length(own).to_numpy(zero_copy_only=False))
        digests.append(batch.column("digest"))
    if not keys:
        return None
    ranks, own = _ranked(digests)
    return np.concatenate(keys), np.repeat(ranks, np.concatenate(counts)), own


@tidy
def near_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links to the least digest of a bucket within this partition."""
    if (found := _stacked(batches)) is not None:
        _, ranks, least = _least_by(*found[:2])
        yield _edges(ranks, least, found[2])


@tidy
def near_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least digest of each bucket within this partition."""
    if (found := _stacked(batches)) is not None:
        keys, ranks, least = _least_by(*found[:2])
        first = ranks == least
        yield pa.RecordBatch.from_arrays([pa.array(keys[first]), found[2].take(pa.array(ranks[first]))], names=["key", "digest"])


@tidy
def far_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links to the least digest of a bucket among those that partitions sent."""
    found = [(b.column("key").to_numpy(), b.column("digest")) for b in batches]
    if found:
        ranks, own = _ranked([d for _, d in found])
        _, ranks, least = _least_by(np.concatenate([k for k, _ in found]), ranks)
        yield _edges(ranks, least, own)


def reach(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number that each of n vertices reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


WHOLE, BUCKET, CORE = 0, 1, 2  # kinds of groups


def verify_group(sets: list[np.ndarray], bands: np.ndarray, large: np.ndarray, block: np.ndarray, kind: int, band: int, two: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (numbers u < v) of a group.

    Pairs share a band. In a bucket it is the first that they share, and they
    share none whose bucket is large; in a core they share one whose bucket is
    large, and if it has two blocks they lie in different ones.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    every = np.concatenate(sets)
    _, column, counts = np.unique(every, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    kept = shared[column]
    row, column = np.repeat(np.arange(n), sizes)[kept], number[column[kept]]
    width = int(shared.sum())
    step = max(64, MATRIX_BYTES * 8 // max(n, 1) // 64 * 64)
    order = np.argsort(column, kind="stable") if width > step else None
    candidates = []
    for i in range(n - 1):
        same = bands[i + 1 :] == bands[i]
        if kind == WHOLE:
            ok = same.any(axis=1)
        elif kind == BUCKET:
            ok = same[:, band] & ~same[:, :band].any(axis=1) & ~(same & large[i]).any(axis=1)
        else:
            ok = (same & large[i]).any(axis=1)
            if two:
                ok &= block[i + 1 :] != block[i]
        ok &= np.minimum(sizes[i + 1 :], sizes[i]) >= threshold * np.maximum(sizes[i + 1 :], sizes[i])
        candidates.append(np.flatnonzero(ok) + i + 1)
    common = [np.zeros(len(c), np.int64) for c in candidates]
    for first in range(0, width, step):
        if order is None:
            r, c = row, column
        else:
            a, b = np.searchsorted(column, [first, first + step], sorter=order)
            r, c = row[order[a:b]], column[order[a:b]] - first
        words = (min(step, width - first) + 63) // 64
        bits = np.zeros(n * words, np.uint64)
        np.bitwise_or.at(bits, r * words + c // 64, np.uint64(1) << (c % 64).astype(np.uint64))
        bits = bits.reshape(n, words)
        rows = max(1, (1 << 21) // words)
        for i, js in enumerate(candidates):
            for a in range(0, len(js), rows):
                own = js[a : a + rows]
                common[i][a : a + rows] += np.bitwise_count(bits[own] & bits[i]).sum(axis=1, dtype=np.int64)
    us, vs = [], []
    for i, (js, k) in enumerate(zip(candidates, common)):
        linked = js[k >= threshold * (sizes[js] + sizes[i] - k) - 1e-9]
        us.append(np.full(len(linked), i))
        vs.append(linked)
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, int), np.empty(0, int))


def hashed(n: int):
    """Replaces the text of rows by its n-gram hashes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, offsets = grams(part.column("text"), n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in MEMBER), list_array(hashes.view(np.int64), offsets, pa.int64())], names=[*MEMBER, "grams"])

    return run


#: A set that may have links: its digest, copies, band hashes, those of large buckets, and the groups that verify it.
MEMBER = ("digest", "copies", "bands", "large", "groups")
GROUP = "struct<kind:int,root:binary,key:bigint,band:int,i:int,j:int,block:int>"
MEMBER_SCHEMA = f"digest binary, copies long, bands array<long>, large array<boolean>, groups array<{GROUP}>"
GROUP_KEY = ["kind", "root", "key", "band", "i", "j"]


def verify(threshold: float):
    """Over rows sorted by group: (digest, root, links, whole) for each set and group."""

    def finish(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0])
        digests = [r[0] for r in rows]
        copies = np.array([r[1] for r in rows], np.int64)
        bands, large, block = np.stack([r[2] for r in rows]), np.stack([r[3] for r in rows]), np.array([r[4] for r in rows])
        u, v = verify_group([r[5] for r in rows], bands, large, block, key[0], key[3], key[4] != key[5], threshold)
        n = len(rows)
        links = (np.bincount(u, copies[v], n) + np.bincount(v, copies[u], n)).astype(np.int64)
        roots = [digests[k] for k in reach(n, u, v).tolist()]
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(roots, pa.binary()), pa.array(links), pa.array([key[0] == WHOLE] * n)], names=["digest", "root", "links", "whole"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            lists = [batch.column(c) for c in ("bands", "large", "grams")]
            bands, large = (x.flatten().to_numpy(zero_copy_only=False).reshape(m, -1) for x in lists[:2])
            at = lists[2].offsets.to_numpy()
            at, sets = at - at[0], lists[2].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            digests, copies, block = (batch.column(c).to_pylist() for c in ("digest", "copies", "block"))
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in GROUP_KEY))):
                if key != now:
                    if len(rows) > 1:
                        yield finish(now, rows)
                    now, rows = key, []
                rows.append((digests[k], copies[k], bands[k].copy(), large[k].copy(), block[k], sets[at[k] : at[k + 1]].copy()))
        if len(rows) > 1:
            yield finish(now, rows)

    return run


def _group(kind: int, **values) -> Column:
    none = {"root": F.lit(b""), "key": F.lit(0).cast("long"), "band": F.lit(-1), "i": F.lit(0), "j": F.lit(0), "block": F.lit(0)}
    return F.struct(F.lit(kind).alias("kind"), *(c.alias(k) for k, c in (none | values).items())).cast(GROUP)


def _groups_of_large(large: DataFrame) -> DataFrame:
    """Members (MEMBER) of components beyond the bounds (digest, copies, n_grams, bands)."""
    own = large.select("digest", "n_grams", F.posexplode("bands").alias("band", "key"))
    buckets = own.groupBy("key", "band").agg(F.count("*").alias("docs"), F.sum("n_grams").alias("grams"), F.min("digest").alias("least")).where("docs > 1")
    beyond = (F.col("docs") > GROUP_DOCS) | (F.col("grams") > GROUP_GRAMS)
    held = checkpointed(own.join(buckets.select("key", "band", "least", beyond.alias("large")), ["key", "band"]))
    roots = components(held.where("large").select(F.col("digest").alias("u"), F.col("least").alias("v"))).withColumnRenamed("id", "digest")
    cores = checkpointed(roots.join(large.select("digest", "n_grams"), "digest"))
    sizes = cores.groupBy("root").agg(F.count("*").alias("docs"), F.sum("n_grams").alias("grams"))
    most = lambda count, of: F.ceil(F.col(count) / F.lit(of))
    blocks = F.greatest(most("docs", BLOCK_DOCS), most("grams", GROUP_GRAMS // 2), F.least(most("docs", max(1, GROUP_DOCS // 2)), F.lit(CORE_BLOCKS))).cast("int")
    cores = cores.join(sizes.select("root", blocks.alias("blocks")), "root")
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    with_each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: _group(CORE, root=F.col("root"), i=F.least(block, o), j=F.greatest(block, o), block=block))
    of_core = cores.select("digest", with_each.alias("in_core"))
    small = F.when(~F.col("large"), _group(BUCKET, key=F.col("key"), band=F.col("band")))
    by_set = held.groupBy("digest").agg(F.collect_list(small).alias("in_buckets"), F.collect_list(F.when(F.col("large"), F.col("band"))).alias("bands_beyond"))
    joined = large.join(by_set, "digest").join(of_core, "digest", "left")
    flags = F.transform("bands", lambda _, k: F.array_contains("bands_beyond", k))
    none = F.array().cast(f"array<{GROUP}>")
    return joined.select("digest", "copies", "bands", flags.alias("large"), F.concat("in_buckets", F.coalesce("in_core", none)).alias("groups"))


def join(docs: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links, n_grams, digest, root) of each row."""
    spark = docs.sparkSession
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands, rows = banding(threshold, recall)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = checkpointed(texts.mapInArrow(sign(bands, rows, n), "doc_id long, digest binary, n_grams long, bands array<long>"))
    # ids that do not name one row: null, or repeated
    per_id = signed.groupBy("doc_id").agg(F.count("*").alias("rows"))
    odd = checkpointed(per_id.where("doc_id IS NULL OR rows > 1").select("doc_id", F.lit(True).alias("odd")))
    has_odd = not odd.isEmpty()
    known = signed.join(odd, "doc_id", "left") if has_odd else signed.withColumn("odd", F.lit(None).cast("boolean"))
    holder = F.min(F.when(F.col("odd").isNull(), F.col("doc_id")))  # null for a null id
    sets = known.groupBy("digest").agg(
        F.min("doc_id").alias("id"), holder.alias("holder"), F.count("*").alias("copies"), F.max("n_grams").alias("n_grams"), F.min("bands").alias("bands")
    )
    sets = checkpointed(sets)
    full = sets.where("n_grams > 0").select("digest", "bands")
    buckets = full.mapInArrow(near_buckets, "key long, digest binary").repartition(deal, "key")
    links = full.mapInArrow(near_links, "u binary, v binary").unionByName(buckets.mapInArrow(far_links, "u binary, v binary"))
    members = checkpointed(components(links).withColumnRenamed("id", "digest").join(sets, "digest"))
    totals = checkpointed(members.groupBy("root").agg(F.count("*").alias("docs"), F.sum("n_grams").alias("grams")))  # apart, so that the join can split a root
    members = checkpointed(members.join(totals, "root"))
    fits = (F.col("docs") <= GROUP_DOCS) & (F.col("grams") <= GROUP_GRAMS)
    none = F.transform("bands", lambda _: F.lit(False))
    placed = members.where(fits).select("digest", "copies", "bands", none.alias("large"), F.array(_group(WHOLE, root=F.col("root"))).alias("groups"))
    large = members.where(~fits).select("digest", "copies", "n_grams", "bands")
    split = not large.isEmpty()
    if split:
        placed = checkpointed(placed.unionByName(_groups_of_large(large)))
    held = members.select("digest", "holder")
    by_id = texts.join(held.where("holder IS NOT NULL"), texts["doc_id"] == F.col("holder")).select("digest", "text")
    if has_odd:
        loose = texts.join(F.broadcast(odd.where("doc_id IS NULL").limit(1).select(F.lit(True).alias("some"))), texts["doc_id"].isNull(), "left_semi")
        loose = loose.unionByName(texts.join(odd, "doc_id").drop("odd"))
        loose = digested(loose, n=n).groupBy("digest").agg(F.min("text").alias("text"))
        by_id = by_id.unionByName(loose.join(held.where("holder IS NULL").select("digest"), "digest").select("digest", "text"))
    rows_of = by_id.join(placed, "digest").mapInArrow(hashed(n), MEMBER_SCHEMA + ", grams array<long>")
    grouped = rows_of.select("digest", "copies", "bands", "large", "grams", F.inline("groups"))
    verified = grouped.repartition(deal, *GROUP_KEY).sortWithinPartitions(*GROUP_KEY).mapInArrow(verify(threshold), "digest binary, root binary, links long, whole boolean")
    verified = checkpointed(verified)
    found = verified.groupBy("digest").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if split:  # components that were verified in parts grow together
        whole = components(verified.where("NOT whole").select(F.col("digest").alias("u"), F.col("root").alias("v"))).select(F.col("id").alias("digest"), F.col("root").alias("top"))
        found = found.join(whole, "digest", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
    classes = sets.select("digest", "id", "copies").join(found, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    classes = checkpointed(classes)
    names = checkpointed(classes.groupBy("root").agg(F.min("id").alias("class_id")))
    classes = classes.join(names, "root")
    return signed.select("doc_id", "digest", "n_grams").join(classes, "digest").select(
        "doc_id",
        "class_id",
        F.col("id").alias("copy_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "n_grams",
        "digest",
        "root",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("digest", "root")
