"""Suffix-array dedup: every byte of a repeated 100-byte string goes, but for the first.

Texts are UTF-8 bytes. A byte is removed if some ``LENGTH``-byte string over it
also starts earlier: in a document with a smaller doc_id, or earlier in the
same one. Strings are judged on the input; matches never cross documents.

A full suffix array of the corpus would move many times its size, so suffixes
are sampled without loss. Each 100-byte window elects an anchor, the 32-byte
string in it with the least hash (leftmost on ties). Equal windows elect the
same anchor at the same place, so only suffixes at anchors, one in about 35,
have to meet, and of these only those whose anchor occurs elsewhere:

1. Documents are dealt to chunks by a hash of their id and text, a chunk to each
   partition; this is the one time that texts are shuffled. A chunk sends the
   distinct hashes of its anchors; the answer is which of them other chunks have too.
2. A chunk resolves repeats among its own windows. Of the rest it sends, for
   each anchor that other chunks have, the suffix at the anchor and the reversed
   prefix before it, as far as its windows reach, in sorted and front-coded runs.
3. Runs of all chunks are combined with loser trees that start each comparison
   behind the prefix already known to be common. The order and the common
   prefix lengths say which windows are equal: those whose suffixes agree on
   100 - r bytes and whose reversed prefixes agree on r. All but the first of
   equal windows go back to their chunks as ranges. The parts grow in number with
   the corpus; where they are more than ``FAN``, runs are merged in levels, each
   task merging some chunks' runs of one part and splitting the result further.
4. Chunks remove what the ranges cover.

Hash collisions cost work, never results: windows are compared byte by byte. A
chunk sends one of equal strings, so a passage copied without end costs one
record a chunk; an anchor that has over ``HOT`` records with different
surroundings is dealt out window by window instead, by a hash of the window.

Defined cases: a null text is an empty one; a null doc_id is the least id
(-2^63); shorter texts than 100 bytes stay whole; rows that repeat a doc_id count
as one document (equal places are not earlier than each other), and equal rows
are worked on once, so that one id, null or not, may hold any share of the rows;
a very long text is one task's work, at some ten bytes of memory a byte; an empty
table gives no rows; further columns stay, but for those named like an output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mishear.llm._arrow import tidy
from mishear.llm._cluster import unused

#: Bytes of a repeated string, and of an anchor.
LENGTH, ANCHOR = 100, 32
#: Bytes of text in a chunk, and window starts that are hashed at once (a power of two bounds them).
CHUNK_BYTES, BLOCK_BITS = 6 << 20, 18
#: Bytes of text for each part of the merge, text that is worth a task of its own, and parts that runs are split into at once.
PART_BYTES, TASK_BYTES, FAN = 16 << 20, 1 << 20, 1024
#: The id that a null one counts as.
NO_ID = -(1 << 63)
#: Records of one anchor above which its windows are dealt out.
HOT = 20_000
WINDOW = LENGTH - ANCHOR + 1  # anchors in a window
PARTS = "part int, chunk int, kind int, data binary"


# packing arrays into one compressed value


def packed(*arrays: np.ndarray) -> bytes:
    head = pa.array([len(arrays), *(a.nbytes for a in arrays)], pa.int64()).to_numpy().tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


# chunks and anchors


class Chunk:
    """The documents of a chunk in the order of id and text, as one run of bytes."""

    def __init__(self, table: pa.Table):
        texts = pc.fill_null(table["text"].cast(pa.large_binary()), b"")
        ids = pc.fill_null(table["doc_id"], NO_ID)
        order = pc.sort_indices(pa.table({"d": ids, "t": texts}), sort_keys=[("d", "ascending"), ("t", "ascending")])
        self.order = order
        own = texts.take(order).combine_chunks()
        del texts
        if isinstance(own, pa.ChunkedArray):
            own = pa.concat_arrays(own.chunks) if own.num_chunks else pa.array([], pa.large_binary())
        self.bounds = np.append(0, np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64)))
        at = int(np.frombuffer(own.buffers()[1], np.int64, 1, 8 * own.offset)[0]) if len(own) else 0
        self.raw = own.buffers()[2].slice(at, int(self.bounds[-1])).to_pybytes() if self.bounds[-1] else b""
        self.data = np.frombuffer(self.raw, np.uint8)
        self.ids = ids.take(order).to_numpy()

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, side="right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and hashes of anchors, with the first and last window start that elects each."""
        size, step = len(self.data), (1 << BLOCK_BITS) - 2 * LENGTH
        found = []
        for first in range(0, max(0, size - LENGTH + 1), step):
            stop = min(first + step, size - LENGTH + 1)
            found.append(self._block(first, stop))
        if not found:
            return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _block(self, first: int, stop: int) -> tuple[np.ndarray, ...]:
        own = self.data[first : stop + LENGTH - 1]
        x = own.astype(np.uint64)
        for shift in (1, 2, 4):  # the 8 bytes from each place on
            x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
        n = len(own) - ANCHOR + 1
        h = x[:n] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(8, ANCHOR, 8):
            h ^= h >> np.uint64(29)
            h += x[k : k + n]
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        places = np.arange(n, dtype=np.uint64)
        low = np.uint64((1 << BLOCK_BITS) - 1)
        least = (h & ~low) | places
        width = 1
        while 2 * width <= WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < WINDOW:
            least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
        elected = (least & low).astype(np.int64)[: stop - first]
        # windows within a document
        docs = self.doc(np.array([first, stop - 1]))
        valid = np.ones(stop - first, bool)
        for end in self.bounds[docs[0] + 1 : docs[1] + 2].tolist():
            a, b = max(first, end - LENGTH + 1), min(end, stop)
            if a < b:
                valid[a - first : b - first] = False
        starts = np.flatnonzero(valid)
        elected = elected[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (elected[1:] != elected[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(starts)) - 1 if len(begin) else begin
        at = elected[begin]
        return at + first, h[at], starts[begin] + first, starts[end] + first


class Records:
    """Anchors with the windows to judge: suffix, reversed prefix, order and first and last shift.

    The shift r of a window is how far before the anchor it starts.
    """

    def __init__(self, doc: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.doc, self.place, self.least, self.most = doc, place, least, most


def strings(chunk: Chunk, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Suffixes at anchors and reversed prefixes before them, as far as the windows reach."""
    data = chunk.raw
    right = [data[a:b] for a, b in zip(at.tolist(), (last + LENGTH).tolist())]
    left = [data[a:b][::-1] for a, b in zip(first.tolist(), at.tolist())]
    return right, left


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n - 1  # the first difference lies in [low, high]
    while low < high:
        middle = (low + high) // 2
        if a[low : middle + 1] == b[low : middle + 1]:
            low = middle + 1
        else:
            high = middle
    return low


def sorted_run(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``items`` and the common prefix of each with the one before it."""
    order = sorted(range(len(items)), key=items.__getitem__)
    prefix = np.zeros(len(items), np.uint8)
    before = b""
    for k, i in enumerate(order):
        own = items[i]
        prefix[k] = common(before, own)
        before = own
    return np.array(order, np.int64), prefix


def front_coded(items: list[bytes], order: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common prefix lengths, lengths and the rest of the bytes of a sorted run."""
    rest = b"".join(items[i][p:] for i, p in zip(order.tolist(), prefix.tolist()))
    return prefix, np.array([len(items[i]) for i in order.tolist()], np.uint8), np.frombuffer(rest, np.uint8)


def front_decoded(prefix: np.ndarray, lengths: np.ndarray, rest: np.ndarray) -> list[bytes]:
    data, at, before, out = rest.tobytes(), 0, b"", []
    for p, n in zip(prefix.tolist(), lengths.tolist()):
        before = before[:p] + data[at : at + n - p]
        at += n - p
        out.append(before)
    return out


def merged(runs: list[tuple[list[bytes], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Positions, counted through all runs, in sorted order, and common prefixes with the one before.

    A loser tree over the runs. A run's candidate knows its common prefix with
    the last output. Of two candidates the one with the longer such prefix comes
    first; only on a tie are bytes compared, from behind that prefix on.
    """
    bases = np.cumsum([0, *(len(s) for s, _ in runs)]).tolist()
    n_runs, total = len(runs), bases[-1]
    order, prefix = np.empty(total, np.int64), np.empty(total, np.uint8)
    if n_runs == 1:
        order[:], prefix[:] = np.arange(total), runs[0][1]
        return order, prefix
    items, prefixes = [s for s, _ in runs], [p.tolist() for _, p in runs]
    at = [0] * n_runs
    now: list[bytes | None] = [s[0] if s else None for s in items]
    known = [0] * n_runs

    def loses(a: int, b: int) -> bool:
        """Whether run a's candidate comes after run b's; the loser learns its prefix with the winner."""
        x, y = now[a], now[b]
        if x is None or y is None:
            return x is None
        if known[a] != known[b]:
            return known[a] < known[b]
        k = common(x, y, known[a])
        later = x[k:] > y[k:] or (x[k:] == y[k:] and a > b)
        known[a if later else b] = k
        return later

    tree = [-1] * n_runs
    champion = -1
    for run in range(n_runs):  # each enters at its leaf and waits at the first empty node
        node, winner = (run + n_runs) // 2, run
        while node:
            if tree[node] < 0:
                tree[node] = winner
                winner = -1
                break
            if loses(winner, tree[node]):
                tree[node], winner = winner, tree[node]
            node //= 2
        if winner >= 0:
            champion = winner
    for k in range(total):
        run = champion
        i = at[run]
        order[k] = bases[run] + i
        prefix[k] = known[run]
        at[run] = i = i + 1
        if i < len(items[run]):
            now[run], known[run] = items[run][i], prefixes[run][i]
        else:
            now[run], known[run] = None, 0
        node, winner = (run + n_runs) // 2, run
        while node:
            if loses(winner, tree[node]):
                tree[node], winner = winner, tree[node]
            node //= 2
        champion = winner
    return order, prefix


def repeats(rec: Records, right: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(record, shift) of each window that an equal one precedes.

    ``right`` and ``left``: order and common prefixes of suffixes and reversed prefixes.
    """
    n = len(rec.doc)
    # number records in the order of (document, place); equal places share a rank
    by_place = np.lexsort((rec.place, rec.doc))
    moved = np.ones(n, bool)
    moved[1:] = (rec.doc[by_place][1:] != rec.doc[by_place][:-1]) | (rec.place[by_place][1:] != rec.place[by_place][:-1])
    rank = np.cumsum(moved)
    right_at, left_at = np.empty(n, np.int64), np.empty(n, np.int64)
    right_at[right[0]], left_at[left[0]] = np.arange(n), np.arange(n)
    right_at, left_at = right_at[by_place], left_at[by_place]
    least, most = rec.least[by_place], rec.most[by_place]
    records, shifts = [], []
    for r in range(int(least.min(initial=LENGTH)), int(most.max(initial=-1)) + 1):
        active = np.flatnonzero((least <= r) & (r <= most))
        if len(active) < 2:
            continue
        suffix = np.cumsum(right[1] < LENGTH - r)[right_at[active]]
        key = suffix if r == 0 else suffix * np.int64(n + 1) + np.cumsum(left[1] < r)[left_at[active]]
        order = np.argsort(key, kind="stable")  # the first of each key has the least rank
        key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        own = rank[active[order]]
        later = own > own[first][np.cumsum(first) - 1]
        hit = by_place[active[order[later]]]
        records.append(hit)
        shifts.append(np.full(len(hit), r, np.int64))
    if not records:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(records), np.concatenate(shifts)


def ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers as first and last of each run."""
    starts = np.unique(starts)
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]


def open_before(gone: np.ndarray) -> np.ndarray:
    """How many places are not gone, of those before each one."""
    kept = np.zeros(len(gone), np.int32 if len(gone) < 1 << 31 else np.int64)
    np.cumsum(~gone[:-1], dtype=kept.dtype, out=kept[1:])
    return kept


def covered(size: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a range [first, end) covers each of ``size`` places."""
    edge = np.zeros(size + 1, np.int8)
    if len(first):
        order = np.argsort(first, kind="stable")
        first, end = first[order], np.maximum.accumulate(end[order])
        apart = np.append(True, first[1:] > end[:-1])
        edge[first[apart]] = 1
        edge[end[np.append(apart[1:], True)]] = -1
    return np.cumsum(edge, dtype=np.int8, out=edge)[:-1].view(bool)


# the four steps


def hashes_of_chunk(parts: int, chunk_name: str = "chunk") -> Callable[[pa.Table], pa.Table]:
    @tidy
    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        _, hashes, _, _ = chunk.anchors()
        own, counts = np.unique(hashes, return_counts=True)
        part = (own % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        own, counts, part = own[order], counts[order].astype(np.uint32), part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        rows = [(p, packed(own[a:b], counts[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        return _rows([p for p, _ in rows], int(table[chunk_name][0].as_py()), 0, [d for _, d in rows])

    return run


def _rows(part: list[int], chunk, kind, data: list[bytes]) -> pa.Table:
    n = len(data)
    chunk = chunk if isinstance(chunk, list) else [chunk] * n
    kind = kind if isinstance(kind, list) else [kind] * n
    return pa.table({"part": pa.array(part, pa.int32()), "chunk": pa.array(chunk, pa.int32()), "kind": pa.array(kind, pa.int32()), "data": pa.array(data, pa.binary())})


@tidy
def answers(table: pa.Table) -> pa.Table:
    """For each chunk, which of its hashes other chunks have too, and which of these are hot."""
    chunks = table["chunk"].to_pylist()
    found = [unpacked(d, "<u8", "<u4") for d in table["data"].to_pylist()]
    own, inverse, n_chunks = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True, return_counts=True)
    records = np.bincount(inverse, np.concatenate([c for _, c in found]))
    data, at = [], 0
    for h, _ in found:
        mine = inverse[at : at + len(h)]
        at += len(h)
        far = n_chunks[mine] > 1
        data.append(packed(h[far], (records[mine] > HOT)[far].astype(np.uint8)))
    return _rows(table["part"].to_pylist(), chunks, 0, data)


def runs_of_chunk(parts: int, levels: list[int], chunk_name: str = "chunk") -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Ranges of repeats within the chunk (kind 0) and sorted runs for each part of the first level (kind 1)."""

    @tidy
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([], 0, 0, [])
        number = int(table[chunk_name][0].as_py())
        chunk = Chunk(table)
        at, hashes, first, last = chunk.anchors()
        replies = [unpacked(d, "<u8", "u1") for d in told["data"].to_pylist()]
        far, hot = (np.concatenate(x) if replies else np.empty(0, k) for x, k in zip(zip(*replies) if replies else ((), ()), ("<u8", "u1")))
        order = np.argsort(far)
        far, hot = far[order], hot[order]
        _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        near = counts[inverse] > 1
        where = np.minimum(np.searchsorted(far, hashes), max(0, len(far) - 1))
        is_far = far[where] == hashes if len(far) else np.zeros(len(hashes), bool)
        is_hot = is_far & (hot[where] > 0) if len(far) else is_far
        gone = np.zeros(len(chunk.data) + 1, bool)  # window starts with an equal earlier one here
        own = np.flatnonzero(near)
        if len(own):
            right, left = strings(chunk, at[own], first[own], last[own])
            doc = chunk.doc(at[own])
            rec = Records(chunk.ids[doc], at[own] - chunk.bounds[doc], at[own] - last[own], at[own] - first[own])
            hit, shift = repeats(rec, sorted_run(right), sorted_run(left))
            gone[at[own][hit] - shift] = True
        rows: list[tuple[int, int, bytes]] = [(number % levels[0], 0, packed(*ranges(np.flatnonzero(gone))))]
        # what is left of the windows of anchors that others have
        send = np.flatnonzero(is_far)
        if len(send):
            kept = open_before(gone)
            open_ = kept[last[send] + 1] > kept[first[send]]
            send = send[open_]
        if len(send):
            f, l = first[send], last[send]
            f, l = (np.searchsorted(kept, x) - 1 for x in (kept[f] + 1, kept[l + 1]))  # the first and the last that are open
            del kept
            a, h, hot_one = at[send], hashes[send], is_hot[send]
            if hot_one.any():  # one record for each window, dealt by the window's hash
                many = np.flatnonzero(hot_one)
                size = (l - f + 1)[many]
                start = np.repeat(f[many], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                data = chunk.raw
                dealt = np.array([xxhash.xxh64_intdigest(data[s : s + LENGTH]) for s in start.tolist()], np.uint64)
                one = ~hot_one
                a, f, l, h = np.append(a[one], np.repeat(a[many], size)), np.append(f[one], start), np.append(l[one], start), np.append(h[one], dealt)
            part = digit(h, levels, 0)
            order = np.argsort(part, kind="stable")
            a, f, l, h, part = a[order], f[order], l[order], h[order], part[order]
            cuts = np.searchsorted(part, np.arange(levels[0] + 1))
            for p, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if i < j:
                    doc = chunk.doc(a[i:j])
                    fields = [chunk.ids[doc], a[i:j] - chunk.bounds[doc], np.full(j - i, number, np.int32), a[i:j], (a - l)[i:j].astype(np.uint8), (a - f)[i:j].astype(np.uint8)]
                    rows.append((p, 1, coded_run(*strings(chunk, a[i:j], f[i:j], l[i:j]), [*fields, h[i:j] if len(levels) > 1 else h[:0]])))
        return _rows([r[0] for r in rows], number, [r[1] for r in rows], [r[2] for r in rows])

    return run


def split_in(parts: int, fan: int) -> list[int]:
    """Numbers of at most ``fan`` whose product is ``parts`` or a little more: how runs are split, level by level."""
    out = []
    while parts > fan:
        out.append(fan)
        parts = -(-parts // fan)
    return [*out, max(1, parts)]


def digit(hashes: np.ndarray, levels: list[int], level: int) -> np.ndarray:
    """Which part of its level a hash goes to."""
    return (hashes // np.uint64(int(np.prod(levels[:level], dtype=object))) % np.uint64(levels[level])).astype(np.int64)


#: A run's arrays: front-coded suffixes, the order of the reversed prefixes and these front-coded, then by suffix: document,
#: place in it, chunk, place in that, first and last shift, and hash, if runs are to be split again.
CODED, FIELDS = ("u1", "u1", "u1", "<u4", "u1", "u1", "u1"), ("<i8", "<i8", "<i4", "<i8", "u1", "u1", "<u8")


def coded_run(right: list[bytes], left: list[bytes], fields: list[np.ndarray]) -> bytes:
    """A sorted, front-coded run of suffixes with all that belongs to them, in the order of the suffixes."""
    order, prefix = sorted_run(right)
    left = [left[i] for i in order.tolist()]
    left_order, left_prefix = sorted_run(left)
    return packed(*front_coded(right, order, prefix), left_order.astype(np.uint32), *front_coded(left, left_order, left_prefix), *(f[order] if len(f) else f for f in fields))


class Runs:
    """Runs of several chunks, put into one order of suffixes and one of reversed prefixes."""

    def __init__(self, data: list[bytes]):
        found = [unpacked(d, *CODED, *FIELDS) for d in data]
        bases = np.cumsum([0, *(len(x[0]) for x in found)])
        self.rights = [front_decoded(*x[:3]) for x in found]
        self.lefts = [front_decoded(*x[4:7]) for x in found]  # each in its own order, which is x[3]
        self.places = np.concatenate([x[3] + b for x, b in zip(found, bases)]).astype(np.int64)
        self.right = merged([(s, x[0]) for s, x in zip(self.rights, found)])
        left_order, left_prefix = merged([(s, x[4]) for s, x in zip(self.lefts, found)])
        self.left = self.places[left_order], left_prefix
        self.fields = [np.concatenate([x[k] for x in found]) for k in range(len(CODED), len(CODED) + len(FIELDS))]


def split_part(levels: list[int], level: int) -> Callable[[pa.Table], pa.Table]:
    """Merges some chunks' runs of one part and splits the run that they make among the parts of the next level."""

    @tidy
    def run(table: pa.Table) -> pa.Table:
        parts, chunks, kinds, data = (table[c].to_pylist() for c in ("part", "chunk", "kind", "data"))
        fan = levels[level]
        out = [(p * fan, c, 0, d) for p, c, k, d in zip(parts, chunks, kinds, data) if k == 0]
        own = [d for d, k in zip(data, kinds) if k == 1]
        if own:
            part = next(p for p, k in zip(parts, kinds) if k == 1)
            runs = Runs(own)
            rights = [s for run in runs.rights for s in run]
            lefts = [b""] * len(rights)
            for i, s in zip(runs.places.tolist(), (s for run in runs.lefts for s in run)):
                lefts[i] = s
            order = runs.right[0]
            to = digit(runs.fields[-1][order], levels, level)
            for p in np.unique(to).tolist():
                mine = order[to == p]
                out.append((part * fan + p, 0, 1, coded_run([rights[i] for i in mine], [lefts[i] for i in mine], [f[mine] for f in runs.fields])))
        return _rows([o[0] for o in out], [o[1] for o in out], [o[2] for o in out], [o[3] for o in out])

    return run


@tidy
def merge_part(table: pa.Table) -> pa.Table:
    """Combines the runs of all chunks; ranges of repeats for each chunk."""
    chunks, kinds, data = (table[c].to_pylist() for c in ("chunk", "kind", "data"))
    out = [(c, d) for c, k, d in zip(chunks, kinds, data) if k == 0]
    own = [d for d, k in zip(data, kinds) if k == 1]
    if own:
        runs = Runs(own)
        doc, place, chunk, at, least, most, _ = runs.fields
        hit, shift = repeats(Records(doc, place, least.astype(np.int64), most.astype(np.int64)), runs.right, runs.left)
        starts, owner = at[hit] - shift, chunk[hit]
        order = np.argsort(owner, kind="stable")
        starts, owner = starts[order], owner[order]
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
        for a, b in zip(cuts.tolist(), [*cuts.tolist()[1:], len(owner)]):
            out.append((int(owner[a]), packed(*ranges(starts[a:b]))))
    return _rows([0] * len(out), [c for c, _ in out], 0, [d for _, d in out])


def remove(columns: list[str], whole: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Cuts the ranges' windows out of a chunk's documents."""

    @tidy
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        found = [unpacked(d, "<i8", "<i8") for d in told["data"].to_pylist()]
        first, last = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        gone = covered(len(chunk.data), first, last + LENGTH)
        kept, n_removed, n_spans = [], [], []
        for a, b in zip(chunk.bounds.tolist(), chunk.bounds.tolist()[1:]):
            own = gone[a:b]
            n = int(np.count_nonzero(own))
            n_removed.append(n)
            n_spans.append(int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if n else 0)  # a span ends with its document
            kept.append(chunk.data[a:b][~own].tobytes() if n else chunk.raw[a:b])
        rest = table.select([c for c in columns if not (whole and c == "text")]).take(chunk.order)
        out = {c: None if whole and c == "text" else rest[c] for c in columns}
        if whole:  # bytes of a character that was cut in two go with the rest of it
            out["text"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        out |= {
            "n_bytes": pa.array(np.diff(chunk.bounds)),
            "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        return pa.table(out)

    return run


def dedup(docs: DataFrame, whole: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept_sha256; if ``whole``, with the text that is left."""
    spark = docs.sparkSession
    outputs = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*outputs).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    chunk_name, copies = unused(docs, "chunk", "copies")
    key = [F.col("doc_id"), F.xxhash64("text").alias("text")]
    by_row = docs.select(*key, F.octet_length("text").alias("n")).groupBy("doc_id", "text").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    sums = by_row.agg(F.sum("n").alias("n"), F.max("rows").alias("rows")).first()
    size, repeated = sums["n"] or 0, (sums["rows"] or 0) > 1 and not any(isinstance(f.dataType, T.MapType) for f in docs.schema.fields)
    if repeated:  # equal rows become one, each task counting its own first
        docs = docs.groupBy(*docs.columns).agg(F.count("*").alias(copies))
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    chunks, parts = (max(1, tasks, -(-size // n)) for n in (CHUNK_BYTES, PART_BYTES))
    levels = split_in(parts, FAN)
    dealt = docs.withColumn(chunk_name, F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    dealt = dealt.repartitionById(chunks, F.col(chunk_name))
    by_chunk = lambda rows: rows.repartitionById(chunks, F.col("chunk")).groupBy("chunk")
    replies = dealt.groupBy(chunk_name).applyInArrow(hashes_of_chunk(parts, chunk_name), PARTS)
    replies = replies.repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(answers, PARTS)
    runs = dealt.groupBy(chunk_name).cogroup(by_chunk(replies)).applyInArrow(runs_of_chunk(parts, levels, chunk_name), PARTS)
    made = levels[0]
    for level in range(1, len(levels)):
        groups = -(-parts // made)  # tasks for each part of this level
        runs = runs.withColumn("task", (F.col("part") * groups + F.pmod("chunk", F.lit(groups))).cast("int")).repartitionById(made * groups, F.col("task"))
        runs = runs.groupBy("task").applyInArrow(split_part(levels, level), PARTS)
        made *= levels[level]
    found = runs.repartitionById(made, F.col("part")).groupBy("part").applyInArrow(merge_part, PARTS)
    columns = [c for c in docs.columns if whole or c != "text"]
    schema = T.StructType([f for f in docs.schema.fields if f.name in columns])
    for name in outputs:
        schema = schema.add(name, T.StringType() if name == "kept_sha256" else T.LongType())
    out = dealt.groupBy(chunk_name).cogroup(by_chunk(found)).applyInArrow(remove(columns, whole), schema)
    if repeated:
        out = out.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(copies)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), whole=False)


SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT doc_id, i, x[i + 1 : i + 100] AS s FROM (SELECT doc_id, x, unnest(range(0, octet_length(x) - 99)) AS i FROM d)),
f AS (SELECT s, min((doc_id, i)) AS first FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE (doc_id, i) <> first),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k
      FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM r)),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, k),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
q AS (SELECT d.doc_id, string_agg(hex(x[before + 1 : a]), '' ORDER BY a) AS head, max(b) AS tail, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans
      FROM p JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || hex(x[coalesce(tail, 0) + 1 : octet_length(x)]))) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)"""
