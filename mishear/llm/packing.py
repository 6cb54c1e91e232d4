"""Best-fit packing of documents into token sequences by a plan over length counts.

1. Documents are tokenized (each distinct word of a slice once) and cut into
   pieces of at most ``capacity`` tokens. The pieces, a few numbers each, are
   checkpointed, since both the histogram and the placement read them.
2. The driver gets the histogram: a count for each length, at most ``capacity``
   rows whatever the corpus. Best-fit decreasing runs over these counts: groups
   of equal bins take as many pieces of a length as fit, smallest sufficient
   room first. The result is a table of slots: for a range of ranks within a
   length, the first sequence, pieces per sequence and offset.
3. Pieces take slots by their rank within their length. A hot length is dealt
   out over salts: rows are numbered within (length, salt), and a running sum
   over the salts' counts makes that a rank within the length, so no task needs
   all rows of a length.

Defined cases: a null text is an empty one, which gives one piece of the end id
alone; a repeated row is packed as often as it occurs; a very long text is one
task's work and is cut into pieces; null ids are kept; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mishear.llm._arrow import gather, remembered, slices, spans, tidy
from mishear.llm._cluster import checkpointed

CAPACITY, END_ID = 2048, 0
#: Text that is tokenized at once: each distinct word of it once.
TOKENIZED_BYTES = 8 << 20
#: Pieces of one length that a task numbers at most, about.
SALT_ROWS = 200_000
#: Words that a worker remembers between slices.
CACHE_WORDS = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of whole texts from ids of their distinct white-space-separated words.

    For byte-level tokenizers that drop white space and whose pre-tokenizer
    never looks across it. A word of plain letters and ASCII punctuation after
    them is two pre-tokens, the lower-cased letters and the punctuation; the
    letters go to the tokenizer's model directly. Any other word goes through
    the whole tokenizer. ``whole`` tells that the tokenizer disagrees with this
    split on a probe, which has every letter at each place of a word and every
    pair of marks; then all words take the second way.
    """

    LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!\"#$%&()*+,\\-./:;<=>?@\\[\\]^_`{|}~"

    @classmethod
    def probe(cls) -> list[str]:
        inside = lambda ranges: [chr(c) for c in range(0x21, 0x100) if re.fullmatch(f"[{ranges}]", chr(c))]
        letters, marks = inside(cls.LETTERS), inside(cls.MARKS)
        words = [w for c in letters for w in (c, f"{c}an", f"w{c}n", f"THE{c}", f"{c}{c.upper()}.")]
        words += [f"word{a}{b}" for a in marks for b in marks] + [f"É{m}" for m in marks] + [f"x{m * k}" for m in marks for k in (3, 4, 9)]
        return [*words, "Straße,", "ÀÖØ***", "a[b", "don't", "b\u0301c."]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.plain = rf"^[{self.LETTERS}]+[{self.MARKS}]*$"
        words = self.probe()
        probe = pa.array(words)
        self.whole = False
        self.whole = [x.tobytes() for x in np.split(*self._split(self.distinct(probe)))] != [self._encoded(w) for w in words]

    @staticmethod
    def _split(flat_sizes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return flat_sizes[0], np.cumsum(flat_sizes[1])[:-1]

    def _encoded(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        units = word if word.isascii() else word.translate(self.bytes_of)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(units)]).tobytes()

    def _units(self, words: pa.Array, encode: Callable[[str], bytes]) -> list[bytes]:
        out, cache = [], self.cache
        for w in words.to_pylist():
            ids = cache.get(w)
            if ids is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                ids = cache[w] = encode(w)
            out.append(ids)
        return out

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each of ``words`` one after the other, and their numbers."""
        plain = pc.match_substring_regex(words, self.plain) if not self.whole else pa.array(np.zeros(len(words), bool))
        is_plain = plain.to_numpy(zero_copy_only=False)
        own = words.filter(plain)
        tails = pc.replace_substring_regex(own, rf"^[{self.LETTERS}]+", "").dictionary_encode()
        heads = pc.utf8_lower(pc.replace_substring_regex(own, rf"[{self.MARKS}]+$", "")).dictionary_encode()
        others = words.filter(pc.invert(plain))
        units = [b"", *self._units(heads.dictionary, self._letters)]
        n_heads = len(units)
        units += self._units(tails.dictionary, self._encoded)
        n_tails = len(units)
        units += self._units(others, self._encoded)
        pair = np.zeros((len(words), 2), np.int32)
        pair[is_plain, 0] = heads.indices.to_numpy(zero_copy_only=False) + 1
        pair[is_plain, 1] = tails.indices.to_numpy(zero_copy_only=False) + n_heads
        pair[~is_plain, 0] = np.arange(len(others)) + n_tails
        sizes = np.fromiter(map(len, units), np.int32, len(units)) // 4
        flat = np.frombuffer(b"".join(units), "<u4")
        return gather(flat, sizes, pair.reshape(-1)), sizes[pair].sum(axis=1, dtype=np.int32)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (and the last's end)."""
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        offsets, coded = parts.offsets.to_numpy(), parts.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        flat, sizes = self.distinct(coded.dictionary)
        ids = gather(flat, sizes, index)
        return ids, np.append(0, np.cumsum(sizes[index], dtype=np.int64))[offsets - offsets[0]]


@remembered(2)
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each worker, so that it remembers words from task to task."""
    return WordTokenizer(path)


def tokenize_pieces(path: str, capacity: int, end_id: int) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", TOKENIZED_BYTES):
                ids, offsets = tokenizer.texts(part.column("text"))
                data = memoryview(np.ascontiguousarray(ids)).cast("B")
                length = np.diff(offsets) + 1
                pieces = -(-length // capacity)
                row = np.repeat(np.arange(len(length)), pieces)
                piece = spans(np.zeros(len(length), np.int64), pieces).astype(np.int64)
                start = piece * capacity
                size = np.minimum(length[row] - start, capacity)
                a = offsets[row] + start
                last = start + size == length[row]
                crc = [
                    zlib.crc32(end, zlib.crc32(data[4 * x : 4 * (x + n - 1)])) if final else zlib.crc32(data[4 * x : 4 * (x + n)])
                    for x, n, final in zip(a.tolist(), size.tolist(), last.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, first sequence, pieces per sequence, offset) for counts of lengths.

    Rank k of a slot's range goes to sequence ``first + (k - rank) // per`` at
    ``offset + (k - rank) % per * length``. Bins with equal room form groups, so
    the work depends on the number of lengths, not of pieces.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    groups: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, bins)
    rooms: list[int] = []  # with groups, sorted
    sequences = 0

    def put(room: int, first: int, bins: int) -> None:
        if room and bins:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((first, bins))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, bins = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, first = capacity, sequences
                bins = -(-left // (capacity // length))
                sequences += bins
            per = room // length
            full = min(bins, left // per)
            if full:
                slots.append((length, rank, first, per, capacity - room))
                put(room, first + full, bins - full)
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            else:
                slots.append((length, rank, first, per, capacity - room))
                put(room, first + 1, bins - 1)
                put(room - left * length, first, 1)
                rank, left = rank + left, 0
    return slots


def place(slots: list[tuple[int, int, int, int, int]]) -> Callable:
    """Ranks to sequence and offset. The table has some rows for each length, however many pieces there are."""
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            own = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1] if len(length) else table[:0]
            nth = rank - own[:, 1]
            sequence = own[:, 2] + nth // np.maximum(own[:, 3], 1)
            offset = own[:, 4] + nth % np.maximum(own[:, 3], 1) * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document, with its place in a sequence."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = checkpointed(rows.mapInArrow(tokenize_pieces(tokenizer, capacity, end_id), PIECES))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # one row a length
    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(histogram.values(), default=0) // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("nth", F.row_number().over(within).cast("long") - 1)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        salted.groupBy("length", "salt")
        .count()
        .select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    )
    ranked = numbered.join(bases, ["length", "salt"]).withColumn("rank", F.col("nth") + F.col("base"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place(best_fit(histogram, capacity)), PIECES + ", sequence_id long, offset long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
