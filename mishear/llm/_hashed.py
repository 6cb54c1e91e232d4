"""Hashed text features, and bounded samples of labelled rows to fit models on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mishear.llm._arrow import list_array, remembered, slices, tidy

#: Buckets of the hash, a power of two.
BUCKETS = 1 << 18
WORD, SHAPE, PAIR, AGAIN = 1, 2, 3, 4  # seeds: kinds of features
#: Characters of a shape that are hashed together.
WINDOW = 12
MARKS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~«»„“”¡¿…"


@remembered(100_000)
def bucket(text: str, kind: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), kind) & (BUCKETS - 1)


class Tokens:
    """White-space-separated tokens of some texts, as buckets: of the bare lower-case word and of the shape.

    A token with a shape longer than a window is one entry for each window in a row, so that all of it is seen.
    """

    #: Whether an entry's token repeats the one before it, if that is not told by ``index``.
    again: np.ndarray | None = None

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = parts.flatten()
        offsets = parts.offsets.to_numpy()
        offsets = offsets - offsets[0]
        if pc.any(pc.equal(words, "")).as_py():  # an empty text has one empty token
            some = pc.not_equal(words, "")
            offsets = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))[offsets]
            words = words.filter(some)
        coded = words.dictionary_encode()
        self.offsets, self.index, own = offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        bare = pc.utf8_lower(pc.utf8_trim(own, MARKS)).dictionary_encode()
        shape = own
        for pattern, mark in ((r"\p{Lu}{2,}", "XX"), (r"\p{Lu}", "X"), (r"[\p{Ll}\p{Lo}\p{Lm}]+", "x"), (r"\p{N}+", "9")):
            shape = pc.replace_substring_regex(shape, pattern, mark)
        long = np.flatnonzero(pc.greater(pc.utf8_length(shape), WINDOW).to_numpy(zero_copy_only=False))
        rest = [[s[i : i + WINDOW] for i in range(0, len(s), WINDOW)] for s in shape.take(pa.array(long)).to_pylist()]
        shapes = self._buckets(pc.utf8_slice_codeunits(shape, 0, WINDOW).dictionary_encode(), SHAPE)
        words = self._buckets(bare, WORD)
        if not len(long):
            self.word, self.shape = words[self.index], shapes[self.index]
            return
        counts = np.ones(len(own), np.int64)
        counts[long] = [len(w) for w in rest]
        first = np.append(0, np.cumsum(counts))  # entries by distinct token
        entries = np.repeat(shapes, counts)
        for k, windows in zip(long, rest):
            entries[first[k] : first[k + 1]] = [bucket(w, SHAPE) for w in windows]
        each = counts[self.index]
        ends = np.append(0, np.cumsum(each))
        within = np.arange(ends[-1]) - np.repeat(ends[:-1], each)
        token = np.repeat(self.index, each)
        self.shape, self.word = entries[first[token] + within], words[token]
        again = np.zeros(len(self.index), bool)
        again[1:] = self.index[1:] == self.index[:-1]
        self.again = np.repeat(again, each)
        self.offsets, self.index = ends[offsets], token

    @staticmethod
    def _buckets(coded: pa.DictionaryArray, kind: int) -> np.ndarray:
        own = np.array([bucket(x, kind) for x in coded.dictionary.to_pylist()], np.int32)
        return own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.empty(0, np.int32)

    def rows(self) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def follows(self) -> np.ndarray:
        """Whether a token has one before it in its text."""
        out = np.ones(len(self.index), bool)
        out[self.offsets[:-1][self.offsets[:-1] < len(out)]] = False
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the shapes of a token and the one before it, and whether it repeats that one; 0 where none is before."""
        mixed = np.zeros(len(self.index), np.int64)
        again = np.zeros(len(self.index), np.int64)
        if len(mixed) > 1:
            mixed[1:] = (self.shape[:-1].astype(np.int64) * 31 + self.shape[1:] * 17 + PAIR) & (BUCKETS - 1)
            repeats = self.index[1:] == self.index[:-1] if self.again is None else self.again[1:]
            again[1:] = np.where(repeats, bucket("again", AGAIN), bucket("other", AGAIN))
        alone = ~self.follows()
        mixed[alone] = again[alone] = bucket("first", AGAIN)
        return mixed, again


def sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int) -> DataFrame:
    """At most ``most`` labelled documents, those with the least hashes of their ids.

    The bound makes what is fitted, and what the driver holds, as large for any
    corpus. A document with several labels takes the least of each.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(c) for c in columns)).dropna()
    own = own.groupBy("doc_id").agg(*(F.min(c).alias(c) for c in columns))
    drawn = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id")  # at most ``most`` rows


class Rows:
    """A sparse matrix by rows, its columns renumbered to those in use."""

    def __init__(self, index: np.ndarray, values: np.ndarray, counts: np.ndarray, least: int):
        """least: columns in fewer rows are dropped."""
        used = np.bincount(index, minlength=BUCKETS) >= least
        self.columns = np.flatnonzero(used)
        number = np.zeros(BUCKETS, np.int32)
        number[self.columns] = np.arange(len(self.columns))
        kept = used[index]
        row = np.repeat(np.arange(len(counts)), counts)[kept]
        self.index, self.values, self.row, self.n = number[index[kept]], values[kept].astype(np.float64), row, len(counts)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.index], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.values * g[self.row], len(self.columns))

    def weights(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.columns] = w
        return out


def gathered(rows: DataFrame, columns: list[str], features) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Labels and features of a bounded sample on the driver: labels by column, index, values, counts.

    ``features`` gives (row, bucket, value) of the texts of a slice, sorted by row.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, index, value = features(part.column("text"))
                offsets = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(part.column(c) for c in columns), list_array(index.astype(np.int32), offsets, pa.int32()), list_array(value.astype(np.float32), offsets, pa.float32())],
                    names=["doc_id", *columns, "index", "value"],
                )

    schema = "doc_id long, " + ", ".join(f"{c} int" for c in columns) + ", index array<int>, value array<float>"
    table = rows.mapInArrow(run, schema).toArrow().combine_chunks().sort_by("doc_id").combine_chunks()
    if not table.num_rows:
        return {c: np.empty(0, np.int64) for c in columns}, *(np.empty(0, np.int64),) * 3
    index = table["index"].combine_chunks()
    counts = pc.list_value_length(index).to_numpy(zero_copy_only=False)
    return {c: table[c].to_numpy() for c in columns}, index.flatten().to_numpy(), table["value"].combine_chunks().flatten().to_numpy(), counts


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
