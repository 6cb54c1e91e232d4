"""Quality classifier: ordinal regression with a cumulative link on graded ratings.

A text's score is the mean weight of its hashed features: shapes of tokens,
pairs of shapes and repeats (bare words only added noise on held-out labels). All grades share these weights; ordered
thresholds t1 < t2 < ... cut the score into grades: P(grade >= k) =
sigmoid(score - tk). The expected grade is the sum of these tail
probabilities, and a document is kept if the tail of the wanted grade is at
least one half.

The fit runs on the driver over at most ``most`` labelled rows (a documented
bound), drawn by hash; every document is then scored whole in one pass over
Arrow batches with a weight table of fixed size.

Defined cases: null and empty texts score by the thresholds alone; labels that
are null, or of no document, are left out; if the labels have fewer than two
grades nothing is fitted, and every row gets the one grade (0 if there is none)
and is kept; repeated rows are scored each; a very long text is one task's work;
an empty table gives no rows; further columns stay, but for those named like an output, which wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mishear.llm._arrow import slices, tidy
from mishear.llm._hashed import BUCKETS, Rows, Tokens, gathered, sample, sigmoid

#: Labelled rows to fit on at most; rows that a feature needs; steps, their size, and the weight of the penalty.
MOST, LEAST_ROWS, STEPS, RATE, PENALTY = 6000, 16, 150, 0.1, 1e-3
#: A document is kept if the chance of this grade or better is at least this.
WANTED, CHANCE = 1, 0.5


def token_features(tokens: Tokens) -> list[np.ndarray]:
    """Three buckets for each token."""
    return [tokens.shape, *tokens.pairs()]


def frequencies(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, mean count a token) of each feature of each text."""
    tokens = Tokens(texts)
    row = tokens.rows()
    key = np.concatenate([row * BUCKETS + f for f in token_features(tokens)]) if len(row) else np.empty(0, np.int64)
    key, counts = np.unique(key, return_counts=True)
    row = key // BUCKETS
    return row, key % BUCKETS, counts / np.maximum(np.diff(tokens.offsets), 1)[row]


class Ordinal:
    """Shared weights by bucket and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: np.ndarray):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each grade but the lowest, by row."""
        return sigmoid(score[:, None] - self.thresholds[None, :])

    def scores(self, texts: pa.Array) -> np.ndarray:
        tokens = Tokens(texts)
        each = sum((self.weights[f] for f in token_features(tokens)), np.zeros(len(tokens.index), np.float32))
        ends = np.append(0, np.cumsum(each, dtype=np.float64))
        return np.diff(ends[tokens.offsets]) / np.maximum(np.diff(tokens.offsets), 1)


def fit(index: np.ndarray, values: np.ndarray, counts: np.ndarray, grades: np.ndarray) -> Ordinal:
    """Minimizes the mean log loss of the cumulative link model by Adam on scaled columns."""
    kinds, y = np.unique(grades, return_inverse=True)
    x = Rows(index, values, counts, LEAST_ROWS)
    if len(kinds) < 2:
        return Ordinal(np.zeros(BUCKETS, np.float32), np.empty(0), kinds)
    scale = np.sqrt(np.maximum(np.bincount(x.index, x.values**2, len(x.columns)) / x.n, 1e-12))
    x.values /= scale[x.index]
    n, k = x.n, len(kinds) - 1
    above = np.array([(y > i).mean() for i in range(k)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(above / (1 - above))
    # thresholds: the first, and logarithms of the steps to the next
    params = np.concatenate([np.zeros(len(x.columns)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    edge = np.concatenate
    for step in range(1, STEPS + 1):
        w, cuts = params[:-k], np.cumsum(edge([params[-k:][:1], np.exp(params[-k:][1:])]))
        score = x.dot(w)
        # P(y) = sigmoid(c[y+1] - s) - sigmoid(c[y] - s), with the outer cuts at infinity
        high, low = edge([cuts, [np.inf]])[y] - score, edge([[-np.inf], cuts])[y] - score
        top, bottom = np.where(np.isinf(high), 1.0, sigmoid(high)), np.where(np.isinf(low), 0.0, sigmoid(low))
        p = np.maximum(top - bottom, 1e-9)
        dtop, dbottom = top * (1 - top) / p, bottom * (1 - bottom) / p
        dscore = (dtop - dbottom) / n
        dcuts = np.array([dbottom[y == i + 1].sum() - dtop[y == i].sum() for i in range(k)]) / n
        dparts = np.cumsum(dcuts[::-1])[::-1] * edge([[1.0], np.exp(params[-k:][1:])])
        g = edge([x.back(dscore) + PENALTY * w, dparts])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    cuts = np.cumsum(edge([params[-k:][:1], np.exp(params[-k:][1:])]))
    return Ordinal(x.weights(params[:-k] / scale), cuts, kinds)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST) -> Ordinal:
    own, index, values, counts = gathered(sample(docs, labels, [label], most), [label], frequencies)
    return fit(index, values, counts, own[label])


def score(docs: DataFrame, model: Ordinal, wanted: int = WANTED, chance: float = CHANCE) -> DataFrame:
    """Adds ``expected_grade``, ``p_wanted`` and ``kept`` to ``docs``."""
    spark = docs.sparkSession
    outputs = ("expected_grade", "p_wanted", "kept")
    rows = docs.drop(*outputs).withColumn("text", F.col("text").cast("string"))
    sent = spark.sparkContext.broadcast((model.weights, model.thresholds, model.grades))  # BUCKETS floats

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*sent.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part, whole in zip(slices(batch, "text"), slices_of(batch, "text")):
                tails = own.tails(own.scores(part.column(at)))
                grades = own.grades if len(own.grades) else np.array([0])
                expected = grades[0] + tails @ np.diff(grades)
                above = np.searchsorted(grades, wanted)
                p = np.ones(part.num_rows) if len(grades) < 2 or above == 0 else tails[:, above - 1] if above < len(grades) else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*whole.columns, pa.array(expected, pa.float64()), pa.array(p, pa.float64()), pa.array(p >= chance)],
                    names=[*batch.schema.names, *outputs],
                )

    added = [T.StructField(n, k) for n, k in zip(outputs, (T.DoubleType(), T.DoubleType(), T.BooleanType()))]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def slices_of(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The same slices with nulls left as they are."""
    start = 0
    for part in slices(batch, column):
        yield batch.slice(start, part.num_rows)
        start += part.num_rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", "expected_grade", "p_wanted", "kept")
