"""Toxicity: a chain of linear classifiers over categories.

Categories are predicted one after the other. Each link is a sparse (L1)
logistic model over the presence of hashed words and shapes, and over the
chances that the links before it give. In training those chances are
out-of-fold: each fold's come from a link fitted on the other folds, so later
links see earlier ones as they will be on new texts.

The fit runs on the driver over at most ``most`` labelled rows (a documented
bound), drawn by hash; every document is then scored whole in one pass over
Arrow batches. Only buckets with a weight are looked at.

Defined cases: null and empty texts score by the intercepts alone; labels that
are null, or of no document, are left out; a category that all training rows
have or lack gets that share (0 without rows) as its chance; repeated rows are
scored each; a very long text is one task's work; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishear.llm._arrow import slices, tidy
from mishear.llm._hashed import BUCKETS, Rows, Tokens, gathered, sample, sigmoid

#: Labelled rows to fit on at most; rows that a feature needs; steps and folds; the penalty on weights.
MOST, LEAST_ROWS, STEPS, FOLDS, PENALTY = 8000, 5, 120, 3, 4e-4
#: A category is assigned at this chance. It was chosen on labelled rows apart from those that were fitted on and from
#: those that the errors in the README are counted on.
CHANCE = 0.2
#: Categories in the order of the chain: name, and the SQL expression of its label.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, 1) of each word and shape that a text has."""
    tokens = Tokens(texts)
    row = tokens.rows()
    key = np.unique(np.concatenate([row * BUCKETS + f for f in (tokens.word, tokens.shape)])) if len(row) else np.empty(0, np.int64)
    return key // BUCKETS, key % BUCKETS, np.ones(len(key))


@dataclass
class Link:
    weights: np.ndarray  # by bucket
    earlier: np.ndarray  # by link before this one
    intercept: float


def logistic(x: Rows, rows: np.ndarray, before: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """FISTA on the mean log loss of ``rows`` (a mask) with an L1 penalty on the text's weights."""
    n, k = max(1, int(rows.sum())), before.shape[1]
    mean = y[rows].mean() if rows.any() else 0.0
    if mean in (0.0, 1.0):
        return np.zeros(len(x.columns)), np.zeros(k), float(np.log(max(mean, 1e-9) / max(1 - mean, 1e-9)))
    # column scales bound the step: a common word moves the loss more than a rare one
    share = np.bincount(x.index, x.values * rows[x.row], len(x.columns)) / n
    scale = 1 / np.sqrt(share * (1 - share) + 1.0 / n)
    scale = np.minimum(scale, 10.0)
    w, b = np.zeros(len(x.columns)), np.zeros(k + 1)
    b[-1] = np.log(mean / (1 - mean))
    zw, zb, t = w, b, 1.0
    extra = np.column_stack([before, np.ones(len(before))])
    size = None
    for _ in range(STEPS):
        p = sigmoid(x.dot(zw * scale) + extra @ zb)
        g = np.where(rows, p - y, 0.0) / n
        gw, gb = scale * x.back(g), extra.T @ g
        if size is None:  # the curvature along the first gradient bounds the step well enough
            d = x.dot(gw * scale) + extra @ gb
            size = 0.5 * (gw @ gw + gb @ gb) / max(1e-12, float((np.where(rows, d, 0) ** 2).mean() * len(rows) / n / 4))
        new_w = zw - size * gw
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - size * PENALTY * scale / 3.0, 0)
        new_b = zb - size * gb
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        zw, zb = new_w + (old - 1) / t * (new_w - w), new_b + (old - 1) / t * (new_b - b)
        w, b = new_w, new_b
    return w * scale, b[:-1], float(b[-1])


def fit(index: np.ndarray, values: np.ndarray, counts: np.ndarray, labels: list[np.ndarray]) -> list[Link]:
    x = Rows(index, values, counts, LEAST_ROWS)
    fold = np.arange(x.n) % FOLDS
    every = np.ones(x.n, bool)
    before = np.empty((x.n, 0))
    links = []
    for i, y in enumerate(labels):
        y = y.astype(np.float64)
        w, e, b = logistic(x, every, before, y)
        links.append(Link(x.weights(w), e, b))
        if i + 1 < len(labels):
            chance = np.zeros(x.n)
            for f in range(FOLDS):
                w, e, b = logistic(x, fold != f, before, y)
                own = fold == f
                chance[own] = sigmoid(x.dot(w) + before @ e + b)[own]
            before = np.column_stack([before, chance])
    return links


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, most: int = MOST) -> list[Link]:
    names = [n for n, _ in chain]
    known = labels.select("doc_id", *(F.expr(e).alias(n) for n, e in chain))
    own, index, values, counts = gathered(sample(docs, known, names, most), names, presence)
    return fit(index, values, counts, [own[n] for n in names])


def chances(texts: pa.Array, links: list[Link]) -> np.ndarray:
    """By text and link."""
    tokens = Tokens(texts)
    row, n = tokens.rows(), len(tokens.offsets) - 1
    used = np.zeros(BUCKETS, bool)
    for link in links:
        used |= link.weights != 0
    key = np.unique(np.concatenate([(row * BUCKETS + f)[used[f]] for f in (tokens.word, tokens.shape)])) if len(row) else np.empty(0, np.int64)
    row, index = key // BUCKETS, key % BUCKETS
    out = np.zeros((n, len(links)))
    for i, link in enumerate(links):
        out[:, i] = sigmoid(np.bincount(row, link.weights[index], n) + out[:, :i] @ link.earlier + link.intercept)
    return out


def score(docs: DataFrame, links: list[Link], names: list[str], chance: float = CHANCE) -> DataFrame:
    """(doc_id, p_<category> ..., <category> ...) of each row."""
    used = [np.flatnonzero(link.weights) for link in links]  # L1 leaves some thousands of weights
    sent = docs.sparkSession.sparkContext.broadcast([(at, link.weights[at], link.earlier, link.intercept) for at, link in zip(used, links)])
    columns = [f"p_{n}" for n in names] + list(names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = []
        for at, values, earlier, intercept in sent.value:
            weights = np.zeros(BUCKETS, np.float32)
            weights[at] = values
            own.append(Link(weights, earlier, intercept))
        for batch in batches:
            for part in slices(batch, "text"):
                p = chances(part.column("text"), own)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, p.T), *(pa.array(q >= chance) for q in p.T)], names=["doc_id", *columns])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join([f"p_{n} double" for n in names] + [f"{n} boolean" for n in names])
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    links = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, links, [n for n, _ in CHAIN])
