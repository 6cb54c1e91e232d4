"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and is judged on its own input; all but
the last return the columns of documents. A stage's result is written as
Parquet and reread, so a lost executor costs no more than a part of one stage;
it is deleted when the next one is written, and only the last one's stays.

Defined cases: null, empty and blank texts fail the quality rules; ids that are
null or repeat are documents of their own unless their texts are near copies;
repeated rows are near copies; very long texts stay whole; an empty table gives
no rows; without labels the classifier keeps all; columns beside those of
documents are dropped.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishear.llm import ngram_join, packing, quality_classifier, quality_rules, suffix_dedup
from mishear.llm._cluster import checkpointed, lookup, removed, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier, fitted on labelled ones, wants."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model).where("kept").select(*COLUMNS)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the quality rules."""
    return quality_rules.judge(docs).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id (null last) of each group of linked ones, and one row of it.

    Rows of one id are one document where their n-gram sets are equal. Only rows
    of ids that are null or have several rows are looked at for that; equal rows
    meet after each task kept one.
    """
    found = checkpointed(ngram_join.join(docs).select("doc_id", "digest", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("first")
    kept = found.groupBy("root").agg(first).select("first.doc_id", "first.digest")
    several = found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("several"))
    kept = checkpointed(kept.join(several, "doc_id", "left"))
    once = docs.join(kept.where("doc_id IS NOT NULL AND several IS NULL"), "doc_id", "left_semi").select(*COLUMNS)
    odd = kept.where("doc_id IS NULL OR several")
    if odd.isEmpty():
        return once
    rows = docs.where("doc_id IS NULL").select(*COLUMNS).unionByName(lookup(docs.select(*COLUMNS), several, ["doc_id"], "inner").select(*COLUMNS))
    least = ngram_join.digested(rows).groupBy("doc_id", "digest").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    own = odd.select(F.col("doc_id").alias("id"), F.col("digest").alias("set"))
    return once.unionByName(least.join(own, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("set")), "left_semi").select("doc_id", "row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out; a document of which nothing is left goes."""
    left = suffix_dedup.dedup(docs).where(F.length(F.trim("text")) > 0)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("near-duplicate join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: Training, hashing and tokenizing have no SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if before is not None:
            removed(spark, before)
        before = f"{folder}/{k}"
    return docs
