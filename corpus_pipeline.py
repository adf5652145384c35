"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents.  All but the last return the columns of ``documents``.  Every stage works on all rows that the one
before has kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import exact, near, packing, quality, substring
from concord.session import scratch_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates here share 80 % of their runs of five words.
GRAM, PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier doesn't reject."""
    docs = docs.select(*COLUMNS)
    return quality.score(docs, quality.fit(docs)).filter("quality_keep").select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact.survivors(docs.select(*COLUMNS)).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; one without an id stays."""
    docs = docs.select(*COLUMNS)
    lost = near.near_duplicates(docs, GRAM, PERCENT).filter("doc_id <> component_id").select("doc_id", "text_hash").distinct()
    marked = docs.withColumn("text_hash", F.xxhash64("text"))
    return marked.join(lost, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that an earlier one holds; one that loses all its words goes."""
    docs = docs.select(*COLUMNS)
    cut = substring.dedup(docs, with_text=True).filter("n_removed > 0").select("doc_id", "text_hash", "kept_text")
    cut = cut.repartition("doc_id", "text_hash").distinct()
    joined = docs.withColumn("text_hash", F.xxhash64("text")).join(cut, ["doc_id", "text_hash"], "left")
    joined = joined.filter(F.col("kept_text").isNull() | (F.col("kept_text") != ""))
    text = F.coalesce("kept_text", "text")
    return joined.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(
        F.length("kept_text")).cast("bigint").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of a document and its place in a sequence of at most 4096 tokens."""
    made = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, keep_ids=False)
    return packing.pack(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("substring dedup", without_repeated_passages),
    ("best-fit packing", packed),
]

#: SQL can't express the classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
