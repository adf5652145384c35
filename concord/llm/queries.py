"""The thin queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import crosstok, exact, licences, mixing, near, packing, parsing, pieces, quality, substring, topk, toxicity, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


@query
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring.dedup(_table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    learnt = toxicity.sampled(labels.filter(_remainder(5) != 0))
    grammar = toxicity.learn(docs.select("doc_id", "text").join(F.broadcast(learnt), "doc_id").select("text", "toxic"))
    return toxicity.score(docs, grammar).select(
        "doc_id", (_remainder(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query
def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs)).select("doc_id", "quality_score", "quality_keep")


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf, "documents"), gram=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query
def op5_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Files are the documents, at source/lang/hundreds/doc_id."""
    docs = _table(spark, sf, "documents")
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.expr("CAST(doc_id DIV 100 AS STRING)"), F.col("doc_id").cast("string")).alias("path"))
    return licences.inherit(files, licences.scan(docs))


@query
def op6_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    made = packing.token_pieces(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, keep_ids=False)
    return packing.pack(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op7_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode_decode(_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.score(_table(spark, sf, "documents"), _remainder(7) != 2)


@query
def op9_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    usable = _table(spark, sf, "embeddings").filter(topk.usable(F.col("embedding")))
    rows = usable.select("vec_id", topk.whole_parts(F.col("embedding"), 64).alias("vector"))
    return topk.top_k(rows.filter(F.col("vec_id") % 20 == 0), rows, 20)


@query
def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.mark(_table(spark, sf, "documents"))


@query
def op11_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.compare_with_next(_table(spark, sf, "documents"))


@query
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return turns.audits(turns.damage(_table(spark, sf, "conversations")))


@query
def op13_cross_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return crosstok.align(
        _table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op1_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
        windows AS (
            SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
        hit AS (SELECT doc_id, list(i ORDER BY i) AS starts FROM
            (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE doc_id > least GROUP BY doc_id),
        gone AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS places FROM hit),
        kept AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
            CASE WHEN places IS NULL THEN w ELSE [w[p] FOR p IN range(1, len(w) + 1) IF NOT list_contains(places, p)] END AS k
            FROM d LEFT JOIN gone USING (doc_id))
        SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept""",
    "op4_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        members AS (
            SELECT DISTINCT doc_id, h FROM (
                SELECT doc_id, md5(array_to_string(list_slice(w, i, i + 3), ' ')) AS h
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
                UNION ALL SELECT doc_id, md5(len(w) || array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 3)),
        sizes AS (SELECT doc_id, count(*) AS n FROM members GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM members a JOIN members b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
        least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id
        FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON x = d.doc_id""",
    "op9_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        ranked AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
                row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
