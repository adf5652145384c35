"""The grading store, report files and the embedding cache."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import names, texts
from concord.sources import files


#: Versions of a store after which they are merged into one.
MERGE_EVERY = 16


def replace_submissions(df: DataFrame, path: str, buckets: int = 64, merge_every: int = MERGE_EVERY) -> None:
    """Write rows keyed by ``submission_id``; submissions present in ``df`` replace their stored rows.

    The rows become a new version in a folder of its own, next to a list of its submissions; nothing that is stored is
    written again.  A manifest, a small file that names the versions from old to new, is put in place last: until then
    readers see the old state, and a writer that fails changes nothing.  Every ``merge_every`` versions the
    rows that still count are merged into one, in ``buckets`` parts.  One writer at a time.
    """
    spark = df.sparkSession
    number, versions = _manifest(spark, path)
    versions = [*versions, _write_version(df, path)]
    if len(versions) >= merge_every:
        versions = [_write_version(_live(spark, path, versions).repartition(buckets, "submission_id"), path)]
    _commit(spark, path, number + 1, versions)


def _write_version(df: DataFrame, path: str) -> str:
    """Rows in a new folder, and which submissions they are of."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/rows/{name}")
    df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows/{name}").select("submission_id").distinct().write.parquet(f"{path}/ids/{name}")
    return name


def _manifest(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number and versions of the manifest in force; 0 and none where nothing is stored."""
    numbers = [int(n) for n in files.children(spark, f"{path}/manifest") if n.isdigit()]
    if not numbers:
        if [n for n in files.children(spark, path) if n not in ("rows", "ids", "manifest") and not n.startswith(".")]:
            raise ValueError(f"{path} holds something else than a store")
        return 0, []
    last = max(numbers)
    return last, files.read_text(spark, f"{path}/manifest/{last}").split()


def _commit(spark: SparkSession, path: str, number: int, versions: list[str]) -> None:
    """The new manifest under its number: written beside, then renamed."""
    if files.exists(spark, f"{path}/manifest/{number}"):
        raise RuntimeError(f"another writer has changed {path}")
    beside = f"{path}/manifest/_{uuid.uuid4().hex}"
    files.write_text(spark, beside, "\n".join(versions))
    files.rename(spark, beside, f"{path}/manifest/{number}")


def _live(spark: SparkSession, path: str, versions: list[str]) -> DataFrame:
    """Rows of every version without the submissions of later ones; the newest is taken as it is."""
    out, later = None, None
    for name in reversed(versions):
        rows, ids = spark.read.parquet(f"{path}/rows/{name}"), spark.read.parquet(f"{path}/ids/{name}")
        kept = rows if later is None else rows.join(later, "submission_id", "left_anti")
        out = kept if out is None else out.unionByName(kept, allowMissingColumns=True)
        later = ids if later is None else later.unionByName(ids)
    return out


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows that count as of now."""
    _, versions = _manifest(spark, path)
    if not versions:
        raise ValueError(f"nothing is stored in {path}")
    return _live(spark, path, versions)


def remove_unused(spark: SparkSession, path: str) -> None:
    """Folders and manifests that the manifest in force does not name; not while anyone still reads an older state."""
    number, versions = _manifest(spark, path)
    for part, kept in (("rows", versions), ("ids", versions), ("manifest", [str(number)])):
        for name in files.children(spark, f"{path}/{part}"):
            if name not in kept and not name.startswith("."):
                files.remove(spark, f"{path}/{part}/{name}")


def resolve_ids(keys: DataFrame, tables: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key columns with surrogate table and column ids, and the key columns that resolve to none."""
    t = tables.select("submission_id", "original_name", "table_id")
    c = columns.select("submission_id", "table_id", "column_name", "column_id")
    joined = keys.join(t, ["submission_id", "original_name"], "left").join(c, ["submission_id", "table_id", "column_name"], "left")
    reason = F.when(F.col("table_id").isNull(), F.lit("table")).otherwise(F.lit("column"))
    return joined.filter("column_id is not null"), joined.filter("column_id is null").withColumn("missing", reason)


def headed(df: DataFrame, headings: dict[str, str]) -> DataFrame:
    """The columns of a report file in order, under their headings."""
    return df.select(*[F.col(c).alias(h) for c, h in headings.items()])


def write_report(df: DataFrame, path: str, per_submission: bool = False) -> None:
    """CSV with a header row: one report for the batch, or a folder per submission (small batches)."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy("submission_id") if per_submission else writer).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Report files back, the submission id taken from their folder where it names one."""
    return spark.read.option("header", True).schema(schema).csv(path)


def read_result_files(spark: SparkSession, folder: str, suffix: str, schema: str) -> DataFrame:
    """Files named <id><suffix>.csv in one folder, with the id from the file name."""
    stem = names.file_stem("_metadata.file_path")
    return (
        spark.read.option("header", True).schema(schema).csv(f"{folder}/*{suffix}.csv")
        .withColumn("submission_id", F.regexp_replace(stem, suffix + "$", ""))
    )


def embed_cached(texts_df: DataFrame, cache_path: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, text, vector) of every distinct text; only texts missing in the cache are embedded.

    The cache is keyed by sha256 of the text.  ``embed`` maps (key, text) to (key, text, vector)
    and may call a provider through mapInPandas; the default is the hash vector.
    """
    spark = texts_df.sparkSession
    embed = embed or (lambda df: df.withColumn("vector", texts.hash_vector(F.col("text"))))
    wanted = texts_df.select("text").distinct().select(F.sha2("text", 256).alias("key"), "text")
    missing = wanted
    if files.exists(spark, cache_path):
        missing = wanted.join(spark.read.parquet(cache_path).select("key"), "key", "left_anti")
    embed(missing).write.mode("append").parquet(cache_path)
    return spark.read.parquet(cache_path).join(wanted.select("key"), "key", "left_semi")
