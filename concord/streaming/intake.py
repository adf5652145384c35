"""Grading submissions as they arrive: whole and resubmitted, in parts, or as running totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concord.sources import files, store

#: Batches of running totals after which they are merged into one folder.
MERGE_EVERY = 16


def _arrivals(
    spark: SparkSession, folder: str, schema: str, run: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int | None
) -> StreamingQuery:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(folder).writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def grade_arrivals(
    spark: SparkSession,
    folder: str,
    schema: str,
    grade: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Run ``grade`` on each batch of new files and replace the graded submissions in ``out``.

    Stops when everything present has been graded.  A submission arrives whole, in files of one
    batch; when it arrives again, it replaces what was there.  A batch that is repeated after a
    failure replaces the same submissions again.
    """
    def run(batch: DataFrame, _: int) -> None:
        store.replace_submissions(grade(batch), out)

    return _arrivals(spark, folder, schema, run, checkpoint, files_per_batch)


def grade_parts(
    spark: SparkSession,
    folder: str,
    schema: str,
    grade: Callable[[DataFrame], DataFrame],
    out: str,
    rows: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    submission: str = "submission_id",
    buckets: int = 64,
) -> StreamingQuery:
    """Grade submissions whose rows come spread over any number of files and batches.

    Every batch's rows are kept under ``rows``, in a folder of the batch's number and buckets of
    the submission (``submission`` is its id in SQL); then the submissions of the batch are graded
    anew over all their rows so far, read from their buckets alone, and replaced in ``out``.  So
    after the last batch each grade is that of the whole submission, in whatever order its parts
    came, for any ``grade``.  A repeated batch writes its folder again and changes nothing.
    """
    def run(batch: DataFrame, number: int) -> None:
        keep_part(batch, number, rows, submission, buckets)
        store.replace_submissions(grade(touched_rows(spark, number, rows)), out)

    return _arrivals(spark, folder, schema, run, checkpoint, files_per_batch)


def keep_part(batch: DataFrame, number: int, rows: str, submission: str, buckets: int) -> None:
    """The rows of one batch, in a folder of its number; written again if the batch is repeated."""
    marked = batch.withColumn("_submission", F.expr(submission).cast("string")).withColumn("_bucket", F.pmod(F.xxhash64("_submission"), F.lit(buckets)).cast("int"))
    marked.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{rows}/_batch={number}")


def touched_rows(spark: SparkSession, number: int, rows: str) -> DataFrame:
    """All rows so far of the submissions that batch ``number`` brought rows of."""
    kept = spark.read.parquet(rows)
    new = spark.read.parquet(f"{rows}/_batch={number}").select("_submission", "_bucket").distinct()
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most as many as there are buckets
    return kept.filter(F.col("_bucket").isin(touched)).join(new.select("_submission"), "_submission", "left_semi").drop("_submission", "_bucket", "_batch")


def total_arrivals(
    spark: SparkSession,
    folder: str,
    schema: str,
    partial: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Running totals of submissions whose rows come in parts, where totals of parts add up.

    ``partial`` maps rows to totals per submission, ``merge`` totals of the same columns to their
    sums; rows themselves are not kept.  A batch's totals lie in a folder of its number, written
    again if the batch is repeated; every ``merge_every`` batches all of them are merged into one
    folder, which counts from the moment it is complete.  ``read_totals`` gives the state.
    """
    def run(batch: DataFrame, number: int) -> None:
        add_totals(partial(batch), number, merge, out, merge_every)

    return _arrivals(spark, folder, schema, run, checkpoint, files_per_batch)


def add_totals(totals: DataFrame, number: int, merge: Callable[[DataFrame], DataFrame], out: str, merge_every: int = MERGE_EVERY) -> None:
    """One batch's totals; what is already merged is not added again."""
    spark = totals.sparkSession
    if number <= _merged(spark, out):
        return
    totals.write.mode("overwrite").parquet(f"{out}/batch={number}")
    if (number + 1) % merge_every == 0:
        read_totals(spark, merge, out).write.mode("overwrite").parquet(f"{out}/merged={number}")


def _merged(spark: SparkSession, out: str) -> int:
    """Number of the last batch in a complete merged folder; -1 without one."""
    folders = [int(n.removeprefix("merged=")) for n in files.children(spark, out) if n.startswith("merged=")]
    return max((n for n in folders if files.exists(spark, f"{out}/merged={n}/_SUCCESS")), default=-1)


def read_totals(spark: SparkSession, merge: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """The merged totals of all batches so far."""
    last = _merged(spark, out)
    batches = [int(n.removeprefix("batch=")) for n in files.children(spark, out) if n.startswith("batch=")]
    parts = [f"{out}/batch={n}" for n in sorted(batches) if n > last and files.exists(spark, f"{out}/batch={n}/_SUCCESS")]
    return merge(spark.read.parquet(*([f"{out}/merged={last}"] if last >= 0 else []), *parts))
