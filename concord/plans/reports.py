"""The reports of a batch as files, one per submission and kind, and the summary worked out from such files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import vocab
from concord.operators import scores
from concord.plans.batch import Batch
from concord.session import plan_by_rows
from concord.sources import folders, store

# Kinds of report as in their file names, and headings of those that have no others.
PAIRS, FKS, COUNTS, VIEWS, SUMMARY = "pairs", "fk", "rowcount", "views", "summary"
FK_HEADINGS = {"ans_fk": "ans_fk", "answer_fk": "answer_fk", "student_fk": "student_fk", "similarity": "similarity", "is_matched": "is_matched"}
VIEW_HEADINGS = {"view": "view", "stu_view": "stu_view", "num_columns": "num_columns", "num_rows": "num_rows"}
HEADINGS = {
    PAIRS: vocab.PAIR_HEADINGS, FKS: FK_HEADINGS, VIEWS: VIEW_HEADINGS,
    COUNTS: {c: h for c, h in vocab.COUNT_HEADINGS.items() if c != "submission_id"},
}


def write_reports(batch: Batch, path: str) -> None:
    """Column pairs, foreign keys, row counts and views of every submission as ``path``/<submission_id>_<kind>.csv."""
    reports = {PAIRS: batch.column_pairs, FKS: batch.fk_pairs, COUNTS: batch.count_report, VIEWS: batch.view_matches}
    for kind, report in reports.items():
        folders.write_reports(store.headed(report, {"submission_id": "submission_id", **HEADINGS[kind]}), path, kind)


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A report back under the names that its columns had; everything is text."""
    headings = HEADINGS[kind]
    back = folders.read_reports(spark, path, kind, ", ".join(f"`{h}` string" for h in headings.values()))
    return back.select("submission_id", *[F.col(f"`{h}`").alias(c) for c, h in headings.items()])


def summary_from_files(spark: SparkSession, path: str, n_views: int = vocab.EXPECTED_VIEWS, submissions: DataFrame | None = None) -> DataFrame:
    """Marks from the report files alone, each submission's files joined by the id in their names.

    Without ``submissions`` those with a file of column pairs are marked.  A missing file counts 0.
    """
    plan_by_rows(spark)
    pairs = _read(spark, path, PAIRS).withColumn("match", F.col("match").cast("boolean"))
    fks = _read(spark, path, FKS).withColumn("is_matched", F.col("is_matched").cast("boolean"))
    listed = pairs.select("submission_id").distinct() if submissions is None else submissions
    return scores.summary(listed, pairs, fks, _read(spark, path, COUNTS), _read(spark, path, VIEWS), n_views)


def write_summary(summary: DataFrame, path: str) -> None:
    """The summary of all submissions under its headings; rows stay dealt over tasks, so there are several CSV files."""
    store.write_report(store.headed(summary, vocab.SUMMARY_HEADINGS), path)
