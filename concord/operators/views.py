"""Matching views, or any named query results, by shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators import assign


def match_by_shape(answer: DataFrame, student: DataFrame) -> DataFrame:
    """Every (answer view, student view) with equal numbers of columns and rows; NULL matches nothing."""
    a = answer.select(F.col("view_name").alias("view"), "num_columns", "num_rows")
    return student.select("submission_id", F.col("view_name").alias("stu_view"), "num_columns", "num_rows").join(
        a, ["num_columns", "num_rows"]
    ).select("submission_id", "view", "stu_view", "num_columns", "num_rows")


def match_by_name(answer: DataFrame, student: DataFrame) -> DataFrame:
    """Views of the same name whose shapes agree."""
    a = answer.select("view_name", F.col("num_columns").alias("ans_cols"), F.col("num_rows").alias("ans_rows"))
    b = student.select("submission_id", "view_name", F.col("num_columns").alias("stu_cols"), F.col("num_rows").alias("stu_rows"))
    return b.join(a, "view_name").filter("ans_cols = stu_cols and ans_rows = stu_rows").select(
        "submission_id", F.col("view_name").alias("view"), "ans_cols", "stu_cols", "ans_rows", "stu_rows", F.lit(True).alias("matched")
    )


def match_one_to_one(answer: DataFrame, student: DataFrame) -> DataFrame:
    """Shape matches with every view used once, in name order."""
    return assign.greedy(
        match_by_shape(answer, student), ["submission_id"], "view", "stu_view", ["view", "stu_view"], descending=False
    )
