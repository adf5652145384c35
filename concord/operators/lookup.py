"""Blocked fuzzy lookup: every answer column looked for in the submission's like-named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import names, similarity, vocab
from concord.operators import pairs
from concord.operators.tables import shape_columns, table_shapes
from concord.session import settle


def table_blocks(answer: DataFrame, shapes: DataFrame, min_table: float = vocab.FUZZY_MIN, limit: int = pairs.ANSWER_LIST_LIMIT) -> DataFrame:
    """(submission, ans_table, original_name, shape): tables of equal canonical name, else similar ones.

    A name without a letter or digit is like no other.
    """
    ans = answer.select("cleaned_name", F.col("original_name").alias("ans_original")).distinct().withColumn(
        "a", names.canonical("ans_original")
    )
    stu = shapes.select("submission_id", "original_name", "shape").withColumn("b", names.canonical("original_name"))
    stu = settle(stu)
    equal = settle(stu.join(ans.filter("a <> ''"), F.col("b") == F.col("a")).select("submission_id", F.col("cleaned_name").alias("ans_table"), "original_name", "shape"))
    # distinct table names against the answer's
    def like(a: str, b: str) -> str:
        score = ", ".join(f(f"{a}_canon", f"{b}_canon") for f in (similarity.token_set_ratio_sql, similarity.ratio_sql, similarity.partial_ratio_sql))
        return f"({a}_canon <> '' AND {b}_canon <> '' AND greatest({score}) >= {min_table})"

    found = pairs.like_names(
        ans.select(F.col("a").alias("ans_name"), F.col("a").alias("ans_name_canon")).distinct(),
        stu.select(F.col("b").alias("stu_name"), F.col("b").alias("stu_name_canon")).distinct().filter(~F.col("b").startswith("stage ")), like, min_table, limit)
    near = settle(found.withColumnsRenamed({"ans_name": "a", "stu_name": "b"}).join(ans, "a").select("b", "cleaned_name"))
    similar = (
        pairs.join_back(stu, near, ["b"]).select("submission_id", F.col("cleaned_name").alias("ans_table"), "original_name", "shape")
        .join(equal.select("submission_id", "ans_table").distinct(), ["submission_id", "ans_table"], "left_anti")
    )
    return equal.unionByName(similar)


def blocked_lookup(answer: DataFrame, columns: DataFrame, submissions: DataFrame, threshold: float = vocab.FUZZY_MIN, limit: int = pairs.ANSWER_LIST_LIMIT) -> DataFrame:
    """Result 1 with the first candidate's score at or above ``threshold``, else 0 with the best score.

    Candidates run in table, then column order.  Scores are worked out per distinct name pair,
    first hits per distinct (answer table, shape).
    """
    shapes = settle(table_shapes(columns))
    content = settle(shape_columns(columns, shapes).withColumn("b", names.canonical("column_name")))
    blocks = settle(table_blocks(answer, shapes, limit=limit))
    ans = answer.select(
        F.col("cleaned_name").alias("ans_table"), F.col("column_name").alias("ans_col"), names.canonical("column_name").alias("a")
    )
    wanted = blocks.select("ans_table", "shape").distinct()
    candidates = wanted.join(ans, "ans_table").join(content, "shape").select("ans_table", "shape", "ans_col", "ordinal", "a", "b")
    candidates = settle(candidates)
    scored = candidates.select("a", "b").distinct().withColumn("score", similarity.fuzzy("a", "b"))
    hit = F.when(F.col("score") >= threshold, F.struct("ordinal", "score"))
    per_shape = settle(
        candidates.join(scored, ["a", "b"]).groupBy("ans_table", "shape", "ans_col")
        .agg(F.min(hit).alias("first_hit"), F.max("score").alias("best"))
    )
    first = F.min(F.when(F.col("first_hit").isNotNull(), F.struct("original_name", "first_hit")))
    found = pairs.join_back(blocks, per_shape, ["ans_table", "shape"]).groupBy("submission_id", "ans_table", "ans_col").agg(
        first.alias("f"), F.max("best").alias("best")
    )
    return pairs.per_submission(submissions, ans.select("ans_table", "ans_col")).join(
        found, ["submission_id", "ans_table", "ans_col"], "left"
    ).select(
        "submission_id", "ans_table", "ans_col", F.col("f").isNotNull().cast("int").alias("result"),
        F.round(F.coalesce(F.col("f.first_hit.score"), F.col("best"), F.lit(0.0)), 6).alias("best_score"),
    )


def lookup_totals(lookup: DataFrame) -> DataFrame:
    """Hits per submission."""
    return lookup.groupBy("submission_id").agg(F.sum("result").alias("score"))
