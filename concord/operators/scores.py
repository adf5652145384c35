"""Ratios, marks and batch reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import vocab


def match_ratio(rows: DataFrame, flag: str, out: str, by: str = "submission_id") -> DataFrame:
    """Mean of a boolean per submission."""
    return rows.groupBy(by).agg(F.avg(F.col(flag).cast("double")).alias(out))


def view_ratio(matches: DataFrame, n_views: int) -> DataFrame:
    """Matched views over expected views."""
    return matches.groupBy("submission_id").agg((F.count(F.lit(1)) / F.lit(n_views)).alias("view_ratio"))


def table_results(mapped: DataFrame, matches: DataFrame, pk: DataFrame, fk: DataFrame, answer: DataFrame) -> DataFrame:
    """Per mapped table: matched columns, enough columns, key and reference equality.

    ``matches`` (submission_id, ans_table, matched_cols).
    """
    sizes = answer.groupBy(F.col("cleaned_name").alias("ans_table")).agg(F.count(F.lit(1)).alias("n"))
    lead = ["submission_id", "ans_table"]
    matched = F.coalesce("matched_cols", F.lit(0))
    return (
        mapped.select(*lead, "stu_table", "cosine")
        .join(sizes, "ans_table")
        .join(matches, lead, "left")
        .join(pk.select(*lead, "pk_ok"), lead)
        .join(fk.select(*lead, "fk_ok"), lead)
        .select(*lead, "stu_table", "cosine", matched.alias("matched_cols"),
                (matched / F.col("n") >= vocab.ENOUGH_COLUMNS).alias("enough_cols"), "pk_ok", "fk_ok")
    )


def schema_score(results: DataFrame, submissions: DataFrame, answer: DataFrame, per_table: float = vocab.SCORE_PER_TABLE) -> DataFrame:
    """Score = tables with enough columns and equal keys and references; overall column ratio."""
    total = answer.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    hit = F.col("enough_cols") & F.col("pk_ok") & F.col("fk_ok")
    sums = results.groupBy("submission_id").agg(
        F.count_if(hit).alias("hit_tables"), F.sum("matched_cols").alias("matched_cols"), F.count(F.lit(1)).alias("mapped_tables")
    )
    return submissions.select("submission_id").join(sums, "submission_id", "left").na.fill(0).select(
        "submission_id", "mapped_tables", "hit_tables", (F.col("hit_tables") * per_table).alias("schema_score"),
        (F.col("matched_cols") / F.lit(total)).alias("column_ratio"),
    )


def table_report(results: DataFrame) -> DataFrame:
    """Complete/incomplete status row per mapped table."""
    hit = F.col("enough_cols") & F.col("pk_ok") & F.col("fk_ok")
    return results.select(
        "submission_id", "ans_table", "stu_table", "cosine", "enough_cols", "pk_ok", "fk_ok",
        F.when(hit, F.lit(vocab.TABLE_COMPLETE)).otherwise(F.lit(vocab.TABLE_INCOMPLETE)).alias("status"),
    )


def marks(ratios: DataFrame, weights: dict[str, int] = vocab.MARKS, ceiling: float = vocab.MARK_CEILING) -> DataFrame:
    """Ratios to marks: each times its weight, the total rounded and capped.

    ``ratios`` (submission_id, column_ratio, fk_ratio, data_ratio, business_ratio, view_ratio).
    """
    def mark(kind: str) -> Column:
        return F.col(f"{kind}_ratio") * weights[kind]

    total = sum((mark(k) for k in ("column", "fk", "data", "view", "business")), F.lit(0.0))
    return ratios.select(
        "submission_id",
        *[F.round(f"{k}_ratio", 4).alias(f"{k}_ratio") for k in ("column", "fk", "data", "business", "view")],
        F.round(mark("column"), 2).alias("mark_a1"), F.round(mark("fk"), 2).alias("mark_a2"),
        F.round(mark("data"), 2).alias("mark_a3"), F.round(mark("view"), 2).alias("mark_b"),
        F.round(mark("business"), 2).alias("mark_c"),
        F.least(F.round(total, 2), F.lit(ceiling)).alias("total"),
    )


def summary(
    submissions: DataFrame, column_pairs: DataFrame, fk_pairs: DataFrame, report: DataFrame, view_matches: DataFrame, n_views: int,
    scope: str = "all",
) -> DataFrame:
    """Marks of every submission; whatever a submission lacks counts 0.

    ``scope='mapped'`` leaves the columns of unmapped answer tables out of the column ratio.
    """
    cols = column_pairs if scope == "all" else column_pairs.filter("stu_table is not null")
    yes = F.avg((F.col("data_ok") == vocab.YES).cast("double")).alias("data_ratio"), F.avg(
        (F.col("rule_ok") == vocab.YES).cast("double")).alias("business_ratio")
    parts = [
        match_ratio(cols, "match", "column_ratio"),
        match_ratio(fk_pairs, "is_matched", "fk_ratio"),
        report.groupBy("submission_id").agg(*yes),
        view_ratio(view_matches, n_views),
    ]
    out = submissions.select("submission_id")
    for part in parts:
        out = out.join(part, "submission_id", "left")
    return marks(out.na.fill(0.0))


def enrich(schema_scores: DataFrame, overall: DataFrame, fk_pairs: DataFrame, n_tables: int) -> DataFrame:
    """Schema scores with business percentage, foreign key ratio and table match ratio, zeros by default."""
    fk = match_ratio(fk_pairs, "is_matched", "fk_ratio")
    return (
        schema_scores.join(overall, "submission_id", "left").join(fk, "submission_id", "left")
        .select(
            "submission_id", "schema_score",
            F.coalesce("business_score", F.lit(0)).alias("business_score"),
            F.coalesce("business_max", F.lit(0)).alias("business_max"),
            F.coalesce("business_complete", F.lit(False)).alias("business_complete"),
            F.coalesce(F.try_divide(F.col("business_score") * 100, F.col("business_max")), F.lit(0.0)).alias("business_percentage"),
            F.coalesce("total_tables", F.lit(0)).alias("tables_compared"),
            F.coalesce("exact_matches", F.lit(0)).alias("tables_matched"),
            F.coalesce("all_tables_match", F.lit(False)).alias("all_tables_match"),
            F.coalesce("fk_ratio", F.lit(0.0)).alias("fk_ratio"),
            F.lit(n_tables).alias("total_tables"),
            F.coalesce(F.try_divide(F.col("hit_tables"), F.lit(n_tables)), F.lit(0.0)).alias("table_match_ratio"),
        )
    )


def batch_statistics(scores: DataFrame, score: str) -> DataFrame:
    """Number of submissions, average, highest and lowest score."""
    return scores.agg(
        F.count(score).alias("submissions"), F.round(F.avg(score), 4).alias("average"),
        F.max(score).alias("highest"), F.min(score).alias("lowest"),
    )


def score_card(rows: DataFrame, by: str, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """Weighted score per entity from boolean checks over its rows."""
    shares = rows.groupBy(by).agg(*[F.avg(c.cast("double")).alias(n) for n, (c, _) in checks.items()])
    total = sum((F.coalesce(n, F.lit(0.0)) * w for n, (_, w) in checks.items()), F.lit(0.0))
    return shares.select(by, *[F.round(n, 4).alias(n) for n in checks], F.round(total, 2).alias("total"))
