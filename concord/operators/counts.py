"""Row count reconciliation and business rule deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import names, vocab
from concord.operators import pairs
from concord.session import local_table


def delta_rules(spark: SparkSession, expected: dict[str, int]) -> DataFrame:
    """Expected increases keyed by canonical table name."""
    return local_table(spark, list(expected.items()), "table_name string, expected_increase int").withColumn(
        "table_key", table_key("table_name")
    )


def table_key(c: Column | str) -> Column:
    return names.squeeze(names.canonical(c))


def count_checks(mapping: DataFrame, answer_counts: DataFrame, student_counts: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Row counts of every mapped pair, classified.

    ``mapping`` (submission_id, ans_table, stu_table, original_name); ``answer_counts``
    (ans_table, row_count); ``student_counts`` (submission_id, original_name, row_count).
    """
    joined = (
        mapping.select("submission_id", "ans_table", "stu_table", "original_name")
        .join(answer_counts.select("ans_table", F.col("row_count").alias("answer_count")), "ans_table", "left")
        .join(student_counts.select("submission_id", "original_name", F.col("row_count").alias("student_count")),
              ["submission_id", "original_name"], "left")
    )
    joined = joined.withColumn("table_key", table_key("ans_table")).join(
        delta_rules(mapping.sparkSession, expected).select("table_key", F.col("expected_increase").alias("_rule")), "table_key", "left"
    )
    rule = F.col("_rule")
    error = (
        F.when(F.col("stu_table").isNull(), F.lit("unmapped"))
        .when(F.col("answer_count").isNull(), F.lit("answer_not_counted"))
        .when(F.col("student_count").isNull(), F.lit("student_not_counted"))
    )
    difference = F.when(error.isNull(), F.col("student_count") - F.col("answer_count"))
    out = joined.select(
        "submission_id", "ans_table", "stu_table", "original_name", "answer_count", "student_count",
        difference.alias("difference"), F.coalesce(difference == 0, F.lit(False)).alias("exact_match"),
        rule.isNotNull().alias("is_business"), F.coalesce(rule, F.lit(0)).alias("expected_increase"), error.alias("error"),
    )
    status = (
        F.when(F.col("error").isNotNull(), F.lit("error"))
        .when(F.col("is_business") & (F.col("difference") == F.col("expected_increase")), F.lit("business_logic_correct"))
        .when(F.col("is_business") & F.col("exact_match"), F.lit("data_correct_business_logic_missing"))
        .when(F.col("is_business"), F.lit("incorrect_business_logic"))
        .when(F.col("exact_match"), F.lit("correct_data_import"))
        .otherwise(F.lit("incorrect_data_import"))
    )
    return out.withColumn("status", status)


def count_overall(checks: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Counters and one overall status per submission."""
    valid = F.col("error").isNull()
    business, regular = F.col("is_business") & valid, ~F.col("is_business") & valid

    def n(condition: Column) -> Column:
        return F.count_if(condition)

    sums = checks.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("total_tables"),
        n(F.col("exact_match")).alias("exact_matches"),
        n(business).alias("business_tables"),
        n(regular).alias("regular_tables"),
        n(F.col("status") == "business_logic_correct").alias("business_score"),
        n(F.col("status") == "correct_data_import").alias("data_score"),
        n(F.col("error") == "unmapped").alias("unmapped_tables"),
        n(F.col("error") == "student_not_counted").alias("query_errors"),
        F.bool_and(F.col("error").isNull() & F.when(
            F.col("is_business"), F.col("difference") == F.col("expected_increase")).otherwise(F.col("exact_match"))
        ).alias("_perfect"),
        F.bool_and("exact_match").alias("all_tables_match"),
    ).withColumn("business_max", F.lit(len(expected)))
    data_done = F.col("data_score") == F.col("regular_tables")
    business_done = F.col("business_score") == F.col("business_max")
    status = (
        F.when((F.col("unmapped_tables") > 0) | (F.col("query_errors") > 0), F.lit("critical_errors_mapping_or_querying"))
        .when(data_done & business_done & F.col("_perfect"), F.lit("perfect_all_correct"))
        .when(data_done & business_done, F.lit("complete_with_business_logic"))
        .when(data_done, F.lit("data_complete_business_partial_or_incorrect"))
        .when(business_done, F.lit("data_partial_or_incorrect_business_complete"))
        .otherwise(F.lit("incomplete_data_and_business_logic"))
    )
    return sums.withColumns({
        "data_complete": data_done, "business_complete": business_done, "overall_status": status,
    }).drop("_perfect")


def count_report(checks: DataFrame, overall: DataFrame, baseline: str = "after") -> DataFrame:
    """Report rows with two yes/no flags, a status and a note.

    With ``baseline='after'`` the answer already holds the business rows, so an equal count is
    right and one row less in a business table is data without the rule.  With 'before' the
    submission is expected to have the increase on top of the answer.
    """
    d, business, bad = F.col("difference"), F.col("is_business"), F.col("error").isNotNull()
    if baseline == "after":
        rule_ok, data_only = d == 0, business & (d == -1)
    else:
        rule_ok, data_only = d == F.col("expected_increase"), business & (d == 0)
    data_ok = F.coalesce(~bad & (rule_ok | data_only), F.lit(False))
    rule_ok = F.coalesce(~bad & rule_ok, F.lit(False))

    def label(flag: Column) -> Column:
        return F.when(flag, F.lit(vocab.YES)).otherwise(F.lit(vocab.NO))

    status = (
        F.when(bad, F.lit(vocab.STATUS_ERROR))
        .when(data_ok & ~business, F.lit(vocab.STATUS_DATA))
        .when(data_ok & rule_ok, F.lit(vocab.STATUS_BUSINESS))
        .when(business, F.lit(vocab.STATUS_BUSINESS_WRONG))
        .otherwise(F.lit(vocab.STATUS_DATA_WRONG))
    )
    note = (
        F.when(bad, F.col("error"))
        .when(data_ok & ~business, F.lit(vocab.NOTE_DATA))
        .when(data_ok & rule_ok, F.lit(vocab.NOTE_BUSINESS))
        .when(business, F.format_string(vocab.NOTE_BUSINESS_WRONG, d))
        .otherwise(F.format_string(vocab.NOTE_DATA_WRONG, d))
    )
    score = overall.select("submission_id", F.format_string("%d/%d", "business_score", "business_max").alias("business_points"))
    return checks.join(score, "submission_id").select(
        "submission_id", "ans_table", "original_name", "answer_count", "student_count", "difference",
        label(data_ok).alias("data_ok"), label(rule_ok).alias("rule_ok"), label(business).alias("business_table"),
        "business_points", status.alias("status"), note.alias("note"),
    )


def count_summary(checks: DataFrame, overall: DataFrame) -> DataFrame:
    """One row per submission and table across the batch, with a short description."""
    d = F.col("difference")
    text = (
        F.when(F.col("exact_match") & F.col("is_business"), F.lit(vocab.SUMMARY_PERFECT))
        .when(F.col("exact_match"), F.lit(vocab.SUMMARY_EQUAL))
        .when(F.col("is_business") & (F.col("status") == "incorrect_business_logic"), F.lit(vocab.SUMMARY_BUSINESS_WRONG))
        .when(F.col("is_business") | d.isNull(), F.lit(vocab.SUMMARY_DIFFERENT))
        .otherwise(F.concat(F.lit(vocab.SUMMARY_DIFFERENT + " "), d.cast("string")))
    )
    lead = overall.select("submission_id", "business_complete", "overall_status",
                          F.format_string("%d/%d", "business_score", "business_max").alias("business_points"))
    return checks.join(lead, "submission_id").select(
        "submission_id", "ans_table", "original_name", "answer_count", "student_count", "difference",
        F.col("exact_match").cast("int").alias("rows_match"), F.col("business_complete").cast("int").alias("business_done"),
        F.col("is_business").cast("int").alias("business_table"), "business_points",
        F.col("overall_status").alias("data_status"), text.alias("note"),
    )


def business_delta(
    submissions: DataFrame, expected: dict[str, int], answer_counts: DataFrame, student_counts: DataFrame
) -> DataFrame:
    """Actual against expected increase of every rule table, with the submission's score.

    Counts are keyed by canonical table name: ``answer_counts`` (table_key, row_count),
    ``student_counts`` (submission_id, table_key, row_count).
    """
    rules = delta_rules(submissions.sparkSession, expected)
    rows = (
        pairs.per_submission(submissions, rules)
        .join(answer_counts.select("table_key", F.col("row_count").alias("answer_count")), "table_key", "left")
        .join(student_counts.select("submission_id", "table_key", F.col("row_count").alias("student_count")),
              ["submission_id", "table_key"], "left")
        .withColumn("actual_increase", F.coalesce(F.col("student_count") - F.col("answer_count"), F.lit(0)))
        .withColumn("readable", F.col("student_count").isNotNull() & F.col("answer_count").isNotNull())
        .withColumn("correct", F.col("readable") & (F.col("actual_increase") == F.col("expected_increase")))
    )
    totals = rows.groupBy("submission_id").agg(
        F.count_if("correct").alias("score"), F.bool_and("correct").alias("all_correct")
    )
    return rows.join(totals, "submission_id").select(
        "submission_id", "table_name", "answer_count", "student_count", "expected_increase", "actual_increase", "correct",
        "all_correct", F.format_string("%d/%d", "score", F.lit(len(expected))).alias("points"),
        F.when(F.col("correct"), F.lit("OK")).otherwise(
            F.format_string(vocab.NOTE_DELTA, "actual_increase", "expected_increase")).alias("note"),
    )


def score_distribution(delta: DataFrame) -> DataFrame:
    """Submissions per score, in score order."""
    return delta.select("submission_id", "points").distinct().groupBy("points").agg(F.count(F.lit(1)).alias("submissions")).orderBy("points")


def delta_statistics(delta: DataFrame) -> DataFrame:
    """Submissions, fully read ones, perfect ones and the perfect rate in percent."""
    per = delta.groupBy("submission_id").agg(
        F.first("all_correct").alias("perfect"), F.bool_and(F.col("student_count").isNotNull()).alias("read")
    )
    return per.agg(
        F.count(F.lit(1)).alias("submissions"), F.count_if("read").alias("fully_read"), F.count_if("perfect").alias("perfect"),
        F.round(F.avg(F.col("perfect").cast("double")) * 100, 1).alias("perfect_rate"),
    )
