"""What the optimizer takes for the size of a table: too small a figure is broadcast through the driver."""

import re

import pytest
from pyspark.sql import functions as F

from concord.operators import pairs
from concord.plans.registry import QUERIES
from concord.session import local_table, settle
from concord.sources import synthetic
from concord.sources.tables import read_table

#: Bytes of a row in memory at least: the null bits and a field.
ROW = 16


@pytest.fixture
def customers(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def estimated(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_catalogs_are_not_taken_for_small(spark, customers):
    for df in (synthetic.raw_columns(spark, customers), synthetic.raw_keys(spark, customers), synthetic.raw_fks(spark, customers)):
        assert estimated(df) >= df.count() * ROW


def test_files_of_few_bytes_a_row_are_not_taken_for_small(spark, customers):
    read_table(spark, customers, "customer")
    names = settle(synthetic.raw_columns(spark, customers).select("submission_id", "original_name").distinct())
    assert estimated(names) >= names.count() * ROW


def test_growing_sides_are_not_broadcast(spark, customers):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("base_tables", "attach_keys", "unresolved_keys", "key_ids", "fk_system_tables"):
            plan = QUERIES[name](spark, customers)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_every_item_for_every_submission(spark):
    rows = local_table(spark, [("1",), (None,), ("1",)], "submission_id string")
    items = local_table(spark, [("a", 1), (None, 2)], "ans_table string, n int")
    assert sorted(map(str, pairs.per_submission(rows, items).collect())) == sorted(
        f"Row(submission_id={s!r}, ans_table={t!r}, n={n})" for s in ("1", None, "1") for t, n in (("a", 1), (None, 2)))
    assert pairs.per_submission(rows, items.limit(0)).collect() == []


def test_joined_names_are_tested_once_a_pair(spark):
    """The test may not be pushed under the removal of repeated pairs."""
    a = local_table(spark, [("order key", "order key")], "ans_name string, ans_name_canon string")
    b = local_table(spark, [("orderkey", "orderkey"), ("zzz", "zzz")], "stu_name string, stu_name_canon string")
    found = pairs.like_names(a, b, lambda x, y: f"length({x}_canon) > 0 AND length({y}_canon) > 0", 75.0, limit=0)
    assert [tuple(r) for r in found.collect()] == [("order key", "orderkey")]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_shape_samples_go_to_the_columns(spark):
    """The columns of all submissions are not shuffled to fetch one table of each shape."""
    from concord.operators import tables

    rows = [(f"s{k}", "T", "T", o, f"c{o}" if k % 3 else "x", "int") for k in range(30) for o in (1, 2)] + [("s99", "T", "T", 1, None, "int")]
    columns = spark.createDataFrame(rows, "submission_id string, original_name string, cleaned_name string, ordinal int, column_name string, data_type string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = tables.shape_columns(columns, tables.table_shapes(columns))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert sorted(str(r[1:]) for r in map(tuple, got.collect())) == sorted(map(str, [(1, "c1", "int"), (2, "c2", "int"), (1, "x", "int"), (2, "x", "int"), (1, None, "int")]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_foreign_keys_are_described_and_scored_once(spark):
    """Texts are cut into grams per distinct text, not per row before that; a key with nulls in it keeps its row."""
    from concord.operators import keys

    columns = "fk_name string, parent_table string, parent_cols array<string>, ref_table string, ref_cols array<string>"
    ans = spark.createDataFrame([("A", "orders", ["custkey"], "customer", ["custkey"])], columns)
    rows = [(f"s{k}", f"F{k}", "Orders", ["custkey"], "Customer", ["custkey"]) for k in range(6)]
    rows += [("s6", "N", "Orders", ["custkey", None], "Customer", ["custkey"]), ("s7", "M", None, ["custkey"], "Customer", ["custkey"])]
    stu = spark.createDataFrame(rows, f"submission_id string, {columns}")
    mapping = spark.createDataFrame([], "submission_id string, ans_table string, original_name string")
    a, b = keys.fk_texts(ans), keys.fk_texts(stu)
    plan = keys.fk_similarity(a, b, 0.5, "cosine")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[(stu|fk)_text#\d+\],", plan)
    want = {r.submission_id: r.fk_text for r in b.collect()}
    got = keys.fk_match(ans, stu, mapping, stu.select("submission_id").distinct()).collect()
    assert len(got) == 8 and want["s0"] == want["s5"]
    assert {r.submission_id: r.student_fk for r in got if r.is_matched} == {k: v for k, v in want.items() if v is not None}
