"""Folds of catalogs: their results, and what their plans sort or join."""

import re

import pytest
from pyspark.sql import functions as F

from concord.operators import tables
from concord.plans.registry import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("customers"))
    spark.createDataFrame([(k,) for k in [*range(1, 40), 5, 5, None]], "c_custkey bigint").write.parquet(f"{folder}/customer.parquet")
    return folder


def test_foreign_keys_are_folded_once_for_both_texts(spark, customers):
    made = QUERIES["fk_text"](spark, customers)
    assert not re.search("SortMergeJoin|HashJoin", plan_of(made))
    rows = made.collect()
    keys = [(r.submission_id, r.fk_name) for r in rows]
    assert len(keys) == len(set(keys)) and all(a and b for a, b in keys)
    assert {r.n_columns for r in rows if r.submission_id == "10000005"} == {3}
    assert {r.n_columns for r in rows if r.submission_id != "10000005"} == {1}
    assert all(r.fk_text and r.plain_text for r in rows)


def test_shapes_of_tables_under_one_cleaned_name(spark):
    schema = "submission_id string, original_name string, cleaned_name string, ordinal int, column_name string, data_type string"
    rows = [("1", "t", "T", 1, "a", "int"), ("1", "t", "T", 2, "b", "int"), ("2", "tbl_t", "T", 1, "a", "int"), ("2", "t", "T", 2, "b", "int"),
            ("3", "t", "T", 1, "a", "int"), ("3", "t", "T", 1, "a", "int"), ("4", None, "T", 1, None, "int"), (None, "t", "T", 1, "a", "int")]
    made = tables.table_shapes(spark.createDataFrame(rows, schema))
    got = {r.submission_id: r for r in made.collect()}
    assert got["1"].shape == got["2"].shape and got["2"].original_name == "t" and got["4"].original_name is None
    assert [got[k].shape.split(":")[0] for k in ("1", "3", "4", None)] == ["2", "2", "1", "1"]
    assert got["3"].shape == "2:0:0"


def test_rows_of_a_catalog_are_not_sorted_for_their_shapes(spark):
    columns = spark.range(1000).select(
        F.col("id").cast("string").alias("submission_id"), F.lit("t").alias("original_name"), F.lit("T").alias("cleaned_name"),
        F.col("id").cast("int").alias("ordinal"), F.lit("a").alias("column_name"), F.lit("int").alias("data_type"))
    over_rows = [line for line in plan_of(tables.table_shapes(columns)).splitlines() if "partial_bit_xor(xxhash64(" in line]
    assert over_rows and all("HashAggregate" in line for line in over_rows)
