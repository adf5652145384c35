"""Answers, tables and keys of any size: nothing is cut, refused or decided by a switch."""

from pyspark.sql import functions as F

from concord.functions import texts
from concord.operators import lookup, pairs, tables
from concord.sources import catalog, store

NAMES = ["数量", "名称", "Customer Name", "cust_name", "c_name", "order", "orders", "x", "", "  ", "Số lượng", "so luong", "数量 2"]


def hits(spark, answers, students, **more):
    ans, stu = (spark.createDataFrame([(n,) for n in names], "column_name string") for names in (answers, students))
    return {tuple(r) for r in pairs.name_hits(ans, stu, **more).collect()}


def test_short_and_long_answers_give_the_same_hits(spark):
    other = [*NAMES, "ordres", "namecustomer", "数 量", "NAME OF CUSTOMER"]
    listed = hits(spark, NAMES, other)
    assert listed == hits(spark, NAMES, other, limit=0)
    assert ("数量", "数量") in listed and not {("数量", "名称"), ("数量", ""), ("", "  ")} & listed and ("order", "ordres") in listed


def test_no_answer_names(spark):
    assert hits(spark, [], NAMES) == set()


def test_blocks_by_list_and_by_join(spark):
    answer = spark.createDataFrame([(n.upper(), n, 1, "id", "int") for n in ("orders", "数量", "customer")], "cleaned_name string, original_name string, ordinal int, column_name string, data_type string")
    found = ("orderss", "名称", "customers", "customer", "stage orders")
    shapes = spark.createDataFrame([(str(k), n, n.upper(), "s") for k, n in enumerate(found)], "submission_id string, original_name string, cleaned_name string, shape string")
    listed, joined = ({tuple(r) for r in lookup.table_blocks(answer, shapes, limit=n).collect()} for n in (2_000, 0))
    assert listed == joined == {("0", "ORDERS", "orderss", "s"), ("2", "CUSTOMER", "customers", "s"), ("3", "CUSTOMER", "customer", "s")}


def test_whole_texts(spark):
    cols = spark.createDataFrame([("t", n, f"c{n:02d}") for n in range(45)], "key string, ordinal int, column_name string")
    row = tables.first_columns(cols, "key").select(
        texts.table_text(F.lit("T"), F.col("first_columns")).alias("all"), texts.table_text(F.lit("T"), F.col("first_columns"), 30).alias("some")).first()
    assert row["all"].endswith("c44") and row["some"].endswith("c29")
    fk = F.struct(F.lit("t").alias("parent"), F.array(F.lit("a")).alias("parent_cols"), F.lit("r").alias("ref"), F.array(F.lit("b")).alias("ref_cols"))
    cols = F.array(F.struct(F.lit("a").alias("name"), F.lit("int").alias("type")))
    text = spark.range(1).select(texts.table_text_full(F.lit("T"), cols, F.array(F.lit("a")), F.array(*[fk] * 14)).alias("t")).first().t
    assert text.count(" | FK ") == 14


def test_a_key_of_two_columns_is_one_relationship(spark):
    columns = spark.createDataFrame([("1", "T", "a")], "submission_id string, cleaned_name string, column_name string")
    keys = spark.createDataFrame([("1", "t")], "submission_id string, original_name string")
    fks = spark.createDataFrame([("1", "FK_1", "t", "r", "a"), ("1", "FK_1", "t", "r", "b"), ("1", "FK_2", "t", "r", "c")],
                                "submission_id string, fk_name string, parent_table string, ref_table string, fk_column string")
    row = catalog.statistics(columns, keys, fks).first()
    assert (row.tables_with_fk, row.relationships) == (1, 2)


def test_an_unreadable_store_is_not_taken_for_an_empty_one(spark, tmp_path):
    import pytest

    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "part-0.parquet").write_bytes(b"garbage")
    with pytest.raises(Exception):  # noqa: B017, PT011
        store.replace_submissions(spark.createDataFrame([("1", 1)], "submission_id string, n int"), str(tmp_path / "store"))
    assert (tmp_path / "store" / "part-0.parquet").read_bytes() == b"garbage"
