"""Folders of Parquet submissions and reports as files."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from concord.functions import vocab
from concord.sources import folders


def table(root, folder, name, rows, file=None, **columns):
    place = root / folder / name if file else root / folder
    place.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns or {"id": pa.array(range(rows), pa.int32())}), place / (file or f"{name}.parquet"))


@pytest.fixture
def root(tmp_path):
    table(tmp_path, "dapan", "orders", 0, o_id=pa.array([1, 2], pa.int64()), o_name=["a", "b"], o_when=pa.array([0, 1], pa.timestamp("us")))
    table(tmp_path, "sv_10000001_x", "Orders", 3, file="part-0.parquet")
    table(tmp_path, "sv_10000001_x", "Orders", 4, file="part-1.parquet")
    table(tmp_path, "sv_10000001_x", "empty", 0)
    table(tmp_path, "sv_10000002", "mixed", 2, file="part-0.parquet")
    table(tmp_path, "sv_10000002", "mixed", 0, file="part-1.parquet", other=["x"])
    (tmp_path / "sv_10000002" / "broken.parquet").write_bytes(b"PAR1 no footer")
    (tmp_path / "sv_10000002" / "nothing").mkdir()
    (tmp_path / "sv_10000002" / "notes.txt").write_text("not a table")
    (tmp_path / "sv_10000003").mkdir()
    (tmp_path / "_hidden").mkdir()
    return tmp_path


def test_catalog_and_counts(spark, root):
    found = folders.read_folder(spark, str(root))
    columns = {tuple(r) for r in folders.columns_in(found).collect()}
    assert columns == {
        (vocab.ANSWER_ID, "orders", 1, "o_id", "bigint"), (vocab.ANSWER_ID, "orders", 2, "o_name", "varchar"), (vocab.ANSWER_ID, "orders", 3, "o_when", "datetime"),
        ("10000001", "Orders", 1, "id", "int"), ("10000001", "empty", 1, "id", "int")}
    counts = {(r.submission_id, r.original_name): (r.row_count, (r.error or "").split(":")[0]) for r in folders.counts_in(found).collect()}
    assert counts == {
        (vocab.ANSWER_ID, "orders"): (2, ""), ("10000001", "Orders"): (7, ""), ("10000001", "empty"): (0, ""),
        ("10000002", "broken"): (None, "ArrowInvalid"), ("10000002", "mixed"): (None, "ValueError"), ("10000002", "nothing"): (None, "ValueError")}
    assert folders.of_answer(found).filter("ordinal = 1").count() == 1 and "submission_id" not in folders.of_answer(found).columns


def test_only_footers_are_read(spark, root):
    """A table whose data pages are overwritten still has its catalog and count."""
    path = root / "sv_10000001_x" / "big.parquet"
    pq.write_table(pa.table({"v": list(range(50_000))}), path)
    raw = bytearray(path.read_bytes())
    raw[4 : len(raw) // 2] = bytes(len(raw) // 2 - 4)
    path.write_bytes(bytes(raw))
    found = folders.counts_in(folders.read_folder(spark, str(root))).filter("original_name = 'big'").collect()
    assert [(r.row_count, r.error) for r in found] == [(50_000, None)]


def test_folders_are_dealt_out(spark, tmp_path):
    for k in range(40):
        table(tmp_path, f"sv_{10000000 + k}", "t", k)
    found = folders.read_folder(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 40
    assert sorted(r.row_count for r in folders.counts_in(found).collect()) == list(range(40))


def test_no_folders(spark, tmp_path):
    assert folders.read_folder(spark, str(tmp_path)).count() == 0


REPORT = "name string, n bigint, ok boolean, share double"


def test_reports_round_trip(spark, tmp_path):
    rows = [("1", "a,b", 1, True, 0.5), ("1", 'q"x\ny', 2, False, None), ("2", None, None, None, 1e-9), ("10", "Tổng điểm", 3, True, 0.1)]
    df = spark.createDataFrame(rows, f"submission_id string, {REPORT}").repartition(3)
    folders.write_reports(df, str(tmp_path), "counts")
    folders.write_reports(df.filter("n = 3"), str(tmp_path), "other")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["10_counts.csv", "10_other.csv", "1_counts.csv", "2_counts.csv"]
    back = folders.read_reports(spark, str(tmp_path), "counts", REPORT).select("submission_id", "name", "n", "ok", "share").collect()
    assert sorted(map(tuple, back), key=str) == sorted(rows, key=str)


def test_a_failed_write_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("1", 5), ("2", 6)], "submission_id string, n int")
    folders.write_reports(df, str(tmp_path), "marks")
    before = {p.name: p.read_text() for p in tmp_path.glob("*.csv")}
    bad = spark.createDataFrame([("1", 7), ("2", 0), ("3", 1)], "submission_id string, n int").repartition(3).select(
        "submission_id", F.when(F.col("n") == 0, F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("n")).alias("n"))
    with pytest.raises(Exception, match="stop"):
        folders.write_reports(bad, str(tmp_path), "marks")
    assert {p.name: p.read_text() for p in tmp_path.glob("*.csv")} == before
    folders.write_reports(df.withColumn("n", F.col("n") + 1), str(tmp_path), "marks")
    assert sorted(r.n for r in folders.read_reports(spark, str(tmp_path), "marks", "n int").collect()) == [6, 7]


def test_the_driver_lists_no_report_files(spark, tmp_path):
    """Files are named and read in tasks; odd names and values come back, other files and folders are not read."""
    rows = [(f"{k}", f"v{k}", k, None) for k in range(50)] + [("a b%20", "", 1, 2.5), ("x_counts", '"', None, None), ("y.z", "é\r\nf", 2, 0.0)]
    df = spark.createDataFrame(rows, "submission_id string, name string, n bigint, share double").repartition(4)
    folders.write_reports(df, str(tmp_path), "counts")
    folders.write_reports(df.limit(0), str(tmp_path), "none")
    (tmp_path / "_hidden_counts.csv").write_text("name,n,share\nno,1,1\n")
    (tmp_path / "sub_counts.csv").mkdir()
    (tmp_path / "short_counts.csv").write_text("name,n,share\n\nonly,word\n")
    assert sum(p.is_file() for p in tmp_path.glob("*_counts.csv")) == 55
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(("_writing", "_listed"))]
    back = folders.read_reports(spark, str(tmp_path), "counts", "name string, n bigint, share double")
    assert not [f for f in back.inputFiles() if f.endswith(".csv")]
    want = [(i, n or None, k, s) for i, n, k, s in rows] + [("short", "only", None, None)]
    assert sorted(map(str, map(tuple, back.select("submission_id", "name", "n", "share").collect()))) == sorted(map(str, want))
    assert folders.read_reports(spark, str(tmp_path), "none", "name string").collect() == []
