from pyspark.sql import functions as F

from concord.functions import texts
from concord.sources import catalog, store
from concord.streaming import intake

ROWS = "submission_id string, table_name string, n long"


def test_replace_touches_only_the_given_submissions(spark, tmp_path):
    path = str(tmp_path / "store")
    store.replace_submissions(spark.createDataFrame([(str(i), t, 1) for i in range(50) for t in "ab"], ROWS), path, buckets=4)
    store.replace_submissions(spark.createDataFrame([("7", "c", 9), ("99", "d", 2)], ROWS), path, buckets=4)
    rows = store.read_store(spark, path).collect()
    assert len(rows) == 49 * 2 + 2
    assert [(r.table_name, r.n) for r in rows if r.submission_id == "7"] == [("c", 9)]


def test_a_writer_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.replace_submissions(spark.createDataFrame([("1", "a", 1), ("2", "a", 2)], ROWS), path)
    before = sorted(map(tuple, store.read_store(spark, path).collect()))

    def stop(*_):
        raise RuntimeError("stopped")

    bad = spark.createDataFrame([("1", "b", 5), ("2", "b", 0)], ROWS).select(
        "submission_id", "table_name", F.when(F.col("n") == 0, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("n")).alias("n"))
    for name in (None, "_commit", "_write_version"):
        with monkeypatch.context() as m:
            if name:
                m.setattr(store, name, stop)
            try:
                store.replace_submissions(bad if name is None else spark.createDataFrame([("1", "c", 7)], ROWS), path)
            except Exception as failed:  # noqa: BLE001
                assert "stop" in str(failed)
        assert sorted(map(tuple, store.read_store(spark, path).collect())) == before
    store.replace_submissions(spark.createDataFrame([("1", "c", 7)], ROWS), path)
    assert sorted(map(tuple, store.read_store(spark, path).collect())) == [("1", "c", 7), ("2", "a", 2)]


def test_versions_are_merged_and_old_ones_removed(spark, tmp_path):
    path, want = str(tmp_path / "store"), {}
    for k in range(7):
        rows = [(str(i), "t", k) for i in range(k, k + 3)]
        want |= {i: n for i, _, n in rows}
        before = {p.name for p in (tmp_path / "store" / "rows").glob("*")} if k else set()
        store.replace_submissions(spark.createDataFrame(rows, ROWS), path, buckets=2, merge_every=3)
        assert before <= {p.name for p in (tmp_path / "store" / "rows").glob("*")}
        assert {r.submission_id: r.n for r in store.read_store(spark, path).collect()} == want
    old = store.read_store(spark, path)
    store.replace_submissions(spark.createDataFrame([("0", "new", 100)], ROWS), path)
    assert {r.submission_id: r.n for r in old.collect()} == want  # a reader keeps the state that it began with
    store.remove_unused(spark, path)
    assert {r.submission_id: r.n for r in store.read_store(spark, path).collect()} == want | {"0": 100}
    assert len(list((tmp_path / "store" / "rows").iterdir())) <= 3 and len([p for p in (tmp_path / "store" / "manifest").iterdir() if p.name.isdigit()]) == 1


def test_report_per_submission_has_a_header_and_comes_back(spark, tmp_path):
    path = str(tmp_path / "report")
    df = spark.createDataFrame([("00000007", "v", 3), ("00000008", "w", 4)], ROWS)
    store.write_report(df, path, per_submission=True)
    back = store.read_report(spark, path, "table_name string, n long, submission_id string")
    assert sorted(tuple(r) for r in back.select(*df.columns).collect()) == sorted(tuple(r) for r in df.collect())
    store.write_report(df.filter("false"), str(tmp_path / "none"))
    heads = [p.read_text().strip() for p in (tmp_path / "none").glob("*.csv")]
    assert heads == ["submission_id,table_name,n"]


def test_result_files_by_name(spark, tmp_path):
    (tmp_path / "11_pairs.csv").write_text("AnsCol,Match\nx,True\ny,False\n")
    (tmp_path / "12_pairs.csv").write_text("AnsCol,Match\nx,True\n")
    (tmp_path / "12_fk.csv").write_text("a\n1\n")
    rows = store.read_result_files(spark, str(tmp_path), "_pairs", "AnsCol string, Match boolean")
    got = {r.submission_id: r.m for r in rows.groupBy("submission_id").agg(F.avg(F.col("Match").cast("double")).alias("m")).collect()}
    assert got == {"11": 0.5, "12": 1.0}


def test_cache_embeds_each_text_once(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def embed(df):
        calls.append(sorted(r.text for r in df.collect()))
        return df.withColumn("vector", texts.hash_vector(F.col("text")))

    store.embed_cached(spark.createDataFrame([("a",), ("a",), ("b",)], "text string"), path, embed)
    out = store.embed_cached(spark.createDataFrame([("b",), ("c",)], "text string"), path, embed)
    assert calls == [["a", "b"], ["c"]]
    assert sorted(r.text for r in out.collect()) == ["b", "c"] and spark.read.parquet(path).count() == 3


def test_resolve_ids_reports_what_is_missing(spark):
    keys = spark.createDataFrame([("1", "A", "x"), ("1", "A", "q"), ("1", "Z", "x")], "submission_id string, original_name string, column_name string")
    t = spark.createDataFrame([("1", "A", 10)], "submission_id string, original_name string, table_id long")
    c = spark.createDataFrame([("1", 10, "x", 100)], "submission_id string, table_id long, column_name string, column_id long")
    found, missing = store.resolve_ids(keys, t, c)
    assert [(r.table_id, r.column_id) for r in found.collect()] == [(10, 100)]
    assert {(r.original_name, r.missing) for r in missing.collect()} == {("A", "column"), ("Z", "table")}


def test_submission_folder(spark, tmp_path):
    for name in ("x_12345678", "dapan", "abc"):
        spark.createDataFrame([("t", 1)], "original_name string, ordinal int").coalesce(1).write.parquet(str(tmp_path / "raw" / name))
        part = next((tmp_path / "raw" / name).glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.parquet").write_bytes(part.read_bytes())
    ids = [r[0] for r in catalog.read_submission_folder(spark, str(tmp_path / "in")).select("submission_id").collect()]
    assert sorted(ids) == ["00000001", "12345678", "abc"]


def test_intake_grades_only_what_is_new_and_equals_the_batch(spark, tmp_path):
    folder, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    graded = []

    def grade(batch):
        graded.append(sorted(r[0] for r in batch.select("submission_id").distinct().collect()))
        return batch.groupBy("submission_id").agg(F.sum("n").alias("n"))

    first = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "a", 5)], ROWS)
    first.coalesce(1).write.parquet(folder)
    intake.grade_arrivals(spark, folder, ROWS, grade, out, state).awaitTermination()
    second = spark.createDataFrame([("3", "a", 7), ("2", "a", 6)], ROWS)
    second.coalesce(1).write.mode("append").parquet(folder)
    intake.grade_arrivals(spark, folder, ROWS, grade, out, state).awaitTermination()
    assert graded == [["1", "2"], ["2", "3"]]
    assert {(r.submission_id, r.n) for r in store.read_store(spark, out).collect()} == {("1", 3), ("2", 6), ("3", 7)}


def test_report_headings(spark):
    from concord.functions import vocab
    from concord.operators import scores

    df = spark.createDataFrame([("1", 1.0, 0.5, 1.0, 0.0, 1.0)],
                               "submission_id string, column_ratio double, fk_ratio double, data_ratio double, business_ratio double, view_ratio double")
    row = store.headed(scores.marks(df), vocab.SUMMARY_HEADINGS).first().asDict()
    assert list(row)[0] == "MSSV" and row["Tổng điểm"] == 8.0 and row["Điểm A2"] == 1.0
