"""Submissions that arrive in parts, repeated batches, merged totals."""

from pyspark.sql import functions as F

from concord.sources import store
from concord.streaming import intake

ROWS = "submission_id string, item string, n int"


def files_of(spark, folder, *parts):
    for part in parts:
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(folder)


PARTS = [("1", "a", 1), ("2", "a", 5)], [("1", "b", 2), ("3", "x", 7)], [("1", "a", 4), ("2", "c", 6)], [("4", None, None), ("1", "z", 0)]
ALL = [r for p in PARTS for r in p]


def grade(rows):
    return rows.groupBy("submission_id").agg(F.count_distinct("item").alias("items"), F.max("n").alias("most"), F.count(F.lit(1)).alias("rows"))


def test_parts_are_graded_together(spark, tmp_path):
    folder, out, rows, state = (str(tmp_path / d) for d in ("in", "out", "rows", "state"))
    files_of(spark, folder, *PARTS)
    intake.grade_parts(spark, folder, ROWS, grade, out, rows, state, files_per_batch=1).awaitTermination()
    want = sorted(tuple(r) for r in grade(spark.createDataFrame(ALL, ROWS)).collect())
    assert sorted(tuple(r) for r in store.read_store(spark, out).select("submission_id", "items", "most", "rows").collect()) == want


def test_a_repeated_part_changes_nothing(spark, tmp_path):
    rows, out = str(tmp_path / "rows"), str(tmp_path / "out")
    for number, part in [*enumerate(PARTS), (3, PARTS[3])]:
        intake.keep_part(spark.createDataFrame(part, ROWS), number, rows, "submission_id", 8)
        touched = intake.touched_rows(spark, number, rows)
        assert {r[0] for r in touched.select("submission_id").collect()} == {r[0] for r in part} and touched.columns == ["submission_id", "item", "n"]
        store.replace_submissions(grade(touched), out)
    want = sorted(tuple(r) for r in grade(spark.createDataFrame(ALL, ROWS)).collect())
    assert sorted(tuple(r) for r in store.read_store(spark, out).select("submission_id", "items", "most", "rows").collect()) == want


def partial(rows):
    return rows.groupBy("submission_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))


def merge(parts):
    return parts.groupBy("submission_id").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))


def test_totals_over_batches(spark, tmp_path):
    folder, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    want = sorted((tuple(r) for r in partial(spark.createDataFrame(ALL, ROWS)).collect()), key=str)

    def got():
        return sorted((tuple(r) for r in intake.read_totals(spark, merge, out).collect()), key=str)

    files_of(spark, folder, *PARTS[:3])
    intake.total_arrivals(spark, folder, ROWS, partial, merge, out, state, 1, merge_every=2).awaitTermination()
    files_of(spark, folder, PARTS[3])
    intake.total_arrivals(spark, folder, ROWS, partial, merge, out, state, 1, merge_every=2).awaitTermination()
    assert got() == want
    # the last batch again, as after a failure, and one that is merged already
    intake.add_totals(partial(spark.createDataFrame(PARTS[3], ROWS)), 3, merge, out, 2)
    intake.add_totals(partial(spark.createDataFrame(PARTS[0], ROWS)), 0, merge, out, 2)
    assert got() == want


def test_an_unfinished_merge_does_not_count(spark, tmp_path):
    out = str(tmp_path / "out")
    for number in (0, 1):
        intake.add_totals(partial(spark.createDataFrame(PARTS[number], ROWS)), number, merge, out, 9)
    half = tmp_path / "out" / "merged=1"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"")
    assert intake.read_totals(spark, merge, out).agg(F.sum("n")).first()[0] == 15
