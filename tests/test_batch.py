import itertools

import pytest
from pyspark.sql import functions as F

from concord.functions import vocab
from concord.operators import columns as col_ops
from concord.operators import counts, records, scores, tables, views
from concord.plans.batch import Batch
from concord.session import local_table
from concord.sources import catalog, synthetic
from tests.test_similarity import cosine

COLS = "submission_id string, original_name string, cleaned_name string, ordinal int, column_name string, data_type string"


def copies_of_the_answer(spark, ids=("s1", "s2")):
    """Submissions identical to the answer."""
    subs = local_table(spark, [(i,) for i in ids], "submission_id string")
    answer, keys, fks = synthetic.answer_columns(spark), synthetic.answer_keys(spark), synthetic.answer_fks(spark)
    n = local_table(spark, [(t, 100) for t in synthetic.TABLES], "original_name string, row_count long")
    v = local_table(spark, [("v1", 2, 5), ("v2", 3, 7)], "view_name string, num_columns int, num_rows long")
    names = answer.select("cleaned_name", "original_name").distinct()
    return Batch(
        expected=synthetic.EXPECTED_DELTA, n_views=2, submissions=subs,
        answer_columns=answer, answer_keys=keys, answer_fks=fks, answer_counts=n, answer_views=v,
        columns=subs.crossJoin(answer.drop("table_no")), keys=subs.crossJoin(keys.join(names, "cleaned_name").drop("cleaned_name")),
        fks=subs.crossJoin(fks), counts=subs.crossJoin(n), views=subs.crossJoin(v),
    )


def test_a_copy_of_the_answer_gets_full_marks(spark):
    rows = copies_of_the_answer(spark).summary.collect()
    assert sorted(r.submission_id for r in rows) == ["s1", "s2"]
    for r in rows:
        assert (r.column_ratio, r.fk_ratio, r.data_ratio, r.business_ratio, r.view_ratio, r.total) == (1, 1, 1, 1, 1, 10)
        assert (r.mark_a1, r.mark_a2, r.mark_a3, r.mark_b, r.mark_c) == (3, 2, 1, 3, 1)


def test_a_copy_of_the_answer_gets_the_full_schema_score(spark):
    b = copies_of_the_answer(spark, ("s1",))
    row = b.schema_score.first()
    assert (row.mapped_tables, row.hit_tables, row.schema_score, row.column_ratio) == (8, 8, 4.0, 1.0)
    assert {r.status for r in scores.table_report(b.table_results).collect()} == {vocab.TABLE_COMPLETE}


def test_a_submission_without_anything_is_present_with_zeros(spark):
    b = copies_of_the_answer(spark, ("s1",))
    b.submissions = local_table(spark, [("s1",), ("empty",)], "submission_id string")
    rows = {r.submission_id: r for r in b.summary.collect()}
    assert rows["empty"].total == 0 and rows["s1"].total == 10


def small_schemas(spark):
    answer = spark.createDataFrame(
        [(0, "A", "A", 1, "ma_hang", "int"), (0, "A", "A", 2, "ten_hang", "varchar"), (1, "B", "B", 1, "ngay_mua", "date"), (1, "B", "B", 2, "gia", "float")],
        "table_no int, original_name string, cleaned_name string, ordinal int, column_name string, data_type string")
    student = spark.createDataFrame(
        [("1", "A", "A", 1, "mahang", "int"), ("1", "A", "A", 2, "hang", "varchar"), ("1", "C", "C", 1, "ngay", "date"), ("1", "C", "C", 2, "gia_ban", "float"),
         ("1", "C", "C", 3, "ten", "varchar")], COLS)
    return answer, student


def test_schema_columns_reach_the_best_total(spark):
    answer, student = small_schemas(spark)
    matches, _ = col_ops.schema_columns(answer, student)
    norm = lambda t, c, d: f"{t}.{c} ({d})".lower().replace("_", " ").replace(".", " ").replace("(", " ").replace(")", " ")
    text = lambda t, c, d: " ".join(norm(t, c, d).split())
    a = [text(r.cleaned_name, r.column_name, r.data_type) for r in answer.collect()]
    b = [text(r.cleaned_name, r.column_name, r.data_type) for r in student.collect()]
    best = max(sum(cosine(x, y) for x, y in zip(a, p)) for p in itertools.permutations(b, len(a)))
    got = matches.collect()
    assert sum(r.cosine for r in got) == pytest.approx(best, abs=1e-5)
    assert len({(r.ans_table, r.ans_col) for r in got}) == len(got) == len({(r.stu_table, r.stu_col) for r in got})


def test_ratio_and_refinement(spark):
    answer, _ = small_schemas(spark)
    student = answer.select(F.lit("1").alias("submission_id"), "original_name", "cleaned_name", "ordinal", "column_name", "data_type")
    matches, schemas = col_ops.schema_columns(answer, student)
    assert {(r.ans_table, r.stu_table, r.ratio) for r in col_ops.table_ratio(matches, answer, "schema").collect()} == {("A", "A", 1.0), ("B", "B", 1.0)}
    refined = col_ops.refine_tables(matches, answer, student, schemas).collect()
    assert len(refined) == 4 and all(r.match and r.ans_col == r.stu_col for r in refined)


def test_exact_matches_score_one_even_when_types_differ(spark):
    answer = spark.createDataFrame([(0, "A", "A", 1, "SoLuong", "int")],
                                   "table_no int, original_name string, cleaned_name string, ordinal int, column_name string, data_type string")
    student = spark.createDataFrame([("1", "A", "A", 1, "so_luong", "decimal")], COLS)
    shapes = tables.table_shapes(student)
    mapping = shapes.select("submission_id", F.lit("A").alias("ans_table"), F.col("cleaned_name").alias("stu_table"), "shape")
    row = col_ops.column_pairs(answer, student, mapping).first()
    assert (row.score, row.match, row.stu_col) == (1.0, False, "so_luong")


def checks_for(spark, difference, business=True, error=None):
    return spark.createDataFrame(
        [("1", "T", "T", "T", 10, None if error else 10 + difference, None if error else difference, difference == 0 and not error, business, 1 if business else 0, error,
          "error" if error else "incorrect_business_logic")],
        "submission_id string, ans_table string, stu_table string, original_name string, answer_count long, student_count long, difference long, "
        "exact_match boolean, is_business boolean, expected_increase int, error string, status string")


@pytest.mark.parametrize("difference, business, error, baseline, data, rule, status", [
    (0, True, None, "after", vocab.YES, vocab.YES, vocab.STATUS_BUSINESS),
    (-1, True, None, "after", vocab.YES, vocab.NO, vocab.STATUS_BUSINESS_WRONG),
    (-1, False, None, "after", vocab.NO, vocab.NO, vocab.STATUS_DATA_WRONG),
    (0, False, None, "after", vocab.YES, vocab.YES, vocab.STATUS_DATA),
    (1, True, None, "before", vocab.YES, vocab.YES, vocab.STATUS_BUSINESS),
    (0, True, None, "before", vocab.YES, vocab.NO, vocab.STATUS_BUSINESS_WRONG),
    (0, True, "unmapped", "after", vocab.NO, vocab.NO, vocab.STATUS_ERROR),
])
def test_count_report_rules(spark, difference, business, error, baseline, data, rule, status):
    checks = checks_for(spark, difference, business, error)
    row = counts.count_report(checks, counts.count_overall(checks, {"T": 1}), baseline).first()
    assert (row.data_ok, row.rule_ok, row.status) == (data, rule, status)


def test_views_match_once_and_unreadable_ones_never(spark):
    a = spark.createDataFrame([("x", 2, 5), ("y", 2, 5), ("z", 1, None)], "view_name string, num_columns int, num_rows long")
    b = spark.createDataFrame([("1", "p", 2, 5), ("1", "q", 1, None)], "submission_id string, view_name string, num_columns int, num_rows long")
    assert views.match_by_shape(a, b).count() == 2
    assert [(r.view, r.stu_view) for r in views.match_one_to_one(a, b).collect()] == [("x", "p")]


def test_key_and_reference_checks(spark):
    t = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 3)], "a int, b int")
    row = records.key_check(t, ["a", "b"], "t").first()
    assert (row.rows, row.distinct_keys, row.duplicate_rows, row.null_rows, row.is_key) == (4, 3, 1, 2, False)
    parent = spark.createDataFrame([(1,)], "k int")
    row = records.orphan_check(t, ["a"], parent, ["k"], "t.a").first()
    assert (row.child_rows, row.orphans, row.holds) == (4, 1, False)


def test_reconcile_covers_both_sides(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    got = {r.k: (r.difference, r.status) for r in records.reconcile_counts(a, b, ["k"]).collect()}
    assert got == {1: (-1, "different"), 2: (-1, "only_answer"), 3: (1, "only_student")}


@pytest.mark.parametrize("share", [0.2, 0.34, 0.5, 0.75, 1.0])
def test_word_overlap_pairs_are_complete(spark, share):
    """The join on rare words finds every pair, also when one word is in all names."""
    import random

    rng = random.Random(2)
    words = ["kho", "hang", "ma", "ten", "gia", "ngay"]
    side = lambda: [(" ".join(["chung"] + rng.sample(words, rng.randint(0, 3))),) for _ in range(25)]
    left, right = side(), side()
    got = {(r.a_name, r.b_name) for r in records.word_overlap_pairs(
        spark.createDataFrame(left, "name string"), spark.createDataFrame(right, "name string"), share).collect()}
    want = {
        (a, b) for (a,) in left for (b,) in right
        if len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())) >= share
    }
    assert got == want


def test_batch_statistics(spark):
    df = spark.createDataFrame([("1", 1.0), ("2", 3.0)], "submission_id string, s double")
    assert tuple(scores.batch_statistics(df, "s").first()) == (2, 2.0, 3.0, 1.0)


def test_marks_are_capped(spark):
    df = spark.createDataFrame([("1", 1.0, 1.0, 1.0, 1.0, 2.0)], "submission_id string, column_ratio double, fk_ratio double, data_ratio double, business_ratio double, view_ratio double")
    row = scores.marks(df).first()
    assert (row.mark_b, row.total) == (6.0, 10.0)


def test_catalog_statistics_of_the_star(spark):
    b = copies_of_the_answer(spark, ("s1",))
    row = catalog.statistics(b.columns, b.keys, b.fks).first()
    assert (row.tables, row["columns"], row.tables_with_pk, row.tables_with_fk, row.relationships) == (8, 43, 8, 5, 7)


def test_joins_beyond_the_size_check_give_the_same(spark, monkeypatch):
    from concord.operators import pairs

    small = copies_of_the_answer(spark, ("s1", "s2")).column_pairs
    want = sorted(map(str, small.collect()))
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", -1)
    large = copies_of_the_answer(spark, ("s1", "s2")).column_pairs
    assert sorted(map(str, large.collect())) == want
