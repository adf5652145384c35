from concord.operators import order


def test_numbers_run_over_all_ranges(spark):
    rows = [(k % 7 if k % 5 else None, f"x{k % 11}", k % 3) for k in range(500)] + [(3, "same", 1)] * 200
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(6)
    got = sorted(((r.row_number, (r.a, r.b, r.c)) for r in order.numbered(df, ["b", "a"]).collect()))
    assert [n for n, _ in got] == list(range(1, 701))
    want = sorted(rows, key=lambda r: (r[1], r[0] is not None, r[0] or 0, r[2]))
    assert [v for _, v in got] == want


def test_no_rows(spark):
    df = spark.createDataFrame([], "a int")
    assert order.numbered(df, ["a"], "n").columns == ["a", "n"] and order.numbered(df, ["a"]).count() == 0
