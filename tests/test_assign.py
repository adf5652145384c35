import itertools
import random

import pytest

from concord.operators import assign


def edges(seed, groups, size, top, density=0.7):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        for i in range(rng.randint(1, size)):
            for j in range(rng.randint(1, size)):
                if rng.random() < density:
                    out.append((g, i, j, rng.randint(1, top)))
    return out


def best_total(es):
    """Largest total by trying every choice per left end."""
    by_left = {}
    for _, i, j, w in es:
        by_left.setdefault(i, [(None, 0)]).append((j, w))
    best = 0
    for combo in itertools.product(*by_left.values()):
        used = [j for j, _ in combo if j is not None]
        if len(used) == len(set(used)):
            best = max(best, sum(w for _, w in combo))
    return best


def walk(es, descending=True, key=lambda e: (e[3], e[1], e[2])):
    left, right, out = set(), set(), []
    for e in sorted(es, key=key, reverse=descending):
        if e[1] not in left and e[2] not in right:
            left.add(e[1])
            right.add(e[2])
            out.append(e)
    return out


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def one_to_one(rows):
    for es in grouped(rows).values():
        assert len({e[1] for e in es}) == len(es) == len({e[2] for e in es})


@pytest.mark.parametrize("cap", [10_000, 1])
def test_greedy_is_the_sequential_walk(spark, cap):
    rows = edges(3, 25, 6, 5)
    df = spark.createDataFrame(rows, "g int, i int, j int, w int")
    got = sorted((r.g, r.i, r.j, r.w) for r in assign.greedy(df, ["g"], "i", "j", ["w"], cap=cap).collect())
    assert got == sorted(e for es in grouped(rows).values() for e in walk(es))


@pytest.mark.parametrize("cap", [10_000, 1])
def test_first_fit(spark, cap):
    rows = edges(4, 20, 6, 1)
    df = spark.createDataFrame(rows, "g int, i int, j int, w int").select("g", "i", "j")
    got = sorted(tuple(r) for r in assign.greedy(df, ["g"], "i", "j", ["i", "j"], descending=False, cap=cap).select("g", "i", "j").collect())
    want = sorted(e[:3] for es in grouped(rows).values() for e in walk(es, False, lambda e: (e[1], e[2])))
    assert got == want


def test_greedy_ties_go_to_larger_ends(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 0, 1.0), (1, 1, 1, 1.0)], "g int, i int, j int, w double")
    got = sorted((r.i, r.j) for r in assign.greedy(df, ["g"], "i", "j", ["w"]).collect())
    assert got == [(0, 0), (1, 1)]


def test_optimal_in_a_task(spark):
    rows = edges(5, 40, 5, 6)
    df = spark.createDataFrame(rows, "g int, i int, j int, w long")
    got = [tuple(r) for r in assign.optimal(df, ["g"], "i", "j", "w").select("g", "i", "j", "w").collect()]
    one_to_one(got)
    assert {g: sum(e[3] for e in es) for g, es in grouped(got).items()} == {g: best_total(es) for g, es in grouped(rows).items()}


def test_optimal_by_rounds_for_large_groups(spark):
    rows = edges(6, 4, 4, 30)
    df = spark.createDataFrame(rows, "g int, i int, j int, w long")
    got = [tuple(r) for r in assign.optimal(df, ["g"], "i", "j", "w", cap=1).select("g", "i", "j", "w").collect()]
    one_to_one(got)
    assert {g: sum(e[3] for e in es) for g, es in grouped(got).items()} == {g: best_total(es) for g, es in grouped(rows).items()}


def test_optimal_is_at_least_greedy_and_ignores_row_order(spark):
    rows = edges(8, 15, 6, 9)
    df = spark.createDataFrame(rows, "g int, i int, j int, w long")
    a = sorted(tuple(r) for r in assign.optimal(df, ["g"], "i", "j", "w").collect())
    random.Random(0).shuffle(rows)
    b = sorted(tuple(r) for r in assign.optimal(spark.createDataFrame(rows, df.schema).repartition(5), ["g"], "i", "j", "w").collect())
    assert a == b
    greedy = assign.greedy(df, ["g"], "i", "j", ["w"]).groupBy().sum("w").first()[0]
    assert sum(e[3] for e in a) >= greedy


def test_no_edges(spark):
    df = spark.createDataFrame([], "g int, i int, j int, w long")
    assert assign.optimal(df, ["g"], "i", "j", "w").count() == 0
    assert assign.greedy(df, ["g"], "i", "j", ["w"]).count() == 0


@pytest.mark.parametrize("cap", [1, 9])
def test_optimal_gives_one_answer_at_every_size(spark, cap):
    """Tied blocks, some linked with one another, solved in a task and as large groups."""
    rows = [(0, i, j, 5) for i in range(3) for j in range(3)] + [(0, 10 + i, 10 + j, 2) for i in range(3) for j in range(3)]
    rows += [(1, i, j, 1 + (i * j) % 2) for i in range(4) for j in range(5)] + [(2, i, 7, 3) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, i int, j int, w long")
    whole, parts = (sorted(tuple(r) for r in assign.optimal(df, ["g"], "i", "j", "w", cap=c).select("g", "i", "j", "w").collect()) for c in (10_000, cap))
    assert whole == parts and len(whole) == 11


def test_only_edges_that_can_win_are_kept(spark):
    rng = random.Random(9)
    rows = [(0, i, j, 10**12 + rng.randint(0, 3)) for i in range(3) for j in range(200)] + [(1, i, j, rng.randint(1, 5)) for i in range(40) for j in range(2)]
    df = spark.createDataFrame(rows, "g int, i int, j int, w long")
    kept = assign._contenders(df, ["g"], "i", "j", "w")
    assert {r.g: r["count"] for r in kept.groupBy("g").count().collect()} == {0: 9, 1: 4}
    whole, parts = (sorted(tuple(r) for r in assign.optimal(df, ["g"], "i", "j", "w", cap=c).collect()) for c in (10_000, 20))
    assert whole == parts and len(whole) == 5


def test_components(spark):
    rows = [(0, k, k) for k in range(30)] + [(0, k + 1, k) for k in range(29) if k != 14] + [(1, 5, 1), (1, 6, 1), (1, 7, 2)]
    got = {(r.g, r.i): r._part for r in assign._components(spark.createDataFrame(rows, "g int, i int, j int"), ["g"], "i", "j").collect()}
    assert got == {(0, k): 0 if k < 15 else 15 for k in range(30)} | {(1, 5): 5, (1, 6): 5, (1, 7): 7}


def test_tied_blocks_take_few_rounds(spark, monkeypatch):
    """A large block of one score, blocks that hang together, and one that an end with a better edge reaches into."""
    rows = [(0, i, j, 5) for i in range(60) for j in range(70)]
    rows += [(0, 100 + i, 100 + j, 7) for i in range(9) for j in range(4)] + [(0, 100, 50, 5), (0, 200, 104, 6), (0, 108, 104, 7)]
    rows += [(1, i, j, 3) for i in range(6) for j in range(6)] + [(1, 50, 5, 9), (1, 3, 60, 3), (1, 50, 60, 9)]
    rows += edges(12, 30, 6, 2)[:0] + [(2 + g, i, j, w) for g, i, j, w in edges(12, 10, 6, 2)]
    settled = []
    original = assign.settle
    monkeypatch.setattr(assign, "settle", lambda df: settled.append(1) or original(df))
    df = spark.createDataFrame(rows, "g int, i int, j int, w int")
    got = sorted((r.g, r.i, r.j, r.w) for r in assign.greedy(df, ["g"], "i", "j", ["w"], cap=1).collect())
    assert got == sorted(e for es in grouped(rows).values() for e in walk(es))
    assert len(settled) < 70  # seven tables a round: under ten rounds for blocks of 60 pairs


@pytest.mark.parametrize("more", [False, True])
def test_tied_blocks_are_found_in_the_first_round_from_sums_per_end(spark, monkeypatch, more):
    """Two blocks that share no end need one round, and no join that would move the edges."""
    rows = [(0, i, j, 5, "a") for i in range(40) for j in range(30)] + [(0, 100 + i, 100 + j, 7, "b") for i in range(9) for j in range(12)]
    columns = ["g", "i", "j", "w", "note"] if more else ["g", "i", "j", "w"]
    df = spark.createDataFrame(rows, "g int, i int, j int, w int, note string").select(*columns)
    settled = []
    original = assign.settle
    monkeypatch.setattr(assign, "settle", lambda df: settled.append(df) or original(df))
    got = sorted(tuple(r) for r in assign.greedy(df, ["g"], "i", "j", ["w"], cap=1).select(*columns).collect())
    assert got == sorted(e[: len(columns)] for e in walk(rows))
    assert not any("SortMergeJoin" in d._jdf.queryExecution().executedPlan().toString() and "note" in d.columns for d in settled)
    assert len(settled) <= 8


@pytest.mark.parametrize("descending", [True, False])
def test_equal_sets_at_other_scores_and_repeated_edges_are_no_block(spark, descending):
    """Ends linked with one set by different scores, an end's pair met again by a lower score, and repeated edges."""
    rows = [(0, i, j, 5 + (i == 2)) for i in range(4) for j in range(5)] + [(0, 1, 2, 3), (0, 3, 3, 9)]
    rows += [(1, i, j, 4) for i in range(5) for j in range(5)] * 2 + [(2, i, j, 4) for i in range(5) for j in range(5)] + [(2, 1, 1, 4)]
    df = spark.createDataFrame(rows, "g int, i int, j int, w int")
    got = sorted((r.g, r.i, r.j, r.w) for r in assign.greedy(df, ["g"], "i", "j", ["w"], descending=descending, cap=1).collect())
    assert got == sorted(e for es in grouped(rows).values() for e in walk(es, descending))


def test_greedy_over_classes_of_like_ends(spark):
    """Edges between classes give what all their edges give, at any size; ends may be in several classes, null or repeated."""
    rng = random.Random(1)
    left = [(g, rng.randrange(4), rng.choice([None, *range(12)])) for g in (0, 1) for _ in range(10)]
    right = [(g, rng.randrange(4), rng.randrange(12)) for g in (0, 1) for _ in range(10)]
    edges = [(g, x, y, rng.randrange(3)) for g in (0, 1) for x in range(4) for y in range(4) if rng.random() < 0.8]
    assert any(a is None for _, _, a in left)
    walk, used, want = [], set(), set()
    for g, x, y, s in edges:
        walk += [(s, -1 if a is None else a, b, g) for h, c, a in left if (h, c) == (g, x) for k, d, b in right if (k, d) == (g, y)]
    for s, a, b, g in sorted(walk, reverse=True):
        if (a < 0 or ("l", g, a) not in used) and ("r", g, b) not in used:
            used |= {("l", g, a), ("r", g, b)}
            want.add((g, s, None if a < 0 else a, b))
    e = spark.createDataFrame(edges, "g int, _left int, _right int, s int")
    ends = spark.createDataFrame(left, "g int, _left int, a int"), spark.createDataFrame(right, "g int, _right int, b int")
    for cap in (1, 100_000):
        got = [tuple(r) for r in assign.greedy(e, ["g"], "a", "b", ["s"], cap=cap, ends=ends).select("g", "s", "a", "b").collect()]
        assert set(got) == want and len(got) == len(want)


def test_tied_pairs_forms_no_edges(spark, tmp_path):
    """Two classes of 3,000 ends: their 9 million edges are not written, the result is that of the walk; a key may be in two classes."""
    from pathlib import Path

    from concord.plans.registry import QUERIES
    from concord.session import scratch_dir

    spark.range(3000).selectExpr("id AS p_partkey", "3 AS p_size").union(spark.sql("SELECT 2999L, 5")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(3000).selectExpr("id AS s_suppkey", "3 AS s_nationkey").union(spark.sql("SELECT 7L, NULL UNION ALL SELECT 5000L, 5")).write.parquet(f"{tmp_path}/supplier.parquet")
    kept = Path(scratch_dir(spark).removeprefix("file:"))
    before = {p for p in kept.rglob("*.parquet")}
    got = sorted((r.p_partkey, r.s_suppkey, r.p_size) for r in QUERIES["tied_pairs"](spark, str(tmp_path)).collect())
    assert got == [(k, k + 1, 3) for k in range(2999)] + [(2999, 5000, 5)]
    written = [p.stat().st_size for p in kept.rglob("*.parquet") if p.is_file() and p not in before]
    assert written and sum(written) < 2_000_000
