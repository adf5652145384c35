"""Links between two vector sets against all pairs."""

import math
import random

import pytest

from concord.operators import records


def cos(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


@pytest.mark.parametrize(("width", "least"), [(3, 0.9), (3, 0.2), (80, 0.3)])
def test_pairs_are_all_pairs(spark, width, least):
    rng = random.Random(width)
    sets = [[(k, [rng.gauss(0, 1) for _ in range(width)]) for k in range(s, 120, 2)] for s in (0, 1)]
    a, b = (spark.createDataFrame(s, "id bigint, v array<double>") for s in sets)
    got = {(r.a_id, r.b_id): r.cosine for r in records.vector_pairs(a, b, "id", "v", least, pivots=5).collect()}
    want = {(i, j): round(cos(x, y), 6) for i, x in sets[0] for j, y in sets[1] if round(cos(x, y), 6) >= least}
    assert got == pytest.approx(want, abs=2e-6) and set(got) == set(want)
    near = {r.a_id: r.cosine for r in records.nearest_pairs(records.vector_pairs(a, b, "id", "v", least, pivots=5)).collect()}
    assert near == pytest.approx({i: max(c for (x, _), c in want.items() if x == i) for i, _ in want}, abs=2e-6)


def test_odd_vectors_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    a = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, [None, 1.0]), (9, []), (None, [0.0, 1.0])]
    b = [(10 + k, [2.0, 0.0]) for k in range(40)] + [(60, [1.0, 1.0]), (61, [1.0])]
    df = [spark.createDataFrame(x, "id bigint, v array<double>") for x in (a, b)]
    got = {(r.a_id, r.b_id, r.cosine) for r in records.vector_pairs(*df, "id", "v", 0.7).collect()}
    assert got == {(1, 10, 1.0), (1, 60, 0.707107), (7, 61, 1.0), (None, 60, 0.707107)}
    assert sorted(tuple(r) for r in records.pair_off(records.vector_pairs(*df, "id", "v", 0.7).filter("a_id is not null")).select("a_id", "b_id").collect()) == [(1, 10), (7, 61)]
    none = spark.createDataFrame([], "id bigint, v array<double>")
    assert records.vector_pairs(none, df[1], "id", "v", 0.5).count() == records.vector_pairs(df[0], none, "id", "v", 0.5).count() == 0


def test_centroids_of_any_width(spark):
    df = spark.createDataFrame([("a", [float(k) for k in range(100)]), ("a", [float(k + 2) for k in range(100)])], "label string, v array<double>")
    assert records.centroids(df, "label", "v").first().centroid == [k + 1.0 for k in range(100)]


def test_blocks_do_not_change_the_pairs(spark):
    """Blocks far smaller than the sets; the vectors travel in no broadcast."""
    rng = random.Random(5)
    a, b = (spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(s, 300, 2)], "id bigint, v array<double>") for s in (0, 1))
    whole = records.vector_pairs(a, b, "id", "v", 0.4, pivots=4)
    small = records.vector_pairs(a, b, "id", "v", 0.4, pivots=4, block=16)
    rows = sorted(map(tuple, whole.collect()))
    assert rows and sorted(map(tuple, small.collect())) == rows
    for line in small._jdf.queryExecution().executedPlan().toString().splitlines():
        assert "BroadcastExchange" not in line or "a_id" not in line
    assert "FlatMapCoGroupsInArrow" in small._jdf.queryExecution().optimizedPlan().toString()


def test_copies_are_whole(spark):
    """Copies, an id with two vectors and a row that comes twice, against all pairs of ids: none is left out."""
    rng = random.Random(11)
    spots = [[float(x) for x in v] for v in ((1, 0, 0), (2, 1, 0), (0, 1, 1), (0, 0, 1))]
    sets = [[(k, rng.choice(spots)) for k in range(s, 60, 2)] + [(s, spots[0]), (s, spots[3]), (s, spots[3])] for s in (0, 1)]
    a, b = (spark.createDataFrame(s, "id bigint, v array<double>") for s in sets)
    edges = {(round(cos(x, y), 6), i, j) for i, x in sets[0] for j, y in sets[1] if round(cos(x, y), 6) >= 0.3}
    near = {i: min((-c, j) for c, k, j in edges if k == i) for _, i, _ in edges}
    got = [tuple(r) for r in records.nearest_vectors(a, b, "id", "v", 0.3).select("a_id", "b_id", "cosine").collect()]
    assert sorted(got) == sorted((i, j, -c) for i, (c, j) in near.items()) and len(got) == 30
    used, want = [set(), set()], set()
    for _, i, j in sorted(edges, reverse=True):
        if i not in used[0] and j not in used[1]:
            used[0].add(i), used[1].add(j), want.add((i, j))
    linked = [tuple(r) for r in records.link_vectors(a, b, "id", "v", 0.3).select("a_id", "b_id").collect()]
    assert set(linked) == want and len(linked) == len(want)


def test_cosines_that_round_up_to_the_threshold(spark):
    """A cosine a little under the threshold is rounded up to it, and its vector lies a little beyond the border of a ring."""
    reach = math.acos(0.3)

    def at(angle, length=1.0):
        return [length * math.cos(angle), length * math.sin(angle)]

    b = [(k, at(0.0, k)) for k in range(1, 30)] + [(101, at(2 * reach + 2e-7))]  # the pivot is one of the many
    df = [spark.createDataFrame(x, "id bigint, v array<double>") for x in ([(0, at(reach - 2e-7))], b)]
    got = {(r.b_id, r.cosine) for r in records.vector_pairs(*df, "id", "v", 0.3, pivots=1).collect()}
    assert got == {(k, 0.3) for k, _ in b}
