import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concord.functions import names, similarity, texts
from concord.operators import pairs


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return 100.0 if a == b else 200.0 * lcs(a, b) / (len(a) + len(b))


def partial(a, b):
    if a == b:
        return 100.0
    if not a or not b:
        return 0.0

    def best(s, t):
        n, m = len(s), len(t)
        windows = [t[max(i, 0):min(i + n, m)] for i in range(1 - n, m)]
        return max(200.0 * lcs(s, w) / (n + len(w)) for w in windows)

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(a, b) if len(a) < len(b) else best(b, a)


def token_set(a, b):
    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    common, ra, rb = sorted(wa & wb), sorted(wa - wb), sorted(wb - wa)
    if common and (not ra or not rb):
        return 100.0
    i, x, y = " ".join(common), " ".join(common + ra), " ".join(common + rb)
    return max([ratio(x, y)] + ([ratio(i, x), ratio(i, y)] if common else []))


def fuzzy(a, b):
    return max(token_set(a, b), partial(a, b), ratio(a.replace(" ", ""), b.replace(" ", "")))


def random_text(rng, alphabet="abcd ", lengths=(0, 1, 2, 3, 8, 14, 20, 20, 70, 90)):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))).split())


def test_ratios_against_plain_python(spark):
    rng = random.Random(1)
    rows = [(random_text(rng), random_text(rng)) for _ in range(150)]
    got = spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", similarity.ratio("a", "b").alias("r"), similarity.partial_ratio("a", "b").alias("p"),
        similarity.token_set_ratio("a", "b").alias("t")).collect()
    for x in got:
        assert (x.r, x.p, x.t) == pytest.approx((ratio(x.a, x.b), partial(x.a, x.b), token_set(x.a, x.b))), (x.a, x.b)


def test_name_hits_join_path_equals_list_path(spark):
    """Beyond the list limit the answer's names are found by joins on letters, with the same result."""
    rng = random.Random(5)

    def name():
        return "_".join("".join(rng.choice("abcdeint") for _ in range(rng.choice((1, 2, 4, 7)))) for _ in range(rng.choice((1, 2, 3))))

    ans = spark.createDataFrame([(name(),) for _ in range(60)], "column_name string")
    stu = spark.createDataFrame([(name(),) for _ in range(60)] + [("a_a_b",), ("x",)], "column_name string")
    by_list = {tuple(r) for r in pairs.name_hits(ans, stu).collect()}
    by_join = {tuple(r) for r in pairs.name_hits(ans, stu, limit=1).collect()}
    assert by_list == by_join
    canon = lambda s: " ".join(s.split("_"))
    expected = {
        (a.column_name, b.column_name) for a in ans.distinct().collect() for b in stu.distinct().collect()
        if fuzzy(canon(a.column_name), canon(b.column_name)) >= 70
    }
    assert by_list == expected


def gram_vector(text):
    padded = f" {text} "
    return Counter(padded[i:i + 3] for i in range(len(padded) - 2))


def cosine(a, b):
    x, y = gram_vector(a), gram_vector(b)
    size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / size if size else 0.0


def test_gram_cosine_in_a_row_and_by_join(spark):
    rng = random.Random(3)
    left = [(i, random_text(rng, "abc ", (1, 5, 30))) for i in range(12)]
    right = [(i, random_text(rng, "abc ", (0, 1, 5, 30))) for i in range(12)]
    a = spark.createDataFrame(left, "l int, text string")
    b = spark.createDataFrame(right, "r int, text string")
    joined = {(r.l, r.r): r.cosine for r in pairs.gram_edges(a, b, [], "l", "r").collect()}
    for i, x in left:
        for j, y in right:
            assert joined.get((i, j), 0.0) == pytest.approx(cosine(x, y))
    both = a.withColumnRenamed("text", "x").crossJoin(b.withColumnRenamed("text", "y"))
    for r in both.select("x", "y", pairs.text_cosine(F.col("x"), F.col("y")).alias("c")).collect():
        assert r.c == pytest.approx(cosine(r.x, r.y))


def test_hash_vector(spark):
    text = "phiếu chi"
    got = spark.createDataFrame([(text,)], "t string").select(texts.pad(texts.hash_vector(F.col("t")))).first()[0]
    raw = list(hashlib.sha256(text.encode()).digest())
    norm = math.sqrt(sum(v * v for v in raw)) + 1e-8
    assert got == pytest.approx([v / norm for v in raw] + [0.0] * 352)


def test_domain_text_lists_the_mentioned_phrases(spark):
    got = spark.createDataFrame([("Supplier and Item",)], "t string").select(texts.domain_text(F.col("t"))).first()[0]
    assert got.split("\n")[-2:] == ["- nha cung cap: ncc, supplier, vendor", "- hang hoa: mat hang, san pham, item, product"]


def test_related_phrases_are_closer_than_unrelated_ones(spark):
    near, far = cosine("phieu chi", "phieu tra"), cosine("phieu chi", "nhan vien")
    row = spark.createDataFrame([("phiếu chi", "phiếu trả", "nhân viên")], "a string, b string, c string").select(
        pairs.text_cosine(F.col("a"), F.col("b")).alias("near"), pairs.text_cosine(F.col("a"), F.col("c")).alias("far")).first()
    assert (row.near, row.far) == pytest.approx((near, far)) and near > far


@pytest.mark.parametrize("a, b, jaccard, chars", [
    ("ma hang", "ma kho", 1 / 3, 3 / 7), ("abc", "abc", 1.0, 1.0), ("", "x", 0.0, 0.0), ("abcd", "abxy", 0.0, 0.5),
])
def test_plain_similarities(spark, a, b, jaccard, chars):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        similarity.token_jaccard(F.col("a"), F.col("b")).alias("j"), similarity.char_similarity(F.col("a"), F.col("b")).alias("c")).first()
    assert (row.j, row.c) == pytest.approx((jaccard, chars))


def test_dense_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(
        similarity.cosine(F.col("a"), F.col("b")).alias("c"), similarity.cosine(F.col("a"), F.col("b"), clamp=True).alias("k"),
        similarity.cosine(F.col("a"), F.col("z")).alias("z")).first()
    assert (row.c, row.k, row.z) == (-1.0, 0.0, 0.0)


def test_fk_text(spark):
    row = spark.createDataFrame([("ChiTiet_HD", ["MaHD"], "HoaDon", ["MaHD"])], "p string, pc array<string>, r string, rc array<string>")
    got = row.select(texts.fk_text(
        names.canonical("p"), F.transform("pc", lambda c: names.canonical(c)), names.canonical("r"),
        F.transform("rc", lambda c: names.canonical(c)))).first()[0]
    assert got == "chi tiet hd(ma hd) -> hoa don(ma hd)"
