"""The same reconciliation on rows: keys, references, counts per key and record linkage."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import names, similarity
from concord.operators import assign, pairs
from concord.session import OPTIMAL_FOLD, literal_rows, settle


def key_check(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """One row: rows, distinct keys, surplus rows of repeated keys, rows with a NULL key part."""
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(any_null, F.col("n"))), F.lit(0)).alias("null_rows"),
    ).select(
        F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), "rows", "distinct_keys",
        "duplicate_rows", "null_rows", ((F.col("duplicate_rows") == 0) & (F.col("null_rows") == 0)).alias("is_key"),
    )


def orphan_check(child: DataFrame, child_cols: list[str], parent: DataFrame, parent_cols: list[str], name: str) -> DataFrame:
    """One row: child rows, and those whose key has no parent row.

    Child rows are counted per key before the join, so a key held by many rows travels once.
    """
    counted = child.groupBy(*child_cols).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_cols, child_cols)]).distinct().withColumn("_found", F.lit(True))
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in child_cols])
    return counted.join(keys, child_cols, "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(F.when(filled & F.col("_found").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
    ).select(F.lit(name).alias("fk_name"), "child_rows", "orphans", (F.col("orphans") == 0).alias("holds"))


def reconcile_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts per key in two versions of a table, classified; keys of either side appear."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("answer_count"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("student_count"))
    difference = F.coalesce("student_count", F.lit(0)) - F.coalesce("answer_count", F.lit(0))
    return a.join(b, keys, "full_outer").select(
        *keys, F.coalesce("answer_count", F.lit(0)).alias("answer_count"), F.coalesce("student_count", F.lit(0)).alias("student_count"),
        difference.alias("difference"),
        F.when(F.col("answer_count").isNull(), F.lit("only_student")).when(F.col("student_count").isNull(), F.lit("only_answer"))
        .when(difference == 0, F.lit("equal")).otherwise(F.lit("different")).alias("status"),
    )


def word_overlap_pairs(left: DataFrame, right: DataFrame, min_jaccard: float) -> DataFrame:
    """All pairs of distinct normalised names whose words have at least ``min_jaccard`` in common.

    Exact without comparing everything: two such names share a word among the rarest
    n - ceil(min * n) + 1 words of each, so only those words are joined on.
    ``left`` and ``right`` hold one ``name`` column.
    """
    def prepared(df: DataFrame, out: str) -> DataFrame:
        norm = names.normalize("name")
        return df.select(norm.alias(out)).filter(F.col(out) != "").distinct().withColumn("words", F.array_distinct(F.split(out, " ")))

    a, b = settle(prepared(left, "a_name")), settle(prepared(right, "b_name"))
    frequency = settle(
        a.select(F.explode("words").alias("w")).unionByName(b.select(F.explode("words").alias("w"))).groupBy("w").count()
    )

    def rare_words(df: DataFrame, name: str) -> DataFrame:
        listed = df.select(name, F.size("words").alias("n"), F.explode("words").alias("w"))
        ranked = pairs.join_back(listed, frequency, ["w"], salt_from=name).groupBy(name, "n").agg(
            F.array_sort(F.collect_list(F.struct("count", "w"))).alias("r")
        )
        kept = F.col("n") - F.ceil(F.col("n") * min_jaccard - 1e-9).cast("int") + 1
        return ranked.select(name, F.explode(F.slice("r", F.lit(1), F.least(kept, F.col("n")))).alias("r")).select(name, F.col("r.w").alias("w"))

    meet = rare_words(a, "a_name").join(rare_words(b, "b_name"), "w").select("a_name", "b_name").distinct()
    overlap = similarity.jaccard(F.col("a_words"), F.col("b_words"))
    return (
        meet.join(a.withColumnRenamed("words", "a_words"), "a_name").join(b.withColumnRenamed("words", "b_words"), "b_name")
        .withColumn("overlap", overlap).filter(F.col("overlap") >= min_jaccard).select("a_name", "b_name", "overlap")
    )


def record_link(left: DataFrame, right: DataFrame, min_jaccard: float, min_score: float) -> DataFrame:
    """One-to-one links of distinct names: candidates by word overlap, fuzzy score, greedy choice."""
    scored = word_overlap_pairs(left, right, min_jaccard).withColumn("score", F.round(similarity.fuzzy("a_name", "b_name"), 6))
    edges = scored.filter(F.col("score") >= min_score).withColumn("_all", F.lit(0))
    return assign.greedy(edges, ["_all"], "a_name", "b_name", ["score"]).drop("_all")


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label, of any width: partial sums per place, then the places in order."""
    places = vectors.select(label, F.posexplode(vector).alias("_place", "_x")).groupBy(label, "_place").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return places.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_m"))), lambda p: p["_m"]).alias("centroid"))


def target_cosines(vectors: DataFrame, vector: str, targets: DataFrame, target: str, limit: int = 10_000) -> DataFrame:
    """Vectors with ``near``: (cosine, target) of every target, in the row; targets are few and checked."""
    rows = targets.select(target, "centroid").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} targets")
    listed = literal_rows([{"target": r[target], "centroid": [float(x) for x in r["centroid"]]} for r in rows])
    return vectors.withColumn("_targets", listed).withColumn("near", F.transform("_targets", lambda t: F.struct(
        F.round(similarity.cosine(F.col(vector), t["centroid"]), 6).alias("cosine"), t["target"].alias("target")))).drop("_targets")


def nearest_targets(cosines: DataFrame, id_col: str, k: int) -> DataFrame:
    """The ``k`` nearest targets per vector, smaller target first among equals; nothing is shuffled."""
    ranked = F.array_sort(F.transform("near", lambda n: F.struct((-n["cosine"]).alias("c"), n["target"].alias("target"))))
    return cosines.select(id_col, F.posexplode(F.slice(ranked, 1, k)).alias("p", "n")).select(
        id_col, F.col("n.target").alias("target"), (-F.col("n.c")).alias("cosine"), (F.col("p") + 1).alias("rank")
    )


def vector_link(cosines: DataFrame, id_col: str, min_cosine: float) -> DataFrame:
    """One vector per target and one target per vector, greedily by cosine."""
    edges = cosines.select(id_col, F.inline(F.filter("near", lambda n: n["cosine"] > min_cosine))).withColumn("_all", F.lit(0))
    return assign.greedy(edges, ["_all"], id_col, "target", ["cosine"]).drop("_all")


def vector_assign(cosines: DataFrame, id_col: str, min_cosine: float, cap: int = OPTIMAL_FOLD) -> DataFrame:
    """One vector per target and one target per vector with the largest total cosine."""
    edges = cosines.select(id_col, F.inline(F.filter("near", lambda n: n["cosine"] > min_cosine))).withColumns(
        {"_all": F.lit(0), "_weight": pairs.micro(F.col("cosine"))})
    return assign.optimal(edges.filter("_weight > 0"), ["_all"], id_col, "target", "_weight", cap).drop("_all", "_weight")


def _directions(df: DataFrame, id_col: str, vector: str, out: str) -> DataFrame:
    """Distinct usable vectors scaled to length 1, each with the least id that has it; null, NaN, infinite and zero ones have no direction."""
    usable = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(usable).groupBy(F.transform(vector, lambda x: x.cast("double")).alias("_v")).agg(F.min(id_col).alias(out))
    length = F.sqrt(similarity.dot(F.col("_v"), F.col("_v")))
    return rows.withColumn("_n", length).filter("_n > 0").select(
        out, F.size("_v").alias("_w"), F.transform("_v", lambda x: x / F.col("_n")).alias(f"{out}_u"), F.col("_v").alias(f"{out}_v"))


def _copies(df: DataFrame, id_col: str, vector: str, directions: DataFrame, out: str, key: str) -> DataFrame:
    """(``key``, ``out``): every id, with the number of the direction that its vector has."""
    rows = df.filter(F.col(vector).isNotNull()).select(F.transform(vector, lambda x: x.cast("double")).alias("_v"), F.col(id_col).alias(out))
    return settle(rows.join(directions.select(F.col(f"{out}_v").alias("_v"), key), "_v").select(key, out).distinct())


def _angle(a: Column, b: Column) -> Column:
    """Between two directions, the shorter one taken as filled up with zeros."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product)))


def _products(least: float):
    """Pairs of two blocks with a product of ``least`` or more; nested so that tasks receive it by value."""
    def products(left, right):
        import numpy as np
        import pyarrow as pa

        sides = ((left, "a_id_u"), (right, "b_id_u"))
        if not all(t.num_rows for t, _ in sides):  # a block that nothing meets
            return pa.table({"a_id": left["a_id"][:0], "b_id": right["b_id"][:0], "cosine": np.zeros(0)})
        a, b = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t, c in sides)
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for start in range(0, len(a), 256):
            i, j = np.nonzero(a[start : start + 256] @ b.T >= least - 1e-9)
            found.append((i + start, j))
        i, j = (np.concatenate(x) for x in zip(*found))
        product = np.zeros(len(i))
        for k in range(a.shape[1]):  # place by place, as a sum over an array runs
            product += a[i, k] * b[j, k]
        return pa.table({"a_id": left["a_id"].take(pa.array(i)), "b_id": right["b_id"].take(pa.array(j)), "cosine": product})

    return products


def vector_pairs(left: DataFrame, right: DataFrame, id_col: str, vector: str, min_cosine: float, pivots: int = 32, block: int = 4096) -> DataFrame:
    """(a_id, b_id, cosine) of all pairs of directions of two sets with a cosine of ``min_cosine`` (above 0) or more.

    Copies of a vector are one, named by their least id; vectors of other widths are never alike.  Exact, by the
    triangle inequality of angles: each right vector belongs to its nearest of a few pivots and to a ring of its angle to that
    pivot; a left one meets only pivots and rings that a partner can be in.  Both sides are dealt in blocks of about
    ``block`` vectors, and two blocks that meet are multiplied in one task, so a task's memory does not grow with the sets.
    """
    a, b = (settle(_directions(df, id_col, vector, out).drop(f"{out}_v")) for df, out in ((left, "a_id"), (right, "b_id")))
    return _direction_pairs(a, b, min_cosine, pivots, block)


def _direction_pairs(a: DataFrame, b: DataFrame, min_cosine: float, pivots: int = 32, block: int = 4096) -> DataFrame:
    """``vector_pairs`` of two settled tables of directions."""
    reach = math.acos(min_cosine - 1e-6)  # a cosine is rounded before it is compared
    slack = 1e-6
    chosen = b.orderBy(F.xxhash64("b_id_u"), "b_id").select("b_id_u").limit(pivots).collect()
    if not chosen:
        return a.join(b, a["_w"] == b["_w"]).select("a_id", "b_id", F.lit(0.0).alias("cosine"))
    listed = literal_rows([{"p": [float(x) for x in r[0]]} for r in chosen])

    def placed(df: DataFrame, u: str, out: str) -> DataFrame:
        angles = F.transform("_pivots", lambda p: _angle(F.col(u), p["p"]))
        return df.withColumn("_pivots", listed).withColumn(out, angles).drop("_pivots").withColumn("_least", F.array_min(out))

    ring = settle(placed(b, "b_id_u", "b_at").select(
        "b_id", "_w", "b_id_u", (F.array_position("b_at", F.col("_least")) - 1).cast("int").alias("pivot"), F.floor(F.col("_least") / reach).cast("int").alias("ring")))
    largest = ring.groupBy("pivot", "ring", "_w").count().agg(F.max("count")).first()[0]
    shares, salts = (max(1, math.ceil(n / block)) for n in (a.count(), largest))

    def dealt(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    near = F.filter(F.transform("a_at", lambda x, i: F.struct(i.cast("int").alias("pivot"), x.alias("angle"))),
                    lambda p: p["angle"] <= F.col("_least") + (2 * reach + slack))
    meets = placed(a, "a_id_u", "a_at").select("a_id", "_w", "a_id_u", F.explode(near).alias("n")).select(
        "a_id", "_w", "a_id_u", F.col("n.pivot").alias("pivot"), F.explode(F.sequence(
            F.floor(F.greatest(F.col("n.angle") - (reach + slack), F.lit(0.0)) / reach).cast("int"),
            F.floor((F.col("n.angle") + (reach + slack)) / reach).cast("int"))).alias("ring")
    ).join(F.broadcast(ring.select("pivot", "ring", "_w").distinct()), ["pivot", "ring", "_w"], "left_semi")
    keys = ["pivot", "ring", "_w", "share", "salt"]
    lefts = meets.withColumn("share", dealt("a_id_u", shares)).withColumn("salt", each(salts))
    rights = ring.withColumn("salt", dealt("b_id_u", salts)).withColumn("share", each(shares))
    ids = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("a_id", a), ("b_id", b)))
    met = lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInArrow(_products(min_cosine - 1e-6), f"{ids}, cosine double")
    return met.select("a_id", "b_id", F.round("cosine", 6).alias("cosine")).filter(F.col("cosine") >= min_cosine)


def _numbered(df: DataFrame, id_col: str, vector: str, out: str, key: str) -> DataFrame:
    """A settled table of directions, each with a number of its own."""
    return settle(_directions(df, id_col, vector, out).withColumn(key, F.monotonically_increasing_id()))


def nearest_vectors(left: DataFrame, right: DataFrame, id_col: str, vector: str, min_cosine: float) -> DataFrame:
    """(a_id, b_id, cosine): for every left id, copies of a vector included, its nearest right one from ``min_cosine`` on; the smaller id among equals.

    Found once per distinct vector and joined back.  Among right copies the least id is the one.
    """
    a, b = _numbered(left, id_col, vector, "a_id", "_a"), settle(_directions(right, id_col, vector, "b_id").drop("b_id_v"))
    own = _copies(left, id_col, vector, a, "a_id", "_a")
    found = _direction_pairs(a.select(F.col("_a").alias("a_id"), "_w", "a_id_u"), b, min_cosine)
    return nearest_pairs(nearest_pairs(found).withColumnRenamed("a_id", "_a").join(own, "_a").drop("_a"))


def link_vectors(left: DataFrame, right: DataFrame, id_col: str, vector: str, min_cosine: float) -> DataFrame:
    """(a_id, b_id, cosine): one right id per left one and the other way round, greedily by cosine over the pairs of all ids.

    Copies of a vector are ends of their own, linked with the same others by the same cosines; so cosines are worked
    out once per pair of distinct vectors, and the copies are one class of ends in the greedy choice.
    """
    a, b = _numbered(left, id_col, vector, "a_id", "_a"), _numbered(right, id_col, vector, "b_id", "_b")
    found = _direction_pairs(a.select(F.col("_a").alias("a_id"), "_w", "a_id_u"), b.select(F.col("_b").alias("b_id"), "_w", "b_id_u"), min_cosine)
    ends = (_copies(left, id_col, vector, a, "a_id", "_a").select(F.col("_a").alias("_left"), "a_id"),
            _copies(right, id_col, vector, b, "b_id", "_b").select(F.col("_b").alias("_right"), "b_id"))
    edges = found.select(F.col("a_id").alias("_left"), F.col("b_id").alias("_right"), "cosine")
    return pair_off(edges, ends)


def nearest_pairs(pairs_found: DataFrame) -> DataFrame:
    """Each left vector's nearest right one, the smaller id among equals."""
    return pairs_found.groupBy("a_id").agg(F.max(F.struct("cosine", (-F.col("b_id")).alias("b"))).alias("m")).select(
        "a_id", (-F.col("m.b")).alias("b_id"), F.col("m.cosine").alias("cosine"))


def pair_off(pairs_found: DataFrame, ends: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One right vector per left one and the other way round, greedily by cosine.

    With ``ends`` the pairs link classes of like vectors, as in ``assign.greedy``.
    """
    together = None if ends is None else tuple(df.withColumn("_all", F.lit(0)) for df in ends)
    return assign.greedy(pairs_found.withColumn("_all", F.lit(0)), ["_all"], "a_id", "b_id", ["cosine"], ends=together).drop("_all")
