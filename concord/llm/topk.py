"""Exact top-k by inner product: columnar branch and bound over blocks of queries and candidates.

Vectors are dealt into blocks of bounded size.  Each pair of a query block and a candidate block is one group; both
sides hold the whole block in vertical layout (one row per dimension), most massive dimensions first.  For a query,
partial scores grow by blocks of dimensions; what is left can add at most the product of the remaining norms, and
candidates that cannot reach the k-th best score any more are compacted away.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.words import mixed, powers

_STEP = 0x9E3779B97F4A7C15
K = 20
#: Vectors in a block, about; dimensions that are added at once.
CANDIDATE_BLOCK, QUERY_BLOCK, DIMENSIONS = 8_192, 1_024, 8
#: Scores up to here are exact as doubles.
EXACT = 2**53


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, a NaN or an infinite component."""
    fine = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def whole_parts(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to the smaller vec_id.

    Both inputs have vec_id and vector (array of long).  A candidate with the query's own vec_id is left out, so is
    any row whose id or vector is null; vectors meet only others of their length.  Rows that repeat both id and vector
    count once.  Queries that repeat an id with other vectors are ranked apart.  Products are exact within 64 bits.
    """
    sides = []
    for df, size in ((queries, query_block), (candidates, candidate_block)):
        rows = df.select("vec_id", "vector").filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).distinct()
        blocks = max(1, math.ceil(df.count() / size))
        sides.append((rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks))), blocks))
    (q, n_q), (c, n_c) = sides
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    q = q.withColumnRenamed("block", "q").withColumn("c", every(n_c))
    c = c.withColumnRenamed("block", "c").withColumn("q", every(n_q))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, k)

    found = q.groupBy("q", "c").cogroup(c.groupBy("q", "c")).applyInArrow(
        best, "query_id bigint, query_no bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors as a matrix, for each length that occurs."""
    column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths())
    values, ends = np.asarray(column.flatten()), np.cumsum(sizes)
    out = {}
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out[int(size)] = rows, values[(ends[rows] - size)[:, None] + np.arange(size)]
    return out


def _best(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    out: list[list[np.ndarray]] = [[], [], [], []]
    if left.num_rows and right.num_rows:
        q_id, c_id = np.asarray(left["vec_id"]), np.asarray(right["vec_id"])
        all_c = _matrix(right["vector"])
        for size, (q_rows, qs) in _matrix(left["vector"]).items():
            if size not in all_c:
                continue
            c_rows, cs = all_c[size]
            found = _search(qs, cs, q_id[q_rows], c_id[c_rows], k)
            for row, number, (at, score) in zip(q_rows, _numbers(qs), found, strict=True):
                out[0].append(np.full(len(at), q_id[row]))
                out[1].append(np.full(len(at), number))
                out[2].append(c_id[c_rows][at])
                out[3].append(score)
    names = ["query_id", "query_no", "vec_id", "score"]
    return pa.table([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)) for c in out], names)


def _numbers(vectors: np.ndarray) -> np.ndarray:
    """A number that tells different vectors of one id apart, the same in every block."""
    up, _ = powers(_STEP, vectors.shape[1] + 1)
    return mixed((vectors.astype(np.int64).view(np.uint64) * up[1:]).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _search(qs: np.ndarray, cs: np.ndarray, q_id: np.ndarray, c_id: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, places and scores of its k best candidates in this block."""
    size = qs.shape[1]
    largest = [int(np.abs(x).max(initial=0)) for x in (qs, cs)]
    if largest[0] * largest[1] * max(size, 1) >= EXACT:  # too large for doubles: all products in 64-bit whole numbers
        each = (cs @ q for q in qs.astype(np.int64))
        return [_top(np.flatnonzero(c_id != own), score, c_id, k) for own, score in zip(q_id, each, strict=True)]
    mass = (cs.astype(np.float64) ** 2).sum(axis=0)
    order = np.argsort(-mass, kind="stable")
    columns = np.ascontiguousarray(cs[:, order].T.astype(np.float64))  # one row per dimension
    qs = qs[:, order].astype(np.float64)
    edges = [*range(0, size, DIMENSIONS), size]
    left_c = np.zeros((len(edges), len(cs)))  # norm of what is left of each candidate before each dimension block
    left_q = np.zeros((len(edges), len(qs)))
    for b in range(len(edges) - 2, -1, -1):
        part = slice(edges[b], edges[b + 1])
        left_c[b] = left_c[b + 1] + (columns[part] ** 2).sum(axis=0)
        left_q[b] = left_q[b + 1] + (qs[:, part] ** 2).sum(axis=1)
    left_c, left_q = np.sqrt(left_c), np.sqrt(left_q)
    out = []
    first = qs[:, : edges[1]] @ columns[: edges[1]] if size else np.zeros((len(qs), len(cs)))
    for n, own in enumerate(q_id):
        q, score = qs[n], first[n]
        alive = np.flatnonzero(c_id != own)
        score = score[alive]
        if len(alive) > k:
            # A first bound: the whole scores of the candidates that lead after the first dimensions.
            lead = np.argpartition(-score, k - 1)[: 4 * k]
            whole = q @ columns[:, alive[lead]]
            least = np.partition(whole, len(whole) - k)[len(whole) - k]
            for b in range(1, len(edges) - 1):
                stays = score + left_c[b][alive] * left_q[b][n] >= least - 0.5  # scores are whole numbers
                alive, score = alive[stays], score[stays]
                part = slice(edges[b], edges[b + 1])
                score = score + q[part] @ columns[part][:, alive]
        out.append(_top(alive, None, c_id, k, score))
    return out


def _top(alive: np.ndarray, whole: np.ndarray | None, c_id: np.ndarray, k: int, score: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    score = (whole[alive] if score is None else score).astype(np.int64)
    if len(alive) > k:  # all that tie with the k-th stay for the order by id
        least = np.partition(score, len(score) - k)[len(score) - k]
        alive, score = alive[score >= least], score[score >= least]
    order = np.lexsort((c_id[alive], -score))[:k]
    return alive[order], score[order]
