"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A frequent-items summary (Spark's ``approx_top_k``, the mergeable Misra-Gries family) finds the digests that occur
most.  The exact winner of each is counted with partial aggregates and sent to every task, where the hot copies are
marked without a shuffle.  All other digests, whose groups are then small, are shuffled as usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.session import settle

#: Counters of the summary: every digest with more than rows / 4,096 copies, roughly, is found.
COUNTERS = 8_192
#: Frequent digests that are sent to every task: at most these many rows of about 100 bytes.
HOT = 1_024
#: A digest is worth sending from so many copies on.
HOT_COPIES = 16


def digest(text: Column) -> Column:
    """Identity of a text: SHA-256 of its UTF-8 bytes, null counting as empty."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def frequent(rows: DataFrame, key: str, counters: int = COUNTERS, hot: int = HOT) -> DataFrame:
    """Keys that the summary holds as frequent, at most ``hot`` rows."""
    top = rows.agg(F.expr(f"approx_top_k({key}, {hot}, {counters})").alias("top"))
    return (
        top.select(F.explode("top").alias("t")).filter(F.col("t.count") >= HOT_COPIES).select(F.col("t.item").alias(key)).distinct()
    )


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays (a null id is smallest; of rows that repeat both id and text
    one stays).  A null text equals the empty one.  Other columns of any name are ignored; an empty table gives none.
    """
    rows = settle(docs.select(
        F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("sha"), F.monotonically_increasing_id().alias("row_no")))
    best = F.max(F.struct("doc_id", "row_no"))
    found = settle(frequent(rows, "sha"))
    winners = settle(
        rows.join(F.broadcast(found), "sha", "left_semi").groupBy("sha").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    # The row that stays in a hot group: one more partial aggregate, as its id may be repeated.
    tied = rows.join(F.broadcast(winners.select("sha", F.col("keep_id").alias("k"))), "sha").filter(F.col("doc_id").eqNullSafe(F.col("k")))
    winners = settle(winners.join(F.broadcast(tied.groupBy("sha").agg(F.max("row_no").alias("keep_row"))), "sha"))
    joined = rows.join(F.broadcast(winners), "sha", "left")
    hot = joined.filter(F.col("keep_row").isNotNull()).select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "sha")
    group = Window.partitionBy("sha")
    rest = joined.filter(F.col("keep_row").isNull()).select("sha", "doc_id", "row_no")
    rest = rest.withColumn("best", best.over(group)).withColumn("group_size", F.count(F.lit(1)).over(group)).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("best.row_no")).alias("kept"), "sha")
    out = hot.unionByName(rest)
    return out.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Copies of frequent texts are dropped where they are read: only rows with the winner's id go on, and a partial
    aggregate leaves one of them.  The others meet in an ordinary shuffle, one row per text staying.
    """
    columns = docs.columns
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("doc"), docs[f"`{id_col}`"].alias("id"), digest(docs[f"`{text_col}`"]).alias("sha"))
    narrow = settle(whole.select("sha", "id"))
    found = settle(frequent(narrow, "sha"))
    winners = settle(narrow.join(F.broadcast(found), "sha", "left_semi").groupBy("sha").agg(F.max("id").alias("keep_id"), F.lit(True).alias("hot")))
    joined = whole.join(F.broadcast(winners), "sha", "left")
    hot = joined.filter(F.col("hot") & F.col("id").eqNullSafe(F.col("keep_id"))).select("sha", "doc").dropDuplicates(["sha"])
    first = Window.partitionBy("sha").orderBy(F.col("id").desc_nulls_last())
    rest = joined.filter(F.col("hot").isNull()).withColumn("place", F.row_number().over(first)).filter(F.col("place") == 1)
    return hot.select("doc").unionByName(rest.select("doc")).select("doc.*")
