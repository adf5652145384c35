"""Global order and running numbers without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.session import settle


def numbered(df: DataFrame, order: list[str], out: str = "row_number") -> DataFrame:
    """``df`` with its rows numbered from 1 in the order of ``order``, then of its other columns; NULLs come first.

    Rows are dealt by ranges of their order and written with the number of their range; each is
    numbered inside its range, and the ranges' counts, one row per range, give what lies before.
    Many rows of one key are split by their other columns; only rows equal in all columns stay together.
    """
    columns = [*order, *[c for c in df.columns if c not in order]]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in columns]).withColumn("_range", F.spark_partition_id()))
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    within = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in columns])
    return ranged.join(F.broadcast(before), "_range").withColumn(out, F.row_number().over(within) + F.col("_before")).drop("_range", "_before")
