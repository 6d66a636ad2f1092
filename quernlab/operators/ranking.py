"""Exact ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernlab.session import materialise

#: Rows below which the ranges are few.
RANGE_ROWS = 500_000


def distributed_rank(df: DataFrame, *order: Column | str, name: str = "rank", rows: int | None = None) -> DataFrame:
    """``df`` with its 1-based rank by ``order``, which must tell all rows apart.

    Rows are range-partitioned by the order, ranked within their range, and moved up by the sizes of
    the ranges before; only the sizes, one per range, meet in one place.
    """
    count = df.count() if rows is None else rows
    ranges = max(1, -(-count // RANGE_ROWS))
    if ranges == 1:
        # One range: a single sort of at most RANGE_ROWS rows.
        return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))
    placed = materialise(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    local = placed.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return local.join(F.broadcast(before), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")
