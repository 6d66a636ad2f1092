"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlab.operators.skew import spread_join
from quernlab.session import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id of an edge with the least id it is connected to.

    Alternating large-star and small-star rounds: each round is two group-bys on the edge table,
    no neighbourhood is ever gathered in one task, and the number of rounds grows with the
    logarithm of the longest path. Each round's edges are written to the shared folder, so a lost
    executor costs at most that round, and deleted once the next has its own. Null ends and self loops are ignored; no edges give no rows.
    """
    one_way = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    current, before = materialise(one_way), None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A node's neighbours may be a third of all rows, so they are dealt to tasks where they meet its least one.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialise(spread_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, parent, "u")
        after = materialise(
            small.select(F.col("u"), F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        state = after.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        discard(large)
        discard(current)
        current = after
        if state == before:
            break
        before = state
    members = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct()).distinct()
