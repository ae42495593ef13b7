"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and two joins over the edges, written to the shared folder, so lineage
stays short and nothing is gathered on the driver but one checksum row a round. Rounds grow with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def _lowest(pairs: DataFrame, rows: int) -> DataFrame:
    """hub, low: the least of a node and its neighbours; pairs: u, v. Written, so that a hub's links can be split in the join."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("hub"), F.least("u", "low").alias("low"))
    return materialize(low, "lowest", rows)


def _large_star(edges: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both, rows)
    return both.join(low, F.col("u") == F.col("hub")).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")), low


def _small_star(edges: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down, rows)
    moved = down.join(low, F.col("u") == F.col("hub")).where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select(F.col("hub").alias("u"), F.col("low").alias("v"))), low


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node that links reach, for every node that has a link to another."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct()
    held, mark = materialize(e, "links"), None
    rows = 2 * held.count()  # nodes, and links of every later round, are no more
    while True:
        large, low = _large_star(held, rows)
        large = materialize(large.where("u != v").distinct(), "stars", rows)
        small, lower = _small_star(large, rows)
        done = materialize(small.where("u != v").distinct(), "stars", rows)
        discard(held, low, large, lower)
        held = done
        row = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row == mark:
            out = held.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._bookloom_path = held._bookloom_path  # so that discard() knows it
            return out
        mark = row
