"""Running values over one order of a whole table, without a task that sorts it all.

ranges are columns whose values, in order, cut the table's order into pieces that a task can sort: spans of a
sequence number, hours, or file and block. Inside a piece a window does the work; between pieces one row a piece
carries values on, so only that small table is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sequence numbers in a piece.
SPAN = 1 << 18


def span_of(number: Column, span: int = SPAN) -> Column:
    return F.floor(number / span)


def _with(rows: DataFrame, carried: DataFrame, ranges: list[str]) -> DataFrame:
    same = F.lit(True)
    for r in ranges:
        same = same & F.col(r).eqNullSafe(F.col(f"__bl_{r}"))
    return rows.join(carried, same, "left")


def last_before(rows: DataFrame, ranges: list[str], order: list[str], values: list[str]) -> DataFrame:
    """rows with <value>_before: the last value that isn't null before each row."""
    inside = W.partitionBy(*ranges).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    at = F.struct(*order)
    ends = rows.groupBy(*ranges).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) for v in values))
    between = W.orderBy(*ranges).rowsBetween(W.unboundedPreceding, -1)  # a row a piece
    ends = ends.select(*(F.col(r).alias(f"__bl_{r}") for r in ranges), *(F.last(v, ignorenulls=True).over(between).alias(f"__bl_last_{v}") for v in values))
    own = rows.withColumns({f"__bl_own_{v}": F.last(v, ignorenulls=True).over(inside) for v in values})
    return _with(own, ends, ranges).select(*rows.columns, *(F.coalesce(f"__bl_own_{v}", f"__bl_last_{v}").alias(f"{v}_before") for v in values))


def numbered(rows: DataFrame, ranges: list[str], order: list[str], name: str, after: int = 0) -> DataFrame:
    """rows with their number in the order, from after + 1 on: how sequence numbers are given out."""
    sizes = rows.groupBy(*ranges).agg(F.count("*").alias("__bl_size"))
    before = F.sum("__bl_size").over(W.orderBy(*ranges).rowsBetween(W.unboundedPreceding, -1))  # a row a piece
    sizes = sizes.select(*(F.col(r).alias(f"__bl_{r}") for r in ranges), F.coalesce(before, F.lit(0)).alias("__bl_before"))
    own = rows.withColumn("__bl_own", F.row_number().over(W.partitionBy(*ranges).orderBy(*order)))
    return _with(own, sizes, ranges).select(*rows.columns, (F.col("__bl_own") + F.col("__bl_before") + after).alias(name))
