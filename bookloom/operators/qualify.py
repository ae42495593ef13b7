"""Checks of a vendor's sample: sequences, integrity, reconciliation, traceability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.sources.schemas import DECIMAL


def sequence_report(raw: DataFrame) -> DataFrame:
    """Per connection: messages, regressions, duplicates, time ties and gaps of msg_seq; gaps are told, not interpreted.

    raw: conn_id, msg_seq, ts_recv_ns, ordinal.
    """
    w = W.partitionBy("conn_id").orderBy("ordinal")
    step = F.col("msg_seq") - F.lag("msg_seq").over(w)
    tie = F.col("ts_recv_ns") == F.lag("ts_recv_ns").over(w)
    rows = raw.select("conn_id", "msg_seq", step.alias("step"), tie.alias("tie"))
    per = rows.groupBy("conn_id").agg(F.count("*").alias("messages"), F.count_if(F.col("step") < 0).alias("regressions"), F.count_if(F.col("step") > 1).alias("gaps"), F.count_if("tie").alias("ties"))
    twice = raw.groupBy("conn_id", "msg_seq").agg((F.count("*") - 1).alias("n")).groupBy("conn_id").agg(F.sum("n").alias("duplicates"))
    return per.join(twice, "conn_id")


def integrity(raw: DataFrame) -> DataFrame:
    """messages, parse_failures, duplicate_payloads, connections."""
    per = raw.groupBy("payload_sha256").agg(F.count("*").alias("n"), F.count_if(~F.col("parse_ok")).alias("bad"))
    a = per.agg(F.sum("n").alias("messages"), F.sum("bad").alias("parse_failures"), F.sum(F.col("n") - 1).alias("duplicate_payloads"))
    return a.crossJoin(raw.agg(F.count_distinct("conn_id").alias("connections")))  # a row each


def reconciliation(normalized: DataFrame, depth: int) -> DataFrame:
    """Overall (event_type null) and by event type: rows, reconciling, not, unknown, truncated at the depth, deepest."""
    r = F.col("bid_ask_reconciles")
    deep = F.greatest("bid_levels", "ask_levels")
    return normalized.rollup("event_type").agg(
        F.count("*").alias("rows"), F.count_if(r).alias("reconciles"), F.count_if(~r).alias("differs"), F.count_if(r.isNull()).alias("unknown"),
        F.count_if(deep >= depth).alias("truncated"), F.max(deep).alias("deepest"),
    )


def traceability(normalized: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """side, matched, unmatched by exact keys alone; times are never matched nearly."""
    found = raw.select(*keys).distinct().withColumn("__bl_hit", F.lit(True))
    back = normalized.select(*keys).distinct().withColumn("__bl_hit", F.lit(True))

    def side(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
        hit = F.col("__bl_hit").isNotNull()
        joined = left.join(right, keys, "left")
        return joined.agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched")).select(F.lit(name).alias("side"), "matched", "unmatched")

    return side("normalized", normalized, found).unionByName(side("raw", raw, back))


def pick_tokens(rows: DataFrame, failed: DataFrame, most: int = 4) -> DataFrame:
    """The first tokens in text order that have books and changes, and every token with a reconciliation failure."""
    both = rows.groupBy("asset_id").agg(F.count_if(F.col("event_type") == "book").alias("b"), F.count_if(F.col("event_type") == "price_change").alias("c"))
    first = both.where("b > 0 AND c > 0").orderBy("asset_id").limit(most).select("asset_id")
    return first.union(failed.select("asset_id")).distinct()


def walk_depth(levels: DataFrame, wanted: float) -> DataFrame:
    """asset_id, filled, notional and complete of a taker order for so much size over visible levels, best first.

    What the delivered levels don't hold is refused, not invented. levels: asset_id, price, size of one side,
    asks for a buy.
    """
    before = F.coalesce(F.sum("size").over(W.partitionBy("asset_id").orderBy("price").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.least(F.col("size"), F.lit(wanted).cast(DECIMAL) - before), F.lit(0))
    rows = levels.withColumn("take", take)
    return rows.groupBy("asset_id").agg(F.sum("take").alias("filled"), F.sum(F.col("take") * F.col("price")).alias("notional"), (F.sum("take") >= wanted).alias("complete"))
