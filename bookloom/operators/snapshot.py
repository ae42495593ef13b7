"""State as observed by a time: nothing received later counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import last_before
from .rest import as_of

#: Observations before this date are of another regime.
REGIME = "2026-04-28"


def in_regime(received: Column, start: str = REGIME) -> Column:
    return received >= F.to_timestamp(F.lit(start))


def market_snapshot(requests: DataFrame, states: DataFrame) -> DataFrame:
    """requests (asset_id, at and more) with the latest state received by then: best_bid, best_ask, spread, as_of, valid.

    states: asset_id, received, best_bid, best_ask, valid. Without one, or with an invalid one, prices are null.
    """
    values = ["best_bid", "best_ask", "valid", "as_of"]
    right = states.select("asset_id", F.col("received").alias("at"), "best_bid", "best_ask", "valid", F.col("received").alias("as_of"))
    out = as_of(requests, right, ["asset_id"], "at", values)
    ok = F.coalesce("valid", F.lit(False))
    shown = {c: F.when(ok, F.col(c)) for c in ("best_bid", "best_ask")}
    return out.withColumns({**shown, "valid": ok}).withColumn("spread", F.col("best_ask") - F.col("best_bid"))


def metadata_as_of(requests: DataFrame, metadata: DataFrame, values: list[str]) -> DataFrame:
    """The last metadata observed by then; missing stays missing."""
    return as_of(requests, metadata, ["asset_id"], "at", values)


def gap_checked(requests: DataFrame, gaps: DataFrame, at: str = "at", seen: str = "as_of") -> DataFrame:
    """requests with valid put to false where a gap of the feed lies between the state seen and the request.

    A gap is of the whole feed, not of an asset: it invalidates every state received before it. gaps: received. Times
    are cut into hours, so gaps and requests meet there and the last gap of earlier hours is carried on.
    """
    asked = requests.withColumns({"__bl_at": F.col(at), "__bl_asked": F.lit(1), "__bl_gap": F.lit(None).cast("timestamp")})
    both = asked.unionByName(gaps.select(F.col("received").alias("__bl_at"), F.lit(0).alias("__bl_asked"), F.col("received").alias("__bl_gap")), allowMissingColumns=True)
    both = both.withColumn("__bl_hour", F.date_trunc("hour", "__bl_at"))
    out = last_before(both, ["__bl_hour"], ["__bl_at", "__bl_asked"], ["__bl_gap"]).where("__bl_asked = 1")
    lost = F.coalesce(F.col("__bl_gap_before") > F.col(seen), F.lit(False))
    return out.withColumn("valid", F.col("valid") & ~lost).select(*requests.columns)


def tick_contradictions(ticks: DataFrame) -> DataFrame:
    """Tick changes whose old size is not the new size of the asset's change before."""
    before = F.lag("new_tick").over(W.partitionBy("asset_id").orderBy("seq"))
    return ticks.withColumn("expected", before).where(F.col("expected").isNotNull() & (F.col("expected") != F.col("old_tick")))


def best_signal(events: DataFrame, states: DataFrame) -> DataFrame:
    """best_bid_ask events against the derived prices then: a signal, never depth. agrees is null without a state."""
    right = states.select("asset_id", "seq", F.col("best_bid").alias("derived_bid"), F.col("best_ask").alias("derived_ask"), F.lit(True).alias("known"))
    out = as_of(events, right, ["asset_id"], "seq", ["derived_bid", "derived_ask", "known"])
    same = F.col("best_bid").eqNullSafe(F.col("derived_bid")) & F.col("best_ask").eqNullSafe(F.col("derived_ask"))
    return out.withColumn("agrees", F.when(F.col("known"), same)).drop("known")


def stale_sources(events: DataFrame, limit_ms: int | None = None) -> DataFrame:
    """Events whose source time is older than the latest of their token by more than the limit; no limit is set by default."""
    if limit_ms is None:
        return events.where(F.lit(False))
    top = F.max("source_ms").over(W.partitionBy("token").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return events.withColumn("__bl_top", top).where(F.col("__bl_top") - F.col("source_ms") > limit_ms).drop("__bl_top")
