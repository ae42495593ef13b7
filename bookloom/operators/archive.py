"""Audit of archived feeds: how much of the order inside one availability time is unknown, and what it costs.

A group is all rows of one (market, asset_id, timestamp_received): an unordered set. Every measure is
exact and order-free; percentiles are nearest rank over exact counts, and pooled results come from the
same counts, never from averages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions.exact import nearest_rank

GROUP = ["market", "asset_id", "received"]
SHARES = {"minimum": 0.0, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "maximum": 1.0}


#: Of the rules that class groups and duplicates; results keep it.
RULE_VERSION = 1


def shard_of(shards: int = 32) -> Column:
    """From market and asset alone, so that an asset never splits."""
    return F.pmod(F.xxhash64("market", "asset_id"), F.lit(shards)).cast("int")


def rows_per_timestamp(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    per = rows.groupBy(*by, "received").agg(F.count("*").alias("rows"))
    return nearest_rank(per, "rows", SHARES, by)


def size_bucket(n: Column) -> Column:
    return F.when(n < 5, n.cast("string")).when(n < 10, "5-9").when(n < 100, "10-99").otherwise("100+")


def size_buckets(rows: DataFrame) -> DataFrame:
    """bucket, groups, rows."""
    per = rows.groupBy(*GROUP).agg(F.count("*").alias("n"))
    return per.groupBy(size_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))


def tied_groups(rows: DataFrame) -> DataFrame:
    """composition (sorted event types, comma-joined), groups, rows of groups with two or more book or change rows."""
    l2 = rows.where(F.col("event_type").isin("book", "price_change"))
    kinds = l2.groupBy(*GROUP, "event_type").agg(F.count("*").alias("n"))
    per = kinds.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("composition"))
    return per.where("n > 1").groupBy("composition").agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))


def classify(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """GROUP with books, changes, ticks, others and class.

    rows: row_id, GROUP, event_type, side, price, size, ok (parsed), book_key (digest of the canonical book:
    its sides, prices and sizes above 0), tick_key. levels: row_id, side, price, size of book rows.
    class: none (no L2 row), invariant, or ambiguous_unparseable, ambiguous_book, ambiguous_change,
    ambiguous_interaction: the first that applies. Tick changes are ambiguous_tick apart, in tick_class.
    """
    l2 = F.col("event_type").isin("book", "price_change")
    per = rows.groupBy(*GROUP).agg(
        F.count_if(F.col("event_type") == "book").alias("books"),
        F.count_if(F.col("event_type") == "price_change").alias("changes"),
        F.count_if(F.col("event_type") == "tick_size_change").alias("ticks"),
        F.count_if(~l2 & (F.col("event_type") != "tick_size_change")).alias("others"),
        F.count_if(l2 & ~F.col("ok")).alias("unparseable"),
        F.count_distinct(F.when(F.col("event_type") == "book", F.col("book_key"))).alias("book_keys"),
        F.count_distinct(F.when(F.col("event_type") == "tick_size_change", F.col("tick_key"))).alias("tick_keys"),
    )
    changes = rows.where("event_type = 'price_change' AND ok").groupBy(*GROUP, "side", "price").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    conflict = changes.groupBy(*GROUP).agg(F.count_if(F.col("low") != F.col("high")).alias("conflicts"))
    # a change next to a book must already be its level; a level that isn't there has size 0
    own = rows.where("event_type = 'book' AND ok").select("row_id", *GROUP)
    held = own.join(levels, "row_id").where("size > 0").groupBy(*GROUP, "side", "price").agg(F.max("size").alias("held"))
    with_book = changes.join(own.select(*GROUP).distinct(), GROUP, "left_semi")
    met = with_book.join(held, [*GROUP, "side", "price"], "left")
    differ = met.groupBy(*GROUP).agg(F.count_if((F.col("low") != F.coalesce("held", F.lit(0))) | (F.col("high") != F.coalesce("held", F.lit(0)))).alias("differing"))
    out = per.join(conflict, GROUP, "left").join(differ, GROUP, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        *GROUP, "books", "changes", "ticks", "others",
        F.when(F.col("books") + F.col("changes") == 0, "none")
        .when(F.col("unparseable") > 0, "ambiguous_unparseable")
        .when(F.col("book_keys") > 1, "ambiguous_book")
        .when(zero("conflicts") > 0, "ambiguous_change")
        .when((F.col("books") > 0) & (zero("differing") > 0), "ambiguous_interaction")
        .otherwise("invariant").alias("class"),
        F.when(F.col("ticks") == 0, "none").when(F.col("tick_keys") > 1, "ambiguous_tick").when(F.col("ticks") > 1, "duplicate").otherwise("single").alias("tick_class"),
    )


def duplicates(rows: DataFrame) -> DataFrame:
    """GROUP, kind (idempotent_book, idempotent_replacement, tick), extra rows and the version of the rules that said so.

    Rows of one group that say the same are duplicates; they are told and kept. Trades are no part of a book and not looked at.
    """
    e = F.col("event_type")
    kind = F.when(e == "book", "idempotent_book").when((e == "price_change") & F.col("ok"), "idempotent_replacement").when(e == "tick_size_change", "tick")
    said = F.when(e == "book", F.coalesce("book_key", F.lit(""))).when(e == "price_change", F.concat_ws(":", "side", "price", "size")).otherwise(F.col("tick_key"))
    same = rows.select(*GROUP, kind.alias("kind"), said.alias("said")).where("kind IS NOT NULL").groupBy(*GROUP, "kind", "said").agg((F.count("*") - 1).alias("extra"))
    return same.where("extra > 0").groupBy(*GROUP, "kind").agg(F.sum("extra").alias("extra")).withColumn("rule_version", F.lit(RULE_VERSION))


def pooled(counts: DataFrame, by: str, *measures: Column) -> DataFrame:
    """Measures for each sample, and for all together where by is null."""
    return counts.rollup(by).agg(*measures)


def source_times(rows: DataFrame) -> DataFrame:
    """GROUP, distinct source times, span in ms; with ordinal, regressions in published order too.

    Rows of one ordinal say nothing of their order: they stand by source time, so that none regresses against another
    and every run counts the same.
    """
    ms = F.unix_millis("source")
    keys = [F.count_distinct("source").alias("source_times"), (F.max(ms) - F.min(ms)).alias("span_ms")]
    if "ordinal" in rows.columns:
        before = F.lag("source").over(W.partitionBy(*GROUP).orderBy("ordinal", "source"))
        rows = rows.withColumn("__bl_back", F.coalesce(F.col("source") < before, F.lit(False)))
        keys.append(F.count_if("__bl_back").alias("regressions"))
    return rows.groupBy(*GROUP).agg(*keys)


def states(groups: DataFrame) -> DataFrame:
    """GROUP with state after it (UNINITIALIZED, VALID, INVALID), until (next group's time), epoch.

    A group with a book sets VALID; an ambiguous one sets INVALID, even if it holds a book. In between the
    state stays: it is that of the last group that sets it.
    """
    sets = F.when(F.col("class").startswith("ambiguous"), "INVALID").when(F.col("books") > 0, "VALID")
    w = W.partitionBy("market", "asset_id").orderBy("received")
    g = groups.withColumn("sets", F.when(sets.isNotNull(), F.struct(sets.alias("s"))))
    last = F.last("sets", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))["s"]
    # before the first book an asset is uninitialised: there is nothing to invalidate
    started = F.max(F.when((F.col("books") > 0) & ~F.col("class").startswith("ambiguous"), 1)).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1
    return g.select(
        *GROUP, "books", "class",
        F.when(F.coalesce(started, F.lit(False)), last).otherwise("UNINITIALIZED").alias("state"),
        F.lead("received").over(w).alias("until"),
    )


def state_durations(found: DataFrame, end: Column) -> DataFrame:
    """market, asset_id, state, ms; the last state lasts to the end."""
    stop = F.least(F.coalesce("until", end), end)
    ms = F.greatest(F.unix_millis(stop) - F.unix_millis("received"), F.lit(0))
    return found.groupBy("market", "asset_id", "state").agg(F.sum(ms).alias("ms"))


def recoveries(found: DataFrame) -> DataFrame:
    """market, asset_id, lost, recovered (null: not before the end), ms of each turn from VALID to INVALID."""
    w = W.partitionBy("market", "asset_id").orderBy("received")
    back = F.first(F.when(F.col("state") == "VALID", F.col("received")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    turn = (F.col("state") == "INVALID") & (F.lag("state").over(w) == "VALID")
    rows = found.withColumn("__bl_turn", turn).withColumn("recovered", back).where("__bl_turn")
    return rows.select("market", "asset_id", F.col("received").alias("lost"), "recovered", (F.unix_millis("recovered") - F.unix_millis("received")).alias("ms"))


def cadence(found: DataFrame, minutes: int, end: Column) -> DataFrame:
    """market, asset_id, points, valid_points on a grid of so many minutes from the asset's first accepted book.

    A state covers the grid points from its start to before the next; each state counts its own points, so no
    grid row is made.
    """
    step = minutes * 60_000
    first = F.min(F.when(F.col("state") == "VALID", F.unix_millis("received"))).over(W.partitionBy("market", "asset_id"))
    rows = found.withColumn("first", first).where("first IS NOT NULL")
    a = F.greatest(F.unix_millis("received"), F.col("first")) - F.col("first")
    b = F.unix_millis(F.least(F.coalesce("until", end), end)) - F.col("first")
    n = F.greatest(F.ceil(b / step) - F.ceil(a / step), F.lit(0))
    return rows.groupBy("market", "asset_id").agg(F.sum(n).alias("points"), F.sum(F.when(F.col("state") == "VALID", n).otherwise(0)).alias("valid_points"))


def coverage(rows: DataFrame) -> DataFrame:
    """hour, events, assets and the ratio to the hour before, for every hour from first to last; missing hours have 0."""
    per = rows.groupBy(F.date_trunc("hour", "received").alias("hour")).agg(F.count("*").alias("events"), F.count_distinct("asset_id").alias("assets"))
    grid = per.agg(F.explode(F.sequence(F.min("hour"), F.max("hour"), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    all_hours = grid.join(per, "hour", "left").select("hour", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("assets", F.lit(0)).alias("assets"))
    before = F.lag("events").over(W.orderBy("hour"))  # hours, not rows
    return all_hours.withColumn("ratio", F.col("events") / F.when(before > 0, before))


def plateaus(rows: DataFrame, most: int) -> DataFrame:
    """received, rows of the largest runs of one receive time."""
    return rows.groupBy("received").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "received").limit(most)


def sort_breaks(rows: DataFrame, order: str) -> DataFrame:
    """breaks of the published order (market, asset_id, received) by physical ordinal within a file; told, never mended."""
    key = F.struct("market", "asset_id", "received")
    before = F.lag(key).over(W.partitionBy("file").orderBy(order))
    return rows.select("file", (key < before).alias("broken")).groupBy("file").agg(F.count_if("broken").alias("breaks"))


def diagnostics(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """problem, rows: null keys and rows outside their hour; they stay visible."""
    problem = F.when(F.col("market").isNull() | F.col("asset_id").isNull() | F.col("received").isNull(), "null_key").when((F.col("received") < start) | (F.col("received") >= end), "out_of_hour")
    return rows.select(problem.alias("problem")).where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("rows"))


def pilot_window(rows: DataFrame, least: int) -> DataFrame:
    """market, asset_id of whole assets in key order until so many rows are reached."""
    per = rows.groupBy("market", "asset_id").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(W.orderBy("market", "asset_id").rowsBetween(W.unboundedPreceding, -1))  # assets, not rows
    return per.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < least).drop("before")


def largest_shard(rows: DataFrame, shards: int = 32) -> DataFrame:
    return rows.groupBy(shard_of(shards).alias("shard")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "shard").limit(1)
