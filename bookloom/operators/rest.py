"""REST snapshots against the replayed state: alignment, depth, validation, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.sources.schemas import REST_FIELDS

from .replay import KEY, ORDER, alive_at


def as_of(left: DataFrame, right: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row at or before it, by key: a union and a running last value."""
    packed = F.struct(*values)
    both = left.withColumns({"__bl_v": F.lit(None).cast(right.select(packed).schema[0].dataType), "__bl_left": F.lit(1)}).unionByName(
        right.select(*by, order, packed.alias("__bl_v"), F.lit(0).alias("__bl_left")), allowMissingColumns=True
    )
    w = W.partitionBy(*by).orderBy(order, "__bl_left").rowsBetween(W.unboundedPreceding, 0)
    last = both.withColumn("__bl_v", F.last("__bl_v", ignorenulls=True).over(w)).where("__bl_left = 1")
    return last.select(*left.columns, *(F.col(f"__bl_v.{v}").alias(v) for v in values))


def statuses(rest: DataFrame) -> DataFrame:
    """status_code, requests; 0 stands for a transport failure."""
    return rest.groupBy(F.coalesce("status_code", F.lit(0)).alias("status_code")).agg(F.count("*").alias("requests"))


def targeted_requests(found: DataFrame, subscribed: DataFrame) -> DataFrame:
    """candidates() as the reads to ask for; code targeted_rest_request_rejected: the token isn't in the subscription.

    subscribed: token. What is asked for stays within what the run subscribed to.
    """
    known = subscribed.select(F.col("token").alias("__bl_token")).distinct()
    rows = found.join(known, F.col("asset_id") == F.col("__bl_token"), "left")
    code = F.when(F.col("__bl_token").isNull(), "targeted_rest_request_rejected")
    return rows.select("candidate_id", "kind", "component", F.col("asset_id").alias("token_id"), "session_id", "seq", "version", code.alias("code"))


def failed_reads(failures: DataFrame) -> DataFrame:
    """Transport failures as reads without a response, of status 0; failures: as of timing.failures()."""
    return failures.where("transport").select(F.col("ingest_sequence").alias("rest_id"), "token_id", "candidate_id", F.lit(0).alias("status_code"), "code")


def outcome(rest: DataFrame) -> DataFrame:
    """rest with code: rest_non_2xx, rest_invalid_json, or null for usable responses."""
    code = F.when(~F.col("status_code").between(200, 299), "rest_non_2xx").when((F.col("parse_status") != "ok") | ~F.col("is_object"), "rest_invalid_json")
    return rest.withColumn("code", code)


def field_presence(rest: DataFrame) -> DataFrame:
    """field, present, missing over usable responses; rest: fields (array of names)."""
    names = F.explode(F.array(*map(F.lit, REST_FIELDS)))
    rows = rest.where("code IS NULL").select(names.alias("field"), "fields")
    has = F.array_contains("fields", F.col("field"))
    return rows.groupBy("field").agg(F.count_if(has).alias("present"), F.count_if(~has).alias("missing"))


def align(rest: DataFrame) -> DataFrame:
    """rest with aligned: the recorded window is one state, and it is the state at receipt.

    rest: state_*_before and _after as recorded, and the state at receipt (valid, session, version), which
    as_of() brings for records that don't hold it.
    """
    c = F.col
    stable = (
        c("now_valid") & c("state_valid_before") & c("state_valid_after")
        & c("state_session_before").isNotNull() & (c("state_session_before") == c("state_session_after"))
        & (c("state_session_after") == c("now_session"))
        & (c("state_version_before") == c("state_version_after")) & (c("state_version_after") == c("now_version"))
    )
    return rest.withColumn("aligned", F.coalesce(stable, F.lit(False)))


def depth_matches(rest: DataFrame, rest_levels: DataFrame, changed: DataFrame) -> DataFrame:
    """rest_id, full_match: both sides hold the same prices with the same sizes; levels of size 0 count.

    rest: rest_id, KEY, n of the last event before it. changed: replay.level_events().
    """
    mine = alive_at(rest.select("rest_id", *KEY, "n"), changed, ["rest_id"]).withColumnRenamed("size", "own_size")
    both = rest_levels.join(mine, ["rest_id", "side", "price"], "full_outer")
    wrong = both.groupBy("rest_id").agg(F.count_if(~F.col("size").eqNullSafe(F.col("own_size"))).alias("differences"))
    return rest.select("rest_id").join(wrong, "rest_id", "left").select("rest_id", (F.coalesce("differences", F.lit(0)) == 0).alias("full_match"))


def validations(fates: DataFrame, books: DataFrame, matched: DataFrame) -> DataFrame:
    """Discriminating updates with superseded_at, validated_at and verdict.

    An update is retired by the next applied touch of its level or the next accepted book of its asset,
    whichever session; it is validated by a fully matching snapshot (matched: asset_id, seq) before that.
    """
    a = fates.where("status = 'applied'")
    touch = W.partitionBy("asset_id", "side", "price").orderBy(*ORDER)
    a = a.withColumn("next_touch", F.lead("seq").over(touch)).select("asset_id", "session_id", *ORDER, "side", "price", "discriminating", "next_touch")
    marks = books.where("code IS NULL").select("asset_id", "seq", "event_index", F.lit("book").alias("mark"))
    marks = marks.unionByName(matched.select("asset_id", "seq", F.lit(0).alias("event_index"), F.lit("rest").alias("mark")))
    both = a.unionByName(marks.withColumn("change_index", F.lit(-1)), allowMissingColumns=True)
    # what comes first ahead is what came last in the order reversed: a frame that only grows is one pass, while one that
    # shrinks is read anew for each row
    ahead = W.partitionBy("asset_id").orderBy(*map(F.desc, ORDER)).rowsBetween(W.unboundedPreceding, -1)
    first = lambda kind: F.last(F.when(F.col("mark") == kind, F.col("seq")), ignorenulls=True).over(ahead)
    both = both.withColumns({"next_book": first("book"), "validated_at": first("rest")}).where("discriminating IS NOT NULL")
    gone = F.least("next_touch", "next_book")
    won = F.col("validated_at").isNotNull() & (gone.isNull() | (F.col("validated_at") < gone))
    return both.withColumn("superseded_at", gone).select(
        "asset_id", "session_id", *ORDER, "side", "price", "discriminating", "superseded_at", "validated_at",
        F.when(won, "validated").when(gone.isNotNull(), "superseded").otherwise("pending").alias("verdict"),
    )


def candidates(fates: DataFrame, states: DataFrame) -> DataFrame:
    """candidate_id, kind and state of each best price that is claimed for an empty side."""
    rows = fates.where("status = 'applied'").join(states.select("session_id", "asset_id", *ORDER, "version"), ["session_id", "asset_id", *ORDER])
    sides = F.array(
        F.struct(F.lit("best_bid").alias("component"), F.lit("bid_zero_when_empty").alias("kind"), F.col("bid_outcome").alias("o")),
        F.struct(F.lit("best_ask").alias("component"), F.lit("ask_one_when_empty").alias("kind"), F.col("ask_outcome").alias("o")),
    )
    rows = rows.withColumn("s", F.explode(sides)).where("s.o = 'candidate'")
    name = F.concat_ws(":", F.col("seq").cast("string"), F.col("change_index").cast("string"), F.col("s.component"))
    return rows.select(name.alias("candidate_id"), "asset_id", "session_id", "seq", "change_index", "s.component", "s.kind", "version")


def candidate_attempts(found: DataFrame, attempts: DataFrame) -> DataFrame:
    """attempts with outcome: what a targeted read says of its candidate.

    attempts: rest_id, candidate_id, token_id, status_code, code, aligned, malformed, full_match,
    bids_empty, asks_empty, now_session, state_version_before, state_version_after.
    """
    c = F.col
    named = found.select(*(c(x).alias(f"c_{x}") for x in ("candidate_id", "asset_id", "session_id", "version", "component", "kind")))
    rows = attempts.join(named, c("candidate_id") == c("c_candidate_id"), "left")
    same = (c("c_asset_id") == c("token_id")) & (c("c_session_id") == c("now_session")) & (c("c_version") == c("state_version_before")) & (c("c_version") == c("state_version_after"))
    empty = F.when(c("c_component") == "best_ask", c("asks_empty")).otherwise(c("bids_empty"))
    out = (
        F.when(c("c_candidate_id").isNull(), "unknown_candidate")
        .when(c("code") == "rest_non_2xx", "non_2xx")
        .when(c("code") == "rest_invalid_json", "invalid_response")
        .when(c("code").isNotNull(), c("code"))
        .when(~c("aligned"), "unaligned_request_window")
        .when(c("malformed"), "malformed_rest_book")
        .when(~F.coalesce(same, F.lit(False)), "candidate_state_superseded")
        .when(c("full_match") & empty, "CONFIRMED")
        .otherwise("aligned_full_depth_mismatch")
    )
    return rows.withColumn("outcome", out)
