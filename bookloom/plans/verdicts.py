"""The eight questions a run answers, each from a small aggregate: CONFIRMED, CONTRADICTED or UNRESOLVED."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YES, NO, OPEN = "CONFIRMED", "CONTRADICTED", "UNRESOLVED"


def _one(df: DataFrame, question: str, status: Column) -> DataFrame:
    return df.agg(status.alias("status")).select(F.lit(question).alias("question"), "status")


def _if(yes: Column, no: Column | None = None) -> Column:
    out = F.when(F.coalesce(no, F.lit(False)), NO) if no is not None else None
    out = out.when(F.coalesce(yes, F.lit(False)), YES) if out is not None else F.when(F.coalesce(yes, F.lit(False)), YES)
    return out.otherwise(OPEN)


def schema(event_counts: DataFrame, ordering: DataFrame) -> DataFrame:
    """Confirmed if there are events and a field that names an order."""
    both = event_counts.agg(F.count("*").alias("e")).crossJoin(ordering.agg(F.count("*").alias("o")))  # a row each
    return _one(both, "q1", F.max(_if((F.col("e") > 0) & (F.col("o") > 0))))


def reconnect(sessions: DataFrame, first: DataFrame) -> DataFrame:
    """Contradicted if a session's token began with a change; confirmed if two or more sessions all completed, the
    first was cleanly controlled, and every token began with a book and saw a change."""
    tokens = first.groupBy("session_id").agg(
        F.bool_or(F.coalesce(F.col("first_state_event") == "price_change", F.lit(False))).alias("delta_first"),
        F.bool_and(F.coalesce(F.col("first_state_event") == "book", F.lit(False))).alias("book_first"),
        F.bool_and(F.col("price_change_entries") > 0).alias("exercised"),
    )
    s = sessions.join(tokens, "session_id", "left")
    clean = F.col("completed") & F.col("controlled") & F.col("error").isNull()
    first_clean = F.min_by(clean.cast("int"), F.col("session_id")) == 1
    every = lambda c: F.bool_and(F.coalesce(F.col(c), F.lit(True)))
    yes = (F.count("*") >= 2) & F.bool_and("completed") & first_clean & every("book_first") & every("exercised")
    return _one(s, "q2", _if(yes, F.bool_or(F.coalesce("delta_first", F.lit(False)))))


def updates(counters: DataFrame, validated: DataFrame, candidates: DataFrame) -> DataFrame:
    """q3 and its five parts. counters: one row of update_counters() and direct_mismatches; validated: discriminating,
    verdict, updates; candidates: kind, confirmed, a row per candidate."""
    v = validated.agg(*(F.coalesce(F.sum(F.when((F.col("verdict") == "validated") & (F.col("discriminating") == k), F.col("updates"))), F.lit(0)).alias(f"v_{k}") for k in ("nonzero_replacement", "zero_delete")))
    c = candidates.agg(F.count("*").alias("candidates"), F.count_if(~F.col("confirmed")).alias("open"))
    row = counters.crossJoin(v).crossJoin(c)  # a row each
    n = F.col
    sides = (n("buy_updates") > 0) & (n("sell_updates") > 0)
    calm, seen = n("comparison_mismatch") == 0, n("comparisons") > 0
    met = (n("candidates") == 0) | (n("open") == 0)
    direct = n("direct_mismatches") > 0
    parts = {
        "q3": _if(seen & calm & (n("v_nonzero_replacement") > 0) & (n("v_zero_delete") > 0) & sides & met, direct),
        "q3.nonzero_aggregate_replacement": _if(n("v_nonzero_replacement") > 0),
        "q3.zero_size_delete": _if(n("v_zero_delete") > 0),
        "q3.buy_bid_sell_ask": F.when(sides & calm, YES).when(direct, NO).otherwise(OPEN),
        "q3.event_best_prices": _if(seen & calm & met, direct),
        "q3.empty_side_boundary_candidates": F.when(n("candidates") == 0, "NOT_OBSERVED").otherwise(_if(n("open") == 0)),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("question"), s.alias("status")) for k, s in parts.items())))
    return row.select(rows.alias("r")).select("r.question", "r.status")


def repeats(counters: DataFrame) -> DataFrame:
    return _one(counters, "q4", F.max(_if(F.col("repeated_key_frames") > 0)))


def hashes(checked: DataFrame) -> DataFrame:
    """Confirmed if books and changes were tried and all of both match; checked: shape (book, change, rest), observed,
    computed (null: skipped). Reads are a diagnostic only."""
    return hash_status(checked).select(F.lit("q5").alias("question"), "status")


def hash_status(checked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The answer of hashes(), by columns of checked."""
    tried = F.col("computed").isNotNull()
    good = F.coalesce(F.col("observed") == F.col("computed"), F.lit(False))
    of = lambda s, c: F.count_if(c & (F.col("shape") == s))
    whole = [(of(s, tried) > 0) & (of(s, tried & ~good) == 0) for s in ("book", "change")]
    return checked.groupBy(*by).agg(_if(whole[0] & whole[1]).alias("status"))


def rest(presence: DataFrame, depth: DataFrame) -> DataFrame:
    """presence: field, present, missing; depth: aligned, full_match of each usable response."""
    p = presence.agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))
    a = depth.agg(F.count_if("aligned").alias("aligned"), F.count_if(F.col("aligned") & ~F.coalesce("full_match", F.lit(False))).alias("wrong"))
    status = F.when(F.col("missing") > 0, NO).when(F.col("wrong") > 0, OPEN).when(F.col("aligned") > 0, YES).otherwise(OPEN)
    return _one(p.crossJoin(a), "q6", F.max(status))  # a row each


def metadata(presence: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """presence: a boolean column for each optional field, a row per book event."""
    seen = F.count("*") > 0
    for x in names:
        seen = seen & (F.count_if(x) > 0)
    return _one(presence, "q7", _if(seen))


def times(order: DataFrame, receive: DataFrame) -> DataFrame:
    """order: token, events, regressions; receive: one row of regression counts."""
    o = order.agg(F.coalesce(F.sum("regressions"), F.lit(0)).alias("r"), F.coalesce(F.min("events"), F.lit(0)).alias("least"))
    row = o.crossJoin(receive)  # a row each
    back = (F.col("r") > 0) | (F.col("sequence_regressions") > 0) | (F.col("monotonic_regressions") > 0)
    return _one(row, "q8", F.max(_if(F.col("least") >= 2, back)))
