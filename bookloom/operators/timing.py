"""Source and receive time: regressions are counted, rows are never reordered or dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions.exact import decimal_code, exact, nearest_rank
from bookloom.functions.exact import delay_ms as delay
from bookloom.functions.wire import event_tokens, has, text_of
from bookloom.sources.schemas import OPERATIONAL_FAILURES, TIME, TRANSPORT_FAILURES


def timed_events(found: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep, event_type, received_at (timestamp), source_ms, stamp, tokens and code of events that carry a timestamp.

    code: why the source time is no number, or received_timestamp_parse_failure; such events have no delay and no order.
    """
    e = F.col("event")
    stamp = text_of(e, "$.timestamp")
    received = F.try_to_timestamp("received_at")
    rows = found.where("code IS NULL").where(has(e, "$.timestamp"))
    code = F.coalesce(decimal_code(stamp, kind=TIME), F.when(received.isNull(), "received_timestamp_parse_failure"))
    return rows.select(*keep, "event_type", received.alias("received_at"), exact(stamp, TIME).alias("source_ms"), stamp.alias("stamp"), event_tokens(e).alias("tokens"), code.alias("code"))


def source_order(events: DataFrame) -> DataFrame:
    """token, seq, event_index, source_ms with regressed and repeated against the token's event before.

    events: a row per event and token. The state goes on across sessions.
    """
    before = F.lag("source_ms").over(W.partitionBy("token").orderBy("seq", "event_index"))
    return events.select(
        "*",
        F.coalesce(F.col("source_ms") < before, F.lit(False)).alias("regressed"),
        F.coalesce(F.col("source_ms") == before, F.lit(False)).alias("repeated"),
    )


def order_counters(ordered: DataFrame) -> DataFrame:
    return ordered.groupBy("token").agg(F.count("*").alias("events"), F.count_if("regressed").alias("regressions"), F.count_if("repeated").alias("adjacent_equal"))


def delays(events: DataFrame) -> DataFrame:
    """n, minimum, p50, p95, maximum, future of receive time less source time, exact nearest rank."""
    d = events.select(delay(F.col("received_at"), F.col("source_ms")).alias("delay"))
    ranks = nearest_rank(d, "delay", {"minimum": 0.0, "p50": 0.5, "p95": 0.95, "maximum": 1.0})
    return ranks.crossJoin(d.agg(F.count_if(F.col("delay") < 0).alias("future")))  # a row each


def same_time_groups(events: DataFrame) -> DataFrame:
    """token, source_ms, events of groups of two or more."""
    return events.groupBy("token", "source_ms").agg(F.count("*").alias("events")).where("events > 1")


def session_grid(sessions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Every session with every subscribed token; both may be of any size, a session's rows are made where it is."""
    listed = tokens.agg(F.collect_set("token").alias("__bl_tokens"))  # one row: a subscription is one message, its list fits
    return sessions.crossJoin(listed).withColumn("token", F.explode("__bl_tokens")).drop("__bl_tokens")


def first_state_events(state_events: DataFrame, grid: DataFrame) -> DataFrame:
    """Per session and token: the first state event, first book and delta sequences, books and change entries.

    state_events: session_id, token, seq, event_index, change_index, event_type (accepted books; every entry).
    """
    per = state_events.groupBy("session_id", "token").agg(
        F.min_by("event_type", F.struct("seq", "event_index", "change_index")).alias("first_state_event"),
        F.min("seq").alias("first_state_seq"),
        F.min(F.when(F.col("event_type") == "book", F.col("seq"))).alias("first_book_seq"),
        F.min(F.when(F.col("event_type") == "price_change", F.col("seq"))).alias("first_delta_seq"),
        F.count_if(F.col("event_type") == "book").alias("book_events"),
        F.count_if(F.col("event_type") == "price_change").alias("price_change_entries"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = grid.select("session_id", "token").join(per, ["session_id", "token"], "left")
    return joined.select("session_id", "token", "first_state_event", "first_state_seq", "first_book_seq", "first_delta_seq", zero("book_events"), zero("price_change_entries"))


def session_table(control: DataFrame) -> DataFrame:
    """session_id, completed, controlled, error of control events: event, session_id, error, controlled.

    A session is what a start or an end names; its close is controlled if its end says so or a request for it is there.
    """
    e = F.col("event")
    asked = F.bool_or(e == "controlled_disconnect_requested")
    said = F.bool_or(F.when(e == "websocket_session_ended", F.col("controlled")))
    return control.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.bool_or(e == "websocket_session_ended").alias("completed"),
        F.coalesce(said, asked).alias("controlled"),
        F.coalesce(F.max("error"), F.max(F.when(e == "heartbeat_timeout", e))).alias("error"),
    )


def failures(control: DataFrame) -> DataFrame:
    """ingest_sequence, code, session_id, token_id, candidate_id and message of control events that are errors of the run.

    Failed reads (transport) count as requests with status 0 too.
    """
    e = F.col("event")
    rows = control.where(e.isin(*OPERATIONAL_FAILURES, *TRANSPORT_FAILURES))
    return rows.select("ingest_sequence", e.alias("code"), e.isin(*TRANSPORT_FAILURES).alias("transport"), "session_id", "token_id", "candidate_id", F.coalesce("message", "error", "event").alias("message"))
