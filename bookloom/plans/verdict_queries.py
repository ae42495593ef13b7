"""The verdict table of the feed view, with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions.wire import has
from bookloom.operators import frames, replay, rest
from bookloom.sources import generated as g
from bookloom.sources.schemas import BOOK_METADATA
from bookloom.sources.staging import staged

from . import feed_queries as q
from . import verdicts as v


def run_verdicts(spark, d):
    made = q.fates(spark, d)
    f, books, reads, match = q.rest_rows(spark, d, made)
    match = staged(match, "matches")
    # what is asked of the events, so that their payloads are read once
    held = F.col("code").isNull() & (F.col("event_type") == "book")
    found = frames.events(g.feed_frames(spark, d)).select("code", "event_type", *(F.when(held, has(F.col("event"), f"$.{x}")).alias(x) for x in BOOK_METADATA))
    found = staged(found, "found")
    first = q.first_state_events(spark, d)
    sessions = first.select("session_id").distinct().withColumns({"completed": F.lit(True), "controlled": F.lit(True), "error": F.lit(None).cast("string")})
    counters = replay.update_counters(f).withColumn("direct_mismatches", F.col("comparison_mismatch"))
    matched = reads.where("aligned").join(match.where("full_match"), "rest_id").select("asset_id", "seq")
    validated = rest.validations(f, books, matched).groupBy("discriminating", "verdict").agg(F.count("*").alias("updates"))
    named = rest.candidates(f, replay.versions(books, f)).select("kind", F.lit(False).alias("confirmed"))
    presence = found.where(held).select(*BOOK_METADATA)
    fields = rest.field_presence(reads.withColumn("code", F.lit(None).cast("string")).withColumn("fields", F.array(*map(F.lit, ("hash", "tick_size", "min_order_size", "neg_risk", "last_trade_price")))))
    parts = [
        v.schema(frames.event_counts(found), q.ordering_fields(spark, d)), v.reconnect(sessions, first), v.updates(counters, validated, named), v.repeats(q.repeat_counters(spark, d)),
        v.hashes(q.checked(spark, d, made)), v.rest(fields, reads.join(match, "rest_id", "left")), v.metadata(presence, BOOK_METADATA), v.times(q.source_order(spark, d), q.receive_order(spark, d)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {"run_verdicts": run_verdicts}
_S = q.SQL
SQL = {
    "run_verdicts": f"""WITH u AS (SELECT sum(comparisons) AS comparisons, sum(comparison_mismatch) AS wrong, sum(buy_updates) AS buys, sum(sell_updates) AS sells, sum(bid_candidate + ask_candidate) AS cand FROM ({_S['update_counters']})),
w AS (SELECT coalesce(sum(updates) FILTER (verdict = 'validated' AND discriminating = 'zero_delete'), 0) AS z, coalesce(sum(updates) FILTER (verdict = 'validated' AND discriminating = 'nonzero_replacement'), 0) AS n FROM ({_S['update_validations']})),
f AS (SELECT bool_or(first_state_event = 'price_change') AS delta, bool_and(coalesce(first_state_event = 'book', false)) AS book, bool_and(price_change_entries > 0) AS ex, count(DISTINCT session_id) AS n FROM ({_S['first_state_events']})),
r AS (SELECT count(*) FILTER (aligned) AS a, count(*) FILTER (full_match = 'false') AS bad FROM ({_S['rest_alignment']})),
o AS (SELECT sum(regressions) AS reg, min(events) AS least FROM ({_S['source_order']})), rr AS (SELECT * FROM ({_S['receive_order']})), k AS (SELECT * FROM ({_S['repeat_counters']})),
h AS (SELECT count(*) AS n FROM ({_S['orderbook_hash']}))
SELECT 'q1' AS question, CASE WHEN (SELECT count(*) FROM ({_S['event_counts']})) > 0 AND (SELECT count(*) FROM ({_S['ordering_fields']})) > 0 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END AS status
UNION ALL SELECT 'q2', CASE WHEN delta THEN 'CONTRADICTED' WHEN n >= 2 AND book AND ex THEN 'CONFIRMED' ELSE 'UNRESOLVED' END FROM f
UNION ALL SELECT 'q3', CASE WHEN wrong > 0 THEN 'CONTRADICTED' WHEN comparisons > 0 AND n > 0 AND z > 0 AND buys > 0 AND sells > 0 AND cand = 0 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END FROM u, w
UNION ALL SELECT 'q3.nonzero_aggregate_replacement', CASE WHEN n > 0 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END FROM w
UNION ALL SELECT 'q3.zero_size_delete', CASE WHEN z > 0 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END FROM w
UNION ALL SELECT 'q3.buy_bid_sell_ask', CASE WHEN buys > 0 AND sells > 0 AND wrong = 0 THEN 'CONFIRMED' WHEN wrong > 0 THEN 'CONTRADICTED' ELSE 'UNRESOLVED' END FROM u
UNION ALL SELECT 'q3.event_best_prices', CASE WHEN wrong > 0 THEN 'CONTRADICTED' WHEN comparisons > 0 AND cand = 0 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END FROM u
UNION ALL SELECT 'q3.empty_side_boundary_candidates', CASE WHEN cand = 0 THEN 'NOT_OBSERVED' ELSE 'UNRESOLVED' END FROM u
UNION ALL SELECT 'q4', CASE WHEN repeated_key_frames > 0 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END FROM k
UNION ALL SELECT 'q5', CASE WHEN (SELECT bool_and(mismatches = 0 AND attempts > 0) AND count(*) = 2 FROM ({_S['hash_checks']})) THEN 'CONFIRMED' ELSE 'UNRESOLVED' END
UNION ALL SELECT 'q6', CASE WHEN bad > 0 THEN 'UNRESOLVED' WHEN a > 0 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END FROM r
UNION ALL SELECT 'q7', CASE WHEN n > 0 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END FROM h
UNION ALL SELECT 'q8', CASE WHEN reg > 0 OR sequence_regressions > 0 OR monotonic_regressions > 0 THEN 'CONTRADICTED' WHEN least >= 2 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END FROM o, rr""",
}
