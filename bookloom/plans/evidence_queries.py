"""Queries over frames of odd shapes, reads, control events and record keeping, with their SQL for DuckDB.

Each view makes one record of every event of the driver's table, so all of them grow with it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions import exact
from bookloom.functions.wire import has, wire_type
from bookloom.operators import frames, ordered, replay, rest, snapshot, timing
from bookloom.sources import evidence
from bookloom.sources import generated as g
from bookloom.sources.schemas import REST_FIELDS

from . import archive_queries
from . import feed_queries as q

_ENTRY = '{"asset_id":"a","price":"0.5","size":"1","side":"BUY","hash":"h"}'
#: What a frame holds, by event number: its payload; codes of its errors; entries of its change frames (-1: no list).
ODD = (
    ("3", ["unexpected_json_shape"], []),
    ('[{"event_type":"book"},7,{"event_type":""},{"event_type":5}]', ["unexpected_event_shape", "missing_event_type", "missing_event_type"], []),
    ('{"event_type":"later","timestamp":"1"}', ["unexpected_event_type"], []),
    ("[]", [], []),
    ('{"event_type"', ["invalid_json"], []),
    ("PONG", [], []),
    ('{"event_type":"price_change","market":"m","timestamp":"5","price_changes":"x"}', ["missing_required_field"], [-1]),
    ('{"event_type":"price_change","timestamp":"x","price_changes":[' + f"{_ENTRY},{_ENTRY}" + "]}", ["missing_required_field"], [2]),
    ('{"event_type":"price_change","market":"m","timestamp":"7","price_changes":[]}', [], [0]),
    ('{"event_type":"price_change","market":"m","timestamp":"NaN","price_changes":[' + _ENTRY + "]}", [], [1]),
    ('[{"event_type":"price_change","market":"m","timestamp":"9","price_changes":[' + _ENTRY + ']},{"event_type":"last_trade_price"}]', [], [1]),
    ('"x"', ["unexpected_json_shape"], []),
)
#: Codes of times, by event number; what isn't named has none to tell.
_TIMES = {2: "ok", 6: "ok", 7: "decimal_parse_failure", 8: "ok", 9: "decimal_not_finite", 10: "ok"}
_EVENTS = (
    "websocket_session_started", "controlled_disconnect_requested", "websocket_session_ended", "heartbeat_sent", "heartbeat_timeout", "rest_timeout",
    "rest_transport_error", "websocket_disconnect", "websocket_connection_error", "targeted_rest_request_rejected", "analysis_error",
)
_BODIES = ('[]', '{', '{"hash":"h","tick_size":"0.1","min_order_size":"5","neg_risk":false,"last_trade_price":"0.5"}', '{"hash":"h"}', '{"tick_size":"0.1","neg_risk":null}')


def _pick(values, number: str):
    """The value at number modulo their count."""
    out = None
    for k, v in enumerate(values):
        test = F.expr(f"{number} % {len(values)} = {k}")
        out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
    return out


def _odd(spark, d):
    rows = g.feed(spark, d).select(F.col("seq").alias("ingest_sequence"), "eid", _pick([p for p, _, _ in ODD], "eid").alias("raw_payload"), F.lit("text").alias("payload_kind"))
    rows = rows.withColumn("received_at", F.when(F.col("eid") % 36 != 10, "2024-01-01T00:00:00.5Z").otherwise("soon"))
    return frames.events(evidence.with_status(rows), ("ingest_sequence", "received_at"))


def _odd_errors(spark, d):
    return frames.event_errors(_odd(spark, d), ("ingest_sequence", "event_index"))


def odd_errors(spark, d):
    return frames.errors(_odd_errors(spark, d))


def odd_error_examples(spark, d):
    some = frames.examples(_odd_errors(spark, d).select("code", "ingest_sequence").distinct(), "code", "ingest_sequence", 20)
    return some.select("code", "ingest_sequence")


def change_frame_sizes(spark, d):
    per = frames.change_frames(_odd(spark, d))
    return per.groupBy(F.coalesce("frame_entries", F.lit(-1)).alias("entries"), F.coalesce("frame_code", F.lit("ok")).alias("code")).agg(F.count("*").alias("frames"))


def frame_excluded_entries(spark, d):
    rows = frames.entries(_odd(spark, d))
    return rows.groupBy("by_frame", F.coalesce("code", F.lit("ok")).alias("code")).agg(F.count("*").alias("entries"))


def timestamp_errors(spark, d):
    timed = timing.timed_events(_odd(spark, d), ("ingest_sequence",))
    return timed.groupBy(F.coalesce("code", F.lit("ok")).alias("code")).agg(F.count("*").alias("events"))


def receive_errors(spark, d):
    return frames.errors(frames.receive_errors(q.received(spark, d)))


def duplicate_ordinals(spark, d):
    rows = g.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.col("doc_id").alias("ingest_sequence"))
    return frames.duplicates(rows).select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"))


def _control(spark, d):
    """A control event for every event of the feed: eleven kinds in turn."""
    e = _pick(_EVENTS, "eid")
    session = F.when(~e.isin("rest_timeout", "rest_transport_error"), F.col("session_id"))
    error = F.when(e.isin("websocket_disconnect", "websocket_connection_error"), F.concat(F.lit("e"), (F.col("eid") % 3).cast("string")))
    controlled = F.when(e == "websocket_session_ended", F.col("eid") % 2 == 0)
    return g.feed(spark, d).select(
        F.col("seq").alias("ingest_sequence"), e.alias("event"), session.alias("session_id"), error.alias("error"), controlled.alias("controlled"), F.col("asset_id").alias("token_id"),
        F.when(F.col("eid") % 4 == 0, F.concat(F.lit("c"), F.col("eid").cast("string"))).alias("candidate_id"), F.lit(None).cast("string").alias("message"),
    )


def failure_events(spark, d):
    found = timing.failures(_control(spark, d))
    return found.groupBy("code", "transport").agg(F.count("*").alias("errors"), F.count("session_id").alias("with_session"), F.count("candidate_id").alias("with_candidate"), F.min("message").alias("first_message"))


def session_results(spark, d):
    return timing.session_table(_control(spark, d))


def _reads(spark, d):
    status = F.expr("CASE eid % 9 WHEN 0 THEN 503 WHEN 2 THEN 302 WHEN 3 THEN 199 ELSE 200 END").cast("int")
    rows = g.feed(spark, d).select(F.col("seq").alias("rest_id"), F.col("asset_id").alias("token_id"), status.alias("status_code"), F.lit("text").alias("payload_kind"), _pick(_BODIES, "eid").alias("raw_response"))
    r = evidence.with_status(rows, "raw_response")
    fields = F.array_compact(F.array(*(F.when(has(F.col("decoded"), f"$.{x}"), F.lit(x)) for x in REST_FIELDS)))
    return rest.outcome(r.withColumns({"is_object": F.coalesce(wire_type(F.col("decoded")) == "object", F.lit(False)), "fields": fields}))


def rest_statuses(spark, d):
    failed = rest.failed_reads(timing.failures(_control(spark, d)))
    return rest.statuses(_reads(spark, d).select("status_code").unionByName(failed.select("status_code"))).select(F.col("status_code").cast("bigint").alias("status_code"), "requests")


def rest_outcomes(spark, d):
    return _reads(spark, d).groupBy(F.coalesce("code", F.lit("usable")).alias("code")).agg(F.count("*").alias("reads"))


def rest_field_presence(spark, d):
    return rest.field_presence(_reads(spark, d))


def targeted_requests(spark, d):
    f, books, _, _ = q.fates(spark, d)
    tokens = g.feed(spark, d).where("user_id % 20 < 15").select(F.col("asset_id").alias("token")).distinct()
    found = rest.targeted_requests(rest.candidates(f, replay.versions(books, f)), tokens)
    return found.groupBy("kind", F.coalesce("code", F.lit("asked")).alias("code")).agg(F.count("*").alias("requests"))


def record_counts(spark, d):
    return frames.record_counts(("websocket", g.feed(spark, d)), ("control", _control(spark, d).where("event <> 'heartbeat_sent'")), ("rest", _reads(spark, d).where("code IS NULL")))


def merged_streams(spark, d):
    f = g.feed(spark, d)
    parts = [f.where(f"eid % 3 = {k}").select((F.col("seq") + k).alias("ingest_sequence"), F.lit(name).alias("record_type"), F.col(column).alias(column)) for k, (name, column) in enumerate((("websocket", "side"), ("rest", "tick"), ("control", "kind")))]
    return frames.merge_streams(*parts)


def sequence_numbers(spark, d):
    rows = g.feed(spark, d).select("eid", ordered.span_of(F.col("eid")).alias("span"))
    return ordered.numbered(rows, ["span"], ["eid"], "ingest_sequence", 1000).select("eid", F.col("ingest_sequence").cast("bigint").alias("ingest_sequence"))


def elapsed_times(spark, d):
    return g.feed(spark, d).select("eid", exact.elapsed_ms(F.col("eid") * 17, F.col("eid") * 1_254).alias("elapsed_ms"))


def canonical_records(spark, d):
    rows = g.feed(spark, d).select("side", "eid", F.when(F.col("eid") % 3 != 0, F.col("kind")).alias("kind"), "asset_id")
    return rows.select("eid", evidence.canonical_json(rows.columns).alias("line"))


def shard_problems(spark, d):
    shards = g.feed(spark, d).where("kind = 'book'").selectExpr("CAST(user_id % 41 AS INT) AS shard", "CASE WHEN user_id % 7 = 0 THEN 'other' ELSE 'x' END AS sample").where("shard % 5 <> 0").distinct()
    return evidence.check_shards(spark, shards, 48, "x")


def regime_rows(spark, d):
    inside = snapshot.in_regime(F.col("ts"), "2024-01-03")
    return g.feed(spark, d).groupBy(inside.alias("in_regime")).agg(F.count("*").alias("events"))


def gap_snapshots(spark, d):
    asked = g.feed(spark, d).select("eid", "asset_id", F.col("ts").alias("at"))
    gaps = g.feed(spark, d).where("kind = 'bad'").where("eid % 4 = 0").select(F.col("ts").alias("received"))
    out = snapshot.gap_checked(snapshot.market_snapshot(asked, archive_queries.quotes(spark, d)), gaps)
    return out.select("eid", "valid")


def stale_events(spark, d):
    return snapshot.stale_sources(q.timed(spark, d), 3_600_000).groupBy("token").agg(F.count("*").alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        odd_errors, odd_error_examples, change_frame_sizes, frame_excluded_entries, timestamp_errors, receive_errors, duplicate_ordinals, failure_events, session_results, rest_statuses, rest_outcomes,
        rest_field_presence, targeted_requests, record_counts, merged_streams, sequence_numbers, elapsed_times, canonical_records, shard_problems, regime_rows, gap_snapshots, stale_events,
    )
}

# ---- SQL -------------------------------------------------------------------------------------------------
_FEED = f"feed AS ({g.FEED}),\nlevels AS ({g.LEVELS})"


def _case(values, number: str = "eid") -> str:
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in xs) + "]"


_ERRS = f"errs AS (SELECT eid, seq, unnest({_case([_list(c) + '::VARCHAR[]' for _, c, _ in ODD])}) AS code FROM feed)"
_SIZES = f"sizes AS (SELECT eid, unnest({_case([_list(n) + '::INT[]' for _, _, n in ODD])}) AS entries FROM feed)"
_NAMES = "ctl AS (SELECT *, " + _case([f"'{e}'" for e in _EVENTS]) + " AS event FROM feed)"
_STATUS = "CASE eid % 9 WHEN 0 THEN 503 WHEN 2 THEN 302 WHEN 3 THEN 199 ELSE 200 END"
_READ = f"""reads AS (SELECT eid, {_STATUS} AS status, eid % 5 AS body, CASE WHEN {_STATUS} <> 200 THEN 'rest_non_2xx' WHEN eid % 5 < 2 THEN 'rest_invalid_json' ELSE 'usable' END AS code FROM feed)"""
_HAS = {"hash": (2, 3), "tick_size": (2, 4), "min_order_size": (2,), "neg_risk": (2, 4), "last_trade_price": (2,)}
_TIMED_ODD = "timed AS (SELECT CASE WHEN eid % 12 IN (7) THEN 'decimal_parse_failure' WHEN eid % 12 = 9 THEN 'decimal_not_finite' WHEN eid % 36 = 10 THEN 'received_timestamp_parse_failure' ELSE 'ok' END AS code FROM feed WHERE eid % 12 IN (" + ", ".join(map(str, _TIMES)) + "))"

SQL = {
    "odd_errors": f"WITH {_FEED}, {_ERRS} SELECT code, count(*) AS errors FROM errs GROUP BY 1",
    "odd_error_examples": f"WITH {_FEED}, {_ERRS} SELECT code, seq AS ingest_sequence FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY seq) AS n FROM (SELECT DISTINCT code, seq FROM errs)) WHERE n <= 20",
    "change_frame_sizes": f"WITH {_FEED}, {_SIZES} SELECT entries, CASE WHEN eid % 12 IN (6, 7) THEN 'missing_required_field' ELSE 'ok' END AS code, count(*) AS frames FROM sizes GROUP BY 1, 2",
    "frame_excluded_entries": f"WITH {_FEED}, {_SIZES} SELECT eid % 12 = 7 AS by_frame, CASE WHEN eid % 12 = 7 THEN 'missing_required_field' ELSE 'ok' END AS code, sum(entries)::BIGINT AS entries FROM sizes WHERE entries > 0 GROUP BY 1, 2",
    "timestamp_errors": f"WITH {_FEED}, {_TIMED_ODD} SELECT code, count(*) AS events FROM timed GROUP BY 1",
    "receive_errors": f"""WITH r AS ({q.SQL['receive_order']}) SELECT 'websocket_ingest_sequence_regression' AS code, sequence_regressions AS errors FROM r WHERE sequence_regressions > 0
UNION ALL SELECT 'websocket_monotonic_receive_regression', monotonic_regressions FROM r WHERE monotonic_regressions > 0""",
    "duplicate_ordinals": "SELECT doc_id, ordinal FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS ordinal FROM documents) WHERE ordinal > 1",
    "failure_events": f"""WITH {_FEED}, {_NAMES} SELECT event AS code, event IN ('rest_timeout', 'rest_transport_error') AS transport, count(*) AS errors,
count(*) FILTER (event NOT IN ('rest_timeout', 'rest_transport_error')) AS with_session, count(*) FILTER (eid % 4 = 0) AS with_candidate,
min(CASE WHEN event IN ('websocket_disconnect', 'websocket_connection_error') THEN 'e' || (eid % 3) ELSE event END) AS first_message
FROM ctl WHERE event IN ('heartbeat_timeout', 'targeted_rest_request_rejected', 'websocket_connection_error', 'websocket_disconnect', 'rest_timeout', 'rest_transport_error') GROUP BY 1, 2""",
    "session_results": f"""WITH {_FEED}, {_NAMES} SELECT session_id, bool_or(event = 'websocket_session_ended') AS completed,
coalesce(bool_or(CASE WHEN event = 'websocket_session_ended' THEN eid % 2 = 0 END), bool_or(event = 'controlled_disconnect_requested')) AS controlled,
coalesce(max(CASE WHEN event IN ('websocket_disconnect', 'websocket_connection_error') THEN 'e' || (eid % 3) END), max(CASE WHEN event = 'heartbeat_timeout' THEN event END)) AS error
FROM ctl WHERE event NOT IN ('rest_timeout', 'rest_transport_error') GROUP BY 1""",
    "rest_statuses": f"""WITH {_FEED}, {_NAMES}, s AS (SELECT {_STATUS} AS c FROM feed UNION ALL SELECT 0 FROM ctl WHERE event IN ('rest_timeout', 'rest_transport_error'))
SELECT c::BIGINT AS status_code, count(*) AS requests FROM s GROUP BY 1""",
    "rest_outcomes": f"WITH {_FEED}, {_READ} SELECT code, count(*) AS reads FROM reads GROUP BY 1",
    "rest_field_presence": f"WITH {_FEED}, {_READ} " + " UNION ALL ".join(f"SELECT '{k}' AS field, count(*) FILTER (body IN ({', '.join(map(str, v))})) AS present, count(*) FILTER (body NOT IN ({', '.join(map(str, v))})) AS missing FROM reads WHERE code = 'usable'" for k, v in _HAS.items()),
    "targeted_requests": f"""WITH {q._FATES}, {q._VERSIONS}, c AS (
  SELECT d.asset_id, k.kind FROM done d JOIN vers v ON v.asset_id = d.asset_id AND v.seq = d.seq
  JOIN (SELECT 'bid_zero_when_empty' AS kind UNION ALL SELECT 'ask_one_when_empty') k ON CASE k.kind WHEN 'bid_zero_when_empty' THEN d.bid_outcome ELSE d.ask_outcome END = 'candidate')
SELECT kind, CASE WHEN asset_id IN (SELECT asset_id FROM feed WHERE user_id % 20 < 15) THEN 'asked' ELSE 'targeted_rest_request_rejected' END AS code, count(*) AS requests FROM c GROUP BY 1, 2""",
    "record_counts": f"WITH {_FEED}, {_NAMES}, {_READ} SELECT 'websocket' AS record_type, count(*) AS records FROM feed UNION ALL SELECT 'control', count(*) FROM ctl WHERE event <> 'heartbeat_sent' UNION ALL SELECT 'rest', count(*) FROM reads WHERE code = 'usable'",
    "merged_streams": f"""WITH {_FEED} SELECT seq + eid % 3 AS ingest_sequence, CASE eid % 3 WHEN 0 THEN 'websocket' WHEN 1 THEN 'rest' ELSE 'control' END AS record_type,
CASE WHEN eid % 3 = 0 THEN side END AS side, CASE WHEN eid % 3 = 1 THEN tick END AS tick, CASE WHEN eid % 3 = 2 THEN kind END AS kind FROM feed""",
    "sequence_numbers": "SELECT event_id AS eid, row_number() OVER (ORDER BY event_id) + 1000 AS ingest_sequence FROM events",
    "elapsed_times": "SELECT event_id AS eid, regexp_replace(regexp_replace((event_id * 1237 // 1000000) || '.' || lpad((event_id * 1237 % 1000000)::VARCHAR, 6, '0'), '0+$', ''), '[.]$', '') AS elapsed_ms FROM events",
    "canonical_records": f"""WITH {_FEED} SELECT eid, '{{"asset_id":"' || asset_id || '","eid":' || eid || ',"kind":' || CASE WHEN eid % 3 <> 0 THEN '"' || kind || '"' ELSE 'null' END || ',"side":"' || side || '"}}' AS line FROM feed""",
    "shard_problems": f"""WITH {_FEED}, s AS (SELECT DISTINCT (user_id % 41)::INT AS shard, CASE WHEN user_id % 7 = 0 THEN 'other' ELSE 'x' END AS sample FROM feed WHERE kind = 'book' AND (user_id % 41) % 5 <> 0)
SELECT i::INT AS shard, 'missing' AS problem FROM range(48) t(i) WHERE i NOT IN (SELECT shard FROM s) UNION ALL SELECT shard, 'duplicate' FROM s GROUP BY shard HAVING count(*) > 1 UNION ALL SELECT shard, 'wrong_sample' FROM s WHERE sample <> 'x'""",
    "regime_rows": f"WITH {_FEED} SELECT ts >= TIMESTAMP '2024-01-03' AS in_regime, count(*) AS events FROM feed GROUP BY 1",
    "gap_snapshots": f"""WITH {_FEED}, q AS (SELECT asset_id, ts, eid % 11 <> 0 AS valid FROM feed WHERE kind = 'change'), gaps AS (SELECT DISTINCT ts FROM feed WHERE kind = 'bad' AND eid % 4 = 0),
s AS (SELECT r.eid, r.ts, q.ts AS seen, coalesce(q.valid, false) AS valid FROM feed r ASOF LEFT JOIN q ON r.asset_id = q.asset_id AND r.ts >= q.ts)
SELECT s.eid, s.valid AND NOT coalesce(g.ts > s.seen, false) AS valid FROM s ASOF LEFT JOIN gaps g ON s.ts >= g.ts""",
    "stale_events": f"""WITH {q._TIMED}, m AS (SELECT token, source_ms, max(source_ms) OVER (PARTITION BY token ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM timed)
SELECT token, count(*) AS events FROM m WHERE top - source_ms > 3600000 GROUP BY 1""",
}
