"""Queries over frames, entries and replayed books, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.functions import bookhash, exact, wire
from bookloom.operators import frames, ordered, replay, repeats, rest, timing
from bookloom.sources import generated as g
from bookloom.sources.schemas import DECIMAL
from bookloom.sources.staging import staged

from . import verdicts

def fates(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """fates, books, numbered events and level events of the feed with claims."""
    books, _, levels = g.feed_parts(spark, d)
    events = staged(replay.number_events(books, g.claimed_entries(spark, d)), "numbered")
    changed = staged(replay.level_events(events, levels), "levels")
    return staged(replay.judge(events, changed), "fates"), books, events, changed


def _cents(c: str):
    """-1 where there is none."""
    return F.coalesce((F.col(c) * 100).cast("bigint"), F.lit(-1)).alias(c)


def frame_status(spark, d):
    return g.feed_frames(spark, d).groupBy("parse_status").agg(F.count("*").alias("frames"))


def duplicate_frames(spark, d):
    digests = g.table(spark, d, "documents").select(F.sha2("text", 256).alias("digest"))
    return frames.duplicate_count(digests)


def payload_digests(spark, d):
    t = g.table(spark, d, "documents")
    return t.select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"), F.length(wire.base64_text(F.col("text"))).cast("bigint").alias("base64_chars"))


def received(spark, d):
    """The feed's frames with what regressed, in processing order."""
    rows = g.feed(spark, d).selectExpr("eid", "eid - CASE WHEN eid % 97 = 0 THEN 5 ELSE 0 END AS ingest_sequence", "CASE WHEN eid % 7 <> 0 THEN eid * 1000 - CASE WHEN eid % 89 = 0 THEN 5000 ELSE 0 END END AS received_monotonic_ns")
    return frames.receive_order(rows.withColumn("span", ordered.span_of(F.col("eid"))), ["eid"], ["span"])


def receive_order(spark, d):
    return received(spark, d).agg(F.count_if("sequence_regressed").alias("sequence_regressions"), F.count_if("monotonic_regressed").alias("monotonic_regressions"))


def event_counts(spark, d):
    return frames.event_counts(frames.events(g.feed_frames(spark, d)))


def event_errors(spark, d):
    return frames.errors(frames.events(g.feed_frames(spark, d)))


_INVENTORY_JSON = "concat('{\"event_type\":\"', event_type, '\",\"props\":', props, ',\"tags\":[{\"id\":', CAST(user_id AS STRING), '},null,\"x\"],\"live\":true,\"value\":', CAST(CAST(value AS BIGINT) AS STRING), ',\"deep\":{\"a\":[{\"sequence_id\":', CAST(event_id AS STRING), '}]}}')"


def _inventory_paths(spark, d):
    e = g.table(spark, d, "events").selectExpr("event_id", "event_type", f"parse_json({_INVENTORY_JSON}) AS event")
    return wire.field_paths(e, "event_id")


def field_inventory(spark, d):
    return frames.inventory(_inventory_paths(spark, d), "event_id")


def ordering_fields(spark, d):
    return frames.ordering_fields(_inventory_paths(spark, d), "event_id")


def event_tokens(spark, d):
    found = frames.events(g.feed_frames(spark, d)).where("code IS NULL")
    return found.select(F.explode(wire.event_tokens(F.col("event"))).alias("token")).groupBy("token").agg(F.count("*").alias("events"))


def frame_metadata(spark, d):
    f = frames.metadata(g.feed_frames(spark, d).where("parse_status = 'ok'"))
    return f.groupBy(F.array_join("event_types", ",").alias("event_types"), F.array_join("asset_ids", ",").alias("asset_ids")).agg(F.count("*").alias("frames"), F.count("source_timestamp").alias("with_time"))


_NUMBERS = "CASE eid % 9 WHEN 0 THEN concat('0.', CAST(tick AS STRING), '0') WHEN 1 THEN '1e-3' WHEN 2 THEN 'abc' WHEN 3 THEN 'NaN' WHEN 4 THEN '1_000' WHEN 5 THEN '.5' WHEN 6 THEN '0.1000000000000000000000001' WHEN 7 THEN '' ELSE concat('-', CAST(eid AS STRING), '.250') END"


def exact_numbers(spark, d):
    rows = g.feed(spark, d).selectExpr("eid", f"{_NUMBERS} AS t")
    t = F.col("t")
    return rows.select("eid", exact.decimal_code(t).alias("code"), exact.plain_text(exact.exact(t)).alias("number"))


def level_checks(spark, d):
    rows = g.feed(spark, d).where("kind = 'book'").selectExpr(
        "seq", "concat('{\"event_type\":\"book\",\"bids\":[', CASE eid % 7 WHEN 0 THEN '{\"price\":\"1.5\",\"size\":\"1\"}' WHEN 1 THEN '{\"price\":\"0.5\",\"size\":\"-1\"}' WHEN 2 THEN '{\"price\":0.5,\"size\":\"1\"}' WHEN 3 THEN '7' WHEN 4 THEN '{\"price\":\"0.5\"}' ELSE '{\"price\":\"0.50\",\"size\":\"1\"}' END, ',{\"price\":\"0.5\",\"size\":\"2\"}],\"asks\":[]}') AS raw_payload", "'text' AS payload_kind")
    found = frames.level_rows(frames.events(g.with_status(rows), ("seq",)), ("seq",))
    return found.groupBy(F.coalesce("level_code", F.lit("accepted")).alias("level_code")).agg(F.count("*").alias("levels"))


def best_prices(spark, d):
    books, entries, levels = g.feed_parts(spark, d)
    n = staged(replay.number_events(books, entries), "numbered")
    points = n.where("NOT is_book AND epoch > 0 AND code IS NULL AND parse_code IS NULL")
    best = replay.best_prices(points, replay.level_events(n, levels))
    return points.select(*replay.KEY, "n", "seq").join(best, [*replay.KEY, "n"]).select("seq", "asset_id", _cents("derived_bid"), _cents("derived_ask"))


def replay_entries(spark, d):
    f = fates(spark, d)[0]
    return f.select("seq", "asset_id", "status", "reason", "bid_outcome", "ask_outcome", "comparison", F.col("idempotent").cast("string").alias("idempotent"), "discriminating", _cents("derived_bid"), _cents("derived_ask"))


def update_counters(spark, d):
    return replay.update_counters(fates(spark, d)[0], ("session_id",))


def state_versions(spark, d):
    f, books, _, _ = fates(spark, d)
    return replay.versions(books, f).groupBy("asset_id").agg(F.max("version").cast("bigint").alias("version"), F.max("seq").alias("last_seq"))


def orderbook_hash(spark, d):
    found = frames.events(g.feed_frames(spark, d)).where("code IS NULL AND event_type = 'book'")
    return found.select(F.col("ingest_sequence").alias("seq"), bookhash.event_hash(F.col("event")).alias("hash"))


def _change_hashes(spark, d, made=None):
    f, _, events, changed = made or fates(spark, d)
    found = g.feed_tables(spark, d)[3]
    return replay.change_hashes(replay.hash_points(found, f), changed, replay.hash_books(found, events))


def change_hashes(spark, d):
    return _change_hashes(spark, d).select("seq", "asset_id", F.col("computed").alias("hash"))


def checked(spark, d, made=None):
    """Digests of books and changes against observed ones; one in 7,919 is another. made: as of fates()."""
    books = g.feed_tables(spark, d)[3].where("code IS NULL AND event_type = 'book'").join(g.feed_parts(spark, d)[0].where("code IS NULL").select("session_id", "seq", "event_index"), ["session_id", "seq", "event_index"])
    both = books.select("session_id", "seq", F.lit("book").alias("shape"), bookhash.event_hash(F.col("event")).alias("computed"))
    both = both.unionByName(_change_hashes(spark, d, made).select("session_id", "seq", F.lit("change").alias("shape"), "computed"))
    return both.withColumn("observed", F.when(F.col("seq") / 10 % 7919 != 0, F.col("computed")).otherwise("h"))


def hash_checks(spark, d):
    return replay.hash_counters(checked(spark, d))


def hash_verdicts(spark, d):
    return verdicts.hash_status(checked(spark, d), ("session_id",))


def entry_histogram(spark, d):
    per = g.frame_entries(spark, d).groupBy("frame").agg(F.count("*").alias("frame_entries"))
    return repeats.entries_histogram(per)


def frame_repeats(spark, d):
    return repeats.frame_repeats(g.frame_entries(spark, d))


def repeat_counters(spark, d):
    return repeats.repeat_counters(frame_repeats(spark, d))


def timed(spark, d):
    source = F.unix_millis("ts") - F.when(F.col("eid") % 29 == 0, 7_200_000).otherwise(0)
    received = F.expr("timestampadd(MILLISECOND, CAST(eid % 1000 - 50 AS INT), ts)")
    return g.feed(spark, d).select(F.col("asset_id").alias("token"), "seq", F.lit(0).alias("event_index"), (F.floor(source / 60_000) * 60_000).alias("source_ms"), received.alias("received_at"), F.unix_millis("ts").alias("exact_ms"))


def source_order(spark, d):
    return timing.order_counters(timing.source_order(timed(spark, d)))


def delays(spark, d):
    rows = timed(spark, d).select("received_at", F.col("exact_ms").cast("decimal(20,0)").alias("source_ms"))
    out = timing.delays(rows)
    return out.select("n", *(F.col(c).cast("double").alias(c) for c in ("minimum", "p50", "p95", "maximum")), "future")


def same_time_groups(spark, d):
    return timing.same_time_groups(timed(spark, d))


def first_state_events(spark, d):
    books, entries, _ = g.feed_parts(spark, d)
    rows = books.where("code IS NULL").select("session_id", F.col("asset_id").alias("token"), "seq", "event_index", F.lit(-1).alias("change_index"), F.lit("book").alias("event_type"))
    rows = rows.unionByName(entries.where("asset_id IS NOT NULL").select("session_id", F.col("asset_id").alias("token"), "seq", "event_index", "change_index", F.lit("price_change").alias("event_type")))
    grid = timing.session_grid(rows.select("session_id").distinct(), rows.select("token").distinct())
    return timing.first_state_events(rows, grid).fillna(-1)


def rest_rows(spark, d, made=None):
    """Snapshots of the feed's state after every 13th event, some with another depth or an unstable window."""
    f, books, numbered, changed = made or fates(spark, d)
    reads = g.feed(spark, d).where("eid % 13 = 0").select("eid", "session_id", "asset_id", (F.col("seq") + 5).alias("seq"))
    state = numbered.select("session_id", "asset_id", "seq", "epoch", "n")
    reads = rest.as_of(reads, state, ["session_id", "asset_id"], "seq", ["epoch", "n"])
    versions = replay.versions(books, f).select("asset_id", "seq", "version")
    reads = rest.as_of(reads, versions, ["asset_id"], "seq", ["version"])
    bad = f.groupBy(*replay.KEY).agg(F.min("first_bad").alias("first_bad"))
    reads = reads.join(bad, replay.KEY, "left")
    valid = F.coalesce((F.col("epoch") > 0) & (F.col("first_bad").isNull() | (F.col("first_bad") > F.col("n"))), F.lit(False))
    reads = reads.withColumn("valid", valid)
    window = {"now_valid": F.col("valid"), "state_valid_before": F.col("valid"), "state_valid_after": F.col("valid"), "now_session": F.col("session_id"), "state_session_before": F.col("session_id"), "state_session_after": F.col("session_id"), "now_version": F.col("version"), "state_version_after": F.col("version"), "state_version_before": F.col("version") - F.when(F.col("eid") % 5 == 0, 1).otherwise(0)}
    reads = staged(rest.align(reads.withColumns(window)).withColumn("rest_id", F.col("eid")), "reads")
    live = reads.where("epoch > 0")
    own = replay.alive_at(live.select("rest_id", *replay.KEY, "n"), changed, ["rest_id"])
    extra = live.where("eid % 3 = 0").select("rest_id", F.lit("BUY").alias("side"), F.lit("0.95").cast(DECIMAL).alias("price"), F.lit(1).cast(DECIMAL).alias("size"))
    return f, books, reads, rest.depth_matches(live, own.unionByName(extra), changed)


def rest_alignment(spark, d):
    _, _, reads, match = rest_rows(spark, d)
    return reads.join(match, "rest_id", "left").select("rest_id", "aligned", F.when(F.col("aligned"), F.col("full_match")).cast("string").alias("full_match"))


def update_validations(spark, d):
    f, books, reads, match = rest_rows(spark, d)
    matched = reads.where("aligned").join(match.where("full_match"), "rest_id").select("asset_id", "seq")
    return rest.validations(f, books, matched).groupBy("discriminating", "verdict").agg(F.count("*").alias("updates"))


def empty_side_candidates(spark, d):
    f, books, reads, match = rest_rows(spark, d)
    found = rest.candidates(f, replay.versions(books, f))
    attempts = reads.join(match, "rest_id", "left").select(
        "rest_id", F.col("asset_id").alias("token_id"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("code"), "aligned", F.lit(False).alias("malformed"),
        F.coalesce("full_match", F.lit(False)).alias("full_match"), F.lit(True).alias("bids_empty"), F.lit(True).alias("asks_empty"), "now_session", "state_version_before", "state_version_after", F.col("seq").alias("read_seq"),
    )
    # each candidate is read by the first snapshot of its asset and session after it
    first = found.select("candidate_id", F.col("asset_id").alias("token_id"), F.col("session_id").alias("now_session"), "seq").join(attempts, ["token_id", "now_session"]).where("read_seq > seq")
    first = first.groupBy("candidate_id").agg(F.min("rest_id").alias("rest_id"))
    return rest.candidate_attempts(found, attempts.join(first, "rest_id")).groupBy("c_kind", "outcome").agg(F.count("*").alias("attempts")).withColumnRenamed("c_kind", "kind")


QUERIES = {
    f.__name__: f
    for f in (
        frame_status, duplicate_frames, payload_digests, receive_order, event_counts, event_errors, field_inventory, ordering_fields, event_tokens, frame_metadata,
        exact_numbers, level_checks, best_prices, replay_entries, update_counters, state_versions, orderbook_hash, change_hashes, hash_checks, hash_verdicts, entry_histogram, frame_repeats, repeat_counters,
        source_order, delays, same_time_groups, first_state_events, rest_alignment, update_validations, empty_side_candidates,
    )
}

# ---- SQL -------------------------------------------------------------------------------------------------
_FEED = f"feed AS ({g.FEED}),\nlevels AS ({g.LEVELS})"
_SHOWN = "shown AS (SELECT *, CASE WHEN eid % 50 = 0 THEN 'expected_heartbeat' WHEN eid % 51 = 0 THEN 'invalid_utf8' WHEN kind = 'bad' AND eid % 4 = 0 THEN 'invalid_json' ELSE 'ok' END AS parse_status FROM feed)"
_BOOK_KIND = "(kind = 'book' OR (kind = 'bad' AND eid % 4 = 3))"

#: Naive: every earlier level event of the epoch, the last one per price, then extremes; first bad entry by epoch.
_FATES = f"""{_FEED},
books AS (SELECT session_id, asset_id, seq AS bseq FROM feed WHERE kind = 'book'),
ent AS (
  SELECT f.*, b.bseq, CASE WHEN kind = 'bad' AND eid % 4 = 2 THEN 'missing_required_field' END AS code,
         CASE WHEN kind = 'bad' AND eid % 4 = 1 THEN 'decimal_parse_failure' END AS parse_code
  FROM (SELECT * FROM feed WHERE kind = 'change' OR (kind = 'bad' AND eid % 4 IN (1, 2))) f
  ASOF LEFT JOIN books b ON f.session_id = b.session_id AND f.asset_id = b.asset_id AND f.seq >= b.bseq),
sets AS (
  SELECT session_id, asset_id, seq AS bseq, seq AS at, side, tick, size, true AS snap FROM levels
  UNION ALL SELECT session_id, asset_id, bseq, seq, side, tick, size, false FROM ent WHERE bseq IS NOT NULL AND code IS NULL AND parse_code IS NULL),
alive AS (
  SELECT e.seq, s.side, s.tick, arg_max(s.size, s.at) AS size FROM ent e JOIN sets s ON e.session_id = s.session_id AND e.asset_id = s.asset_id AND e.bseq = s.bseq AND s.at <= e.seq
  WHERE e.code IS NULL AND e.parse_code IS NULL GROUP BY e.seq, s.side, s.tick),
best AS (
  SELECT seq, max(tick) FILTER (side = 'BUY' AND size > 0) * 10 AS derived_bid, min(tick) FILTER (side = 'SELL' AND size > 0) * 10 AS derived_ask FROM alive GROUP BY seq),
olds AS (
  SELECT e.seq, arg_max(s.size, s.at) AS old_size, arg_max(s.snap, s.at) AS old_snap FROM ent e
  JOIN sets s ON e.session_id = s.session_id AND e.asset_id = s.asset_id AND e.bseq = s.bseq AND s.side = e.side AND s.tick = e.tick AND s.at < e.seq GROUP BY e.seq),
claimed AS (
  SELECT e.*, derived_bid, derived_ask, old_size, coalesce(old_snap OR old_size > 0, false) AS old_exists,
         CASE WHEN eid % 37 = 0 THEN 99 ELSE coalesce(derived_bid, CASE WHEN eid % 2 = 0 THEN 0 END) END AS claim_bid,
         coalesce(derived_ask, CASE WHEN eid % 2 = 0 THEN 100 END) AS claim_ask
  FROM ent e LEFT JOIN best USING (seq) LEFT JOIN olds USING (seq)),
judged AS (
  SELECT *, CASE WHEN eid % 43 = 0 THEN NULL WHEN claim_bid IS NOT DISTINCT FROM derived_bid THEN 'match' WHEN derived_bid IS NULL AND claim_bid = 0 THEN 'candidate' ELSE 'mismatch' END AS bid_o,
         CASE WHEN eid % 43 = 0 THEN NULL WHEN eid % 41 = 0 THEN 'unparseable' WHEN claim_ask IS NOT DISTINCT FROM derived_ask THEN 'match' WHEN derived_ask IS NULL AND claim_ask = 100 THEN 'candidate' ELSE 'mismatch' END AS ask_o
  FROM claimed),
compared AS (
  SELECT *, CASE WHEN 'unparseable' IN (bid_o, ask_o) THEN 'unparseable' WHEN bid_o = 'mismatch' OR ask_o = 'mismatch' THEN 'mismatch' WHEN bid_o = 'candidate' OR ask_o = 'candidate' THEN 'candidate' WHEN bid_o = 'match' OR ask_o = 'match' THEN 'match' END AS cmp FROM judged),
cut AS (
  SELECT *, min(CASE WHEN code IS NULL AND (parse_code IS NOT NULL OR cmp IN ('mismatch', 'unparseable')) THEN seq END) OVER (PARTITION BY session_id, asset_id, bseq) AS first_bad FROM compared),
fates AS (
  SELECT *, CASE WHEN code IS NOT NULL THEN code WHEN bseq IS NULL OR seq > first_bad THEN 'price_change_without_valid_book' ELSE parse_code END AS reason FROM cut),
done AS (
  SELECT eid, seq, session_id, asset_id, bseq, side, tick, size, first_bad, reason, CASE WHEN reason IS NULL THEN 'applied' ELSE 'excluded' END AS status,
         CASE WHEN reason IS NULL THEN bid_o END AS bid_outcome, CASE WHEN reason IS NULL THEN ask_o END AS ask_outcome, CASE WHEN reason IS NULL THEN cmp END AS comparison,
         CASE WHEN reason IS NULL THEN CASE WHEN size = 0 THEN NOT old_exists ELSE old_exists AND old_size = size END END AS idempotent,
         CASE WHEN reason IS NULL THEN CASE WHEN size = 0 AND old_exists AND old_size > 0 THEN 'zero_delete' WHEN size <> 0 AND old_exists AND old_size <> size THEN 'nonzero_replacement' END END AS discriminating,
         CASE WHEN reason IS NULL THEN derived_bid END AS derived_bid, CASE WHEN reason IS NULL THEN derived_ask END AS derived_ask FROM fates)"""
_VERSIONS = """vers AS (SELECT asset_id, seq, session_id, row_number() OVER (PARTITION BY asset_id ORDER BY seq) AS version FROM
  (SELECT asset_id, bseq AS seq, session_id FROM books UNION ALL SELECT asset_id, seq, session_id FROM done WHERE status = 'applied'))"""
_LEVEL = "'{\"price\":\"0.' || tick || '\",\"size\":\"' || size || '\"}'"
_HASHED = f"""{_FATES}, shown_levels AS (
  SELECT seq, coalesce(string_agg({_LEVEL}, ',' ORDER BY tick DESC) FILTER (side = 'BUY' AND size > 0), '') AS bids, coalesce(string_agg({_LEVEL}, ',' ORDER BY tick) FILTER (side = 'SELL' AND size > 0), '') AS asks FROM alive GROUP BY seq),
hashed AS (
  SELECT d.seq, d.session_id, d.asset_id, sha1('{{"market":"m","asset_id":"' || d.asset_id || '","timestamp":"' || (epoch_us(f.ts) // 1000) || '","hash":"","bids":[' || l.bids || '],"asks":[' || l.asks || '],"min_order_size":"5","tick_size":"0.1","neg_risk":false,"last_trade_price":"0.' || b.tick || '"}}') AS hash
  FROM done d JOIN feed f ON f.seq = d.seq JOIN feed b ON b.seq = d.bseq JOIN shown_levels l ON l.seq = d.seq WHERE d.status = 'applied'),
checked AS (
  SELECT session_id, seq, 'change' AS shape FROM hashed UNION ALL SELECT session_id, seq, 'book' FROM feed WHERE kind = 'book'),
marked AS (SELECT *, (seq // 10) % 7919 <> 0 AS good FROM checked)"""
_READS = f"""{_FATES}, {_VERSIONS},
reads AS (SELECT eid, session_id, asset_id, seq + 5 AS seq FROM feed WHERE eid % 13 = 0),
seen AS (
  SELECT r.*, b.bseq, v.version FROM (SELECT * FROM reads) r
  ASOF LEFT JOIN books b ON r.session_id = b.session_id AND r.asset_id = b.asset_id AND r.seq >= b.bseq
  ASOF LEFT JOIN vers v ON r.asset_id = v.asset_id AND r.seq >= v.seq),
bads AS (SELECT session_id, asset_id, bseq, min(first_bad) AS first_bad FROM fates WHERE bseq IS NOT NULL GROUP BY ALL),
rests AS (
  SELECT s.eid AS rest_id, s.session_id, s.asset_id, s.seq, s.version, s.bseq IS NOT NULL AND (b.first_bad IS NULL OR b.first_bad > s.seq) AND s.eid % 5 <> 0 AS aligned, s.eid % 3 <> 0 AS full_match
  FROM seen s LEFT JOIN bads b ON s.session_id = b.session_id AND s.asset_id = b.asset_id AND s.bseq = b.bseq)"""

_TIMED = f"{_FEED}, timed AS (SELECT asset_id AS token, seq, CAST(floor((epoch_us(ts) // 1000 - CASE WHEN eid % 29 = 0 THEN 7200000 ELSE 0 END) / 60000.0) * 60000 AS BIGINT) AS source_ms, epoch_us(ts) % 1000 / 1000.0 + (eid % 1000 - 50) AS delay FROM feed)"
_COMPONENTS = ", ".join(
    f"count(*) FILTER ({s}_outcome IN ('match', 'candidate', 'mismatch')) AS {s}_total, " + ", ".join(f"count(*) FILTER ({s}_outcome = '{k}') AS {s}_{k}" for k in ("match", "candidate", "mismatch")) for s in ("bid", "ask")
)
_HASH_LEVELS = {
    side: " || ',' || ".join(f"'{{\"price\":\"0.' || (tick + {o} + 3 * {d}) % 10 || '\",\"size\":\"' || (size + {m} * {d}) % 5 || '\"}}'" for d in range(3)) for side, o, m in (("bids", 0, 1), ("asks", 1, 2))
}
_REPEATS = f"""frames AS ({g.FRAMES}),
k AS (SELECT frame, asset_id, side, price_key, count(*) AS n, arg_min(size_key, change_index) AS a, arg_max(size_key, change_index) AS b FROM frames GROUP BY ALL),
per AS (SELECT frame, sum(n)::BIGINT AS frame_entries, count(*) FILTER (n > 1) AS repeated_keys, coalesce(bool_or(n > 1 AND a <> b), false) AS order_sensitive FROM k GROUP BY frame),
asset AS (SELECT frame, max(n) > 1 AS same_asset FROM (SELECT frame, asset_id, count(*) AS n FROM frames GROUP BY ALL) GROUP BY frame)"""

_PATHS = f"""p AS (SELECT event_id, event_type, unnest(t) AS t FROM (SELECT event_id, event_type, (SELECT list(j) FROM json_tree({_INVENTORY_JSON.replace('AS STRING', 'AS VARCHAR')}) j) AS t FROM events)),
n AS (SELECT event_id, event_type, regexp_replace(substr(t.fullkey, 3), '\\[[0-9]+\\]', '[]', 'g') AS path,
      CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS wire_type FROM p WHERE t.fullkey <> '$')"""

SQL = {
    "frame_status": f"WITH {_FEED}, {_SHOWN} SELECT parse_status, count(*) AS frames FROM shown GROUP BY 1",
    "duplicate_frames": "SELECT (count(*) - count(DISTINCT text))::BIGINT AS duplicate_frames FROM documents",
    "payload_digests": "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, length(base64(encode(text)))::BIGINT AS base64_chars FROM documents",
    "receive_order": """WITH r AS (SELECT event_id AS eid, event_id - CASE WHEN event_id % 97 = 0 THEN 5 ELSE 0 END AS s, CASE WHEN event_id % 7 <> 0 THEN event_id * 1000 - CASE WHEN event_id % 89 = 0 THEN 5000 ELSE 0 END END AS m FROM events),
w AS (SELECT s <= lag(s) OVER (ORDER BY eid) AS sr, m < last_value(m IGNORE NULLS) OVER (ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mr FROM r)
SELECT count(*) FILTER (sr) AS sequence_regressions, count(*) FILTER (mr) AS monotonic_regressions FROM w""",
    "event_counts": f"WITH {_FEED}, {_SHOWN} SELECT CASE WHEN {_BOOK_KIND} THEN 'book' ELSE 'price_change' END AS event_type, count(*) AS events FROM shown WHERE parse_status = 'ok' GROUP BY 1",
    "event_errors": f"WITH {_FEED}, {_SHOWN} SELECT parse_status AS code, count(*) AS errors FROM shown WHERE parse_status IN ('invalid_utf8', 'invalid_json') GROUP BY 1",
    "field_inventory": f"""WITH {_PATHS}
SELECT event_type, path, wire_type, count(DISTINCT event_id) AS presence, count(*) AS occurrences FROM n GROUP BY 1, 2, 3""",
    "ordering_fields": f"""WITH {_PATHS} SELECT path, count(DISTINCT event_id) AS events FROM n WHERE contains(lower(regexp_extract(path, '[^.]*$')), 'sequence') OR lower(regexp_extract(path, '[^.]*$')) IN ('offset', 'seq', 'seq_id', 'seqid', 'update_id', 'updateid') GROUP BY 1""",
    "event_tokens": f"WITH {_FEED}, {_SHOWN} SELECT asset_id AS token, count(*) AS events FROM shown WHERE parse_status = 'ok' GROUP BY 1",
    "frame_metadata": f"WITH {_FEED}, {_SHOWN} SELECT CASE WHEN {_BOOK_KIND} THEN 'book' ELSE 'price_change' END AS event_types, asset_id AS asset_ids, count(*) AS frames, count(*) AS with_time FROM shown WHERE parse_status = 'ok' GROUP BY 1, 2",
    "exact_numbers": f"""WITH {_FEED} SELECT eid, CASE eid % 9 WHEN 2 THEN 'decimal_parse_failure' WHEN 3 THEN 'decimal_not_finite' WHEN 4 THEN 'decimal_parse_failure' WHEN 7 THEN 'decimal_parse_failure' END AS code,
CASE eid % 9 WHEN 0 THEN CASE WHEN tick = 0 THEN '0' ELSE '0.' || tick END WHEN 1 THEN '0.001' WHEN 5 THEN '0.5' WHEN 6 THEN '0.1000000000000000000000001' WHEN 8 THEN '-' || eid || '.25' END AS number FROM feed""",
    "level_checks": f"""WITH {_FEED}, r AS (SELECT unnest(CASE eid % 7 WHEN 0 THEN ['price_out_of_bounds', 'accepted'] WHEN 1 THEN ['negative_size', 'duplicate_snapshot_level'] WHEN 2 THEN ['decimal_not_string', 'duplicate_snapshot_level']
  WHEN 3 THEN ['malformed_level', 'accepted'] WHEN 4 THEN ['missing_required_field', 'duplicate_snapshot_level'] ELSE ['accepted', 'duplicate_snapshot_level'] END) AS level_code FROM feed WHERE kind = 'book')
SELECT level_code, count(*) AS levels FROM r GROUP BY 1""",
    "best_prices": f"WITH {_FATES} SELECT e.seq, e.asset_id, coalesce(b.derived_bid, -1)::BIGINT AS derived_bid, coalesce(b.derived_ask, -1)::BIGINT AS derived_ask FROM ent e LEFT JOIN best b USING (seq) WHERE e.bseq IS NOT NULL AND code IS NULL AND parse_code IS NULL",
    "replay_entries": f"WITH {_FATES} SELECT seq, asset_id, status, reason, bid_outcome, ask_outcome, comparison, idempotent::VARCHAR AS idempotent, discriminating, coalesce(derived_bid, -1)::BIGINT AS derived_bid, coalesce(derived_ask, -1)::BIGINT AS derived_ask FROM done",
    "update_counters": f"""WITH {_FATES} SELECT session_id, count(*) AS entries, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status <> 'applied') AS excluded,
count(*) FILTER (status = 'applied' AND size = 0) AS zero_updates, count(*) FILTER (status = 'applied' AND size <> 0) AS nonzero_updates,
count(*) FILTER (status = 'applied' AND side = 'BUY') AS buy_updates, count(*) FILTER (status = 'applied' AND side = 'SELL') AS sell_updates, count(*) FILTER (idempotent) AS idempotent,
count(*) FILTER (discriminating = 'zero_delete') AS zero_delete, count(*) FILTER (discriminating = 'nonzero_replacement') AS nonzero_replacement, count(comparison) AS comparisons,
count(*) FILTER (comparison = 'match') AS comparison_match, count(*) FILTER (comparison = 'candidate') AS comparison_candidate, count(*) FILTER (comparison = 'mismatch') AS comparison_mismatch, {_COMPONENTS} FROM done GROUP BY 1""",
    "state_versions": f"WITH {_FATES}, {_VERSIONS} SELECT asset_id, max(version) AS version, max(seq) AS last_seq FROM vers GROUP BY 1",
    "orderbook_hash": f"""WITH {_FEED}, {_SHOWN}, b AS (SELECT *, CASE WHEN kind = 'book' THEN {_HASH_LEVELS['bids']} ELSE '{{"price":"0.' || tick || '","size":"' || size || '"}},{{"price":"0.' || tick || '","size":"' || size || '"}}' END AS bids,
{_HASH_LEVELS['asks']} AS asks FROM shown WHERE parse_status = 'ok' AND {_BOOK_KIND})
SELECT seq, sha1('{{"market":"m","asset_id":"' || asset_id || '","timestamp":"' || (epoch_us(ts) // 1000) || '","hash":"","bids":[' || bids || '],"asks":[' || asks || '],"min_order_size":"5","tick_size":"0.1","neg_risk":false,"last_trade_price":"0.' || tick || '"}}') AS hash FROM b""",
    "change_hashes": f"WITH {_HASHED} SELECT seq, asset_id, hash FROM hashed",
    "hash_checks": f"WITH {_HASHED} SELECT shape, count(*) AS attempts, count(*) FILTER (good) AS matches, count(*) FILTER (NOT good) AS mismatches, 0::BIGINT AS skipped FROM marked GROUP BY 1",
    "hash_verdicts": f"""WITH {_HASHED} SELECT session_id, CASE WHEN bool_and(good) AND count(*) FILTER (shape = 'book') > 0 AND count(*) FILTER (shape = 'change') > 0 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END AS status FROM marked GROUP BY 1""",
    "entry_histogram": "SELECT n AS frame_entries, count(*) AS frames FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1",
    "frame_repeats": f"WITH {_REPEATS} SELECT frame, frame_entries, same_asset, repeated_keys, order_sensitive FROM per JOIN asset USING (frame)",
    "repeat_counters": f"""WITH {_REPEATS} SELECT count(*) AS frames, sum(frame_entries)::BIGINT AS entries, count(*) FILTER (frame_entries > 1) AS multi_entry_frames, count(*) FILTER (same_asset) AS same_asset_frames,
count(*) FILTER (repeated_keys > 0) AS repeated_key_frames, count(*) FILTER (order_sensitive) AS order_sensitive_frames FROM per JOIN asset USING (frame)""",
    "source_order": f"""WITH {_TIMED}, w AS (SELECT token, source_ms, lag(source_ms) OVER (PARTITION BY token ORDER BY seq) AS p FROM timed)
SELECT token, count(*) AS events, count(*) FILTER (source_ms < p) AS regressions, count(*) FILTER (source_ms = p) AS adjacent_equal FROM w GROUP BY 1""",
    "delays": f"""WITH {_TIMED}, o AS (SELECT delay, row_number() OVER (ORDER BY delay) AS r, count(*) OVER () AS n FROM timed)
SELECT max(n) AS n, min(delay)::DOUBLE AS minimum, min(delay) FILTER (r >= ceil(n * 0.5))::DOUBLE AS p50, min(delay) FILTER (r >= ceil(n * 0.95))::DOUBLE AS p95, max(delay)::DOUBLE AS maximum, count(*) FILTER (delay < 0) AS future FROM o""",
    "same_time_groups": f"WITH {_TIMED} SELECT token, source_ms, count(*) AS events FROM timed GROUP BY 1, 2 HAVING count(*) > 1",
    "first_state_events": f"""WITH {_FEED}, r AS (SELECT session_id, asset_id AS token, seq, CASE WHEN kind = 'book' THEN 'book' ELSE 'price_change' END AS t FROM feed WHERE kind IN ('book', 'change') OR eid % 4 IN (1, 2)),
grid AS (SELECT * FROM (SELECT DISTINCT session_id FROM r) CROSS JOIN (SELECT DISTINCT token FROM r))
SELECT session_id, token, arg_min(t, seq) AS first_state_event, coalesce(min(seq), -1) AS first_state_seq, coalesce(min(seq) FILTER (t = 'book'), -1) AS first_book_seq, coalesce(min(seq) FILTER (t = 'price_change'), -1) AS first_delta_seq,
count(*) FILTER (t = 'book') AS book_events, count(*) FILTER (t = 'price_change') AS price_change_entries FROM grid LEFT JOIN r USING (session_id, token) GROUP BY 1, 2""",
    "rest_alignment": f"WITH {_READS} SELECT rest_id, coalesce(aligned, false) AS aligned, (CASE WHEN aligned THEN full_match END)::VARCHAR AS full_match FROM rests",
    "update_validations": f"""WITH {_READS}, u AS (
  SELECT d.*, (SELECT min(x.seq) FROM done x WHERE x.status = 'applied' AND x.asset_id = d.asset_id AND x.side = d.side AND x.tick = d.tick AND x.seq > d.seq) AS touch,
         (SELECT min(b.bseq) FROM books b WHERE b.asset_id = d.asset_id AND b.bseq > d.seq) AS book,
         (SELECT min(r.seq) FROM rests r WHERE r.asset_id = d.asset_id AND r.aligned AND r.full_match AND r.seq > d.seq) AS v
  FROM done d WHERE discriminating IS NOT NULL),
s AS (SELECT *, least(touch, book) AS gone FROM u)
SELECT discriminating, CASE WHEN v IS NOT NULL AND (gone IS NULL OR v < gone) THEN 'validated' WHEN gone IS NOT NULL THEN 'superseded' ELSE 'pending' END AS verdict, count(*) AS updates FROM s GROUP BY 1, 2""",
    "empty_side_candidates": f"""WITH {_READS}, c AS (
  SELECT d.seq, d.asset_id, d.session_id, v.version, k.kind FROM done d JOIN vers v ON v.asset_id = d.asset_id AND v.seq = d.seq
  JOIN (SELECT 'bid_zero_when_empty' AS kind UNION ALL SELECT 'ask_one_when_empty') k ON CASE k.kind WHEN 'bid_zero_when_empty' THEN d.bid_outcome ELSE d.ask_outcome END = 'candidate'),
a AS (SELECT c.*, (SELECT min(r.rest_id) FROM rests r WHERE r.asset_id = c.asset_id AND r.session_id = c.session_id AND r.seq > c.seq) AS rest_id FROM c)
SELECT kind, CASE WHEN NOT coalesce(r.aligned, false) THEN 'unaligned_request_window' WHEN r.version <> a.version THEN 'candidate_state_superseded' WHEN r.full_match THEN 'CONFIRMED' ELSE 'aligned_full_depth_mismatch' END AS outcome, count(*) AS attempts
FROM a JOIN rests r USING (rest_id) GROUP BY 1, 2""",
}
