"""Queries over the archive view, snapshots and vendor checks, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions.exact import nearest_rank
from bookloom.operators import archive, qualify, snapshot
from bookloom.sources import generated as g
from bookloom.sources.staging import staged


def _rows(spark, d):
    return g.archive(spark, d)[0]


def _groups(spark, d):
    rows, levels = g.archive(spark, d)
    return archive.classify(staged(rows, "archive"), levels)


def _end(rows):
    """The end of the hour of the last row, as a literal: one row comes to the driver."""
    last = rows.agg(F.max("received")).first()[0]
    return F.lit(last) + F.expr("INTERVAL 1 HOUR")


def archive_size_buckets(spark, d):
    return archive.size_buckets(_rows(spark, d))


def archive_tied_groups(spark, d):
    return archive.tied_groups(_rows(spark, d))


def archive_group_classes(spark, d):
    return _groups(spark, d).groupBy("class", "tick_class").agg(F.count("*").alias("groups"), F.sum("books").alias("books"), F.sum("changes").alias("changes"), F.sum("others").alias("others"))


def archive_duplicates(spark, d):
    return archive.duplicates(_rows(spark, d)).groupBy("kind", "rule_version").agg(F.count("*").alias("groups"), F.sum("extra").alias("extra"))


def archive_pooled(spark, d):
    rows = _rows(spark, d).withColumn("sample", F.concat(F.lit("h"), (F.hour("received") % 2).cast("string")))
    out = archive.pooled(rows, "sample", F.count("*").alias("rows"), F.count_distinct("asset_id", "received").alias("groups"), F.count_if(F.col("event_type") == "book").alias("books"))
    return out.withColumn("sample", F.coalesce("sample", F.lit("all")))


def archive_rows_per_time(spark, d):
    rows = _rows(spark, d).withColumn("sample", F.concat(F.lit("h"), (F.hour("received") % 2).cast("string")))
    per = archive.rows_per_timestamp(rows, ("sample",))
    return per.unionByName(archive.rows_per_timestamp(rows).withColumn("sample", F.lit("all")))


def archive_source_times(spark, d):
    rows = _rows(spark, d).withColumn("ordinal", F.col("row_id") * 7 % 1001)
    return archive.source_times(rows).groupBy((F.col("source_times") > 1).cast("string").alias("several")).agg(F.count("*").alias("groups"), F.sum("span_ms").alias("span_ms"), F.max("span_ms").alias("longest_ms"), F.sum("regressions").alias("regressions"))


def _states(spark, d):
    return staged(archive.states(_groups(spark, d)), "states")


def archive_states(spark, d):
    return _states(spark, d).groupBy("asset_id", "state").agg(F.count("*").alias("groups"))


def archive_durations(spark, d):
    found = _states(spark, d)
    return archive.state_durations(found, _end(found)).select("asset_id", "state", "ms")


def archive_recoveries(spark, d):
    r = archive.recoveries(_states(spark, d))
    done = nearest_rank(r, "ms", {"p50": 0.5, "p95": 0.95, "longest": 1.0}, ("asset_id",))
    open_ = r.groupBy("asset_id").agg(F.count_if(F.col("recovered").isNull()).alias("censored"))
    return done.join(open_, "asset_id").withColumnRenamed("n", "recovered")


def archive_cadence(spark, d):
    found = _states(spark, d)
    return archive.cadence(found, 30, _end(found)).select("asset_id", "points", "valid_points")


def archive_coverage(spark, d):
    return archive.coverage(_rows(spark, d)).select(F.unix_millis("hour").alias("hour_ms"), "events", "assets", "ratio")


def archive_plateaus(spark, d):
    return archive.plateaus(_rows(spark, d), 20).select(F.unix_millis("received").alias("received_ms"), "rows")


def archive_sort_breaks(spark, d):
    return archive.sort_breaks(_rows(spark, d).withColumn("file", (F.col("row_id") % 3).cast("string")), "row_id")


def archive_diagnostics(spark, d):
    rows = _rows(spark, d).withColumn("asset_id", F.when(F.col("row_id") % 101 != 0, F.col("asset_id")))
    return archive.diagnostics(rows, F.timestamp_millis(F.lit(1704067200000 + 3600000)), F.timestamp_millis(F.lit(1704067200000 + 25 * 3600000)))


def archive_pilot_window(spark, d):
    return archive.pilot_window(_rows(spark, d), 3000).select("asset_id", "rows")


def quotes(spark, d):
    """asset_id, received, prices, valid: one in 11 states invalid."""
    f = g.feed(spark, d).where("kind = 'change'")
    return f.select("eid", "asset_id", F.col("ts").alias("received"), "seq", (F.col("tick") / 20).alias("best_bid"), (F.col("tick") / 20 + 0.25).alias("best_ask"), (F.col("eid") % 11 != 0).alias("valid"))


def market_snapshot(spark, d):
    asked = g.feed(spark, d).select("eid", "asset_id", F.col("ts").alias("at"))
    out = snapshot.market_snapshot(asked, quotes(spark, d))
    return out.select("eid", "asset_id", "best_bid", "best_ask", F.round("spread", 6).alias("spread"), F.coalesce(F.unix_millis("as_of"), F.lit(-1)).alias("as_of_ms"), "valid")


def metadata_as_of(spark, d):
    asked = g.feed(spark, d).select("eid", "asset_id", F.col("seq").alias("at"))
    known = g.feed(spark, d).where("kind = 'book'").select("asset_id", F.col("seq").alias("at"), F.col("tick").alias("tick_size"))
    return snapshot.metadata_as_of(asked, known, ["tick_size"]).select("eid", "asset_id", F.coalesce("tick_size", F.lit(-1)).alias("tick_size"))


def tick_contradictions(spark, d):
    ticks = g.feed(spark, d).where("kind = 'bad'").select("asset_id", "seq", (F.col("eid") % 2).alias("old_tick"), (F.col("eid") % 3).alias("new_tick"))
    return snapshot.tick_contradictions(ticks).select("asset_id", "seq", "old_tick", "expected")


def best_signal(spark, d):
    q = quotes(spark, d)
    asked = g.feed(spark, d).select("asset_id", "seq", (F.col("tick") / 20).alias("best_bid"), (F.col("tick") / 20 + 0.25).alias("best_ask"))
    out = snapshot.best_signal(asked, q.select("asset_id", "seq", "best_bid", "best_ask"))
    return out.groupBy(F.coalesce(F.col("agrees").cast("string"), F.lit("unknown")).alias("agrees")).agg(F.count("*").alias("events"))


def sequence_report(spark, d):
    raw = g.feed(spark, d).select((F.col("user_id") % 6).alias("conn_id"), (F.floor(F.col("eid") / 2) - F.when(F.col("eid") % 61 == 0, 40).otherwise(0)).alias("msg_seq"), F.floor(F.col("eid") / 3).alias("ts_recv_ns"), F.col("eid").alias("ordinal"))
    return qualify.sequence_report(raw)


def capture_integrity(spark, d):
    t = g.table(spark, d, "documents")
    return qualify.integrity(t.select(F.col("source").alias("conn_id"), F.sha2("text", 256).alias("payload_sha256"), (F.col("doc_id") % 13 != 0).alias("parse_ok")))


def reconciliation(spark, d):
    rows = g.feed(spark, d).select(F.col("kind").alias("event_type"), F.when(F.col("eid") % 9 != 0, F.col("eid") % 4 != 0).alias("bid_ask_reconciles"), F.col("tick").alias("bid_levels"), F.col("size").alias("ask_levels"))
    return qualify.reconciliation(rows, 8).withColumn("event_type", F.coalesce("event_type", F.lit("all")))


def traceability(spark, d):
    f = g.feed(spark, d)
    return qualify.traceability(f.where("eid % 3 <> 0").select("asset_id", "seq"), f.where("eid % 5 <> 0").select("asset_id", "seq"), ["asset_id", "seq"])


def pick_tokens(spark, d):
    f = g.feed(spark, d).select("asset_id", F.when(F.col("kind") == "book", "book").otherwise("price_change").alias("event_type"), "eid")
    return qualify.pick_tokens(f, f.where("eid % 977 = 5"))


def walk_depth(spark, d):
    levels = g.feed(spark, d).where("kind = 'change'").groupBy("asset_id", F.col("tick").alias("price")).agg(F.sum("size").alias("size"))
    levels = levels.select("asset_id", F.col("price").cast("decimal(20,0)").alias("price"), F.col("size").cast("decimal(20,0)").alias("size"))
    return qualify.walk_depth(levels, 400).select("asset_id", F.col("filled").cast("bigint").alias("filled"), F.col("notional").cast("bigint").alias("notional"), "complete")


QUERIES = {
    f.__name__: f
    for f in (
        archive_size_buckets, archive_tied_groups, archive_group_classes, archive_duplicates, archive_pooled, archive_rows_per_time, archive_source_times, archive_states, archive_durations,
        archive_recoveries, archive_cadence, archive_coverage, archive_plateaus, archive_sort_breaks, archive_diagnostics, archive_pilot_window,
        market_snapshot, metadata_as_of, tick_contradictions, best_signal, sequence_report, capture_integrity, reconciliation, traceability, pick_tokens, walk_depth,
    )
}

# ---- SQL -------------------------------------------------------------------------------------------------
_A = f"archive AS ({g.ARCHIVE}),\nalevels AS ({g.ARCHIVE_LEVELS})"
_FEED = f"feed AS ({g.FEED})"
_CLASSES = f"""{_A},
bk AS (SELECT row_id, string_agg(side || price || ':' || size, ',' ORDER BY side, price, size) FILTER (size > 0) AS book_key FROM alevels GROUP BY 1),
r AS (SELECT a.*, coalesce(b.book_key, '') AS book_key FROM archive a LEFT JOIN bk b USING (row_id)),
per AS (SELECT asset_id, received, count(*) FILTER (event_type = 'book') AS books, count(*) FILTER (event_type = 'price_change') AS changes, count(*) FILTER (event_type = 'tick_size_change') AS ticks,
  count(*) FILTER (event_type = 'last_trade_price') AS others, count(*) FILTER (event_type IN ('book', 'price_change') AND NOT ok) AS unparseable,
  count(DISTINCT CASE WHEN event_type = 'book' THEN book_key END) AS book_keys, count(DISTINCT tick_key) FILTER (event_type = 'tick_size_change') AS tick_keys FROM r GROUP BY 1, 2),
conf AS (SELECT DISTINCT asset_id, received FROM (SELECT asset_id, received, side, price FROM r WHERE event_type = 'price_change' AND ok GROUP BY ALL HAVING count(DISTINCT size) > 1)),
held AS (SELECT asset_id, received, l.side, l.price, max(l.size) AS size FROM r JOIN alevels l USING (row_id) WHERE r.event_type = 'book' AND l.size > 0 GROUP BY ALL),
diff AS (SELECT DISTINCT c.asset_id, c.received FROM r c LEFT JOIN held h ON h.asset_id = c.asset_id AND h.received = c.received AND h.side = c.side AND h.price = c.price WHERE c.event_type = 'price_change' AND c.ok AND c.size <> coalesce(h.size, 0)),
classes AS (SELECT p.*, CASE WHEN books + changes = 0 THEN 'none' WHEN unparseable > 0 THEN 'ambiguous_unparseable' WHEN book_keys > 1 THEN 'ambiguous_book'
  WHEN EXISTS (SELECT 1 FROM conf c WHERE c.asset_id = p.asset_id AND c.received = p.received) THEN 'ambiguous_change'
  WHEN books > 0 AND EXISTS (SELECT 1 FROM diff c WHERE c.asset_id = p.asset_id AND c.received = p.received) THEN 'ambiguous_interaction' ELSE 'invariant' END AS class,
  CASE WHEN ticks = 0 THEN 'none' WHEN tick_keys > 1 THEN 'ambiguous_tick' WHEN ticks > 1 THEN 'duplicate' ELSE 'single' END AS tick_class FROM per p)"""
_STATES = f"""{_CLASSES},
s0 AS (SELECT asset_id, received, books, class, CASE WHEN class LIKE 'ambiguous%' THEN 'INVALID' WHEN books > 0 THEN 'VALID' END AS sets FROM classes),
s1 AS (SELECT *, last_value(sets IGNORE NULLS) OVER w AS last, count(*) FILTER (sets = 'VALID') OVER w AS started, lead(received) OVER (PARTITION BY asset_id ORDER BY received) AS until FROM s0
  WINDOW w AS (PARTITION BY asset_id ORDER BY received ROWS UNBOUNDED PRECEDING)),
states AS (SELECT asset_id, received, CASE WHEN started > 0 THEN last ELSE 'UNINITIALIZED' END AS state, epoch_ms(received) AS a,
  epoch_ms(coalesce(until, (SELECT max(received) FROM s0) + INTERVAL 1 HOUR)) AS b FROM s1)"""
_RANKS = "min({v}) FILTER (r >= greatest(1, ceil(n * {p})))"


def _rank_sql(by: str) -> str:
    cols = ", ".join(f"min(c) FILTER (r >= greatest(1, ceil(n * {p})))::BIGINT AS {name}" for name, p in (("minimum", 0.0), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("maximum", 1.0)))
    return f"SELECT {by} AS sample, max(n) AS n, {cols} FROM (SELECT sample, c, row_number() OVER (PARTITION BY {by} ORDER BY c) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM t) GROUP BY 1"


SQL = {
    "archive_size_buckets": f"WITH {_A}, p AS (SELECT asset_id, received, count(*) AS n FROM archive GROUP BY 1, 2) SELECT CASE WHEN n < 5 THEN n::VARCHAR WHEN n < 10 THEN '5-9' WHEN n < 100 THEN '10-99' ELSE '100+' END AS bucket, count(*) AS groups, sum(n)::BIGINT AS rows FROM p GROUP BY 1",
    "archive_duplicates": f"""WITH {_CLASSES}, said AS (
  SELECT asset_id, received, CASE event_type WHEN 'book' THEN 'idempotent_book' WHEN 'price_change' THEN 'idempotent_replacement' ELSE 'tick' END AS kind,
         CASE event_type WHEN 'book' THEN book_key WHEN 'price_change' THEN side || ':' || price || ':' || size ELSE tick_key END AS said
  FROM r WHERE event_type IN ('book', 'tick_size_change') OR (event_type = 'price_change' AND ok)),
same AS (SELECT asset_id, received, kind, said, count(*) - 1 AS extra FROM said GROUP BY ALL HAVING count(*) > 1),
dup AS (SELECT asset_id, received, kind, sum(extra) AS extra FROM same GROUP BY ALL)
SELECT kind, 1 AS rule_version, count(*) AS groups, sum(extra)::BIGINT AS extra FROM dup GROUP BY 1""",
    "archive_tied_groups": f"WITH {_A}, p AS (SELECT asset_id, received, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS composition FROM archive WHERE event_type IN ('book', 'price_change') GROUP BY 1, 2) SELECT composition, count(*) AS groups, sum(n)::BIGINT AS rows FROM p WHERE n > 1 GROUP BY 1",
    "archive_group_classes": f"WITH {_CLASSES} SELECT class, tick_class, count(*) AS groups, sum(books)::BIGINT AS books, sum(changes)::BIGINT AS changes, sum(others)::BIGINT AS others FROM classes GROUP BY 1, 2",
    "archive_pooled": f"""WITH {_A}, s AS (SELECT *, 'h' || (hour(received) % 2) AS sample FROM archive)
SELECT coalesce(sample, 'all') AS sample, count(*) AS rows, count(DISTINCT (asset_id, received)) AS groups, count(*) FILTER (event_type = 'book') AS books FROM s GROUP BY ROLLUP (sample)""",
    "archive_rows_per_time": f"WITH {_A}, t AS (SELECT 'h' || (hour(received) % 2) AS sample, received, count(*) AS c FROM archive GROUP BY 1, 2) {_rank_sql('sample')} UNION ALL {_rank_sql(chr(39) + 'all' + chr(39))}",
    "archive_source_times": f"""WITH {_A}, w AS (SELECT *, source < lag(source) OVER (PARTITION BY asset_id, received ORDER BY row_id * 7 % 1001) AS back FROM archive),
p AS (SELECT asset_id, received, count(DISTINCT source) AS k, epoch_us(max(source)) // 1000 - epoch_us(min(source)) // 1000 AS span, count(*) FILTER (back) AS back FROM w GROUP BY 1, 2)
SELECT (k > 1)::VARCHAR AS several, count(*) AS groups, sum(span)::BIGINT AS span_ms, max(span) AS longest_ms, sum(back)::BIGINT AS regressions FROM p GROUP BY 1""",
    "archive_states": f"WITH {_STATES} SELECT asset_id, state, count(*) AS groups FROM states GROUP BY 1, 2",
    "archive_durations": f"WITH {_STATES} SELECT asset_id, state, sum(b - a)::BIGINT AS ms FROM states GROUP BY 1, 2",
    "archive_recoveries": f"""WITH {_STATES}, t AS (SELECT *, lag(state) OVER (PARTITION BY asset_id ORDER BY received) AS p FROM states),
x AS (SELECT t.asset_id, t.a, (SELECT min(v.a) FROM states v WHERE v.asset_id = t.asset_id AND v.state = 'VALID' AND v.a > t.a) - t.a AS ms FROM t WHERE state = 'INVALID' AND p = 'VALID'),
o AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ms) AS r, count(*) OVER (PARTITION BY asset_id) AS n FROM x WHERE ms IS NOT NULL)
SELECT o.asset_id, max(n) AS recovered, min(ms) FILTER (r >= ceil(n * 0.5)) AS p50, min(ms) FILTER (r >= ceil(n * 0.95)) AS p95, max(ms) AS longest,
       (SELECT count(*) FROM x WHERE x.asset_id = o.asset_id AND x.ms IS NULL) AS censored FROM o GROUP BY 1""",
    "archive_cadence": f"""WITH {_STATES}, f AS (SELECT asset_id, min(a) AS first FROM states WHERE state = 'VALID' GROUP BY 1),
grid AS (SELECT asset_id, unnest(range(first, (SELECT max(b) FROM states), 1800000)) AS t FROM f)
SELECT g.asset_id, count(*) AS points, count(*) FILTER (s.state = 'VALID') AS valid_points FROM grid g ASOF JOIN states s ON g.asset_id = s.asset_id AND g.t >= s.a GROUP BY 1""",
    "archive_coverage": f"""WITH {_A}, p AS (SELECT received, count(*) AS events, count(DISTINCT asset_id) AS assets FROM archive GROUP BY 1),
h AS (SELECT unnest(generate_series((SELECT min(received) FROM p), (SELECT max(received) FROM p), INTERVAL 1 HOUR)) AS hour)
SELECT epoch_ms(hour) AS hour_ms, coalesce(events, 0) AS events, coalesce(assets, 0) AS assets, coalesce(events, 0)::DOUBLE / nullif(lag(coalesce(events, 0)) OVER (ORDER BY hour), 0) AS ratio FROM h LEFT JOIN p ON p.received = h.hour""",
    "archive_plateaus": f"WITH {_A} SELECT epoch_ms(received) AS received_ms, count(*) AS rows FROM archive GROUP BY received ORDER BY 2 DESC, 1 LIMIT 20",
    "archive_sort_breaks": f"WITH {_A}, w AS (SELECT (row_id % 3)::VARCHAR AS file, (asset_id, received) < lag((asset_id, received)) OVER (PARTITION BY row_id % 3 ORDER BY row_id) AS broken FROM archive) SELECT file, count(*) FILTER (broken) AS breaks FROM w GROUP BY 1",
    "archive_diagnostics": f"WITH {_A}, w AS (SELECT CASE WHEN row_id % 101 = 0 THEN 'null_key' WHEN epoch_ms(received) < 1704070800000 OR epoch_ms(received) >= 1704157200000 THEN 'out_of_hour' END AS problem FROM archive) SELECT problem, count(*) AS rows FROM w WHERE problem IS NOT NULL GROUP BY 1",
    "archive_pilot_window": f"WITH {_A}, p AS (SELECT asset_id, count(*) AS rows FROM archive GROUP BY 1), w AS (SELECT *, coalesce(sum(rows) OVER (ORDER BY asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT asset_id, rows FROM w WHERE before < 3000",
    "market_snapshot": f"""WITH {_FEED}, q AS (SELECT asset_id, ts, tick / 20 AS b, tick / 20 + 0.25 AS a, eid % 11 <> 0 AS valid FROM feed WHERE kind = 'change'), r AS (SELECT eid, asset_id, ts FROM feed)
SELECT r.eid, r.asset_id, CASE WHEN q.valid THEN q.b END::DOUBLE AS best_bid, CASE WHEN q.valid THEN q.a END::DOUBLE AS best_ask, round(CASE WHEN q.valid THEN q.a - q.b END, 6)::DOUBLE AS spread, coalesce(epoch_us(q.ts) // 1000, -1) AS as_of_ms, coalesce(q.valid, false) AS valid
FROM r ASOF LEFT JOIN q ON r.asset_id = q.asset_id AND r.ts >= q.ts""",
    "metadata_as_of": f"WITH {_FEED} SELECT r.eid, r.asset_id, coalesce(m.tick, -1) AS tick_size FROM (SELECT eid, asset_id, seq FROM feed) r ASOF LEFT JOIN (SELECT asset_id, seq, tick FROM feed WHERE kind = 'book') m ON r.asset_id = m.asset_id AND r.seq >= m.seq",
    "tick_contradictions": f"WITH {_FEED}, w AS (SELECT asset_id, seq, eid % 2 AS old_tick, lag(eid % 3) OVER (PARTITION BY asset_id ORDER BY seq) AS expected FROM feed WHERE kind = 'bad') SELECT * FROM w WHERE expected <> old_tick",
    "best_signal": f"""WITH {_FEED}, j AS (SELECT r.tick AS a, q.tick AS b FROM (SELECT * FROM feed) r ASOF LEFT JOIN (SELECT asset_id, seq, tick FROM feed WHERE kind = 'change') q ON r.asset_id = q.asset_id AND r.seq >= q.seq)
SELECT CASE WHEN b IS NULL THEN 'unknown' WHEN a = b THEN 'true' ELSE 'false' END AS agrees, count(*) AS events FROM j GROUP BY 1""",
    "sequence_report": f"""WITH {_FEED}, r AS (SELECT user_id % 6 AS conn_id, eid // 2 - CASE WHEN eid % 61 = 0 THEN 40 ELSE 0 END AS m, eid // 3 AS t, eid FROM feed),
w AS (SELECT *, m - lag(m) OVER x AS step, t = lag(t) OVER x AS tie FROM r WINDOW x AS (PARTITION BY conn_id ORDER BY eid))
SELECT conn_id, count(*) AS messages, count(*) FILTER (step < 0) AS regressions, count(*) FILTER (step > 1) AS gaps, count(*) FILTER (tie) AS ties, count(*) - count(DISTINCT m) AS duplicates FROM w GROUP BY 1""",
    "capture_integrity": "SELECT count(*)::BIGINT AS messages, count(*) FILTER (doc_id % 13 = 0)::BIGINT AS parse_failures, (count(*) - count(DISTINCT text))::BIGINT AS duplicate_payloads, count(DISTINCT source) AS connections FROM documents",
    "reconciliation": f"""WITH {_FEED}, r AS (SELECT kind, CASE WHEN eid % 9 <> 0 THEN eid % 4 <> 0 END AS ok, greatest(tick, size) AS deep FROM feed)
SELECT coalesce(kind, 'all') AS event_type, count(*) AS rows, count(*) FILTER (ok) AS reconciles, count(*) FILTER (NOT ok) AS differs, count(*) FILTER (ok IS NULL) AS unknown, count(*) FILTER (deep >= 8) AS truncated, max(deep) AS deepest FROM r GROUP BY ROLLUP (kind)""",
    "traceability": f"WITH {_FEED} SELECT 'normalized' AS side, count(*) FILTER (eid % 5 <> 0) AS matched, count(*) FILTER (eid % 5 = 0) AS unmatched FROM feed WHERE eid % 3 <> 0 UNION ALL SELECT 'raw', count(*) FILTER (eid % 3 <> 0), count(*) FILTER (eid % 3 = 0) FROM feed WHERE eid % 5 <> 0",
    "pick_tokens": f"WITH {_FEED} (SELECT asset_id FROM feed GROUP BY 1 HAVING count(*) FILTER (kind = 'book') > 0 AND count(*) FILTER (kind <> 'book') > 0 ORDER BY 1 LIMIT 4) UNION SELECT asset_id FROM feed WHERE eid % 977 = 5",
    "walk_depth": f"""WITH {_FEED}, l AS (SELECT asset_id, tick AS price, sum(size)::BIGINT AS size FROM feed WHERE kind = 'change' GROUP BY 1, 2),
w AS (SELECT *, greatest(least(size, 400 - coalesce(sum(size) OVER (PARTITION BY asset_id ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS take FROM l)
SELECT asset_id, sum(take)::BIGINT AS filled, sum(take * price)::BIGINT AS notional, sum(take) >= 400 AS complete FROM w GROUP BY 1""",
}
