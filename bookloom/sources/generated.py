"""Feed-like views over the driver's tables, which hold no order books.

The SQL of a view runs in Spark and DuckDB alike. events: every event is a frame of one of 20 assets
(signup: a book; error: something malformed; else one price change). lineitem: an order is a frame of many
entries. archive(): the same events by the hour, for five assets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.operators import frames, replay

from .evidence import with_status
from .schemas import DECIMAL
from .staging import staged

FEED = """SELECT event_id AS eid, event_id * 10 AS seq,
  concat('s', CAST(CAST(floor(event_id / 4000.0) AS BIGINT) AS STRING)) AS session_id,
  concat('a', lpad(CAST(user_id % 20 AS STRING), 2, '0')) AS asset_id,
  CASE event_type WHEN 'signup' THEN 'book' WHEN 'error' THEN 'bad' ELSE 'change' END AS kind,
  CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
  CAST(floor(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) / 10.0) AS BIGINT) AS tick,
  CAST(floor(value) AS BIGINT) % 5 AS size, ts, user_id, value
FROM events"""

LEVELS = """SELECT f.eid, f.seq, f.session_id, f.asset_id, 'BUY' AS side, (f.tick + 3 * o.d) % 10 AS tick, (f.size + o.d) % 5 AS size
FROM feed f CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 AS d UNION ALL SELECT 2 AS d) o WHERE f.kind = 'book'
UNION ALL
SELECT f.eid, f.seq, f.session_id, f.asset_id, 'SELL' AS side, (f.tick + 1 + 3 * o.d) % 10 AS tick, (f.size + 2 * o.d) % 5 AS size
FROM feed f CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 AS d UNION ALL SELECT 2 AS d) o WHERE f.kind = 'book'"""

FRAMES = """SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS change_index,
  concat('a', CAST(l_suppkey % 5 AS STRING)) AS asset_id, CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side,
  CAST(CAST(round(l_discount * 100) AS BIGINT) AS STRING) AS price_key, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS size_key
FROM lineitem"""

ARCHIVE = """SELECT event_id AS row_id, 'm' AS market, concat('a', CAST(user_id % 5 AS STRING)) AS asset_id, date_trunc('hour', ts) AS received, ts AS source,
  CASE event_type WHEN 'signup' THEN 'book' WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'last_trade_price' WHEN 1 THEN 'price_change' ELSE 'tick_size_change' END ELSE 'price_change' END AS event_type,
  NOT (event_type = 'error' AND event_id % 4 = 1) AS ok,
  CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
  CAST(floor(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) / 10.0) AS BIGINT) AS price,
  CAST(floor(value) AS BIGINT) % 3 AS size,
  CASE WHEN event_type = 'error' AND event_id % 4 >= 2 THEN concat(CAST(event_id % 2 AS STRING), '>', CAST(event_id % 3 AS STRING)) END AS tick_key
FROM events"""

ARCHIVE_LEVELS = """SELECT a.row_id, a.side, a.price, a.size FROM archive a WHERE a.event_type = 'book'
UNION ALL
SELECT a.row_id, a.side, (a.price + 5) % 10 AS price, a.size AS size FROM archive a WHERE a.event_type = 'book'"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times without a zone are read as UTC, whatever the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.concat(F.col(c).cast("string"), F.lit("Z")).cast("timestamp") for c in plain})


def _view(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **tables)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, FEED, events=table(spark, sf_dir, "events"))


def frame_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, FRAMES, lineitem=table(spark, sf_dir, "lineitem"))


def archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows with book_key, and the levels of book rows."""
    rows = _view(spark, ARCHIVE, events=table(spark, sf_dir, "events"))
    levels = _view(spark, ARCHIVE_LEVELS, archive=rows)
    live = F.array_sort(F.collect_list(F.when(F.col("size") > 0, F.struct("side", "price", "size"))))
    keys = levels.groupBy("row_id").agg(F.sha2(F.to_json(live), 256).alias("book_key"))
    return rows.join(keys, "row_id", "left"), levels


def payload() -> F.Column:
    """The JSON text of a feed row."""
    text = lambda c: F.expr(c).cast("string")
    level = lambda tick, size: F.concat(F.lit('{"price":"0.'), text(tick), F.lit('","size":"'), text(size), F.lit('"}'))
    bids = F.concat_ws(",", *(level(f"(tick + 3 * {d}) % 10", f"(size + {d}) % 5") for d in range(3)))
    asks = F.concat_ws(",", *(level(f"(tick + 1 + 3 * {d}) % 10", f"(size + 2 * {d}) % 5") for d in range(3)))
    twice = F.concat_ws(",", level("tick", "size"), level("tick", "size"))
    ms = text("unix_millis(ts)")

    def book(bid_side):
        return F.concat(F.lit('{"event_type":"book","asset_id":"'), "asset_id", F.lit('","market":"m","bids":['), bid_side, F.lit('],"asks":['), asks, F.lit('],"timestamp":"'), ms, F.lit('","hash":"h","tick_size":"0.1","min_order_size":"5","neg_risk":false,"last_trade_price":"0.'), text("tick"), F.lit('"}'))

    def change(size):
        return F.concat(F.lit('{"event_type":"price_change","market":"m","timestamp":"'), ms, F.lit('","price_changes":[{"asset_id":"'), "asset_id", F.lit('","price":"0.'), text("tick"), F.lit('"'), size, F.lit(',"side":"'), "side", F.lit('","hash":"h"}]}'))

    sized = F.concat(F.lit(',"size":"'), text("size"), F.lit('"'))
    bad = F.expr("eid % 4")
    return (
        F.when(F.col("kind") == "book", book(bids)).when(F.col("kind") == "change", change(sized))
        .when(bad == 0, '{"event_type"').when(bad == 1, change(F.lit(',"size":"x"'))).when(bad == 2, change(F.lit(""))).otherwise(book(twice))
    )


def feed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as raw frames, decoded, with status."""
    rows = feed(spark, sf_dir).select("eid", "session_id", "asset_id", "ts", F.col("seq").alias("ingest_sequence"), payload().alias("raw"))
    kind = F.when((F.col("eid") % 51 == 0) & (F.col("eid") % 50 != 0), "bytes_base64").otherwise("text")
    raw = F.when(F.col("eid") % 50 == 0, "PONG").when(F.col("eid") % 51 == 0, "/w==").otherwise(F.col("raw"))
    return with_status(rows.select("eid", "session_id", "asset_id", "ts", "ingest_sequence", raw.alias("raw_payload"), kind.alias("payload_kind")))


#: Views made once in an application and kept in the shared folder: they are the queries' input, not their work.
_MADE: dict[tuple[str, str, str], tuple[DataFrame, ...]] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> tuple[DataFrame, ...]:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def feed_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """books, entries and levels of the feed, read from its payloads."""
    return feed_tables(spark, sf_dir)[:3]


def feed_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """feed_parts() and the events they come from."""

    def make():
        rows = feed(spark, sf_dir).select("session_id", F.col("seq"), F.lit("text").alias("payload_kind"), payload().alias("raw_payload"))
        keep = ("session_id", "seq", "event_index")
        found = staged(frames.events(with_status(rows), ("session_id", "seq")), "events")
        books = staged(frames.books(found, keep), "books")
        levels = frames.level_rows(found, keep).where("level_code IS NULL")
        levels = levels.join(books.where("code IS NULL").select(*keep, "asset_id"), list(keep))
        return books, staged(frames.entries(found, keep), "entries"), staged(levels, "book-levels"), found

    return _once(spark, sf_dir, "feed", make)


def claimed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's entries with claims of best prices, which a replay of them gives."""

    def make():
        books, entries, levels = feed_parts(spark, sf_dir)
        events = staged(replay.number_events(books, entries), "numbered")
        points = events.where("NOT is_book AND epoch > 0 AND code IS NULL AND parse_code IS NULL")
        best = replay.best_prices(points, staged(replay.level_events(events, levels), "levels"))
        at = ["session_id", "asset_id", "seq", "event_index", "change_index"]
        derived = points.select(*replay.KEY, "n", "seq", "event_index", "change_index").join(best, [*replay.KEY, "n"]).select(*at, "derived_bid", "derived_ask")
        return (staged(with_claims(entries, derived), "claimed"),)

    return _once(spark, sf_dir, "claims", make)[0]


def with_claims(entries: DataFrame, derived: DataFrame) -> DataFrame:
    """Entries that claim their derived best prices, some wrong, absent, empty or unreadable."""
    eid = F.col("seq") / 10
    e = entries.drop("has_bid", "best_bid", "best_bid_code", "has_ask", "best_ask", "best_ask_code").join(derived, ["session_id", "asset_id", "seq", "event_index", "change_index"], "left")
    given = eid % 43 != 0
    boundary = lambda v: F.when(eid % 2 == 0, F.lit(v)).cast(DECIMAL)
    bid = F.when(eid % 37 == 0, F.lit("0.99").cast(DECIMAL)).otherwise(F.coalesce("derived_bid", boundary(0)))
    ask = F.when(eid % 41 != 0, F.coalesce("derived_ask", boundary(1)))
    out = {"has_bid": given, "best_bid": bid, "best_bid_code": F.lit(None).cast("string"), "has_ask": given, "best_ask": ask, "best_ask_code": F.when(given & (eid % 41 == 0), "decimal_parse_failure")}
    return e.withColumns(out).drop("derived_bid", "derived_ask")
