"""From frames to logical events to price-change entries; what cannot be used becomes a row with a code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions.exact import bounds_code, decimal_code, exact
from bookloom.functions.wire import frame_metadata, has, leaf, member, text_of, wire_type
from bookloom.sources.schemas import ENTRY_FIELDS, KNOWN_EVENT_TYPES, ORDERING_LEAVES, TIME

from .ordered import last_before


def record_counts(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """record_type, records of each sink."""
    out = None
    for name, df in kinds:
        one = df.agg(F.count("*").alias("records")).select(F.lit(name).alias("record_type"), "records")
        out = one if out is None else out.unionByName(one)
    return out


def merge_streams(*streams: DataFrame) -> DataFrame:
    """Record streams as one, in the order of their shared sequence (a range sort); columns that one lacks are null."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.orderBy("ingest_sequence")


def duplicates(frames: DataFrame) -> DataFrame:
    """Frames whose digest was seen before, with their ordinal; nothing is dropped."""
    order = W.partitionBy("digest").orderBy("ingest_sequence")
    return frames.withColumn("ordinal", F.row_number().over(order)).where("ordinal > 1")


def duplicate_count(frames: DataFrame) -> DataFrame:
    """duplicate_frames: the sum of n - 1 over equal digests, heartbeats included."""
    per = frames.groupBy("digest").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_frames"))


def receive_order(frames: DataFrame, order: list[str], ranges: list[str]) -> DataFrame:
    """Each frame with sequence_regressed and monotonic_regressed, in processing order.

    A sequence that doesn't rise, and a clock reading below the last one there was. order and ranges: as of ordered.
    """
    seen = last_before(frames, ranges, order, ["ingest_sequence", "received_monotonic_ns"])
    return seen.select(
        *frames.columns,
        F.coalesce(F.col("ingest_sequence") <= F.col("ingest_sequence_before"), F.lit(False)).alias("sequence_regressed"),
        F.coalesce(F.col("received_monotonic_ns") < F.col("received_monotonic_ns_before"), F.lit(False)).alias("monotonic_regressed"),
    )


def receive_errors(ordered: DataFrame) -> DataFrame:
    """ingest_sequence and code of frames that regressed; one may have both."""
    both = F.array_compact(F.array(
        F.when(F.col("sequence_regressed"), "websocket_ingest_sequence_regression"),
        F.when(F.col("monotonic_regressed"), "websocket_monotonic_receive_regression"),
    ))
    return ordered.select("ingest_sequence", F.explode(both).alias("code"))


def events(frames: DataFrame, keep: tuple[str, ...] = ("ingest_sequence",)) -> DataFrame:
    """event_index, event, event_type and code of each logical event of decoded frames; keep: columns of frames.

    code: the parse status of frames that aren't ok, unexpected_json_shape, unexpected_event_shape,
    missing_event_type; null for events. unexpected_event_type events keep their type and count.
    """
    live = frames.where(F.col("parse_status") != "expected_heartbeat")
    kind = wire_type(F.col("decoded"))
    parts = F.when(kind == "array", F.try_variant_get("decoded", "$", "array<variant>"))
    parts = parts.when(kind == "object", F.array("decoded"))
    rows = live.select(*keep, "parse_status", kind.alias("kind"), F.posexplode_outer(parts).alias("event_index", "event"))
    rows = rows.where(~((F.col("kind") == "array") & F.col("event_index").isNull()) | F.col("kind").isNull())
    named = F.try_variant_get("event", "$.event_type", "string")
    typed = F.when((wire_type(member(F.col("event"), "$.event_type")) == "string") & (named != ""), named)
    code = (
        F.when(F.col("parse_status") != "ok", F.col("parse_status"))
        .when(~F.coalesce(F.col("kind").isin("array", "object"), F.lit(False)), "unexpected_json_shape")
        .when(wire_type(F.col("event")) != "object", "unexpected_event_shape")
        .when(typed.isNull(), "missing_event_type")
    )
    return rows.select(*keep, "event_index", "event", typed.alias("event_type"), code.alias("code"))


def metadata(frames: DataFrame) -> DataFrame:
    """frames with the metadata columns of their decoded payload."""
    value = F.col("decoded")
    parts = F.when(wire_type(value) == "array", F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))
    return frames.withColumns(frame_metadata(parts))


def unexpected_types(found: DataFrame) -> DataFrame:
    """Events of no known type: they are errors (unexpected_event_type), and still count."""
    return found.where(F.col("event_type").isNotNull() & ~F.col("event_type").isin(*KNOWN_EVENT_TYPES))


def event_errors(found: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep, event_type and code of every event that is an error by its shape or type, and of changes that name no list,
    market or time: one for each such event, whatever its entries."""
    bad = found.where("code IS NOT NULL").select(*keep, "event_type", "code")
    odd = unexpected_types(found).select(*keep, "event_type", F.lit("unexpected_event_type").alias("code"))
    void = change_frames(found, keep).where("frame_code IS NOT NULL").select(*keep, F.lit("price_change").alias("event_type"), F.col("frame_code").alias("code"))
    return bad.unionByName(odd).unionByName(void)


def event_counts(found: DataFrame) -> DataFrame:
    return found.where("code IS NULL").groupBy("event_type").agg(F.count("*").alias("events"))


def errors(found: DataFrame, code: str = "code") -> DataFrame:
    """code, errors."""
    return found.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.count("*").alias("errors"))


def examples(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first rows of each group, in order."""
    return rows.withColumn("__bl_n", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("__bl_n") <= most).drop("__bl_n")


def inventory(paths: DataFrame, key: str) -> DataFrame:
    """event_type, path, wire_type, presence (events with the path), occurrences of that type."""
    one = paths.groupBy("event_type", "path", "wire_type", key).agg(F.count("*").alias("n"))
    return one.groupBy("event_type", "path", "wire_type").agg(F.count("*").alias("presence"), F.sum("n").alias("occurrences"))


def ordering_fields(paths: DataFrame, key: str) -> DataFrame:
    """path, events of the paths whose leaf names an order."""
    name = leaf(F.col("path"))
    hits = paths.where(name.isin(*ORDERING_LEAVES) | name.contains("sequence")).select("path", key).distinct()
    return hits.groupBy("path").agg(F.count("*").alias("events"))


def _changes():
    """The entries of a price_change event; null if it has no list of them."""
    listed = wire_type(member(F.col("event"), "$.price_changes")) == "array"
    return F.when(listed, F.try_variant_get("event", "$.price_changes", "array<variant>"))


def _whole():
    return has(F.col("event"), "$.market") & has(F.col("event"), "$.timestamp")


def change_frames(found: DataFrame, keep: tuple[str, ...] = ("ingest_sequence", "event_index")) -> DataFrame:
    """A row per price_change event: frame_entries (null without a list) and frame_code, why none of them is used."""
    rows = found.where("code IS NULL AND event_type = 'price_change'").select(*keep, F.size(_changes()).alias("n"), _whole().alias("whole"))
    return rows.select(
        *keep, F.when(F.col("n") >= 0, F.col("n")).alias("frame_entries"),
        F.when(F.coalesce(F.col("n") < 0, F.lit(True)) | ~F.col("whole"), "missing_required_field").alias("frame_code"),
    )


def entries(found: DataFrame, keep: tuple[str, ...] = ("ingest_sequence", "event_index")) -> DataFrame:
    """A row per price-change entry of price_change events, with its checks.

    code: missing_required_field (frame or entry), malformed_price_change, or null; by_frame: the code is the frame's,
    which change_frames() tells once; parse_code: why price, size or side cannot be used, size first. Missing and null
    best prices differ: has_bid, has_ask.
    """
    changes, whole = _changes(), _whole()
    rows = found.where("code IS NULL AND event_type = 'price_change'").select(
        *keep, whole.alias("whole"), F.size(changes).alias("frame_entries"), F.posexplode(changes).alias("change_index", "c")
    )
    c = F.col("c")
    absent = F.lit(False)
    for name in ENTRY_FIELDS:
        absent = absent | ~has(c, f"$.{name}")
    code = (
        F.when(~F.col("whole"), "missing_required_field")
        .when(wire_type(c) != "object", "malformed_price_change")
        .when(absent, "missing_required_field")
    )
    # texts and wire types are taken once; the checks below read columns
    names = ("price", "size", "best_bid", "best_ask")
    rows = rows.select(
        *keep, "change_index", "frame_entries", code.alias("code"), (~F.col("whole")).alias("by_frame"), *(text_of(c, f"$.{x}").alias(x) for x in ("asset_id", "side", "hash")),
        *(text_of(c, f"$.{x}").alias(f"{x}_text") for x in names), *(wire_type(member(c, f"$.{x}")).alias(f"{x}_type") for x in names),
    )
    text, is_string = lambda x: F.col(f"{x}_text"), lambda x: F.col(f"{x}_type") == "string"
    rows = rows.withColumns({x: exact(text(x)) for x in ("price", "size")} | {f"{x}_code": decimal_code(text(x), is_string(x)) for x in ("price", "size")})
    parse = F.coalesce(
        F.col("size_code"), F.col("price_code"), bounds_code(F.col("price"), F.col("size")), F.when(~F.col("side").isin("BUY", "SELL"), "invalid_side")
    )

    def best(x: str) -> list:
        there = F.col(f"{x}_type").isNotNull()
        blank = (F.col(f"{x}_type") == "null") | (is_string(x) & (text(x) == ""))
        return [there.alias(f"has_{x[5:]}"), F.when(there & ~blank, exact(text(x))).alias(x), F.when(there & ~blank, decimal_code(text(x), is_string(x))).alias(f"{x}_code")]

    return rows.select(
        *keep, "change_index", "frame_entries", "code", "by_frame", "asset_id", "side", "price_text", "size_text", "price", "size",
        F.when(F.col("code").isNull(), parse).alias("parse_code"), "hash", *best("best_bid"), *best("best_ask"),
    )


def book_levels(side: str):
    """SQL of the typed levels of a book event's side."""
    return F.try_variant_get("event", f"$.{side}", "array<variant>")


def level_rows(found: DataFrame, keep: tuple[str, ...] = ("ingest_sequence", "event_index")) -> DataFrame:
    """A row per level of book events: side, level_index, price, size, their texts and level_code.

    Equal numbers repeat a price, whatever their spelling.
    """
    books = found.where("code IS NULL AND event_type = 'book'")
    sides = F.array(*(F.struct(F.lit(s).alias("side"), book_levels(n).alias("levels")) for n, s in (("bids", "BUY"), ("asks", "SELL"))))
    rows = books.select(*keep, F.explode(sides).alias("s")).select(*keep, "s.side", F.posexplode("s.levels").alias("level_index", "x"))
    x = F.col("x")
    shape = F.when(wire_type(x) != "object", "malformed_level").when(~has(x, "$.price") | ~has(x, "$.size"), "missing_required_field")
    names = ("price", "size")
    rows = rows.select(
        *keep, "side", "level_index", shape.alias("shape"), *(text_of(x, f"$.{n}").alias(f"{n}_text") for n in names), *(wire_type(member(x, f"$.{n}")).alias(f"{n}_type") for n in names)
    )
    rows = rows.withColumns({n: exact(F.col(f"{n}_text")) for n in names} | {f"{n}_code": decimal_code(F.col(f"{n}_text"), F.col(f"{n}_type") == "string") for n in names})
    code = F.coalesce("shape", "price_code", "size_code", bounds_code(F.col("price"), F.col("size")))
    rows = rows.select(*keep, "side", "level_index", "price", "size", "price_text", "size_text", code.alias("level_code"))
    again = F.row_number().over(W.partitionBy(*keep, "side", "price").orderBy("level_index")) > 1
    return rows.withColumn("level_code", F.coalesce("level_code", F.when(again & F.col("price").isNotNull(), "duplicate_snapshot_level")))


def books(found: DataFrame, keep: tuple[str, ...] = ("ingest_sequence", "event_index")) -> DataFrame:
    """A row per book event: asset_id, market, and code, null for accepted books: the first reason otherwise."""
    e = F.col("event")
    rows = found.where("code IS NULL AND event_type = 'book'")
    first = level_rows(found, keep).where("level_code IS NOT NULL").groupBy(*keep).agg(F.min_by("level_code", F.struct("side", "level_index")).alias("level_code"))
    absent = F.lit(False)
    for name in ("asset_id", "market", "bids", "asks", "timestamp", "hash"):
        absent = absent | ~has(e, f"$.{name}")
    asset, market = text_of(e, "$.asset_id"), text_of(e, "$.market")
    listed = (wire_type(member(e, "$.bids")) == "array") & (wire_type(member(e, "$.asks")) == "array")
    head = F.coalesce(
        F.when(absent | (asset == "") | (market == ""), "missing_required_field"),
        decimal_code(text_of(e, "$.timestamp"), kind=TIME),
        F.when(~listed, "missing_required_field"),
    )
    rows = rows.select(*keep, asset.alias("asset_id"), market.alias("market"), text_of(e, "$.hash").alias("hash"), head.alias("head"))
    return rows.join(first, list(keep), "left").withColumn("code", F.coalesce("head", "level_code")).drop("head", "level_code")
