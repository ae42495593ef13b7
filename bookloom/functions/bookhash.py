"""The order-book digest: SHA-1 of compact JSON with fixed keys in fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookloom.sources.schemas import BOOK_METADATA, HASH_FIELDS

from .wire import has, member, wire_type


def quoted(text: Column) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def wire_json(value: Column) -> Column:
    """A member as the feed's own tools would print it again; null where its spelling can't be told.

    Whole numbers keep their digits. Numbers with a point are what the shortest decimal of a double shows, which for
    up to 15 digits between 1e-4 and 1e15 is the number itself. Of numbers with an exponent the spelling isn't kept.
    """
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    text = F.try_variant_get(value, "$", "string")
    plain = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")).otherwise(F.concat(text, F.lit(".0")))
    digits = F.length(F.regexp_replace(F.regexp_replace(plain, "[^0-9]", ""), "^0+", ""))
    size = F.abs(F.try_variant_get(value, "$", "decimal(38,18)"))
    sure = (digits <= 15) & ((size == 0) | ((size >= F.lit("0.0001").cast("decimal(38,18)")) & (size < 10**15)))
    return (
        F.when(kind.isin("STRING", "BOOLEAN"), F.to_json(value)).when(kind == "VOID", "null")
        .when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), text).when((kind == "DECIMAL") & sure, plain)
    )


def levels_json(levels: Column) -> Column:
    """Of an array of price and size texts, in the order given."""
    return F.to_json(F.transform(levels, lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"))))


def book_hash(market: Column, asset_id: Column, timestamp: Column, bids: Column, asks: Column, metadata: dict[str, Column]) -> Column:
    """From JSON values and arrays of levels; null where one is null."""
    parts = [("market", market), ("asset_id", asset_id), ("timestamp", timestamp), ("hash", F.lit('""')), ("bids", levels_json(bids)), ("asks", levels_json(asks))]
    parts += [(name, metadata[name]) for name in BOOK_METADATA]
    pieces = [x for k, (name, value) in enumerate(parts) for x in (F.lit(f'{"," if k else ""}"{name}":'), value)]
    return F.sha1(F.concat(F.lit("{"), *pieces, F.lit("}")))


def missing_inputs(event: Column) -> Column:
    return F.array_compact(F.array(*(F.when(~has(event, f"$.{x}"), F.lit(x)) for x in HASH_FIELDS)))


def encoded(event: Column, names: tuple[str, ...]) -> dict[str, Column]:
    """The members as wire_json()."""
    return {x: wire_json(member(event, f"$.{x}")) for x in names}


def event_hash(event: Column) -> Column:
    """Of a book event; null unless all inputs are there, spelled so that they can be told, and levels hold texts."""
    level = "array<struct<price:string,size:string>>"
    bids, asks = F.try_variant_get(event, "$.bids", level), F.try_variant_get(event, "$.asks", level)
    whole = lambda side: ~F.exists(side, lambda x: x["price"].isNull() | x["size"].isNull())
    ready = (F.size(missing_inputs(event)) == 0) & bids.isNotNull() & asks.isNotNull() & whole(bids) & whole(asks)
    e = encoded(event, ("market", "asset_id", "timestamp", *BOOK_METADATA))
    return F.when(ready, book_hash(e["market"], e["asset_id"], e["timestamp"], bids, asks, e))


def attempt_code(event: Column) -> Column:
    """Why a book event gives no digest: hash_fields_missing (it is skipped) or hash_levels_malformed (an error)."""
    level = lambda side: F.try_variant_get(event, f"$.{side}", "array<variant>")
    bad = lambda side: (
        (wire_type(member(event, f"$.{side}")) != "array")
        | F.exists(level(side), lambda x: (wire_type(x) != "object") | ~has(x, "$.price") | ~has(x, "$.size"))
    )
    return F.when(F.size(missing_inputs(event)) > 0, "hash_fields_missing").when(F.coalesce(bad("bids") | bad("asks"), F.lit(True)), "hash_levels_malformed")
