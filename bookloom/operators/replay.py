"""Fail-closed book reconstruction without recursion.

Between two accepted books the state before the first bad entry is what it would be if nothing were ever
invalidated, and everything after that entry is excluded. So every entry is applied, best prices are
derived and compared, and the first bad entry of an epoch cuts it.

The best prices at an entry are the extremes of the levels alive there. A level is alive from the event
that set it to the next event at its price; that range join runs by blocks of BLOCK positions within an
epoch, so an entry meets the levels alive in its block, not all levels of the epoch. Of levels that live all
through a block only the extremes count: one row a side and block stands for them, however deep the book is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions.bookhash import book_hash, encoded, quoted
from bookloom.sources.schemas import BOOK_METADATA, DECIMAL

BLOCK = 64
KEY = ["session_id", "asset_id", "epoch"]
ORDER = ["seq", "event_index", "change_index"]


def number_events(books: DataFrame, entries: DataFrame) -> DataFrame:
    """Accepted books and entries with epoch and n, the position in the epoch (the book itself is 1).

    books: session_id, asset_id, seq, event_index, code. entries: also change_index, code, parse_code and more.
    """
    b = books.where("code IS NULL").select("session_id", "asset_id", "seq", "event_index", F.lit(-1).alias("change_index"), F.lit(True).alias("is_book"))
    both = entries.withColumn("is_book", F.lit(False)).unionByName(b, allowMissingColumns=True)
    w = W.partitionBy("session_id", "asset_id").orderBy(*ORDER)
    both = both.withColumn("epoch", F.sum(F.col("is_book").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return both.withColumn("n", F.row_number().over(W.partitionBy(*KEY).orderBy(*ORDER)))


def level_events(events: DataFrame, levels: DataFrame) -> DataFrame:
    """KEY, n, side, price, size, is_book, next_n: what sets a level, and where that ends (null: at the epoch's end).

    events: as of number_events(). levels: session_id, asset_id, seq, event_index, side, price, size.
    """
    at = ["session_id", "asset_id", "seq", "event_index"]
    texts = [c for c in ("price_text", "size_text") if c in levels.columns and c in events.columns]
    books = events.where("is_book").select("session_id", "asset_id", "epoch", "seq", "event_index", "n")
    set_by_book = books.join(levels, at).select(*KEY, "n", "side", "price", "size", *texts, F.lit(True).alias("is_book"))
    usable = (F.col("epoch") > 0) & ~F.col("is_book") & F.col("code").isNull() & F.col("parse_code").isNull()
    set_by_entry = events.where(usable).select(*KEY, "n", "side", "price", "size", *texts, F.lit(False).alias("is_book"))
    price = W.partitionBy(*KEY, "side", "price").orderBy("n")
    return set_by_book.unionByName(set_by_entry).select(
        "*",
        F.lead("n").over(price).alias("next_n"),
        F.lag("size").over(price).alias("old_size"),
        F.lag("is_book").over(price).alias("old_is_book"),
    )


def _block(n: Column) -> Column:
    return F.floor(n / BLOCK).cast("int")


def _by_block(points: DataFrame, levels: DataFrame, more: list[str]) -> DataFrame:
    """KEY, side, price, more, from_n, end_n, block and last_n: levels that are on the book, in every block up to the last point."""
    last = points.groupBy(*KEY).agg(F.max("n").alias("last_n"))
    held = levels.where("is_book OR size > 0").join(last, KEY)
    end = F.least(F.coalesce("next_n", F.col("last_n") + 1), F.col("last_n") + 1)
    held = held.withColumn("end_n", end).where("end_n > n")
    return held.select(*KEY, "side", "price", *more, F.col("n").alias("from_n"), "end_n", "last_n", F.explode(F.sequence(_block(F.col("n")), _block(F.col("end_n") - 1))).alias("block"))


def alive_at(points: DataFrame, levels: DataFrame, keep: list[str], more: list[str] = []) -> DataFrame:  # noqa: B006
    """keep, side, price, size and more of the levels that are on the book at points (KEY, n and keep).

    Levels of size 0 that a book set are on it; an entry of size 0 takes its level off.
    """
    held = _by_block(points, levels, ["size", *more])
    at = points.select(*KEY, "n", *(c for c in keep if c not in KEY and c != "n"), _block(F.col("n")).alias("block"))
    met = at.join(held, [*KEY, "block"]).where("n >= from_n AND n < end_n")
    return met.select(*keep, "side", "price", "size", *more)


def best_prices(points: DataFrame, levels: DataFrame) -> DataFrame:
    """KEY, n, derived_bid, derived_ask: null where a side has no level with size."""
    held = _by_block(points, levels.where("size > 0"), [])
    bid, ask = (F.when(F.col("side") == s, F.col("price")) for s in ("BUY", "SELL"))
    through = (F.col("from_n") <= F.col("block") * BLOCK) & (F.col("end_n") >= F.least((F.col("block") + 1) * BLOCK, F.col("last_n") + 1))
    whole = held.where(through).groupBy(*KEY, "block").agg(F.max(bid).alias("whole_bid"), F.min(ask).alias("whole_ask"))
    at = points.select(*KEY, "n", _block(F.col("n")).alias("block"))
    part = held.where(~through).select(*KEY, "block", "from_n", "end_n", bid.alias("part_bid"), ask.alias("part_ask"))
    met = at.join(part, [*KEY, "block"]).where("n >= from_n AND n < end_n")
    found = met.groupBy(*KEY, "n").agg(F.max("part_bid").alias("part_bid"), F.min("part_ask").alias("part_ask"))
    out = at.join(whole, [*KEY, "block"], "left").join(found, [*KEY, "n"], "left")
    return out.select(*KEY, "n", F.greatest("whole_bid", "part_bid").alias("derived_bid"), F.least("whole_ask", "part_ask").alias("derived_ask"))


def _outcome(name: str, empty: int) -> Column:
    """Of one supplied best price against the derived one."""
    seen, derived = F.col(f"best_{name}"), F.col(f"derived_{name}")
    return (
        F.when(~F.coalesce(f"has_{name}", F.lit(False)), None)
        .when(F.col(f"best_{name}_code").isNotNull(), "unparseable")
        .when(seen.eqNullSafe(derived), "match")
        .when(derived.isNull() & (seen == empty), "candidate")
        .otherwise("mismatch")
    )


def replay(books: DataFrame, entries: DataFrame, levels: DataFrame) -> DataFrame:
    """Every entry with its fate.

    status: applied or excluded; reason: the code of an exclusion; bid_outcome, ask_outcome: of best
    prices that were looked at; comparison: match, candidate, mismatch or unparseable (null: none supplied);
    old_size and old_exists of its level; idempotent; discriminating: zero_delete, nonzero_replacement.
    """
    events = number_events(books, entries)
    return judge(events, level_events(events, levels))


def judge(events: DataFrame, changed: DataFrame) -> DataFrame:
    """replay() of numbered events and their level events; both are read more than once, so stage them where large."""
    points = events.where("NOT is_book AND epoch > 0 AND code IS NULL AND parse_code IS NULL")
    best = best_prices(points, changed)
    before = changed.where("NOT is_book").select(*KEY, "n", "old_size", F.coalesce(F.col("old_is_book") | (F.col("old_size") > 0), F.lit(False)).alias("old_exists"))
    e = events.where("NOT is_book").join(best, [*KEY, "n"], "left").join(before, [*KEY, "n"], "left")
    bid = _outcome("bid", 0)
    ask = F.when(~F.coalesce(F.col("bid_outcome") == "unparseable", F.lit(False)), _outcome("ask", 1))
    e = e.withColumn("bid_outcome", bid).withColumn("ask_outcome", ask)
    either = lambda kind: F.coalesce(F.col("bid_outcome") == kind, F.lit(False)) | F.coalesce(F.col("ask_outcome") == kind, F.lit(False))
    comparison = F.when(either("unparseable"), "unparseable").when(either("mismatch"), "mismatch").when(either("candidate"), "candidate").when(either("match"), "match")
    e = e.withColumn("comparison", comparison)
    bad = F.col("code").isNull() & (F.col("parse_code").isNotNull() | F.coalesce(F.col("comparison").isin("mismatch", "unparseable"), F.lit(False)))
    e = e.withColumn("first_bad", F.min(F.when(bad, F.col("n"))).over(W.partitionBy(*KEY)))
    reason = (
        F.when(F.col("code").isNotNull(), F.col("code"))
        .when((F.col("epoch") == 0) | (F.col("n") > F.col("first_bad")), "price_change_without_valid_book")
        .otherwise(F.col("parse_code"))
    )
    e = e.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "applied").otherwise("excluded"))
    on = F.col("status") == "applied"
    zero, exists = F.col("size") == 0, F.col("old_exists")
    out = {c: F.when(on, F.col(c)) for c in ("bid_outcome", "ask_outcome", "comparison", "derived_bid", "derived_ask", "old_size", "old_exists")}
    out["idempotent"] = F.when(on, F.when(zero, ~exists).otherwise(exists & (F.col("old_size") == F.col("size"))))
    out["discriminating"] = F.when(on, F.when(zero & exists & (F.col("old_size") > 0), "zero_delete").when(~zero & exists & (F.col("old_size") != F.col("size")), "nonzero_replacement"))
    return e.withColumns(out).drop("is_book")


def update_counters(fates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Entries, applied, excluded, zero and non-zero, by side, idempotent, discriminating, comparisons and components."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    on = F.col("status") == "applied"
    c = F.col
    parts = [F.count("*").alias("entries"), n(on, "applied"), n(~on, "excluded"), n(on & (c("size") == 0), "zero_updates"), n(on & (c("size") != 0), "nonzero_updates")]
    parts += [n(on & (c("side") == "BUY"), "buy_updates"), n(on & (c("side") == "SELL"), "sell_updates"), n(c("idempotent"), "idempotent")]
    parts += [n(c("discriminating") == k, k) for k in ("zero_delete", "nonzero_replacement")]
    parts += [n(c("comparison").isNotNull(), "comparisons")]
    parts += [n(c("comparison") == k, f"comparison_{k}") for k in ("match", "candidate", "mismatch")]
    for side in ("bid", "ask"):
        o = c(f"{side}_outcome")
        parts += [n(o.isin("match", "candidate", "mismatch"), f"{side}_total"), *(n(o == k, f"{side}_{k}") for k in ("match", "candidate", "mismatch"))]
    return fates.groupBy(*by).agg(*parts)


def versions(books: DataFrame, fates: DataFrame) -> DataFrame:
    """asset_id, ORDER, session_id, epoch, n, version: one more for each accepted book and applied entry, across sessions."""
    b = books.where("code IS NULL").select("session_id", "asset_id", "seq", "event_index", F.lit(-1).alias("change_index"))
    a = fates.where("status = 'applied'").select("session_id", "asset_id", *ORDER)
    w = W.partitionBy("asset_id").orderBy(*ORDER)
    return b.unionByName(a).withColumn("version", F.row_number().over(w))


def hash_books(found: DataFrame, events: DataFrame) -> DataFrame:
    """KEY, market and the metadata columns, as JSON, of the book that opens each epoch.

    found: events with session_id, seq, event_index; events: as of number_events().
    """
    e = F.col("event")
    meta = encoded(e, BOOK_METADATA)
    said = found.where("code IS NULL AND event_type = 'book'").select("session_id", "seq", "event_index", quoted(F.try_variant_get(e, "$.market", "string")).alias("market"), *(v.alias(k) for k, v in meta.items()))
    return events.where("is_book").select(*KEY, "seq", "event_index").join(said, ["session_id", "seq", "event_index"]).select(*KEY, "market", *BOOK_METADATA)


def hash_points(found: DataFrame, fates: DataFrame) -> DataFrame:
    """KEY, ORDER, n, timestamp (as JSON) and observed hash of applied entries."""
    stamp = encoded(F.col("event"), ("timestamp",))["timestamp"]
    said = found.where("code IS NULL AND event_type = 'price_change'").select("session_id", "seq", "event_index", stamp.alias("timestamp"))
    applied = fates.where("status = 'applied'").select(*KEY, *ORDER, "n", F.col("hash").alias("observed"))
    return applied.join(said, ["session_id", "seq", "event_index"])


def change_hashes(points: DataFrame, changed: DataFrame, books: DataFrame) -> DataFrame:
    """points (as of hash_points()) with computed: the digest after each entry; null where the book had not all metadata.

    changed: level_events() of levels that hold price_text and size_text. books: as of hash_books(). Bids fall, asks
    rise, levels of size 0 are left out. A digest is of the whole book, so all its levels meet in a row for it.
    """
    met = alive_at(points.select(*KEY, "n"), changed.where("size > 0"), [*KEY, "n"], ["price_text", "size_text"])
    level = F.struct("price", F.col("price_text"), F.col("size_text"))
    side = lambda s: F.array_sort(F.array_compact(F.collect_list(F.when(F.col("side") == s, level))))
    shown = met.groupBy(*KEY, "n").agg(F.reverse(side("BUY")).alias("bids"), side("SELL").alias("asks"))
    kind = f"array<struct<price:{DECIMAL},price_text:string,size_text:string>>"
    named = lambda c: F.transform(F.coalesce(c, F.array().cast(kind)), lambda x: F.struct(x["price_text"].alias("price"), x["size_text"].alias("size")))
    rows = points.join(shown, [*KEY, "n"], "left").join(books, KEY)
    digest = book_hash(F.col("market"), quoted(F.col("asset_id")), F.col("timestamp"), named(F.col("bids")), named(F.col("asks")), {x: F.col(x) for x in BOOK_METADATA})
    return rows.select(*points.columns, digest.alias("computed"))


def hash_counters(checked: DataFrame) -> DataFrame:
    """shape, attempts, matches, mismatches, skipped; checked: shape, observed, computed (null: skipped)."""
    tried = F.col("computed").isNotNull()
    good = F.coalesce(F.col("observed") == F.col("computed"), F.lit(False))
    return checked.groupBy("shape").agg(F.count_if(tried).alias("attempts"), F.count_if(tried & good).alias("matches"), F.count_if(tried & ~good).alias("mismatches"), F.count_if(~tried).alias("skipped"))
