"""The set-based replay against the sequential fold, over random feeds, and the fixed cases of the feed's rules."""

import random
import re

import pytest
from bookloom.operators import replay, rest
from bookloom.streaming.replay_stream import Book, fold, replay_stream

ENTRY = "session_id string, asset_id string, seq long, event_index int, change_index int, code string, parse_code string, side string, price decimal(38,18), size decimal(38,18), has_bid boolean, best_bid decimal(38,18), best_bid_code string, has_ask boolean, best_ask decimal(38,18), best_ask_code string"
BOOKS = "session_id string, asset_id string, seq long, event_index int, code string"
LEVELS = "session_id string, asset_id string, seq long, event_index int, side string, price decimal(38,18), size decimal(38,18)"


def feed(seed, n):
    """Rows in order, as the fold reads them; claims come from a fold without claims, some spoilt."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        base = {"session_id": f"s{seq * 2 // n}", "asset_id": f"a{rng.randrange(3)}", "seq": seq, "event_index": 0, "change_index": 0}
        if rng.random() < 0.06:
            levels = [(s, f"0.{p}", str(rng.choice([0, 1, 2]))) for s in ("BUY", "SELL") for p in rng.sample(range(1, 9), rng.randint(0, 3))]
            rows.append(base | {"kind": "book", "change_index": -1, "levels": levels, "ok": rng.random() < 0.9})
            continue
        roll = rng.random()
        rows.append(base | {
            "kind": "entry", "code": "missing_required_field" if roll < 0.03 else None, "parse_code": "decimal_parse_failure" if 0.03 < roll < 0.05 else None,
            "side": rng.choice(["BUY", "SELL"]), "price": f"0.{rng.randint(1, 8)}", "size": str(rng.choice([0, 0, 1, 2])), "has_bid": False, "best_bid": None, "best_bid_code": None, "has_ask": False, "best_ask": None, "best_ask_code": None,
        })
    for r, (_, _, _, _, _, _, bid, ask, _) in zip([r for r in rows if r["kind"] == "entry"], sequential(rows), strict=True):
        if rng.random() < 0.8:
            r["has_bid"] = r["has_ask"] = True
            r["best_bid"] = rng.choice([bid or rng.choice(["0", None])] * 15 + ["0.99"])
            r["best_ask"] = rng.choice([ask or rng.choice(["1", None])] * 15 + ["0.01"])
            r["best_ask_code"] = "decimal_parse_failure" if rng.random() < 0.03 else None
    return rows


def sequential(rows):
    """By session and asset, then in order again."""
    books, out = {}, []
    for r in rows:
        if r["kind"] == "book" and not r["ok"]:
            continue
        out += fold(books.setdefault((r["session_id"], r["asset_id"]), Book()), [r])
    return out


def frames(spark, rows):
    books = [(r["session_id"], r["asset_id"], r["seq"], 0, None if r["ok"] else "malformed_level") for r in rows if r["kind"] == "book"]
    levels = [(r["session_id"], r["asset_id"], r["seq"], 0, *x) for r in rows if r["kind"] == "book" for x in r["levels"]]
    cols = [c.split()[0] for c in ENTRY.split(", ")]
    entries = [tuple(r[c] for c in cols) for r in rows if r["kind"] == "entry"]
    typed = lambda data, ddl: spark.createDataFrame(data, ddl.replace("decimal(38,18)", "string")).selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in ddl.split(", ")))
    return typed(books, BOOKS), typed(entries, ENTRY), typed(levels, LEVELS)


@pytest.mark.parametrize(("seed", "block"), [(1, 64), (2, 3), (3, 1)])
def test_batch_equals_fold(spark, seed, block, monkeypatch):
    monkeypatch.setattr(replay, "BLOCK", block)
    rows = feed(seed, 900)
    want = {(w[0]): w[3:8] for w in sequential(rows)}
    fates = replay.replay(*frames(spark, rows)).collect()
    assert len(fates) == len(want)
    plain = lambda v: None if v is None else format(v.normalize(), "f")
    for f in fates:
        assert (f.status, f.reason, f.comparison, plain(f.derived_bid), plain(f.derived_ask)) == want[f.seq], f.seq
    kinds = {f.comparison for f in fates}
    assert {"match", "mismatch", "candidate", "unparseable"} <= kinds


def test_partitions_do_not_change_fates(spark):
    rows = feed(9, 300)
    parts = frames(spark, rows)
    one = sorted(map(str, replay.replay(*parts).select("seq", "status", "reason", "comparison").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        two = sorted(map(str, replay.replay(*(p.repartition(5) for p in parts)).select("seq", "status", "reason", "comparison").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == two


def entry(seq, side, price, size, **more):
    return {"session_id": "s", "asset_id": "a", "seq": seq, "event_index": 0, "change_index": 0, "kind": "entry", "code": None, "parse_code": None, "side": side, "price": price, "size": size, "has_bid": False, "best_bid": None, "best_bid_code": None, "has_ask": False, "best_ask": None, "best_ask_code": None} | more


BOOK = {"session_id": "s", "asset_id": "a", "seq": 0, "event_index": 0, "change_index": -1, "kind": "book", "ok": True, "levels": [("BUY", "0.40", "10"), ("BUY", "0.30", "20"), ("SELL", "0.60", "12"), ("SELL", "0.70", "22")]}


def fates(spark, *rows):
    return sorted(replay.replay(*frames(spark, [BOOK, *rows])).collect(), key=lambda r: r.seq)


def test_delete_replace_idempotent(spark):
    got = fates(spark, entry(1, "BUY", "0.40", "8"), entry(2, "BUY", "0.400", "8.0"), entry(3, "BUY", "0.40", "0"), entry(4, "BUY", "0.40", "0"))
    assert [r.idempotent for r in got] == [False, True, False, True]
    assert [r.discriminating for r in got] == ["nonzero_replacement", None, "zero_delete", None]
    assert float(got[0].derived_bid) == 0.4 and float(got[3].derived_bid) == 0.3


def test_mismatch_cuts_until_the_next_book(spark):
    got = fates(spark, entry(1, "BUY", "0.5", "4", has_bid=True, best_bid="0.5"), entry(2, "BUY", "0.5", "5", has_bid=True, best_bid="0.9"), entry(3, "BUY", "0.5", "6"))
    assert [(r.status, r.comparison) for r in got] == [("applied", "match"), ("applied", "mismatch"), ("excluded", None)]
    counters = replay.update_counters(replay.replay(*frames(spark, [BOOK, entry(1, "BUY", "0.5", "4", has_bid=True, best_bid="0.9"), entry(2, "BUY", "0.5", "5")]))).first()
    assert (counters.comparisons, counters.comparison_mismatch, counters.excluded) == (1, 1, 1)


def test_empty_side_is_a_candidate(spark):
    got = fates(spark, entry(1, "SELL", "0.6", "0"), entry(2, "SELL", "0.7", "0", has_ask=True, best_ask="1"), entry(3, "BUY", "0.1", "1"))
    assert [(r.status, r.comparison) for r in got] == [("applied", None), ("applied", "candidate"), ("applied", None)]


def test_superseded_and_validated(spark):
    parts = frames(spark, [BOOK, entry(1, "BUY", "0.40", "8"), entry(2, "BUY", "0.40", "7")])
    f = replay.replay(*parts)
    matched = spark.createDataFrame([("a", 3)], "asset_id string, seq long")
    got = {r.seq: r.verdict for r in rest.validations(f, parts[0], matched).collect()}
    assert got == {1: "superseded", 2: "validated"}


def test_validations_read_an_asset_once(spark):
    """Verdicts by hand; a frame that runs to the asset's end is read anew for each row, which grows with the square."""
    parts = frames(spark, feed(5, 900))
    f = replay.replay(*parts)
    matched = [(f"a{k % 3}", k) for k in range(7, 900, 7)]
    out = rest.validations(f, parts[0], spark.createDataFrame(matched, "asset_id string, seq long"))
    assert not re.search(r"RowFrame, (?!unboundedpreceding)[^,]+, unboundedfollowing", out._jdf.queryExecution().analyzed().toString())
    applied = [r for r in f.collect() if r.status == "applied"]
    books = [(r.asset_id, r.seq) for r in parts[0].collect() if r.code is None]
    after = lambda rows, a, seq: min((n for x, n in rows if x == a and n > seq), default=None)
    want = {}
    for r in applied:
        if r.discriminating is None:
            continue
        touch = after([(x.asset_id, x.seq) for x in applied if (x.side, x.price) == (r.side, r.price)], r.asset_id, r.seq)
        gone = min((x for x in (touch, after(books, r.asset_id, r.seq)) if x is not None), default=None)
        seen = after(matched, r.asset_id, r.seq)
        verdict = "validated" if seen is not None and (gone is None or seen < gone) else "pending" if gone is None else "superseded"
        want[r.seq] = (gone, seen, verdict)
    assert {r.seq: (r.superseded_at, r.validated_at, r.verdict) for r in out.collect()} == want
    assert len(want) > 50 and {w[2] for w in want.values()} >= {"validated", "superseded"}


def test_stream_equals_fold_in_any_batches(spark, tmp_path):
    rows = feed(4, 200)
    ddl = ENTRY.replace("decimal(38,18)", "string") + ", kind string, levels array<struct<side:string,price:string,size:string>>"
    cols = [c.split()[0] for c in ddl.split(", ")]
    live = [tuple(r.get(c) for c in cols) for r in rows if r["kind"] == "entry" or r["ok"]]
    for i, part in enumerate((live[:70], live[70:150], live[150:])):
        spark.createDataFrame(part, ddl).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = replay_stream(source).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.seq: (r.status, r.reason, r.comparison, r.derived_bid, r.derived_ask) for r in spark.table("replayed").collect()}
    assert got == {w[0]: w[3:8] for w in sequential(rows)}


def test_late_rows_are_told_and_invalidate():
    book = Book()
    first = list(fold(book, [BOOK, entry(5, "BUY", "0.40", "8")]))
    assert first[0][3:5] == ("applied", None)
    book = Book(book.dump())
    late, after = fold(book, [entry(3, "BUY", "0.30", "1"), entry(6, "BUY", "0.30", "2")])
    assert late[3:5] == ("excluded", "late_row") and after[3:5] == ("excluded", "price_change_without_valid_book")
    assert next(fold(Book(book.dump()), [BOOK | {"seq": 7}, entry(8, "SELL", "0.60", "0")]))[3] == "applied"


def test_a_sessions_end_removes_its_state(spark, tmp_path):
    ddl = ENTRY.replace("decimal(38,18)", "string") + ", kind string, levels array<struct<side:string,price:string,size:string>>"
    cols = [c.split()[0] for c in ddl.split(", ")]
    end = entry(9, None, None, None) | {"kind": "end", "change_index": 0}
    for i, part in enumerate(([BOOK, entry(1, "BUY", "0.40", "8")], [end], [entry(2, "BUY", "0.40", "7")])):
        spark.createDataFrame([tuple(r.get(c) for c in cols) for r in part], ddl).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = replay_stream(source).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.seq: (r.status, r.reason) for r in spark.table("ended").collect()}
    assert got == {1: ("applied", None), 2: ("excluded", "price_change_without_valid_book")}  # not late: nothing is left of the session
