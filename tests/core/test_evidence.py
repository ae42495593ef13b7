import json
from datetime import datetime
from decimal import Decimal

import pytest
from bookloom.functions import bookhash, exact, wire
from bookloom.operators import archive, frames, ordered, repeats, snapshot
from bookloom.plans import config, report
from bookloom.sources import evidence
from pyspark.sql import functions as F


def decoded(spark, payloads):
    df = spark.createDataFrame([(i, "text", p) for i, p in enumerate(payloads)], "ingest_sequence long, payload_kind string, raw_payload string")
    return evidence.with_status(df)


BOOK = {"event_type": "book", "asset_id": "7", "market": "m", "bids": [{"price": "0.40", "size": "10.00"}, {"price": "0.30", "size": "20.00"}], "asks": [{"price": "0.60", "size": "12.00"}], "timestamp": "1787702400000", "hash": "x", "min_order_size": "5", "tick_size": "0.01", "neg_risk": False, "last_trade_price": "0.5"}


def test_status_of_frames(spark):
    rows = [(1, "text", "PONG"), (2, "bytes_base64", "UE9ORw=="), (3, "bytes_base64", "/w=="), (4, "text", "{"), (5, "text", "[]"), (6, "text", '{"a":1,"a":2}')]
    df = spark.createDataFrame(rows, "ingest_sequence long, payload_kind string, raw_payload string")
    got = {r.ingest_sequence: r.parse_status for r in evidence.with_status(df).collect()}
    assert got == {1: "expected_heartbeat", 2: "invalid_json", 3: "invalid_utf8", 4: "invalid_json", 5: "ok", 6: "invalid_json"}


def test_events_and_their_codes(spark):
    found = frames.events(decoded(spark, ["3", '[{"event_type":"book"},7,{"event_type":""},{"event_type":5}]', '{"event_type":"later"}', "[]", "{", "PONG"]))
    got = sorted((r.ingest_sequence, r.event_index or 0, r.code, r.event_type) for r in found.collect())
    assert got == [(0, 0, "unexpected_json_shape", None), (1, 0, None, "book"), (1, 1, "unexpected_event_shape", None), (1, 2, "missing_event_type", None), (1, 3, "missing_event_type", None), (2, 0, None, "later"), (4, 0, "invalid_json", None)]
    assert [r.event_type for r in frames.unexpected_types(found).collect()] == ["later"]


def test_exact_numbers(spark):
    cases = {"0.10": None, "1e-3": None, "1_0": "decimal_parse_failure", "": "decimal_parse_failure", "NaN": "decimal_not_finite", "-Infinity": "decimal_not_finite", "0.1000000000000000000000001": None, "0.1000000000000000000000000": None, "0.10000000000000000000000001": "decimal_precision_unsupported"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r for r in df.select("t", exact.decimal_code(df.t).alias("c"), exact.exact(df.t).alias("v"), exact.plain_text(exact.exact(df.t)).alias("p")).collect()}
    assert {k: r.c for k, r in got.items()} == cases
    assert got["1e-3"].v == Decimal("0.001") and got["1e-3"].p == "0.001" and got["0.10"].p == "0.1"
    assert got["0.1000000000000000000000001"].v == Decimal("0.1000000000000000000000001")


def test_book_checks(spark):
    twice = BOOK | {"bids": [{"price": "0.40", "size": "1"}, {"price": "0.400", "size": "1"}]}
    number = BOOK | {"bids": [{"price": 0.4, "size": "1"}]}
    void = {k: v for k, v in BOOK.items() if k != "hash"}
    blank = BOOK | {"asset_id": None}
    found = frames.events(decoded(spark, [json.dumps(x) for x in (BOOK, twice, number, void, BOOK | {"bids": []}, blank, BOOK | {"bids": 3})]))
    got = {r.ingest_sequence: (r.asset_id, r.code) for r in frames.books(found).collect()}
    assert got == {0: ("7", None), 1: ("7", "duplicate_snapshot_level"), 2: ("7", "decimal_not_string"), 3: ("7", "missing_required_field"), 4: ("7", None), 5: ("None", None), 6: ("7", "missing_required_field")}


def test_book_hash(spark):
    import hashlib

    plain = {k: BOOK[k] for k in ("market", "asset_id", "timestamp")} | {"hash": "", "bids": BOOK["bids"], "asks": BOOK["asks"]} | {k: BOOK[k] for k in ("min_order_size", "tick_size", "neg_risk", "last_trade_price")}
    want = hashlib.sha1(json.dumps(plain, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    numbers = [0.01, 5, 5.0, 0.5, 120, 0.0001, -3, 0, 0.0, 1234567.125]
    payloads = [BOOK, {k: v for k, v in BOOK.items() if k != "tick_size"}, BOOK | {"bids": 3}, BOOK | {"bids": [{"price": "1"}]}, *(BOOK | {"tick_size": x} for x in numbers)]
    found = frames.events(decoded(spark, [json.dumps(x) for x in payloads] + [json.dumps(BOOK).replace('"0.01"', "1e-3")]))
    e = F.col("event")
    got = {r.ingest_sequence: (r.h, r.c) for r in found.select("ingest_sequence", bookhash.event_hash(e).alias("h"), bookhash.attempt_code(e).alias("c")).collect()}
    assert [got[i] for i in range(4)] == [(want, None), (None, "hash_fields_missing"), (None, "hash_levels_malformed"), (None, "hash_levels_malformed")]
    for i, x in enumerate(numbers, 4):
        assert got[i][0] == hashlib.sha1(json.dumps(plain | {"tick_size": x}, separators=(",", ":")).encode()).hexdigest(), x
    assert got[len(payloads)] == (None, None)  # the spelling of exponents isn't kept


def test_entries_tell_missing_from_null(spark):
    e = {"asset_id": "7", "price": "0.5", "size": "1", "side": "BUY", "hash": "h"}
    changes = [e, {k: v for k, v in e.items() if k != "size"}, e | {"size": "x"}, e | {"price": "1.5"}, e | {"side": "UP"}, 5, e | {"best_bid": None, "best_ask": "0.6"}, e | {"best_bid": 0.5}]
    found = frames.events(decoded(spark, [json.dumps({"event_type": "price_change", "market": "m", "timestamp": "1", "price_changes": changes}), json.dumps({"event_type": "price_change", "price_changes": [e]})]))
    got = sorted(frames.entries(found).collect(), key=lambda r: (r.ingest_sequence, r.change_index))
    assert [(r.code, r.parse_code) for r in got] == [(None, None), ("missing_required_field", None), (None, "decimal_parse_failure"), (None, "price_out_of_bounds"), (None, "invalid_side"), ("malformed_price_change", None), (None, None), (None, None), ("missing_required_field", None)]
    assert (got[0].has_bid, got[6].has_bid, got[6].best_bid, got[6].best_bid_code, got[6].best_ask) == (False, True, None, None, Decimal("0.6"))
    assert got[7].best_bid_code == "decimal_not_string"


def test_paths_and_tokens(spark):
    found = frames.events(decoded(spark, ['{"event_type":"x","future":{"nested":[{"sequence_id":1},null]},"assets_ids":["9","8"],"asset_id":"8"}'])).withColumn("k", F.col("ingest_sequence"))
    paths = wire.field_paths(found.where("code IS NULL"), "k")
    got = {(r.path, r.wire_type) for r in paths.collect()}
    assert {("future", "object"), ("future.nested[]", "object"), ("future.nested[]", "null"), ("future.nested[].sequence_id", "number")} <= got
    assert [tuple(r) for r in frames.ordering_fields(paths, "k").collect()] == [("future.nested[].sequence_id", 1)]
    assert found.select(wire.event_tokens(F.col("event"))).first()[0] == ["8", "9"]


def test_repeats_compare_first_with_last(spark):
    rows = [(1, i, "a", "BUY", "4", s) for i, s in enumerate("121")] + [(2, i, "a", "BUY", "4", s) for i, s in enumerate("12")] + [(3, 0, "a", "BUY", "4", "1"), (3, 1, "b", "BUY", "4", "2")]
    got = {r.frame: r for r in repeats.frame_repeats(spark.createDataFrame(rows, "frame long, change_index long, asset_id string, side string, price_key string, size_key string")).collect()}
    assert [(got[i].repeated_keys, got[i].order_sensitive, got[i].same_asset) for i in (1, 2, 3)] == [(1, False, True), (1, True, True), (0, False, False)]


def test_archive_rules_do_not_depend_on_order(spark):
    t = datetime(2026, 5, 1)
    rows = [(1, "m", "a", t, "price_change", "BUY", 4, 1, True, None, None), (2, "m", "a", t, "price_change", "BUY", 4, 1, True, None, None), (3, "m", "b", t, "price_change", "BUY", 4, 1, True, None, None), (4, "m", "b", t, "price_change", "BUY", 4, 2, True, None, None),
            (5, "m", "c", t, "book", "BUY", 0, 0, True, "k", None), (6, "m", "c", t, "price_change", "BUY", 4, 7, True, None, None), (7, "m", "d", t, "book", "BUY", 0, 0, True, "k", None), (8, "m", "d", t, "price_change", "SELL", 9, 0, True, None, None), (9, "m", "e", t, "book", "BUY", 0, 0, False, "k", None)]
    df = spark.createDataFrame(rows, "row_id long, market string, asset_id string, received timestamp, event_type string, side string, price long, size long, ok boolean, book_key string, tick_key string")
    levels = spark.createDataFrame([(5, "BUY", 4, 1), (7, "BUY", 4, 1)], "row_id long, side string, price long, size long")
    for data in (df, df.orderBy(F.desc("row_id")).repartition(5)):
        got = {r.asset_id: r["class"] for r in archive.classify(data, levels).collect()}
        assert got == {"a": "invariant", "b": "ambiguous_change", "c": "ambiguous_interaction", "d": "invariant", "e": "ambiguous_unparseable"}


def test_source_times_of_one_ordinal_do_not_depend_on_order(spark):
    t = datetime(2026, 5, 1)
    rows = [("m", "a", t, n, t.replace(second=s)) for n, s in ((1, 9), (1, 3), (1, 6), (2, 5), (2, 8), (3, 8))]
    for data in (rows, rows[::-1], sorted(rows)):
        df = spark.createDataFrame(data, "market string, asset_id string, received timestamp, ordinal long, source timestamp").coalesce(1)
        (got,) = archive.source_times(df).collect()
        assert (got.source_times, got.span_ms, got.regressions) == (5, 6000, 1)  # 9 to 5, from the first ordinal to the second


def test_snapshot_sees_nothing_later(spark):
    states = spark.createDataFrame([("a", 10, 1.0, 2.0, True), ("a", 20, 3.0, 4.0, False)], "asset_id string, received long, best_bid double, best_ask double, valid boolean")
    asked = spark.createDataFrame([("a", 9), ("a", 10), ("a", 19), ("a", 25), ("b", 30)], "asset_id string, at long")
    got = {(r.asset_id, r.at): (r.best_bid, r.valid) for r in snapshot.market_snapshot(asked, states).collect()}
    assert got == {("a", 9): (None, False), ("a", 10): (1.0, True), ("a", 19): (1.0, True), ("a", 25): (None, False), ("b", 30): (None, False)}


def test_runs_are_written_once(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "ä", None)], "ingest_sequence long, event string, note string")
    evidence.write_records(df, str(tmp_path), "control")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        evidence.write_records(df, str(tmp_path), "control")
    line = spark.read.text(str(tmp_path / "control-events.jsonl")).first()[0]
    assert line == '{"event":"ä","ingest_sequence":1,"note":null}'
    import hashlib

    (tmp_path / "a b+c.txt").write_text("x")
    for large in (1 << 20, 0):
        monkeypatch.setattr(evidence, "LARGE", large)
        got = {r.file: (r.bytes, r.sha256) for r in evidence.manifest(spark, str(tmp_path)).collect()}
        assert got["a b+c.txt"] == (1, hashlib.sha256(b"x").hexdigest()) and len(got) >= 2


def test_shards_and_samples(spark):
    shards = spark.createDataFrame([(0, "x"), (0, "x"), (2, "y")], "shard int, sample string")
    got = {tuple(r) for r in evidence.check_shards(spark, shards, 3, "x").collect()}
    assert got == {(1, "missing"), (0, "duplicate"), (2, "wrong_sample")}
    a, b = datetime(2026, 5, 1, 3), datetime(2026, 5, 2, 3)
    assert evidence.pick_samples([a, b], {datetime(2026, 5, 1, 5), b}) == {a: datetime(2026, 5, 1, 5), b: b}
    with pytest.raises(LookupError):
        evidence.pick_samples([a], {a})


def test_capture_boundary():
    ok = config.CaptureConfig(("1", "2"), "out/x", "out")
    ok.validate()
    for bad in (("1", "1"), (), ("x",), ("1" * 101,)):
        with pytest.raises(ValueError):
            config.CaptureConfig(bad, "out/x", "out").validate()
    with pytest.raises(ValueError):
        config.CaptureConfig(("1",), "elsewhere", "out").validate()
    config.check_request("GET", "https://h/book?token_id=1", {}, "h", "/book")
    for method, url, headers in (("POST", "https://h/book?token_id=1", {}), ("GET", "http://h/book?token_id=1", {}), ("GET", "https://h/book?token_id=1&x=2", {}), ("GET", "https://h/book?token_id=1", {"Cookie": "x"})):
        with pytest.raises(PermissionError):
            config.check_request(method, url, headers, "h", "/book")


def test_capture_says_all_that_is_wrong(tmp_path):
    with pytest.raises(ValueError, match="seconds from 30 to 900; rest_interval from 5 to 120; each token once") as e:
        config.CaptureConfig(("1", "1", "x"), "/else", str(tmp_path), seconds=5, rest_interval=500, baseline=str(tmp_path / "none")).validate()
    assert "'x'" in str(e.value) and "output below" in str(e.value) and "baseline is a file" in str(e.value)
    with pytest.raises(PermissionError, match="redirect"):
        config.Boundary("h", "/book").check_response(302)
    config.Boundary("h", "/book").check_response(200)
    assert config.subscription(("1", "2")) == {"assets_ids": ["1", "2"], "type": "market"}
    told = config.subscription_metadata(("1",))
    assert told["type_field_sent"] and not told["custom_feature_enabled_field_sent"] and told["market_subscription_fields"] == ["assets_ids", "type"]
    assert config.provenance(tmp_path)["git_commit"] is None and set(config.provenance(tmp_path)) >= {"git_dirty", "python", "pyspark"}
    assert config.within_gate(0.25, 0.5, 100, 75) == (75.0, True) and config.within_gate(0.25, 0.5, 101, 75)[1] is False
    assert config.shard_gate(343.0, 41.0, 32, 5400)[1] and config.shard_gate(0, 591.0, 28, 5400) == (16548.0, False)
    assert config.run_id(datetime(2026, 5, 1)).startswith("20260501T000000.000000Z-")


def test_order_is_carried_over_ranges(spark):
    import random

    rng = random.Random(3)
    rows = [(i, i - (5 if rng.random() < 0.2 else 0), None if rng.random() < 0.3 else i * 10 - (100 if rng.random() < 0.2 else 0)) for i in range(200)]
    want_s = sum(b[1] <= a[1] for a, b in zip(rows, rows[1:], strict=False))
    last, want_m = None, 0
    for _, _, m in rows:
        if m is not None:
            want_m += last is not None and m < last
            last = m
    df = spark.createDataFrame(rows, "eid long, ingest_sequence long, received_monotonic_ns long").repartition(5)
    for span in (3, 64, 1000):
        cut = df.withColumn("span", ordered.span_of(F.col("eid"), span))
        got = frames.receive_order(cut, ["eid"], ["span"])
        assert (got.where("sequence_regressed").count(), got.where("monotonic_regressed").count()) == (want_s, want_m)
        codes = {r.code: r.errors for r in frames.errors(frames.receive_errors(got)).collect()}
        assert codes == {"websocket_ingest_sequence_regression": want_s, "websocket_monotonic_receive_regression": want_m}
        numbers = ordered.numbered(cut.select("eid", "span"), ["span"], ["eid"], "k", 7)
        assert sorted((r.eid, r.k) for r in numbers.collect()) == [(i, i + 8) for i in range(200)]


def test_archive_files_and_their_schema(spark, tmp_path):
    rows = spark.range(10).selectExpr("'m' AS market", "concat('a', id % 3) AS asset_id", "timestamp'2026-05-01' AS timestamp_received", "'book' AS event_type")
    rows.write.parquet(str(tmp_path / "h"))
    got = evidence.read_archive(spark, str(tmp_path / "h"), ["asset_id", "price"])
    assert got.columns == ["asset_id", "price"] and got.where("price IS NULL").count() == 10
    assert ("old_tick_size", "string", None) in evidence.schema_drift(rows) and ("market", "string", "string") not in evidence.schema_drift(rows)
    assert evidence.schema_drift(rows.withColumn("new", F.lit(1)))[-1] == ("timestamp", "timestamp", None) or ("new", None, "int") in evidence.schema_drift(rows.withColumn("new", F.lit(1)))
    shards = rows.select("market", "asset_id").withColumn("s", archive.shard_of(4))
    assert shards.groupBy("asset_id").agg(F.count_distinct("s").alias("n")).where("n > 1").isEmpty()
    top = archive.largest_shard(rows, 4).first()
    assert top.rows == max(r["count"] for r in shards.groupBy("s").count().collect())
    evidence.write_shard(rows, str(tmp_path), 3)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        evidence.write_shard(rows, str(tmp_path), 3)


def test_regime_gaps_and_stale_sources(spark):
    t = lambda h, m=0: datetime(2026, 5, 1, h, m)
    asked = spark.createDataFrame([(t(1), t(0), True), (t(3), t(0), True), (t(3), t(2, 30), True), (t(3), None, False)], "at timestamp, as_of timestamp, valid boolean")
    gaps = spark.createDataFrame([(t(2),), (t(1, 30),)], "received timestamp")
    got = sorted(((r["at"], r["as_of"] or t(9)), r.valid) for r in snapshot.gap_checked(asked, gaps).collect())
    assert [v for _, v in got] == [True, False, True, False]
    rows = spark.createDataFrame([("a", 1, 100), ("a", 2, 95), ("a", 3, 60)], "token string, seq long, source_ms long")
    assert [r.seq for r in snapshot.stale_sources(rows, 10).collect()] == [3] and snapshot.stale_sources(rows).count() == 0
    days = spark.sql("SELECT timestamp'2026-04-27' AS t UNION ALL SELECT timestamp'2026-04-28'")
    assert days.where(snapshot.in_regime(F.col("t"))).count() == 1


def test_evidence_run(spark, tmp_path):
    run = evidence.EvidenceRun(spark, str(tmp_path), "r1")
    with pytest.raises(FileExistsError):
        evidence.EvidenceRun(spark, str(tmp_path), "r1")
    run.start({"b": 1, "a": "é"})
    assert (tmp_path / "r1/initial-config.json").read_text() == '{"a":"é","b":1}\n'
    with pytest.raises(Exception, match="exist"):
        run.start({})
    frames_ = spark.range(30).selectExpr("id", "id div 7 AS span", "'websocket' AS record_type", "concat('p', id) AS raw_payload")
    run.append(frames_, "websocket", ["span"], ["id"])
    run.append(spark.range(5).selectExpr("id", "0 AS span", "'control' AS record_type", "'heartbeat_sent' AS event"), "control", ["span"], ["id"])
    run.append(frames_.limit(3), "websocket", ["span"], ["id"])
    assert run.counts == {"websocket": 33, "control": 5} and run.last_sequence == 38
    got = evidence.read_records(spark, run.path, "websocket")
    assert sorted(r.ingest_sequence for r in got.collect()) == [*range(1, 31), *range(36, 39)]
    assert {r.raw_payload for r in got.where("ingest_sequence = 4").collect()} == {"p3"}
    found = run.close({"run": {"run_id": "r1"}}, "# r1\n")
    assert found["files"]["initial-config.json"]["bytes"] == len('{"a":"é","b":1}\n'.encode())
    assert evidence.read_document(spark, f"{run.path}/summary.json")[0] == {"run": {"run_id": "r1"}} and (tmp_path / "r1/report.md").read_text() == "# r1\n"
    with pytest.raises(RuntimeError):
        run.append(frames_, "websocket", ["span"], ["id"])


def test_reports_are_stable_and_read_older_documents():
    s = {"run": {"run_id": "r|1", "websocket_level": 2}, "evidence": {"records": {"websocket": 3}}, "q1": {"status": "CONFIRMED", "event_schema": {"book": {"events": 2, "fields": {}}}}, "q8": {"status": "UNRESOLVED", "delay_ms_local_clock_dependent": {"p50": "1.5", "count": 4}}, "errors": {"counts": {"x": 5}, "examples": [{"code": "x", "n": i} for i in range(5)]}}
    text = report.render(s)
    assert text == report.render(json.loads(json.dumps(s))) and "r\\|1" in text and "| P50 ms | 1.5 |" in text and "| Level | sent as 2 |" in text
    assert text.count('{"code":"x"') == 3 and "and 2 more" in text and "2 events of 1 types" in text
    other = s | {"q1": {"status": "CONTRADICTED"}, "q3": {"status": "CONFIRMED"}, "run": {"run_id": "b", "level_field_sent": False}}
    both = report.compare(s, other)
    assert "| q1 | CONFIRMED | CONTRADICTED | CONFIRMED -> CONTRADICTED |" in both and "| q2 | UNRESOLVED | UNRESOLVED | UNCHANGED |" in both and "UNRESOLVED -> CONFIRMED" in both and "left out" in both
    with pytest.raises(TypeError):
        report.compare({}, s)


def test_bundles_and_their_files(spark, tmp_path):
    rows = spark.range(20).selectExpr("id", "timestamp_seconds(id) AS ts_event")
    rows.coalesce(1).write.parquet(str(tmp_path / "b/l2"))
    rows.coalesce(1).write.option("header", "true").csv(str(tmp_path / "b/trades"))
    (tmp_path / "b/raw").mkdir()
    (tmp_path / "b/raw/x.jsonl").write_text('{"msg_seq":1}\n{"msg_seq":3}\n')
    got = evidence.read_bundle(spark, str(tmp_path / "b"))
    assert {k: v.count() for k, v in got.items()} == {"raw": 2, "l2": 20, "trades": 20}
    assert got["raw"].select("source_file", "source_part").distinct().collect() == [("x.jsonl", "raw")]
    with pytest.raises(PermissionError):
        evidence.read_bundle(spark, "https://h/b")
    scan = spark.read.parquet(str(tmp_path / "b/l2"))
    name = next(p.name for p in (tmp_path / "b/l2").glob("*.parquet"))
    (r,) = evidence.file_provenance(spark, scan, "ts_event", {name: "hour 5"}).collect()
    import hashlib

    assert (r.file, r.rows, r.requested, r.sha256) == (name, 20, "hour 5", hashlib.sha256((tmp_path / "b/l2" / name).read_bytes()).hexdigest())
    assert r.bytes == (tmp_path / "b/l2" / name).stat().st_size and "ts_event" in r.schema and r["first"] < r["last"]
