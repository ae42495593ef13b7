import json
import time
from datetime import datetime

import pytest
from bookloom.plans.config import Boundary
from bookloom.sources import evidence, live

HERE = Boundary("feed.example", "/book")


def recorded(session, tokens, start):
    """Three frames of a session, by position."""
    frames = [json.dumps({"event_type": "book", "asset_id": tokens[0]}), b"\xff", "PONG"]
    yield from ((f, i) for i, f in enumerate(frames) if i >= start)


def test_frames_of_a_supplied_connection(spark, tmp_path, monkeypatch):
    spark.dataSource.register(live.FrameSource)
    source = spark.readStream.format("bookloom_frames").options(connect="tests.core.test_live:recorded", session="s1", tokens="7,8", most="2").load()
    query = source.writeStream.format("memory").queryName("live_frames").option("checkpointLocation", str(tmp_path / "ck")).start()
    live.run_until([query], 6)
    assert not query.isActive
    rows = evidence.with_status(spark.table("live_frames")).collect()
    got = {r.ingest_sequence: (r.collector_session_id, r.payload_kind, r.parse_status, r.digest == r.raw_payload_sha256) for r in rows}
    assert got == {0: ("s1", "text", "ok", True), 1: ("s1", "bytes_base64", "invalid_utf8", True), 2: ("s1", "text", "expected_heartbeat", True)}


def test_reads_by_a_plan(spark):
    def answer(url, seconds):
        token = url.rsplit("=", 1)[1]
        if token == "2":
            raise TimeoutError("slow")
        if token == "3":
            raise ConnectionResetError("reset")
        return (302, b"") if token == "4" else (200, b'{"hash":"h"}')

    tokens = spark.createDataFrame([(str(i),) for i in range(1, 5)], "token string")
    plan = live.poll_plan(spark, tokens, datetime(2026, 5, 1), 20, 15)
    assert plan.count() == 8 and plan.select("due").distinct().count() == 2
    rows = live.read_books(plan, HERE, answer, wait=False).collect()
    assert sorted({(r.token_id, r.status_code, r.failure) for r in rows}, key=str) == [("1", 200, None), ("2", None, "rest_timeout"), ("3", None, "rest_transport_error"), ("4", None, "rest_transport_error")]
    assert all(r.raw_response == '{"hash":"h"}' and float(r.elapsed_ms) >= 0 and r.request_context == {"request_purpose": "periodic_poll"} for r in rows if r.status_code)
    found = spark.createDataFrame([("c1", "k", "x", "1", "s", 3, 2, None), ("c2", "k", "x", "9", "s", 3, 2, "targeted_rest_request_rejected")], "candidate_id string, kind string, component string, token_id string, session_id string, seq long, version long, code string")
    (one,) = live.read_books(live.targeted_plan(found), HERE, answer).collect()
    assert one.request_context["candidate_id"] == "c1"


def test_a_failed_query_stops_the_others(spark, tmp_path):
    rate = lambda: spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    ok = rate().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "a")).start()
    bad = rate().selectExpr("raise_error('gone') AS x").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "b")).start()
    with pytest.raises(Exception, match="gone"):
        live.run_until([ok, bad], 60)
    deadline = time.time() + 20
    while ok.isActive and time.time() < deadline:
        time.sleep(0.2)
    assert not ok.isActive
