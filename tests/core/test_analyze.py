import hashlib
import json
import re

from bookloom.plans import analyze, report, verdict_queries


def book(ts, bids, asks):
    level = lambda x: [{"price": p, "size": s} for p, s in x]
    return {"event_type": "book", "asset_id": "7", "market": "m", "bids": level(bids), "asks": level(asks), "timestamp": str(ts), "hash": "h", "min_order_size": "5", "tick_size": "0.01", "neg_risk": False, "last_trade_price": "0.5"}


def change(ts, side, price, size, **more):
    return {"event_type": "price_change", "market": "m", "timestamp": str(ts), "price_changes": [{"asset_id": "7", "price": price, "size": size, "side": side, "hash": "h"} | more]}


def write(path, records, folder):
    (folder / path).write_text("".join(json.dumps(r) + "\n" for r in records))


def run_dir(folder, wrong=False):
    bids, asks = [("0.40", "10"), ("0.30", "20")], [("0.60", "12")]
    ws, seq = [], 0
    t0 = 1_787_702_400_000
    for session in ("s1", "s2"):
        for i, payload in enumerate([book(t0 + seq, bids, asks), change(t0 + seq + 1, "BUY", "0.40", "8", best_bid="0.90" if wrong else "0.4", best_ask="0.60"), change(t0 + seq + 2, "SELL", "0.60", "0", best_bid="0.40", best_ask="1")]):
            seq += 10
            ws.append({"collector_session_id": session, "ingest_sequence": seq, "received_at": f"2026-08-26T00:00:{seq % 60:02d}.000000Z", "received_monotonic_ns": seq, "payload_kind": "text", "raw_payload": json.dumps(payload)})
    ws.append({"collector_session_id": "s2", "ingest_sequence": seq + 1, "received_at": "2026-08-26T00:01:05.000000Z", "received_monotonic_ns": seq + 1, "payload_kind": "text", "raw_payload": "PONG"})
    depth = book(t0, [("0.40", "8"), ("0.30", "20")], [])

    def read(seq, session, version, **more):
        window = {f"state_{k}_{w}": v for k, v in (("version", version), ("session", session), ("valid", True)) for w in ("before", "after")}
        return {"token_id": "7", "ingest_sequence": seq, "status_code": 200, "payload_kind": "text", "raw_response": json.dumps(depth), **window} | more

    targeted = lambda c: {"request_context": {"request_purpose": "empty_side_boundary_candidate", "candidate_id": c}}
    rest = [read(31, "s1", 3, **targeted("30:0:best_ask")), read(65, "s2", 6, **targeted("60:0:best_ask")), read(66, "s2", 5), read(67, "s2", 6, status_code=503)]
    control = [{"ingest_sequence": n, "event": ev, "details": {"session_id": s}} for n, (s, ev) in enumerate([("s1", "controlled_disconnect_requested"), ("s1", "websocket_session_ended"), ("s2", "controlled_disconnect_requested"), ("s2", "websocket_session_ended")], 100)]
    write("raw-websocket.jsonl", ws, folder)
    write("raw-rest-book.jsonl", rest, folder)
    write("control-events.jsonl", control, folder)
    return str(folder)


def digest(b, ts, bids, asks):
    level = lambda x: [{"price": p, "size": n} for p, n in x]
    plain = {"market": b["market"], "asset_id": b["asset_id"], "timestamp": ts, "hash": "", "bids": level(bids), "asks": level(asks)} | {k: b[k] for k in ("min_order_size", "tick_size", "neg_risk", "last_trade_price")}
    return hashlib.sha1(json.dumps(plain, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_run_to_report(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    good = analyze.summarize(spark, run_dir(tmp_path / "a"), {"run_id": "a"}, ("7",))
    status = {q: good[q]["status"] for q in report.QUESTIONS}
    assert status == {"q1": "UNRESOLVED", "q2": "CONFIRMED", "q3": "CONFIRMED", "q4": "UNRESOLVED", "q5": "UNRESOLVED", "q6": "CONFIRMED", "q7": "CONFIRMED", "q8": "CONFIRMED"}
    q3 = good["q3"]
    assert {q3["component_statuses"][k] for k in ("nonzero_aggregate_replacement", "zero_size_delete", "empty_side_boundary_candidates")} == {"CONFIRMED"}
    assert (q3["observed_change_entries"], q3["applied_change_entries"], q3["zero_size_updates"], q3["side_updates"]) == (4, 4, 2, {"BUY": 2, "SELL": 2})
    assert q3["empty_side_boundary_interpretation"]["observed_kinds"] == {"ask_one_when_empty": 2} and q3["empty_side_boundary_interpretation"]["status"] == "CONFIRMED"
    assert good["errors"]["counts"] == {"rest_non_2xx": 1} and good["errors"]["examples"][0]["ingest_sequence"] == 67
    assert good["evidence"]["records"] == {"websocket": 7, "rest": 4, "control": 4} and good["evidence"]["duplicate_raw_frames"] == 0
    assert good["evidence"]["manifest"]["files"]["raw-websocket.jsonl"]["bytes"] == (tmp_path / "a/raw-websocket.jsonl").stat().st_size
    assert good["q6"]["status_codes"] == {"200": 3, "503": 1} and (good["q6"]["aligned_comparisons"], good["q6"]["aligned_matches"], good["q6"]["unaligned_diagnostics"]) == (2, 2, 1)
    assert good["q1"]["event_schema"]["book"]["fields"]["bids[].price"] == {"event_presence": 2, "occurrences": 4, "types": {"string": 4}}
    assert good["q4"]["entries_per_frame"] == {"1": 4} and good["q5"]["websocket_book"] == {"attempts": 2, "matches": 0, "mismatches": 2, "skipped_missing_fields": 0}
    assert good["q8"]["probe_observed_source_to_processing_delay_ms"]["count"] == 6 and good["q8"]["processing_order"]["websocket_records_observed"] == 7
    bad = analyze.summarize(spark, run_dir(tmp_path / "b", wrong=True), {"run_id": "b"}, ("7",))
    assert bad["q3"]["status"] == "CONTRADICTED" and bad["errors"]["counts"]["best_bid_ask_mismatch"] == 2 and bad["errors"]["counts"]["price_change_without_valid_book"] == 2
    assert bad["q3"]["counterexamples"][0]["best_prices"]["best_bid"] == {"observed": "0.9", "derived": "0.4"}
    assert "| q3 | CONFIRMED | CONTRADICTED | CONFIRMED -> CONTRADICTED |" in report.compare(good, bad)
    assert report.render(good) == report.render(json.loads(json.dumps(good))) and "best_bid_ask_mismatch" in report.render(bad)


def test_a_run_with_failures_and_true_hashes(spark, tmp_path):
    bids, asks = [("0.40", "10"), ("0.30", "20")], [("0.60", "12")]
    t0 = 1_787_702_400_000
    b = book(t0, bids, asks) | {"tick_size": 0.01}
    b["hash"] = digest(b, b["timestamp"], bids, asks)
    one = change(t0 + 1, "BUY", "0.400", "8.50", best_bid="0.4")
    one["price_changes"][0]["hash"] = digest(b, one["timestamp"], [("0.400", "8.50"), ("0.30", "20")], asks)
    two = change(t0 + 2, "SELL", "0.60", "0")
    two["price_changes"][0]["hash"] = digest(b, two["timestamp"], [("0.400", "8.50"), ("0.30", "20")], [])
    no_list, no_market = change(t0 + 3, "BUY", "0.4", "1") | {"price_changes": {"a": 1}}, change(t0 + 4, "BUY", "0.4", "1")
    no_market["price_changes"] *= 2
    del no_market["market"]
    payloads = [b, one, two, no_list, no_market, {"event_type": "later", "timestamp": str(t0)}, {"event_type": "best_bid_ask", "timestamp": "x"}, 5, {"event_type": ""}]
    ws = [{"collector_session_id": "s1", "ingest_sequence": i + 1, "received_at": "2026-08-26T00:00:01.000000Z", "received_monotonic_ns": 5 if i == 4 else i * 10, "payload_kind": "text", "raw_payload": json.dumps(p)} for i, p in enumerate(payloads)]
    ws[2]["received_at"] = "yesterday"
    ws[6]["ingest_sequence"] = 6
    control = [
        ("websocket_session_started", {"session_id": "s1"}), ("rest_timeout", {"token_id": "7", "request_context": {"request_purpose": "empty_side_boundary_candidate", "candidate_id": "3:0:best_ask"}}), ("rest_transport_error", {"token_id": "7", "message": "reset"}),
        ("heartbeat_timeout", {"session_id": "s1"}), ("websocket_disconnect", {"session_id": "s1", "error": "gone"}), ("targeted_rest_request_rejected", {"token_id": "8"}), ("websocket_session_ended", {"session_id": "s1", "controlled_disconnect": False, "disconnect_error": "gone"}),
    ]
    write("raw-websocket.jsonl", ws, tmp_path)
    write("raw-rest-book.jsonl", [{"token_id": "7", "ingest_sequence": 60, "status_code": 200, "payload_kind": "text", "raw_response": json.dumps(b | {"bids": 3})}], tmp_path)
    write("control-events.jsonl", [{"ingest_sequence": 100 + i, "event": e, "details": x} for i, (e, x) in enumerate(control)], tmp_path)
    s = analyze.summarize(spark, str(tmp_path), {"run_id": "x"}, ("7",))
    assert s["q5"]["status"] == "CONFIRMED"
    assert s["q5"]["price_change_post_update"] == {"attempts": 2, "matches": 2, "mismatches": 0, "skipped_missing_fields": 0} and s["q5"]["websocket_book"]["matches"] == 1
    counts = s["errors"]["counts"]
    for code in ("unexpected_event_type", "received_timestamp_parse_failure", "unexpected_json_shape", "missing_event_type", "websocket_ingest_sequence_regression", "hash_levels_malformed", "rest_timeout", "rest_transport_error", "heartbeat_timeout", "websocket_disconnect", "targeted_rest_request_rejected"):
        assert counts[code] == 1, (code, counts)
    assert counts["missing_required_field"] == 2 and counts["decimal_parse_failure"] == 1 and counts["websocket_monotonic_receive_regression"] == 1
    assert (s["q3"]["observed_change_entries"], s["q3"]["applied_change_entries"], s["q3"]["excluded_change_entries"]) == (4, 2, 2)
    assert s["q4"]["price_change_frames"] == 4 and s["q4"]["entries_per_frame"] == {"1": 2, "2": 1}
    assert s["q6"]["status_codes"] == {"0": 2, "200": 1} and s["q6"]["requests"] == 3
    assert s["q2"]["sessions"]["s1"]["disconnect_error"] == "gone" and not s["q2"]["sessions"]["s1"]["controlled_disconnect"]
    assert s["q8"]["status"] == "CONTRADICTED"
    text = report.render(s)
    assert "rest_timeout" in text and "After changes | 2 | 2 | 0 | 0" in text


def test_run_verdicts_reads_payloads_once(spark):
    """Of the plan that gives the verdicts, only the inventory of paths parses anything: the events are parsed before."""
    out = verdict_queries.run_verdicts(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"parse_?json", plan, re.I)) == 1
    got = {r.question: r.status for r in out.collect()}
    assert len(got) == 13 and set(got.values()) <= {"CONFIRMED", "CONTRADICTED", "UNRESOLVED", "NOT_OBSERVED"}
