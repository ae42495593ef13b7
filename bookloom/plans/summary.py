"""The summary document of a run: what its tables hold, as counts, statuses and first examples.

Every table is aggregated, or cut to its first examples, before anything comes to the driver, so a document's size
depends on the kinds of things a run holds, not on its length. Whole lists (candidates, errors, retired updates) stay
in the analysis as tables. Names of members are those of the format, which readers of older documents rely on.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.functions.exact import plain_text
from bookloom.operators import frames, replay, repeats, rest, timing
from bookloom.sources.schemas import BOOK_METADATA, EXAMPLES, REST_FIELDS

if TYPE_CHECKING:
    from .analyze import Analysis

#: Fixed values of the format.
VERSION = "bookloom-1"
SHAPES = {"book": "websocket_book", "change": "price_change_post_update", "rest": "rest_book_diagnostic"}
KINDS = ("ask_one_when_empty", "bid_zero_when_empty")
ALGORITHM = "SHA-1 of compact JSON with fixed keys in fixed order and an empty hash"
ALIGNMENT = "Levels are compared only if the asset had a valid state before the request and its session and version stayed the same until receipt."
CONFIRMATION = (
    "A candidate is confirmed by a read whose window is aligned with the candidate's own state, whose whole depth equals the replayed book, "
    "and whose side in question is empty. Any other outcome is a diagnostic, and one open candidate keeps the interpretation unresolved."
)
SCOPE = {
    "q1": "A field that is absent here is absent from this sample only.",
    "q2": "What began with a book did so for these sessions, tokens and this subscription; that is no promise of the server.",
    "q3": "Best prices that agree don't tell a replaced size from an added one; only whole depth in an aligned read does.",
    "q7": "A member that is absent here is absent from this sample only.",
    "q8": "These counts describe the order in which frames were processed, not whether the network delivered all of them.",
}
DELAY_NOTE = (
    "Receive time less source time as this run saw it: clock offset, scheduling, buffering and durable writes are in it. It is no latency of a network or venue."
)
SAFETY = {"authenticated_operations": 0, "trading_operations": 0, "wallets_or_credentials_used": False, "http_methods": ["GET"], "websocket_channel": "market", "trading_performance_result": False}


def _one(df: DataFrame) -> dict:
    return df.first().asDict()


def _counts(df: DataFrame, key: str, value: str) -> dict:
    return {str(r[key]): r[value] for r in sorted(df.select(key, value).collect(), key=lambda r: str(r[key]))}


def _first(df: DataFrame, order: list[str], most: int = EXAMPLES) -> list[dict]:
    """The first rows; nulls are left out."""
    return [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in df.orderBy(*order).limit(most).collect()]


def _schema(a: Analysis) -> dict:
    """By event type: events, and for each path its presence, occurrences and types."""
    out = {t: {"events": n, "fields": {}} for t, n in _counts(frames.event_counts(a.events), "event_type", "events").items()}
    per = a.paths.groupBy("event_type", "path").agg(F.count_distinct("k").alias("presence"), F.count("*").alias("n"))
    for r in sorted(per.collect()):
        out[r["event_type"]]["fields"][r["path"]] = {"event_presence": r["presence"], "occurrences": r["n"], "types": {}}
    for r in sorted(a.paths.groupBy("event_type", "path", "wire_type").count().collect()):
        out[r["event_type"]]["fields"][r["path"]]["types"][r["wire_type"]] = r["count"]
    return out


def _sessions(a: Analysis) -> tuple[dict, list[dict]]:
    """Sessions with their tokens, and what speaks against a clean reconnect."""
    out = {
        r["session_id"]: {"started": True, "completed": bool(r["completed"]), "controlled_disconnect": bool(r["controlled"]), "disconnect_error": r["error"], "tokens": {}}
        for r in sorted(a.sessions.collect(), key=lambda r: r["session_id"])
    }
    against: list[dict] = []
    if len(out) >= 2:
        name, s = next(iter(out.items()))
        if not s["completed"] or not s["controlled_disconnect"] or s["disconnect_error"] is not None:
            against.append({"session_id": name, "kind": "first_session_not_cleanly_controlled", **{k: s[k] for k in ("completed", "controlled_disconnect", "disconnect_error")}})
    for r in sorted(a.first.collect(), key=lambda r: (r["session_id"], r["token"])):
        item = {
            "first_state_event": r["first_state_event"], "first_state_ingest_sequence": r["first_state_seq"], "first_book_ingest_sequence": r["first_book_seq"],
            "first_delta_ingest_sequence": r["first_delta_seq"], "book_events": r["book_events"], "price_change_entries": r["price_change_entries"],
        }
        out[r["session_id"]]["tokens"][r["token"]] = item
        who = {"session_id": r["session_id"], "asset_id": r["token"], "first_state_event": r["first_state_event"]}
        if r["first_state_event"] != "book":
            against.append(who)
        if not r["price_change_entries"]:
            against.append(who | {"kind": "no_delta_observed_after_fresh_book", "first_book_ingest_sequence": r["first_book_seq"]})
    return out, against


def _updates(a: Analysis, status: dict[str, str]) -> dict:
    c = _one(replay.update_counters(a.fates))
    verdict = {(r["discriminating"], r["verdict"]): r["count"] for r in a.validations.groupBy("discriminating", "verdict").count().collect()}
    by_kind = {r["kind"]: (r["n"], r["good"]) for r in a.candidates.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("confirmed").alias("good")).collect()}
    observed, confirmed = sum(n for n, _ in by_kind.values()), sum(g for _, g in by_kind.values())
    kinds_ok = bool(by_kind) and all(g for _, g in by_kind.values())
    outcomes = _counts(a.attempts.groupBy("outcome").count(), "outcome", "count")
    yes = lambda x: "CONFIRMED" if x else "UNRESOLVED"
    wrong = a.fates.where("comparison = 'mismatch'").select(
        F.col("seq").alias("ingest_sequence"), "change_index", "asset_id", F.col("price_text").alias("price"), F.col("size_text").alias("size"), "side", "frame_entries",
        F.struct(F.struct(plain_text(F.col("best_bid")).alias("observed"), plain_text(F.col("derived_bid")).alias("derived")).alias("best_bid"), F.struct(plain_text(F.col("best_ask")).alias("observed"), plain_text(F.col("derived_ask")).alias("derived")).alias("best_ask")).alias("best_prices"),
    )
    retired = a.validations.where("verdict = 'superseded'").select(F.col("discriminating").alias("kind"), F.col("seq").alias("ingest_sequence"), "side", plain_text(F.col("price")).alias("price"), F.col("superseded_at").alias("superseding_ingest_sequence"))
    listed = a.candidates.select("candidate_id", "kind", F.col("seq").alias("ingest_sequence"), "change_index", "asset_id", "component", F.col("version").alias("state_version"), "session_id", F.when(F.col("confirmed"), "CONFIRMED").otherwise("UNRESOLVED").alias("rest_validation"))
    components = {f"best_{s}_{name}": c[f"{s}_{k}"] for s in ("ask", "bid") for k, name in (("total", "total"), ("match", "matches"), ("mismatch", "mismatches"), ("candidate", "empty_side_boundary_candidates")) if c[f"{s}_{k}"]}
    return {
        "status": status["q3"],
        "comparison_entries": c["comparisons"], "observed_change_entries": c["entries"], "applied_change_entries": c["applied"], "excluded_change_entries": c["excluded"],
        "exact_matches": c["comparison_match"], "mismatches": c["comparison_mismatch"], "genuine_mismatches": c["comparison_mismatch"],
        "direct_single-entry_mismatches": a.direct.first()[0], "components": dict(sorted(components.items())),
        "zero_size_updates": c["zero_updates"], "nonzero_replacements": c["nonzero_updates"], "side_updates": {k: v for k, v in (("BUY", c["buy_updates"]), ("SELL", c["sell_updates"])) if v},
        "discriminating_nonzero_updates": c["nonzero_replacement"], "discriminating_zero_deletes": c["zero_delete"],
        "independently_validated_nonzero_replacements": verdict.get(("nonzero_replacement", "validated"), 0), "independently_validated_zero_deletes": verdict.get(("zero_delete", "validated"), 0),
        "superseded_before_validation": sum(n for (_, v), n in verdict.items() if v == "superseded"), "superseded_validation_examples": _first(retired, ["ingest_sequence", "side", "price"]),
        "idempotent_replacements": c["idempotent"],
        "empty_side_boundary_interpretation": {
            "status": yes(kinds_ok and confirmed == observed), "kind_level_status": yes(kinds_ok), "all_observed_candidates_confirmed": bool(observed) and confirmed == observed,
            "observed_candidates": observed, "observed_kinds": {k: by_kind[k][0] for k in KINDS if k in by_kind}, "confirmed_candidates": confirmed, "confirmed_kinds": {k: by_kind[k][1] for k in KINDS if k in by_kind and by_kind[k][1]},
            "unresolved_candidates": observed - confirmed, "targeted_rest_unaligned": outcomes.get("unaligned_request_window", 0) + outcomes.get("candidate_state_superseded", 0),
            "targeted_rest_diagnostics": {k: n for k, n in outcomes.items() if k != "CONFIRMED"}, "confirmation_rule": CONFIRMATION, "candidates": _first(listed, ["ingest_sequence", "change_index", "component"]),
        },
        "component_statuses": {k.partition(".")[2]: v for k, v in sorted(status.items()) if k.startswith("q3.")},
        "validation_note": SCOPE["q3"], "counterexamples": _first(wrong, ["ingest_sequence", "change_index"]),
    }


def _repeats(a: Analysis) -> dict:
    sizes = a.change_frames.groupBy("frame_entries").count().collect()
    c = _one(repeats.repeat_counters(a.repeats))
    odd = a.repeats.where("repeated_keys > 0").select(F.col("frame.seq").alias("ingest_sequence"), "frame_entries", "repeated_keys", "order_sensitive")
    return {
        "price_change_frames": sum(r["count"] for r in sizes),
        "entries_per_frame": {str(n): k for n, k in sorted((r["frame_entries"], r["count"]) for r in sizes if r["frame_entries"] is not None)},
        "multi_entry_frames": sum(r["count"] for r in sizes if (r["frame_entries"] or 0) > 1), "multi_same_asset_frames": c["same_asset_frames"],
        "duplicate_asset_side_price_frames": c["repeated_key_frames"], "order_sensitive_frames": c["order_sensitive_frames"], "counterexamples": _first(odd, ["ingest_sequence"]),
    }


def _hashes(a: Analysis) -> dict:
    zero = {"attempts": 0, "matches": 0, "mismatches": 0, "skipped": 0}
    by = {r["shape"]: {k: r[k] for k in zero} for r in replay.hash_counters(a.hashes).collect()}
    out = {}
    for shape, name in SHAPES.items():
        c = dict(by.get(shape, zero))
        skipped = c.pop("skipped")
        out[name] = c if shape == "rest" else c | {"skipped_missing_fields": skipped}
    wrong = a.hashes.where("computed IS NOT NULL AND NOT (computed <=> observed)").select("shape", F.col("seq").alias("ingest_sequence"), "asset_id", F.col("observed").alias("observed_hash"), F.col("computed").alias("computed_hash"))
    return {"algorithm": ALGORITHM, **out, "counterexamples": _first(wrong, ["ingest_sequence", "shape", "asset_id"])}


def _rest(a: Analysis) -> dict:
    codes = _counts(rest.statuses(a.reads.select("status_code").unionByName(a.failed.select("status_code"))), "status_code", "requests")
    present = {r["field"]: (r["present"], r["missing"]) for r in rest.field_presence(a.reads).collect()}
    c = _one(a.reads.where("code IS NULL").agg(
        F.count("*").alias("good"), F.count_if("compared").alias("aligned"), F.count_if(F.col("compared") & F.col("full_match")).alias("matched"), F.count_if(~F.col("aligned")).alias("unaligned"),
    ))
    odd = a.reads.where("code IS NOT NULL OR (compared AND NOT full_match)").select(F.coalesce("code", F.lit("aligned_level_mismatch")).alias("kind"), F.col("seq").alias("ingest_sequence"), "asset_id", "status_code")
    odd = odd.unionByName(a.failed.select(F.col("code").alias("kind"), F.col("rest_id").alias("ingest_sequence"), F.col("token_id").alias("asset_id"), "status_code"))
    return {
        "requests": sum(codes.values()), "successful_responses": c["good"], "status_codes": codes,
        "expected_field_presence": {f: present.get(f, (0, 0))[0] for f in REST_FIELDS}, "expected_field_missing": {f: present.get(f, (0, 0))[1] for f in REST_FIELDS}, "alignment_rule": ALIGNMENT,
        "aligned_comparisons": c["aligned"], "aligned_matches": c["matched"], "aligned_mismatches": c["aligned"] - c["matched"], "unaligned_diagnostics": c["unaligned"], "counterexamples": _first(odd, ["ingest_sequence", "kind"]),
    }


def _times(a: Analysis) -> dict:
    good = a.timed.where("code IS NULL").select("seq", "event_type", "received_at", "source_ms", "stamp")
    late = good.withColumn("delay_ms", plain_text(timing.delay(F.col("received_at"), F.col("source_ms"))))
    ranks = timing.delays(good).collect()
    d = ranks[0].asDict() if ranks else {}
    text = lambda v: None if v is None else format(v.normalize() if v else v * 0, "f")
    o = _one(a.order.agg(F.count_if("regressed").alias("back"), F.count_if("repeated").alias("same")))
    r = _one(a.receive.agg(F.count("*").alias("n"), F.count_if("sequence_regressed").alias("s"), F.count("received_monotonic_ns").alias("with_ns"), F.count_if("monotonic_regressed").alias("m")))
    groups = timing.same_time_groups(a.order.select("token", F.col("stamp").alias("source_ms"))).select(F.col("token").alias("asset_id"), F.col("source_ms").alias("source_timestamp"), "events")
    ahead = late.where(F.unix_micros("received_at") < F.col("source_ms") * 1000).select(F.lit("source_after_local_receive").alias("kind"), F.col("seq").alias("ingest_sequence"), "event_type", F.col("stamp").alias("source_timestamp"), "delay_ms")
    back = a.order.where("regressed").select(F.lit("source_timestamp_regression").alias("kind"), F.col("seq").alias("ingest_sequence"), F.col("token").alias("asset_id"), F.col("stamp").alias("current"))
    return {
        "timestamped_events": d.get("n", 0), "timestamp_events_by_token": _counts(a.per_token, "token", "events"), "source_timestamp_regressions": o["back"], "adjacent_same_timestamp_events": o["same"],
        "same_timestamp_groups": _first(groups, ["asset_id", "source_timestamp"]), "source_after_local_receive": d.get("future", 0),
        "processing_order": {"websocket_records_observed": r["n"], "ingest_sequence_regressions": r["s"], "records_with_received_monotonic_ns": r["with_ns"], "received_monotonic_ns_regressions": r["m"], "scope_note": SCOPE["q8"]},
        "probe_observed_source_to_processing_delay_ms": {"quantile_method": "nearest-rank without interpolation", "count": d.get("n", 0), "min": text(d.get("minimum")), "p50": text(d.get("p50")), "p95": text(d.get("p95")), "max": text(d.get("maximum"))},
        "delay_caveat": DELAY_NOTE, "counterexamples": _first(ahead.unionByName(back, allowMissingColumns=True), ["ingest_sequence", "kind"]),
    }


def _errors(a: Analysis) -> dict:
    columns = ["code", F.col("seq").alias("ingest_sequence"), *(c for c in ("event_type", "asset_id", "change_index", "message") if c in a.errors.columns)]
    some = frames.examples(a.errors.select(*columns), "code", "ingest_sequence", EXAMPLES)
    return {"counts": _counts(frames.errors(a.errors), "code", "errors"), "examples": _first(some, ["code", "ingest_sequence"], most=10_000)}


def assemble(a: Analysis, run: dict, evidence: dict) -> dict:
    status = {r["question"]: r["status"] for r in a.verdicts.collect()}
    sessions, against = _sessions(a)
    first = next(iter(sessions.values()), None)
    books, seen = a.presence.count(), _one(a.presence.agg(*(F.count_if(c).alias(c) for c in BOOK_METADATA)))
    return {
        "version": VERSION,
        "run": run,
        "evidence": evidence | {"duplicate_raw_frames": frames.duplicate_count(a.frames).first()[0]},
        "q1": {"status": status["q1"], "event_schema": _schema(a), "candidate_ordering_fields": _counts(frames.ordering_fields(a.paths, "k"), "path", "events"), "scope_note": SCOPE["q1"], "counterexamples": []},
        "q2": {
            "status": status["q2"], "sessions": sessions, "sessions_observed": len(sessions), "all_sessions_completed": len(sessions) >= 2 and all(s["completed"] for s in sessions.values()),
            "clean_controlled_reconnect": len(sessions) >= 2 and first["completed"] and first["controlled_disconnect"] and first["disconnect_error"] is None, "scope_note": SCOPE["q2"], "counterexamples": against,
        },
        "q3": _updates(a, status),
        "q4": {"status": status["q4"], **_repeats(a)},
        "q5": {"status": status["q5"], **_hashes(a)},
        "q6": {"status": status["q6"], **_rest(a)},
        "q7": {"status": status["q7"], "websocket_book_events": books, "optional_field_presence": seen, "scope_note": SCOPE["q7"], "counterexamples": []},
        "q8": {"status": status["q8"], **_times(a)},
        "errors": _errors(a),
        "safety": dict(SAFETY),
    }
