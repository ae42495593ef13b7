"""Markdown of summary documents: pure functions of them, so equal documents give equal bytes.

Tables are declared as rows of a label and where its value lies; get() follows a path through a document and takes what
older documents call it where the present name is absent, so both kinds of document can be read and compared.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from bookloom.sources.schemas import EXAMPLES_SHOWN

QUESTIONS = {
    "q1": "Which fields do events carry?",
    "q2": "Does a fresh subscription begin with a book?",
    "q3": "Do changes replace aggregate sizes?",
    "q4": "Do frames repeat a level?",
    "q5": "Can hashes be recomputed?",
    "q6": "Do REST books equal the replayed books?",
    "q7": "Is optional metadata present?",
    "q8": "Is time ordered?",
}
#: How far each answer reaches.
LIMITS = {
    "q1": "Absence holds for this sample only.",
    "q2": "It holds for these tokens, sessions, this subscription and a clean reconnect.",
    "q3": "Only applied updates that nothing retired and that an aligned read confirmed support it; 0 and 1 at an empty side are no rule of the feed.",
    "q4": "A count of zero says that nothing was seen, not that it can't be.",
    "q5": "Only payloads with every input of the one algorithm were tried; no other meaning of a hash was guessed.",
    "q6": "Reads and frames run side by side; a difference outside an aligned window is a diagnostic.",
    "q7": "Frequencies are of the books seen.",
    "q8": "Order is that of this run's own processing, and its delays are no latency of a network or venue.",
}
#: What a corrected run does otherwise than the first one.
METHODS = {
    "q1": "The same inventory over another sample.",
    "q2": "The subscription sends two fields and leaves the rest to defaults.",
    "q3": "Claims for an empty side are kept apart from real differences, need a targeted read each, and retired updates are no longer credited.",
    "q4": "Entries of several assets are told from several entries of one.",
    "q5": "The same algorithm, with no input ever filled in.",
    "q6": "The same window rule, with targeted reads as further diagnostics.",
    "q7": "The same frequencies.",
    "q8": "Delays keep their numbers under a plainer name, and processing order is checked.",
}
DELAY_LIMIT = "Delays are receive time less source time as the run saw them, with clock offset, scheduling, buffering and durable writes in them; they are no latency of a network or venue."
#: Where a present path is absent: what older documents call it.
OLDER = {
    "q8.probe_observed_source_to_processing_delay_ms": "q8.delay_ms_local_clock_dependent",
    "q3.genuine_mismatches": "q3.mismatches",
    "run.market_subscription_payload": "run.subscription_payload",
    "run.market_subscription_fields": "run.subscription_fields",
    "evidence.run_directory": "run.raw_evidence_path",
}
DELAYS = "q8.probe_observed_source_to_processing_delay_ms"

Row = tuple[str, "str | Callable[[Mapping], Any]"]


def get(doc: Any, path: str, default: Any = None) -> Any:
    """The member at a dotted path, or at its older name; null counts as absent."""
    for start, older in ((path, None), *((p, o) for p, o in OLDER.items() if path == p or path.startswith(p + "."))):
        value = doc
        for part in (path if older is None else older + path[len(start) :]).split("."):
            value = value.get(part) if isinstance(value, Mapping) else None
        if value is not None:
            return value
    return default


def cell(value: Any) -> str:
    return str(value).replace("|", "\\|").replace("\n", " ")


def compact(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def shown(value: Any, absent: str = "not recorded") -> str:
    if value is None:
        return absent
    if isinstance(value, bool):
        return "true" if value else "false"
    return cell(compact(value) if isinstance(value, (Mapping, list, tuple)) else value)


def table(head: Iterable[str], rows: Iterable[Iterable[Any]]) -> list[str]:
    head = list(head)
    return [f"| {' | '.join(head)} |", f"|{' --- |' * len(head)}", *(f"| {' | '.join(shown(x) for x in row)} |" for row in rows), ""]


def values(doc: Mapping, rows: Iterable[Row]) -> list[tuple[str, Any]]:
    return [(label, get(doc, where) if isinstance(where, str) else where(doc)) for label, where in rows]


def setting(name: str) -> Callable[[Mapping], str | None]:
    """How a member of the subscription was handled: left out, or sent, and as what; older documents only name its value."""

    def say(doc: Mapping) -> str | None:
        sent = get(doc, f"run.{name}_field_sent")
        told = get(doc, "run.market_subscription_payload", {}).get(name, get(doc, f"run.{'websocket_level' if name == 'level' else name}"))
        if sent is False:
            return "left out; the feed's default applies"
        return None if sent is None and told is None else "sent" if told is None else f"sent as {shown(told)}"

    return say


RUN: tuple[Row, ...] = (
    ("Run", "run.run_id"), ("Start", "run.started_at"), ("End", "run.ended_at"), ("Seconds asked for", "run.requested_duration_seconds"), ("Seconds taken", "run.actual_duration_seconds"),
    ("Seconds between reads", "run.rest_interval_seconds"), ("Controlled reconnects", "run.controlled_reconnects"), ("Tokens", "run.token_ids"), ("Sample", "run.sample_note"),
    ("Initial dump", setting("initial_dump")), ("Level", setting("level")), ("Subscription control", "run.subscription_control"), ("Subscription fields", "run.market_subscription_fields"),
    ("Subscription", "run.market_subscription_payload"), ("Evidence", "evidence.run_directory"), ("Boundary of raw capture", "run.raw_boundary"), ("Software", "run.software"),
    ("Offline tests", "run.offline_test_command"), ("Their result", "run.offline_test_result"), ("Baseline run", "run.baseline_run_id"), ("Baseline document", "run.baseline_summary_path"), ("Baseline SHA-256", "run.baseline_summary_sha256"),
)

UPDATES: tuple[Row, ...] = tuple((label, f"q3.{name}") for label, name in (
    ("Entries seen", "observed_change_entries"), ("Applied", "applied_change_entries"), ("Excluded", "excluded_change_entries"), ("Best prices compared", "comparison_entries"), ("Equal", "exact_matches"),
    ("Different", "genuine_mismatches"), ("Different, the only entry of its asset", "direct_single-entry_mismatches"), ("Sizes above zero", "nonzero_replacements"), ("Sizes of zero", "zero_size_updates"),
    ("Telling replacements", "discriminating_nonzero_updates"), ("of these validated", "independently_validated_nonzero_replacements"), ("Telling deletions", "discriminating_zero_deletes"), ("of these validated ", "independently_validated_zero_deletes"),
    ("Without effect", "idempotent_replacements"), ("Retired before validation", "superseded_before_validation"), ("By side", "side_updates"), ("By best price", "components"), ("Parts", "component_statuses"),
))
EMPTY_SIDE: tuple[Row, ...] = tuple((label, f"q3.empty_side_boundary_interpretation.{name}") for label, name in (
    ("Status", "status"), ("Status by kind", "kind_level_status"), ("Candidates", "observed_candidates"), ("Kinds", "observed_kinds"), ("Confirmed", "confirmed_candidates"), ("Kinds confirmed", "confirmed_kinds"),
    ("Open", "unresolved_candidates"), ("Reads that weren't aligned", "targeted_rest_unaligned"), ("Other outcomes of reads", "targeted_rest_diagnostics"),
))
FRAMES: tuple[Row, ...] = tuple((label, f"q4.{name}") for label, name in (
    ("Frames of changes", "price_change_frames"), ("by entries", "entries_per_frame"), ("with several entries", "multi_entry_frames"), ("with several entries of an asset", "multi_same_asset_frames"),
    ("with a level twice", "duplicate_asset_side_price_frames"), ("where its order matters", "order_sensitive_frames"),
))
READS: tuple[Row, ...] = tuple((label, f"q6.{name}") for label, name in (
    ("Requests", "requests"), ("Usable responses", "successful_responses"), ("By status", "status_codes"), ("Aligned", "aligned_comparisons"), ("Equal in depth", "aligned_matches"), ("Different", "aligned_mismatches"), ("Not aligned", "unaligned_diagnostics"),
))
TIMES: tuple[Row, ...] = (
    ("Events with a time", "q8.timestamped_events"), ("By token", "q8.timestamp_events_by_token"), ("Back in time", "q8.source_timestamp_regressions"), ("Same time as before", "q8.adjacent_same_timestamp_events"),
    ("Groups of one time", lambda d: len(get(d, "q8.same_timestamp_groups", []))), ("After receipt", "q8.source_after_local_receive"), ("Processing order", "q8.processing_order"),
    ("Delays", f"{DELAYS}.count"), ("Least ms", f"{DELAYS}.min"), ("P50 ms", f"{DELAYS}.p50"), ("P95 ms", f"{DELAYS}.p95"), ("Most ms", f"{DELAYS}.max"), ("Quantiles", f"{DELAYS}.quantile_method"),
)
HASH_SHAPES = (("Books of the feed", "websocket_book"), ("After changes", "price_change_post_update"), ("Books read", "rest_book_diagnostic"))


def status_of(doc: Mapping, q: str) -> str:
    return str(get(doc, f"{q}.status", "UNRESOLVED"))


def evidence_of(doc: Mapping, q: str) -> str:
    """A line of the figures behind an answer; what a document lacks counts as none."""
    n = lambda path, default=0: get(doc, path, default)
    if q == "q1":
        events = n("q1.event_schema", {})
        return f"{sum(x.get('events', 0) for x in events.values())} events of {len(events)} types; members that may say an order were there {sum(n('q1.candidate_ordering_fields', {}).values())} times."
    if q == "q2":
        sessions = n("q2.sessions", {})
        tokens = [t for s in sessions.values() for t in s.get("tokens", {}).values()]
        began = sum(t.get("first_state_event") == "book" for t in tokens)
        moved = sum((t.get("price_change_entries") or 0) > 0 for t in tokens)
        return f"{len(sessions)} sessions with {len(tokens)} token subscriptions: {began} began with a book, {moved} saw a change; clean reconnect: {shown(n('q2.clean_controlled_reconnect', None))}."
    if q == "q3":
        e = "q3.empty_side_boundary_interpretation"
        return (
            f"{n('q3.applied_change_entries')} of {n('q3.observed_change_entries')} entries applied, {n('q3.excluded_change_entries')} excluded; best prices equal in {n('q3.exact_matches')}, different in {n('q3.genuine_mismatches')}; "
            f"validated: {n('q3.independently_validated_nonzero_replacements')} replacements and {n('q3.independently_validated_zero_deletes')} deletions, {n('q3.superseded_before_validation')} retired before; "
            f"{n(f'{e}.confirmed_candidates')} of {n(f'{e}.observed_candidates')} empty-side candidates confirmed."
        )
    if q == "q4":
        return ", ".join(f"{label[0].lower()}{label[1:]}: {shown(v, '0')}" for label, v in values(doc, FRAMES) if not isinstance(v, Mapping)) + "."
    if q == "q5":
        return "; ".join(f"{label.lower()}: {n(f'q5.{s}.matches')} of {n(f'q5.{s}.attempts')} match" for label, s in HASH_SHAPES) + "."
    if q == "q6":
        return f"{n('q6.successful_responses')} of {n('q6.requests')} requests usable; {n('q6.aligned_matches')} of {n('q6.aligned_comparisons')} aligned books equal; {n('q6.unaligned_diagnostics')} not aligned."
    if q == "q7":
        return f"{n('q7.websocket_book_events')} books; members: {compact(n('q7.optional_field_presence', {}))}."
    order = "q8.processing_order"
    return (
        f"{n('q8.timestamped_events')} events with a time, {n('q8.source_timestamp_regressions')} back in time, {n('q8.source_after_local_receive')} after receipt; processing order broken "
        f"{shown(n(f'{order}.ingest_sequence_regressions', None))} and {shown(n(f'{order}.received_monotonic_ns_regressions', None))} times; {n(f'{DELAYS}.count')} delays, median {shown(n(f'{DELAYS}.p50', None))} ms."
    )


def conclusions(doc: Mapping) -> list[str]:
    return table(("Question", "Status", "Within this run"), ((f"{q[0].upper()}{q[1]}: {text}", f"**{status_of(doc, q)}**", evidence_of(doc, q)) for q, text in QUESTIONS.items()))


def counterexamples(doc: Mapping) -> list[str]:
    """Repeated frames, what speaks against each answer, and errors by code with their first examples."""
    lines = []
    if twice := get(doc, "evidence.duplicate_raw_frames", 0):
        lines.append(f"- {twice} frames repeat an earlier payload; all are kept, and heartbeats are among them.")
    for q in QUESTIONS:
        lines += [f"- {q.upper()}: `{compact(x)}`" for x in get(doc, f"{q}.counterexamples", [])]
    by_code: dict[str, list] = {}
    for x in get(doc, "errors.examples", []):
        by_code.setdefault(str(x.get("code", "uncategorized")), []).append(x)
    for code, count in sorted(get(doc, "errors.counts", {}).items()):
        some = by_code.get(code, [])
        lines += [f"- `{cell(code)}`: {count}", *(f"  - `{compact(x)}`" for x in some[:EXAMPLES_SHOWN])]
        if count > EXAMPLES_SHOWN and some:
            lines.append(f"  - and {count - EXAMPLES_SHOWN} more in the evidence")
    return [*(lines or ["Nothing speaks against an answer, and there was no error."]), ""]


def exclusions(doc: Mapping) -> list[str]:
    """What a run's third answer leaves out, and its candidates one by one."""
    path = "q3.empty_side_boundary_interpretation"
    lines = [f"- {get(doc, 'q3.excluded_change_entries', 0)} of {shown(get(doc, 'q3.observed_change_entries'))} entries are excluded, {shown(get(doc, 'q3.applied_change_entries'))} applied; answers don't reach over what is excluded."]
    if (n := get(doc, "q3.superseded_before_validation")) is not None:
        lines.append(f"- {n} updates were retired before a read could validate them.")
    lines += [f"  - `{compact(x)}`" for x in get(doc, "q3.superseded_validation_examples", [])]
    if get(doc, path) is not None:
        lines.append(f"- Empty sides: {shown(get(doc, f'{path}.status'))}; {get(doc, f'{path}.observed_candidates', 0)} candidates, {get(doc, f'{path}.confirmed_candidates', 0)} confirmed, {get(doc, f'{path}.unresolved_candidates', 0)} open; reads: {compact(get(doc, f'{path}.targeted_rest_diagnostics', {}))}.")
    return [*lines, *(f"  - `{compact(x)}`" for x in get(doc, f"{path}.candidates", [])), ""]


def manifest(doc: Mapping) -> list[str]:
    files = get(doc, "evidence.manifest.files", {})
    rows = [(name, get(x, "bytes"), get(x, "sha256")) for name, x in sorted(files.items())] or [("no files recorded", "n/a", "n/a")]
    return [f"Folder `{shown(get(doc, 'evidence.run_directory'))}`, records `{compact(get(doc, 'evidence.records', {}))}`, digest `{shown(get(doc, 'evidence.manifest.algorithm'))}`.", "", *table(("File", "Bytes", "SHA-256"), rows)]


def details(doc: Mapping) -> list[str]:
    """Question by question."""
    lines: list[str] = []

    def head(q: str, *more: str) -> None:
        lines.extend([f"### {q.upper()}: {QUESTIONS[q]} **{status_of(doc, q)}**", "", *more])

    head("q1")
    for kind, x in get(doc, "q1.event_schema", {}).items():
        lines.extend([f"`{cell(kind)}`, {x['events']} events:", "", *table(("Path", "Events", "Occurrences", "Types"), ((p, f["event_presence"], f["occurrences"], f["types"]) for p, f in x["fields"].items()))])
    lines.extend([f"Members that may say an order: `{compact(get(doc, 'q1.candidate_ordering_fields', {}))}`.", ""])
    head("q2")
    tokens = [(s, t, x, v) for s, v in sorted(get(doc, "q2.sessions", {}).items()) for t, x in sorted(v.get("tokens", {}).items())]
    lines.extend(table(("Session", "Token", "First", "at", "First book", "First change", "Books", "Changes", "Controlled"), (
        (s, t, x["first_state_event"], x["first_state_ingest_sequence"], x["first_book_ingest_sequence"], x["first_delta_ingest_sequence"], x["book_events"], x["price_change_entries"], v["controlled_disconnect"]) for s, t, x, v in tokens
    )))
    head("q3", *table(("Measure", "Value"), values(doc, UPDATES)), "Claims for an empty side:", "", *table(("Measure", "Value"), values(doc, EMPTY_SIDE)))
    lines.extend(exclusions(doc))
    head("q4", *table(("Measure", "Value"), values(doc, FRAMES)))
    head("q5", f"{shown(get(doc, 'q5.algorithm'))}.", "", *table(("What", "Tried", "Equal", "Different", "Skipped"), ((label, *(get(doc, f"q5.{s}.{k}", "n/a") for k in ("attempts", "matches", "mismatches", "skipped_missing_fields"))) for label, s in HASH_SHAPES)))
    head("q6", *table(("Measure", "Value"), values(doc, READS)), *table(("Expected field", "There", "Missing"), ((f, n, get(doc, f"q6.expected_field_missing.{f}")) for f, n in sorted(get(doc, "q6.expected_field_presence", {}).items()))), shown(get(doc, "q6.alignment_rule")), "")
    head("q7", f"Of {get(doc, 'q7.websocket_book_events', 0)} books:", "", *table(("Member", "Books"), sorted(get(doc, "q7.optional_field_presence", {}).items())))
    head("q8", *table(("Measure", "Value"), values(doc, TIMES)), DELAY_LIMIT, "")
    return lines


METHOD_TEXT = (
    "- Only the public market channel and GET of one public book are used, without credentials and redirects.",
    "- Sessions are replayed apart; no state crosses a reconnect.",
    "- Raw frames are kept as they came, with sequence, receive time and digest, before anything is derived.",
    "- Prices and sizes are exact decimals. Entries apply in the order seen: BUY to bids, SELL to asks, zero deletes, else replaces.",
    "- A digest is tried only where the payload or the replayed state holds every input.",
    "- Read books are compared only if the asset's state stayed the same from request to receipt.",
)


def render(doc: Mapping) -> str:
    lines = [f"# Run {shown(get(doc, 'run.run_id'), 'unknown')}", "", *table(("Property", "Value"), values(doc, RUN)), "## Method", "", *METHOD_TEXT, "", "## Evidence", ""]
    lines += table(("Records", "Count"), sorted(get(doc, "evidence.records", {}).items()))
    lines += ["## Answers", "", "CONFIRMED: supported with no eligible evidence against it. CONTRADICTED: eligible evidence against it. UNRESOLVED: neither.", "", *conclusions(doc), *details(doc)]
    lines += ["## Counterexamples and errors", "", *counterexamples(doc), "## Files", "", *manifest(doc), "## Limits", "", *(f"- {q.upper()}: {x}" for q, x in LIMITS.items()), f"- {DELAY_LIMIT}", "- Nothing here is a result of trading.", ""]
    return "\n".join(lines)


def compare(before: Mapping, after: Mapping) -> str:
    """Two runs side by side; neither replaces the other, and an answer that a document lacks counts as UNRESOLVED."""
    for doc in (before, after):
        if not isinstance(doc.get("run"), Mapping):
            raise TypeError("a summary document has a run")
    lines = ["# Comparison", "", "Both runs keep their own evidence, exclusions and answers.", "", *table(("Property", "First", "Second"), ((label, a, b) for (label, a), (_, b) in zip(values(before, RUN), values(after, RUN), strict=True)))]
    lines += ["## Files", "", "### First run", "", *manifest(before), "### Second run", "", *manifest(after), "## Answers", ""]
    pairs = [(q, status_of(before, q), status_of(after, q)) for q in QUESTIONS]
    lines += table(("Question", "First", "Second", "Change"), ((q, a, b, "UNCHANGED" if a == b else f"{a} -> {b}") for q, a, b in pairs))
    for q, a, b in pairs:
        lines += [f"### {q.upper()}: {QUESTIONS[q]}", "", f"- First, **{a}**: {evidence_of(before, q)}", f"- Second, **{b}**: {evidence_of(after, q)}", f"- Method: {METHODS[q]}", f"- Limit: {LIMITS[q]}", ""]
    delays = [(x, f"{DELAYS}.{x}") for x in ("count", "min", "p50", "p95", "max")]
    lines += ["## Delays", "", DELAY_LIMIT, "", *table(("Measure", "First", "Second"), ((label, a, b) for (label, a), (_, b) in zip(values(before, delays), values(after, delays), strict=True)))]
    for name, doc in (("First", before), ("Second", after)):
        lines += [f"## {name} run: exclusions, counterexamples, errors", "", *exclusions(doc), *counterexamples(doc)]
    lines += ["## Limits", "", "- Two bounded samples: what was not seen may still be.", "- What the first run excluded stays excluded.", "- Equal best prices prove neither whole depth nor gap-free delivery.", ""]
    return "\n".join(lines)
