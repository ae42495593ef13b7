"""Envelopes of the evidence files, and the vocabularies of the feed.

Envelopes have fixed columns; payloads stay VARIANT, so that a missing key and an explicit null differ.
"""

from __future__ import annotations

#: Fixed values of the feed.
KNOWN_EVENT_TYPES = ("best_bid_ask", "book", "last_trade_price", "market_resolved", "new_market", "price_change", "tick_size_change")
BOOK_METADATA = ("min_order_size", "tick_size", "neg_risk", "last_trade_price")
REST_FIELDS = ("hash", "tick_size", "min_order_size", "neg_risk", "last_trade_price")
HASH_FIELDS = ("market", "asset_id", "timestamp", "hash", "bids", "asks", "min_order_size", "tick_size", "neg_risk", "last_trade_price")
ENTRY_FIELDS = ("asset_id", "price", "size", "side", "hash")
HEARTBEAT = "PONG"
#: Fixed values of the analysis, not of the feed: names of members that may say an order.
ORDERING_LEAVES = ("offset", "seq", "seq_id", "seqid", "sequence", "sequence_id", "sequenceid", "update_id", "updateid")
#: Control events of a collector that are errors of a run, and those that are failed reads.
OPERATIONAL_FAILURES = ("heartbeat_timeout", "targeted_rest_request_rejected", "websocket_connection_error", "websocket_disconnect")
TRANSPORT_FAILURES = ("rest_timeout", "rest_transport_error")
EXAMPLES, EXAMPLES_SHOWN = 20, 3

#: Exact prices and sizes: up to 13 whole and 25 fraction digits; what has more is reported, never rounded.
DECIMAL = "decimal(38,25)"
#: Exact times in milliseconds need more whole digits.
TIME = "decimal(38,9)"
#: The one spelling of numbers that every engine reads alike.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NOT_FINITE = r"(?i)^[+-]?(inf(inity)?|s?nan[0-9]*)$"

WEBSOCKET = (
    "record_type string, source_name string, source_version string, probe_version string, parser_version string, "
    "collector_id string, collector_session_id string, ingest_sequence bigint, received_at string, received_monotonic_ns bigint, "
    "subscribed_token_ids array<string>, payload_kind string, raw_payload string, raw_payload_sha256 string, parse_status string, "
    "parse_error string, event_types array<string>, source_timestamps array<string>, asset_ids array<string>, source_timestamp string"
)
REST = (
    "record_type string, source_name string, source_version string, probe_version string, parser_version string, "
    "collector_id string, token_id string, url string, http_method string, request_started_at string, received_at string, "
    "elapsed_ms string, ingest_sequence bigint, status_code int, source_timestamp string, payload_kind string, raw_response string, "
    "raw_response_sha256 string, parse_status string, parse_error string, state_version_before bigint, state_version_after bigint, "
    "state_session_before string, state_session_after string, state_valid_before boolean, state_valid_after boolean, "
    "request_context map<string,string>"
)
CONTROL = "record_type string, probe_version string, ingest_sequence bigint, recorded_at string, event string, details variant"
ARCHIVE = (
    "market string, asset_id string, timestamp_received timestamp, timestamp timestamp, event_type string, side string, "
    "price string, size string, bids string, asks string, old_tick_size string, new_tick_size string"
)
