"""Explicit schemas: envelope, payload structs, frames, markets, segments, snapshots."""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql.types import StructType

DEC = "DECIMAL(18,8)"
WIDE = "DECIMAL(38,18)"
LEVELS = f"ARRAY<STRUCT<price: {DEC}, quantity: {DEC}>>"
WINDOW = (
    "STRUCT<timeframe: STRING, market_id: STRING, condition_id: STRING, slug: STRING, "
    "start_timestamp_ns: BIGINT, end_timestamp_ns: BIGINT, up_token_id: STRING, "
    "down_token_id: STRING, resolution_source: STRING>"
)
HEALTH = (
    "STRUCT<connected: BOOLEAN, stale: BOOLEAN, current_session_id: STRING, "
    "last_message_timestamp_ns: BIGINT, age_ms: BIGINT, reconnect_count: BIGINT, "
    "invalid_count: BIGINT, duplicate_count: BIGINT, stale_session_count: BIGINT, "
    "divergence_count: BIGINT, protocol_error_count: BIGINT>"
)
HEALTH_ROWS = f"ARRAY<STRUCT<source: STRING, health: {HEALTH}>>"

PAYLOADS = {
    "p_oracle": f"STRUCT<symbol: STRING, price: {WIDE}>",
    "p_trade": (
        f"STRUCT<symbol: STRING, aggregate_trade_id: BIGINT, price: {DEC}, quantity: {DEC}, "
        "first_trade_id: BIGINT, last_trade_id: BIGINT, trade_timestamp_ns: BIGINT, "
        "taker_side: STRING>"
    ),
    "p_ticker": (
        f"STRUCT<symbol: STRING, update_id: BIGINT, best_bid_price: {DEC}, "
        f"best_bid_quantity: {DEC}, best_ask_price: {DEC}, best_ask_quantity: {DEC}>"
    ),
    "p_depth": (
        f"STRUCT<symbol: STRING, last_update_id: BIGINT, bids: {LEVELS}, asks: {LEVELS}>"
    ),
    "p_book": f"STRUCT<bids: {LEVELS}, asks: {LEVELS}, book_hash: STRING>",
    "p_change": (
        f"STRUCT<side: STRING, price: {DEC}, quantity: {DEC}, best_bid: {DEC}, "
        f"best_ask: {DEC}, change_hash: STRING>"
    ),
    "p_best": f"STRUCT<best_bid: {DEC}, best_ask: {DEC}, spread: {DEC}>",
    "p_last_trade": (
        f"STRUCT<price: {DEC}, quantity: {DEC}, side: STRING, fee_rate_bps: {DEC}>"
    ),
    "p_tick_size": f"STRUCT<old_tick_size: {DEC}, new_tick_size: {DEC}>",
    "p_resolved": (
        "STRUCT<winning_asset_id: STRING, winning_outcome: STRING, "
        "affected_asset_ids: ARRAY<STRING>, market_id: STRING, condition_id: STRING>"
    ),
    "p_status": (
        "STRUCT<source: STRING, connected: BOOLEAN, session_id: STRING, "
        "reconnect_count: BIGINT, reason: STRING>"
    ),
    "p_tick": (
        "STRUCT<snapshot_sequence: BIGINT, scheduled_timestamp_ns: BIGINT, "
        f"health: {HEALTH_ROWS}>"
    ),
    "p_market": (
        f"STRUCT<state: STRING, timeframe: STRING, current_market: {WINDOW}, "
        f"next_market: {WINDOW}, expected_transition_timestamp_ns: BIGINT, "
        "updated_at_timestamp_ns: BIGINT, attempt_count: BIGINT, last_error: STRING>"
    ),
}
PAYLOAD_OF_STREAM = {
    "chainlink_price": "p_oracle",
    "binance_agg_trade": "p_trade",
    "binance_book_ticker": "p_ticker",
    "binance_depth20": "p_depth",
    "clob_book": "p_book",
    "clob_price_change": "p_change",
    "clob_best_bid_ask": "p_best",
    "clob_last_trade": "p_last_trade",
    "clob_tick_size_change": "p_tick_size",
    "clob_market_resolved": "p_resolved",
    "source_status": "p_status",
    "snapshot_tick": "p_tick",
    "market_window_state": "p_market",
}

ENVELOPE = {
    "schema_version": "INT",
    "ingest_sequence": "BIGINT",
    "event_id": "STRING",
    "source": "STRING",
    "stream": "STRING",
    "instrument": "STRING",
    "source_timestamp_ns": "BIGINT",
    "server_timestamp_ns": "BIGINT",
    "received_wall_timestamp_ns": "BIGINT",
    "received_monotonic_ns": "BIGINT",
    "source_sequence": "STRING",
    "timeframe": "STRING",
    "market_id": "STRING",
    "condition_id": "STRING",
    "asset_id": "STRING",
    "outcome": "STRING",
    "source_session_id": "STRING",
    "payload_raw": "STRING",
}
EVENT_COLUMNS = {**ENVELOPE, **PAYLOADS}


def ddl(columns: dict[str, str]) -> StructType:
    return T._parse_datatype_string(", ".join(f"{n}: {t}" for n, t in columns.items()))


FRAMES = {
    "source": "STRING",
    "session_id": "STRING",
    "received_wall_ns": "BIGINT",
    "received_monotonic_ns": "BIGINT",
    "raw": "STRING",
}
SEGMENTS = {
    "schema_version": "INT",
    "relative_path": "STRING",
    "sha256": "STRING",
    "event_count": "BIGINT",
    "first_ingest_sequence": "BIGINT",
    "last_ingest_sequence": "BIGINT",
    "first_received_timestamp_ns": "BIGINT",
    "last_received_timestamp_ns": "BIGINT",
    "uncompressed_bytes": "BIGINT",
    "compressed_bytes": "BIGINT",
    "created_at_utc": "STRING",
    "finalized_at_utc": "STRING",
}
TRANSITION_LOG = {
    "event_type": "STRING",
    "timeframe": "STRING",
    "status": "STRING",
    "expected_start_utc": "STRING",
    "search_started_at_utc": "STRING",
    "resolved_at_utc": "STRING",
    "attempt_count": "BIGINT",
    "transition_delay_ms": "BIGINT",
    "previous_market_id": "STRING",
    "new_market_id": "STRING",
    "condition_id": "STRING",
    "up_token_id": "STRING",
    "down_token_id": "STRING",
    "last_error": "STRING",
}
MARKET_PAYLOADS = {
    "timeframe": "STRING",
    "expected_start": "TIMESTAMP",
    "fetched_at": "TIMESTAMP",
    "body": "STRING",
    "error": "STRING",
}
ATTEMPTS = {
    "timeframe": "STRING",
    "expected_start": "TIMESTAMP",
    "requested_at": "TIMESTAMP",
    "resolved_at": "TIMESTAMP",
    "outcome": "STRING",
    "market": WINDOW,
    "error": "STRING",
}
TEXT_LEVELS = "ARRAY<STRUCT<price: STRING, quantity: STRING>>"
SNAPSHOT_FILE = {
    "schema_version": "INT",
    "snapshot_sequence": "BIGINT",
    "snapshot_timestamp_ns": "BIGINT",
    "ready_for_strategy": "BOOLEAN",
    "not_ready_reasons": "ARRAY<STRING>",
    "chainlink_price": "STRING",
    "binance_last_price": "STRING",
    "binance_best_bid": "STRING",
    "binance_best_ask": "STRING",
    "binance_depth_bids": TEXT_LEVELS,
    "binance_depth_asks": TEXT_LEVELS,
    "market_5m_up_bids": TEXT_LEVELS,
    "market_5m_up_asks": TEXT_LEVELS,
    "market_5m_down_bids": TEXT_LEVELS,
    "market_5m_down_asks": TEXT_LEVELS,
    "market_15m_up_bids": TEXT_LEVELS,
    "market_15m_up_asks": TEXT_LEVELS,
    "market_15m_down_bids": TEXT_LEVELS,
    "market_15m_down_asks": TEXT_LEVELS,
    "snapshot_json": "STRING",
}
