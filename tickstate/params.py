"""Plain parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Provider limits and defaults.
ROLLING_SECONDS = (1, 5, 30, 60)
TIMEFRAME_SECONDS = {"5m": 300, "15m": 900}
SLUG_PREFIX = "btc-updown"
RESOLUTION_SOURCE = "https://data.chain.link/streams/btc-usd"
ORACLE_TOPIC = "crypto_prices_chainlink"
ORACLE_SYMBOL = "btc/usd"
ORACLE_INSTRUMENT = "BTC/USD"
SPOT_SYMBOL = "BTCUSDT"
SPOT_STREAMS = {
    "trade": "btcusdt@aggTrade",
    "ticker": "btcusdt@bookTicker",
    "depth": "btcusdt@depth20@100ms",
}
SOURCES = ("market_discovery", "chainlink_rtds", "binance_spot", "clob")
STREAMS = (
    "market_window_state",
    "source_status",
    "snapshot_tick",
    "chainlink_price",
    "binance_agg_trade",
    "binance_book_ticker",
    "binance_depth20",
    "clob_book",
    "clob_price_change",
    "clob_best_bid_ask",
    "clob_last_trade",
    "clob_tick_size_change",
    "clob_market_resolved",
)
BOOK_STREAMS = STREAMS[7:]

# Rows of one scan chunk. A chunk is a range of the ingest sequence, so no
# chunk can hold more rows than this whatever the key distribution is.
CHUNK_ROWS = 1 << 20


@dataclass(frozen=True)
class Params:
    """Readiness limits and sizes; the defaults are the documented ones."""

    oracle_stale_ms: int = 10_000
    depth_stale_ms: int = 1_000
    trade_stale_ms: int = 5_000
    future_limit_s: int = 5
    grace_s: int = 10
    tick_interval_ms: int = 250
    rolling_seconds: tuple[int, ...] = ROLLING_SECONDS
    depth_levels: int = 20
    divergence_limit: int = 3
    connectivity: str = "tick_health"
    require_both: bool = False
    chunk_rows: int = CHUNK_ROWS

    def __post_init__(self) -> None:
        if not 50 <= self.tick_interval_ms <= 5000:
            raise ValueError("tick_interval_ms must be between 50 and 5000")
        if self.connectivity not in ("tick_health", "status_events"):
            raise ValueError("connectivity must be tick_health or status_events")
