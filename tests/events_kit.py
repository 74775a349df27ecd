"""Invented events for the tests: small builders and a random market day."""

import random
from decimal import Decimal as D

from tickstate.schemas import EVENT_COLUMNS, ddl

SECOND = 1_000_000_000
START = 1_700_000_100 * SECOND
BLANK = {name: None for name in EVENT_COLUMNS}


def event(seq, source, stream, at, **more):
    row = dict(BLANK)
    row.update(
        schema_version=2,
        ingest_sequence=seq,
        event_id=f"e{seq}",
        source=source,
        stream=stream,
        instrument="X",
        received_wall_timestamp_ns=at,
        received_monotonic_ns=at,
        source_timestamp_ns=at - 5,
    )
    row.update(more)
    return row


def frame(spark, rows):
    schema = ddl(EVENT_COLUMNS)
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def window(tf, start_s, tag):
    length = {"5m": 300, "15m": 900}[tf]
    return {
        "timeframe": tf,
        "market_id": f"m-{tag}",
        "condition_id": f"c-{tag}",
        "slug": f"btc-updown-{tf}-{start_s}",
        "start_timestamp_ns": start_s * SECOND,
        "end_timestamp_ns": (start_s + length) * SECOND,
        "up_token_id": f"{tag}-up",
        "down_token_id": f"{tag}-down",
        "resolution_source": "https://data.chain.link/streams/btc-usd",
    }


def levels(pairs):
    return [{"price": D(p), "quantity": D(q)} for p, q in pairs]


def health(rng):
    def one():
        return {
            "connected": rng.random() < 0.8,
            "stale": False,
            "current_session_id": None,
            "last_message_timestamp_ns": None,
            "age_ms": None,
            "reconnect_count": 0,
            "invalid_count": 0,
            "duplicate_count": 0,
            "stale_session_count": 0,
            "divergence_count": 0,
            "protocol_error_count": 0,
        }

    names = ("market_discovery", "chainlink_rtds", "binance_spot", "clob")
    return [{"source": n, "health": one()} for n in names]


def random_day(seed, count=600):
    """Event rows with reconnects, stale sessions, market changes and bad quotes."""
    rng = random.Random(seed)
    rows, now, ticks = [], START, 0
    current = {"5m": 0, "15m": 0}
    session, sessions = None, 0

    def state(tf, name="active"):
        n = current[tf]
        length = {"5m": 300, "15m": 900}[tf]
        base = 1_700_000_100
        return {
            "state": name,
            "timeframe": tf,
            "current_market": window(tf, base + n * length, f"{tf}-{n}") if rng.random() < 0.9 else None,
            "next_market": window(tf, base + (n + 1) * length, f"{tf}-{n + 1}")
            if rng.random() < 0.6
            else None,
            "expected_transition_timestamp_ns": None,
            "updated_at_timestamp_ns": now,
            "attempt_count": 0,
            "last_error": None,
        }

    def book_event(stream, payload, **more):
        tf = rng.choice(["5m", "5m", "15m"])
        n = current[tf] + rng.choice([0, 0, 0, 0, 1, -1])
        tag = f"{tf}-{n}"
        side = rng.choice(["up", "down"])
        outcome = side if rng.random() < 0.97 else "up"
        used = session if rng.random() < 0.93 else f"s{max(0, sessions - 1)}"
        return event(
            seq, "clob", stream, now, timeframe=tf, market_id=f"m-{tag}", condition_id=f"c-{tag}",
            asset_id=f"{tag}-{side}", outcome=outcome, source_session_id=used, **{payload[0]: payload[1]},
        )

    price = lambda: D(rng.randint(40, 60)) / 100
    for seq in range(1, count + 1):
        now += rng.choice([0, 1, 5_000_000, 120_000_000, 700_000_000])
        pick = rng.random()
        if seq <= 2:
            tf = ("5m", "15m")[seq - 1]
            rows.append(event(seq, "market_discovery", "market_window_state", now, timeframe=tf, p_market=state(tf)))
        elif pick < 0.05:
            ticks += 1
            rows.append(event(seq, "market_discovery", "snapshot_tick", now, p_tick={
                "snapshot_sequence": ticks, "scheduled_timestamp_ns": now, "health": health(rng)}))
        elif pick < 0.07:
            tf = rng.choice(["5m", "15m"])
            current[tf] += rng.choice([0, 0, 1])
            name = rng.choice(["active", "active", "searching_next", "next_ready"])
            rows.append(event(seq, "market_discovery", "market_window_state", now, timeframe=tf, p_market=state(tf, name)))
        elif pick < 0.085:
            source = rng.choice(["clob", "clob", "binance_spot", "chainlink_rtds"])
            on = rng.random() < 0.7
            if source == "clob" and on and rng.random() < 0.7:
                sessions += 1
            sid = f"s{sessions}" if source == "clob" else None
            if source == "clob" and on:
                session = sid
            rows.append(event(seq, source, "source_status", now, p_status={
                "source": source, "connected": on, "session_id": sid, "reconnect_count": 0, "reason": None}))
        elif pick < 0.12:
            rows.append(event(seq, "chainlink_rtds", "chainlink_price", now, p_oracle={
                "symbol": "btc/usd", "price": D(rng.randint(60000, 70000))}))
        elif pick < 0.25:
            rows.append(event(seq, "binance_spot", "binance_agg_trade", now, p_trade={
                "symbol": "BTCUSDT", "aggregate_trade_id": seq, "price": D(rng.randint(100, 200)),
                "quantity": D(rng.randint(1, 50)) / 10, "first_trade_id": 1, "last_trade_id": 1,
                "trade_timestamp_ns": now, "taker_side": rng.choice(["buy", "sell"])}))
        elif pick < 0.28:
            bid = D(rng.randint(100, 200))
            rows.append(event(seq, "binance_spot", "binance_book_ticker", now, p_ticker={
                "symbol": "BTCUSDT", "update_id": seq, "best_bid_price": bid,
                "best_bid_quantity": D(rng.randint(0, 3)), "best_ask_price": bid + 1,
                "best_ask_quantity": D(rng.randint(0, 3))}))
        elif pick < 0.31:
            bid = D(rng.randint(100, 200))
            rows.append(event(seq, "binance_spot", "binance_depth20", now, p_depth={
                "symbol": "BTCUSDT", "last_update_id": seq,
                "bids": levels([(bid - i, i + 1) for i in range(3)]),
                "asks": levels([(bid + 1 + i, i + 2) for i in range(3)])}))
        elif pick < 0.40:
            middle = rng.randint(45, 55)
            bids = [(D(middle - 1 - i) / 100, rng.randint(0, 5)) for i in range(rng.randint(0, 4))]
            asks = [(D(middle + i) / 100, rng.randint(1, 5)) for i in range(rng.randint(0, 4))]
            rows.append(book_event("clob_book", ("p_book", {
                "bids": levels(bids), "asks": levels(asks), "book_hash": None})))
        elif pick < 0.70:
            side = rng.choice(["BUY", "SELL"])
            cents = rng.randint(40, 51) if side == "BUY" else rng.randint(50, 60)
            rows.append(book_event("clob_price_change", ("p_change", {
                "side": side, "price": D(cents) / 100, "quantity": D(rng.choice([0, 1, 2, 3])),
                "best_bid": None, "best_ask": None, "change_hash": None})))
        elif pick < 0.92:
            rows.append(book_event("clob_best_bid_ask", ("p_best", {
                "best_bid": "?", "best_ask": "?", "spread": None})))
        elif pick < 0.95:
            rows.append(book_event("clob_last_trade", ("p_last_trade", {
                "price": price(), "quantity": D(1), "side": "BUY", "fee_rate_bps": None})))
        elif pick < 0.97:
            rows.append(book_event("clob_tick_size_change", ("p_tick_size", {
                "old_tick_size": D("0.01"), "new_tick_size": D(rng.randint(1, 9)) / 1000})))
        else:
            row = book_event("clob_market_resolved", ("p_resolved", {
                "winning_asset_id": None, "winning_outcome": None, "affected_asset_ids": [],
                "market_id": None, "condition_id": None}))
            row["p_resolved"]["affected_asset_ids"] = rng.choice([[], [row["asset_id"]], ["other"]])
            rows.append(row)
    return rows
