"""Sequential state machine used as the expectation in tests.

Written from the documented semantics; it walks the events one by one, which
the library never does.
"""

import random
from decimal import Decimal as D

LIMITS = {"oracle": 10_000, "depth": 1_000, "trade": 5_000}


def side_best(book):
    return max(book["bids"], default=None), min(book["asks"], default=None)


def uncrossed(book):
    bid, ask = side_best(book)
    return bid is None or ask is None or bid < ask


def run(rows, seed=0, status_connectivity=False):
    """Yields one snapshot dict per tick. Published quotes given as ``?`` are filled in."""
    rng = random.Random(seed)
    latest, trades, states, books, online = {}, [], {}, {}, {}
    session = None
    out = []
    for row in rows:
        stream, at, seq = row["stream"], row["received_wall_timestamp_ns"], row["ingest_sequence"]
        if stream == "clob_best_bid_ask" and row["p_best"]["best_bid"] == "?":
            book = books.get(row["asset_id"])
            bid, ask = side_best(book) if book else (None, None)
            if rng.random() < 0.5:
                bid = D("0.07")
            row["p_best"]["best_bid"], row["p_best"]["best_ask"] = bid, ask
        if stream == "snapshot_tick":
            out.append(snapshot(row, latest, trades, states, books, online, status_connectivity))
            continue
        if stream == "source_status":
            p = row["p_status"]
            online[p["source"]] = p["connected"]
            if p["source"] == "clob":
                if not p["connected"] or p["session_id"] != session:
                    for book in books.values():
                        book.update(bids={}, asks={}, init=False, coherent=False, misses=0, session=None)
                if p["connected"]:
                    session = p["session_id"]
            continue
        if row["source"] == "clob" and session is not None and row["source_session_id"] != session:
            continue
        if stream == "market_window_state":
            states[row["p_market"]["timeframe"]] = row["p_market"]
            wanted = wanted_assets(states)
            books = {a: b for a, b in books.items() if a in wanted}
        elif stream.startswith(("chainlink", "binance")):
            latest[stream] = row
            if stream == "binance_agg_trade":
                trades.append(row)
        elif row["asset_id"] in wanted_assets(states):
            apply_book(row, books)
    return out


def wanted_assets(states):
    return {
        w[f"{side}_token_id"]
        for s in states.values()
        for w in (s["current_market"], s["next_market"])
        if w
        for side in ("up", "down")
    }


def apply_book(row, books):
    identity = tuple(row[c] for c in ("market_id", "condition_id", "timeframe", "outcome"))
    book = books.setdefault(row["asset_id"], {
        "identity": identity, "bids": {}, "asks": {}, "init": False, "coherent": True, "misses": 0,
        "session": row["source_session_id"], "trade": None, "tick": None, "resolved": False, "at": None,
    })
    if book["identity"] != identity:
        return
    book["at"] = row["source_timestamp_ns"]
    stream = row["stream"]
    if stream == "clob_book":
        for side in ("bids", "asks"):
            book[side] = {l["price"]: l["quantity"] for l in row["p_book"][side]}
        book.update(init=True, misses=0, session=row["source_session_id"])
        book["coherent"] = uncrossed(book)
    elif stream == "clob_price_change":
        if book["init"]:
            p = row["p_change"]
            side = book["bids" if p["side"] == "BUY" else "asks"]
            side.pop(p["price"], None)
            if p["quantity"]:
                side[p["price"]] = p["quantity"]
            book["coherent"] = uncrossed(book)
    elif stream == "clob_best_bid_ask":
        if book["init"]:
            p = row["p_best"]
            if side_best(book) != (p["best_bid"], p["best_ask"]):
                book["misses"] += 1
                if book["misses"] > 2:
                    book["coherent"] = False
            elif book["coherent"]:
                book["misses"] = 0
    elif stream == "clob_last_trade":
        book["trade"] = row["p_last_trade"]["price"]
    elif stream == "clob_tick_size_change":
        book["tick"] = row["p_tick_size"]["new_tick_size"]
    elif stream == "clob_market_resolved":
        ids = row["p_resolved"]["affected_asset_ids"]
        book["resolved"] |= not ids or row["asset_id"] in ids


def age(row, now):
    return None if row is None else max(0, (now - row["received_wall_timestamp_ns"]) // 1_000_000)


def snapshot(row, latest, trades, states, books, online, status_connectivity):
    now = row["p_tick"]["scheduled_timestamp_ns"]
    if not status_connectivity:
        online = {h["source"]: h["health"]["connected"] for h in row["p_tick"]["health"]}
    reasons = []

    def need(ok, reason):
        if not ok:
            reasons.append(reason)

    def fresh(stream, limit):
        a = age(latest.get(stream), now)
        return a is not None and a <= limit

    need(online.get("chainlink_rtds", False), "chainlink_disconnected")
    need(fresh("chainlink_price", LIMITS["oracle"]), "chainlink_stale")
    need(online.get("binance_spot", False), "binance_disconnected")
    need(fresh("binance_depth20", LIMITS["depth"]), "binance_depth_stale")
    need(fresh("binance_agg_trade", LIMITS["trade"]), "binance_trade_stale")
    need("binance_book_ticker" in latest, "binance_book_ticker_missing")
    need(online.get("clob", False), "clob_disconnected")
    markets = {tf: market(tf, states.get(tf), books, now) for tf in ("5m", "15m")}
    need(any(markets.values()), "no_active_market")
    for m in markets.values():
        if m:
            reasons += m["reasons"]
    windows = {}
    for s in (1, 5, 30, 60):
        inside = [t["p_trade"] for t in trades if t["received_wall_timestamp_ns"] >= now - s * 10**9]
        buy = sum((t["quantity"] for t in inside if t["taker_side"] == "buy"), D(0))
        sell = sum((t["quantity"] for t in inside if t["taker_side"] == "sell"), D(0))
        notional = sum((t["quantity"] * t["price"] for t in inside), D(0))
        windows[s] = (buy, sell, round(notional / (buy + sell), 6) if inside else None)
    return {
        "sequence": row["p_tick"]["snapshot_sequence"],
        "reasons": list(dict.fromkeys(reasons)),
        "markets": markets,
        "windows": windows,
        "latest": {k: v["ingest_sequence"] for k, v in latest.items()},
    }


def market(tf, state, books, now):
    if state is None or state["current_market"] is None:
        return None
    w = state["current_market"]
    reasons = [] if state["state"] == "active" else [f"{tf}:market_not_active"]
    sides = {}
    for side in ("up", "down"):
        book = books.get(w[f"{side}_token_id"])
        sides[side] = book and {
            "init": book["init"], "coherent": book["coherent"], "resolved": book["resolved"],
            "bids": sorted(book["bids"].items(), reverse=True)[:20],
            "asks": sorted(book["asks"].items())[:20],
            "trade": book["trade"], "tick": book["tick"], "at": book["at"], "session": book["session"],
            "outcome": book["identity"][3],
        }
        if not book or not book["init"]:
            reasons.append(f"{tf}:{side}_book_uninitialized")
        elif not book["coherent"]:
            reasons.append(f"{tf}:{side}_book_incoherent")
    if any(s and s["resolved"] for s in sides.values()):
        reasons.append(f"{tf}:market_resolved")
    return {"id": w["market_id"], "reasons": reasons, "sides": sides,
            "remaining": max(0, (w["end_timestamp_ns"] - now) // 1_000_000)}
