import json

from pyspark.sql import functions as F

from tickstate.functions.decimals import validate_decimal
from tickstate.operators.ordering import ARRIVAL
from tickstate.operators.parse_books import asset_registry, parse_book_frames
from tickstate.operators import parse_prices
from tickstate.operators.parse_prices import parse_agg_trades, parse_book_ticker, parse_depth, parse_oracle_price

NOW_MS = 1_741_336_200_000
NOW = NOW_MS * 1_000_000


def frames(spark, source, raws):
    rows = [
        (source, "s1", i + 1, NOW + i, NOW + i, r if isinstance(r, str) else json.dumps(r))
        for i, r in enumerate(raws)
    ]
    return spark.createDataFrame(
        rows,
        f"source string, session_id string, {ARRIVAL} long, received_wall_ns long, "
        "received_monotonic_ns long, raw string",
    )


def reasons(result):
    accepted, rejected = result
    out = {r[ARRIVAL]: "ok" for r in accepted.collect()}
    out.update({r[ARRIVAL]: r["reject_reason"] for r in rejected.collect()})
    return [out[k] for k in sorted(out)]


def test_decimals(spark):
    cases = {
        "1.5": None, " 2 ": None, "0": None, "-0": None, "1e5": None, "NaN": "not_finite",
        "-Infinity": "not_finite", "-1": "negative", "x": "not_decimal", "": "not_decimal",
        "0.123456789": "decimal_out_of_range", "0.1234567800": None, "1e-9": "decimal_out_of_range",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["t_reason"] for r in validate_decimal(df, "t").collect()}
    assert got == cases
    zero = validate_decimal(df, "t", True).where("t in ('0', '-0')").select("t_reason").distinct()
    assert [r[0] for r in zero.collect()] == ["not_positive"]


def oracle(ms=NOW_MS, value="51876.25", **top):
    payload = {"symbol": "btc/usd", "timestamp": ms}
    if value is not None:
        payload["value"] = value
    return {"topic": "crypto_prices_chainlink", "type": "update", "timestamp": ms, "payload": payload} | top


def test_oracle_price(spark):
    raws = [
        oracle(), oracle(topic="x"), oracle(type="y"), oracle(payload=[]), oracle(timestamp="1"),
        oracle(NOW_MS + 6000), oracle(NOW_MS - 1), oracle(value=None), oracle(value="0"), oracle(),
        "PONG", "{",
    ]
    assert reasons(parse_oracle_price(frames(spark, "chainlink_rtds", raws))) == [
        "ok", "unexpected_topic", "unexpected_type", "payload_not_object", "invalid_timestamp",
        "future_time", "out_of_order", "price_missing", "price_not_positive", "ok", "control", "not_json",
    ]


def trade(a=1, **data):
    base = {"e": "aggTrade", "E": NOW_MS * 1000, "s": "BTCUSDT", "a": a, "p": "1.5", "q": "2", "f": 1,
            "l": 2, "T": NOW_MS * 1000, "m": True, "M": True}
    return {"stream": "btcusdt@aggTrade", "data": base | data}


def test_agg_trades(spark):
    raws = [trade(5), trade(5), trade(7, f=3), trade(8, m=1), trade(9, q="0"), trade(6, m=False), trade(True)]
    result = parse_agg_trades(frames(spark, "binance_spot", raws))
    assert reasons(result) == [
        "ok", "not_increasing", "first_after_last", "invalid_maker", "quantity_not_positive", "ok", "invalid_trade_id",
    ]
    sides = {r[ARRIVAL]: r["p_trade"]["taker_side"] for r in result[0].collect()}
    assert sides == {1: "sell", 6: "buy"}


def test_ticker_keys_differ_by_case(spark):
    data = {"u": 1, "s": "BTCUSDT", "b": "99", "B": "2", "a": "101", "A": "3"}
    raws = [{"stream": "btcusdt@bookTicker", "data": data},
            {"stream": "btcusdt@bookTicker", "data": data | {"u": 2, "b": "101"}}, trade(1)]
    result = parse_book_ticker(frames(spark, "binance_spot", raws))
    assert reasons(result) == ["ok", "crossed"]
    q = result[0].first()["p_ticker"]
    assert (q["best_bid_quantity"], q["best_ask_quantity"]) == (2, 3)


def test_depth(spark):
    def depth(n, bids, asks):
        return {"stream": "btcusdt@depth20@100ms", "data": {"lastUpdateId": n, "bids": bids, "asks": asks}}

    ok = [["10", "1"], ["9", "1"]]
    asks = [["11", "1"]]
    raws = [depth(1, ok, asks), depth(2, [], asks), depth(3, ok * 11, asks), depth(4, ok[::-1], asks),
            depth(5, [["10", "1"], ["10.0", "1"]], asks), depth(6, ok, [["10", "1"]]), depth(7, [["10"]], asks)]
    assert reasons(parse_depth(frames(spark, "binance_spot", raws))) == [
        "ok", "bids_count", "bids_count", "bids_unsorted", "bids_duplicate", "crossed", "bids_level",
    ]


def registry(spark):
    rows = [(a, "5m", "m1", "c1", o, 0, 1 << 62) for a, o in (("up1", "up"), ("down1", "down"))]
    return spark.createDataFrame(
        rows, "asset_id string, timeframe string, market_id string, condition_id string, outcome string, "
        "known_from_ns long, known_to_ns long")


def book(bids, asks, asset="up1", **more):
    level = lambda pairs: [{"price": p, "size": s} for p, s in pairs]
    return {"event_type": "book", "asset_id": asset, "market": "c1", "bids": level(bids), "asks": level(asks),
            "timestamp": str(NOW_MS), "hash": "h"} | more


def change(*items):
    return {"event_type": "price_change", "market": "c1", "timestamp": str(NOW_MS), "price_changes": [
        {"asset_id": a, "price": p, "size": "1", "side": "BUY", "best_bid": "0.4", "best_ask": None} for a, p in items]}


def test_book_frames(spark):
    raws = [
        book([("0.4", "1"), ("0.45", "2"), ("0.3", "0")], [("0.5", "1")]),
        change(("up1", "0.4"), ("down1", "0.5")),
        change(("up1", "0.4"), ("zzz", "0.5")),
        book([("0.4", "1"), ("0.4", "0")], []),
        book([("0.4", "0"), ("0.4", "1")], []),
        book([("0.6", "1")], [("0.5", "1")]),
        [book([("0.4", "1")], [], hash="a"), {"event_type": "new"}, book([("0.4", "1")], [], hash="b")],
        {"event_type": "market_resolved", "timestamp": str(NOW_MS), "market": "c1", "winning_asset_id": "up1", "winning_outcome": "Yes"},
        {"event_type": "market_resolved", "timestamp": str(NOW_MS), "assets_ids": ["zzz"]},
    ]
    accepted, rejected = parse_book_frames(frames(spark, "clob", raws), registry(spark))
    bad = {(r[ARRIVAL], r["position"]): r["reject_reason"] for r in rejected.collect()}
    assert bad == {
        (3, 0): "unknown_asset", (4, 0): "bids_duplicate", (6, 0): "crossed", (7, 1): "invalid_timestamp",
        (7, 2): "frame_aborted", (9, 0): "unknown_asset",
    }
    rows = accepted.orderBy(ARRIVAL, "position", "item").collect()
    assert [(r[ARRIVAL], r["asset_id"]) for r in rows] == [
        (1, "up1"), (2, "up1"), (2, "down1"), (5, "up1"), (7, "up1"), (8, "down1"), (8, "up1")]
    assert [float(l["price"]) for l in rows[0]["p_book"]["bids"]] == [0.45, 0.4]
    assert rows[0]["event_id"] == "clob:book:up1:h"
    resolved = rows[-1]["p_resolved"]
    assert (resolved["winning_outcome"], resolved["affected_asset_ids"]) == ("up", ["down1", "up1"])


def test_registry_grace(spark):
    import events_kit as kit

    rows = []
    for seq, second, tag in ((1, 0, "a"), (2, 100, "b"), (3, 105, "a"), (4, 300, "b")):
        at = kit.START + second * kit.SECOND
        rows.append(kit.event(seq, "market_discovery", "market_window_state", at, p_market={
            "state": "active", "timeframe": "5m", "current_market": kit.window("5m", 1_700_000_100, tag),
            "next_market": None, "expected_transition_timestamp_ns": None, "updated_at_timestamp_ns": at,
            "attempt_count": 0, "last_error": None}))
    spans = asset_registry(kit.frame(spark, rows), 10).where("asset_id like '%up'").collect()
    got = sorted((r["asset_id"], (r["known_from_ns"] - kit.START) // kit.SECOND,
                  min((r["known_to_ns"] - kit.START) // kit.SECOND, 999)) for r in spans)
    assert got == [("a-up", 0, 310), ("b-up", 100, 115), ("b-up", 300, 999)]


def test_frames_are_parsed_once(spark):
    """A frame's JSON is read once, lists and single messages alike."""
    from pyspark.sql import functions as F

    from tickstate.operators.parse_books import explode_frames

    texts = ['[{"event_type":"a"},{"event_type":"b"}]', '{"event_type":"c"}', "[]", "{broken", "null", "7"]
    frames = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "arrival_no long, raw string")
    rows = explode_frames(frames)
    got = sorted(rows.select("arrival_no", "position", F.coalesce("event_type", F.lit("-"))).collect())
    assert [tuple(r) for r in got] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (3, 0, "-"), (4, 0, "-"), (5, 0, "-")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_depth_lists_are_read_from_the_frame_once(spark):
    sides = {
        '[["2","1"],["1","1"]]': None, "[]": "bids_count", '{"a":1}': "bids_count", '[["1","1"],["1","1"]]': "bids_duplicate",
        '[["1","1"],["2","1"]]': "bids_unsorted", '[["1"]]': "bids_level", '[["1","1","1"]]': "bids_level", "[null]": "bids_level",
        '[["1","0"]]': "bids_level", '[[null,"1"]]': "bids_level", "[1]": "bids_level", '["x",2,3,4]': "bids_count",
    }
    rows = [(f'{{"data":{{"bids":{text}}}}}', reason) for text, reason in sides.items()]
    df = spark.createDataFrame(rows, "raw string, want string").withColumn("v", F.try_parse_json("raw"))
    df = parse_prices._depth_side(df, F.col("v"), "bids", 3)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.data.bids") <= 4
    assert [(r.raw, r._bids_reason) for r in df.collect()] == rows
