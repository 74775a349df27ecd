"""Oracle price and spot market frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstate import params as P
from tickstate.functions import variants as V
from tickstate.functions.decimals import decimal_reason, to_decimal
from tickstate.operators.ordering import future_reason, in_ns, keyed_id
from tickstate.operators.parse_common import (
    event_columns,
    first_of,
    frame_envelope,
    json_reason,
    ordered_reasons,
    split,
    when,
)


WIDE = "decimal(38,18)"


def _with_values(df: DataFrame, *fields: str, kind: str = "decimal(18,8)") -> DataFrame:
    """``<field>_value`` for each ``<field>_text``, converted once."""
    return df.withColumns({f"{f}_value": to_decimal(F.col(f"{f}_text"), kind) for f in fields})


def _checked(field: str, positive: bool, kind: str = "decimal(18,8)") -> Column:
    reason = decimal_reason(F.col(f"{field}_text"), positive, kind, F.col(f"{field}_value"))
    return F.concat(F.lit(f"{field}_"), reason)


def _beyond(field: str) -> Column:
    """A valid source time whose nanoseconds do not fit lies in the future."""
    return F.when(F.col(field).isNotNull() & F.col("source_ns").isNull(), "future_time")


def parse_oracle_price(
    frames: DataFrame, future_limit_s: int = 5, chunk_rows: int = P.CHUNK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Oracle price updates; source times may repeat but not go back."""
    df = frames.withColumn("v", F.try_parse_json("raw"))
    v = F.col("v")
    df = df.withColumns(
        {
            "topic": V.text_at(v, "$.topic"),
            "kind": V.text_at(v, "$.type"),
            "symbol": V.text_at(v, "$.payload.symbol"),
            "source_ms": V.positive_int_at(v, "$.payload.timestamp"),
            "server_ms": V.positive_int_at(v, "$.timestamp"),
            "price_text": V.scalar_at(v, "$.payload.value"),
            "_json": json_reason(F.col("raw"), v),
            "_object": V.is_object(v, "$", "topic"),
            "_payload": V.is_object(v, "$.payload", "symbol"),
        }
    ).withColumn("source_ns", in_ns(F.col("source_ms"), 1_000_000))
    df = _with_values(df, "price", kind=WIDE)
    before = first_of(
        F.col("_json"),
        when(~F.col("_object"), "not_object"),
        when(F.col("topic") != P.ORACLE_TOPIC, "unexpected_topic"),
        when(F.col("kind") != "update", "unexpected_type"),
        when(~F.col("_payload"), "payload_not_object"),
        when(F.col("symbol") != P.ORACLE_SYMBOL, "unexpected_symbol"),
        when(F.col("source_ms").isNull(), "invalid_payload_timestamp"),
        when(F.col("server_ms").isNull(), "invalid_timestamp"),
        _beyond("source_ms"),
        future_reason(F.col("source_ns"), F.col("received_wall_ns"), future_limit_s),
    )
    after = first_of(
        F.when(F.col("price_text").isNull(), "price_missing"),
        _checked("price", True, WIDE),
    )
    df = ordered_reasons(
        df, before, after, "source_ns", [], strict=False, chunk_rows=chunk_rows
    )
    columns = event_columns(
        frame_envelope()
        | {
            "event_id": keyed_id("chainlink", "", F.col("source_ms"), F.col("server_ms")),
            "source": F.lit("chainlink_rtds"),
            "stream": F.lit("chainlink_price"),
            "instrument": F.lit(P.ORACLE_INSTRUMENT),
            "source_timestamp_ns": F.col("source_ns"),
            "server_timestamp_ns": in_ns(F.col("server_ms"), 1_000_000),
            "source_sequence": F.col("source_ms"),
            "payload_raw": F.col("raw"),
            "p_oracle": F.struct(
                F.col("symbol").alias("symbol"), F.col("price_value").alias("price")
            ),
        }
    )
    return split(df, columns)


def _spot(frames: DataFrame, stream: str, field: str) -> tuple[DataFrame, Column]:
    """Parsed frames with the checks every spot frame shares.

    Frames of the other spot streams belong to the other parsers and are left out;
    frames of no known stream are rejected by the trade parser.
    """
    raw = F.col("raw")
    others = [name for name in P.SPOT_STREAMS.values() if name != stream]
    # the name may be written with \\u escapes; without any it stands there as it is
    escaped = raw.contains("\\u")
    if stream == P.SPOT_STREAMS["trade"]:
        # text of another stream is a hint; only then is the field itself looked at
        hinted = raw.contains(others[0]) | raw.contains(others[1]) | escaped
        named = F.get_json_object(raw, "$.stream").isin(others)
        frames = frames.where(~hinted | ~F.coalesce(named, F.lit(False)))
    else:
        frames = frames.where(raw.contains(stream) | escaped)
    df = frames.withColumn("v", F.try_parse_json("raw"))
    v = F.col("v")
    df = df.withColumns(
        {
            "stream": V.text_at(v, "$.stream"),
            "_json": json_reason(raw, v),
            "_data": V.is_object(v, "$.data", field),
        }
    )
    shared = first_of(
        F.col("_json"),
        when(~F.col("_data"), "data_not_object"),
        when(F.col("stream") != stream, "unexpected_stream"),
    )
    return df, shared


def _spot_event(stream: str, provider_kind: str, number: str, per_session: bool) -> dict:
    parts = [F.lit(P.SPOT_SYMBOL)] + ([F.col("session_id")] if per_session else [])
    return frame_envelope() | {
        "event_id": keyed_id("binance", provider_kind, *parts, F.col(number)),
        "source": F.lit("binance_spot"),
        "stream": F.lit(stream),
        "instrument": F.lit(P.SPOT_SYMBOL),
        "source_sequence": F.col(number),
        "payload_raw": F.col("raw"),
    }


def parse_agg_trades(
    frames: DataFrame,
    unit: str = "us",
    future_limit_s: int = 5,
    chunk_rows: int = P.CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Aggregate trades; the taker sells when the buyer is the maker."""
    factor = {"us": 1_000, "ms": 1_000_000}[unit]
    df, shared = _spot(frames, P.SPOT_STREAMS["trade"], "a")
    v = F.col("v")
    df = df.withColumns(
        {
            "kind": V.text_at(v, "$.data.e"),
            "symbol": V.text_at(v, "$.data.s"),
            "trade_no": V.positive_int_at(v, "$.data.a"),
            "first_no": V.positive_int_at(v, "$.data.f"),
            "last_no": V.positive_int_at(v, "$.data.l"),
            "event_at": V.positive_int_at(v, "$.data.E"),
            "trade_at": V.positive_int_at(v, "$.data.T"),
            "maker": V.bool_at(v, "$.data.m"),
            "price_text": V.scalar_at(v, "$.data.p"),
            "quantity_text": V.scalar_at(v, "$.data.q"),
        }
    ).withColumn("source_ns", in_ns(F.col("trade_at"), factor))
    df = _with_values(df, "price", "quantity")
    before = first_of(
        shared,
        when(
            (F.col("kind") != "aggTrade") | (F.col("symbol") != P.SPOT_SYMBOL), "invalid_identity"
        ),
        when(F.col("trade_no").isNull(), "invalid_trade_id"),
    )
    after = first_of(
        when(F.col("first_no").isNull(), "invalid_first_id"),
        when(F.col("last_no").isNull(), "invalid_last_id"),
        when(F.col("first_no") > F.col("last_no"), "first_after_last"),
        when(F.col("event_at").isNull(), "invalid_event_time"),
        when(F.col("trade_at").isNull(), "invalid_trade_time"),
        _beyond("trade_at"),
        future_reason(F.col("source_ns"), F.col("received_wall_ns"), future_limit_s),
        when(F.col("maker").isNull(), "invalid_maker"),
        _checked("price", True),
        _checked("quantity", True),
    )
    df = ordered_reasons(
        df, before, after, "trade_no", ["session_id"], strict=True, chunk_rows=chunk_rows
    )
    payload = F.struct(
        F.lit(P.SPOT_SYMBOL).alias("symbol"),
        F.col("trade_no").alias("aggregate_trade_id"),
        F.col("price_value").alias("price"),
        F.col("quantity_value").alias("quantity"),
        F.col("first_no").alias("first_trade_id"),
        F.col("last_no").alias("last_trade_id"),
        F.col("source_ns").alias("trade_timestamp_ns"),
        F.when(F.col("maker"), "sell").otherwise("buy").alias("taker_side"),
    )
    columns = event_columns(
        _spot_event("binance_agg_trade", "aggTrade", "trade_no", False)
        | {
            "source_timestamp_ns": F.col("source_ns"),
            "server_timestamp_ns": in_ns(F.col("event_at"), factor),
            "p_trade": payload,
        }
    )
    return split(df, columns)


def parse_book_ticker(
    frames: DataFrame, chunk_rows: int = P.CHUNK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """P5: best bid and ask of the spot market; crossed quotes are rejected."""
    stream = P.SPOT_STREAMS["ticker"]
    df, shared = _spot(frames, stream, "u")
    v = F.col("v")
    df = df.withColumns(
        {
            "symbol": V.text_at(v, "$.data.s"),
            "update_no": V.positive_int_at(v, "$.data.u"),
            "bid_text": V.scalar_at(v, "$.data.b"),
            "ask_text": V.scalar_at(v, "$.data.a"),
            "bid_quantity_text": V.scalar_at(v, "$.data.B"),
            "ask_quantity_text": V.scalar_at(v, "$.data.A"),
        }
    )
    df = _with_values(df, "bid", "ask", "bid_quantity", "ask_quantity")
    bid, ask = F.col("bid_value"), F.col("ask_value")
    before = first_of(
        shared,
        when(F.col("symbol") != P.SPOT_SYMBOL, "unexpected_symbol"),
        when(F.col("update_no").isNull(), "invalid_update_id"),
    )
    after = first_of(
        _checked("bid", True),
        _checked("ask", True),
        _checked("bid_quantity", False),
        _checked("ask_quantity", False),
        when(bid >= ask, "crossed"),
    )
    df = ordered_reasons(
        df,
        before,
        after,
        "update_no",
        ["session_id"],
        strict=True,
        chunk_rows=chunk_rows,
        keep=F.col("stream") == stream,
    )
    payload = F.struct(
        F.lit(P.SPOT_SYMBOL).alias("symbol"),
        F.col("update_no").alias("update_id"),
        bid.alias("best_bid_price"),
        F.col("bid_quantity_value").alias("best_bid_quantity"),
        ask.alias("best_ask_price"),
        F.col("ask_quantity_value").alias("best_ask_quantity"),
    )
    columns = event_columns(
        _spot_event("binance_book_ticker", "bookTicker", "update_no", True) | {"p_ticker": payload}
    )
    return split(df, columns)


def _depth_side(df: DataFrame, v: Column, side: str, max_levels: int) -> DataFrame:
    """Add ``<side>`` and ``_<side>_reason`` of one side given as ``[[price, quantity], ...]``.

    Each step reads columns of the one before, so the list is taken from the frame and its numbers are read once.
    """
    path = f"$.data.{side}"
    rows, levels, reason = f"_{side}_rows", f"_{side}_levels", f"_{side}_reason"
    df = df.withColumn(rows, V.get(v, path, "array<array<string>>"))
    # a list with another kind of row is counted as it is
    count = F.when(F.col(rows).isNotNull(), F.size(rows)).otherwise(F.size(V.list_at(v, path)))
    df = df.withColumns(
        {
            f"_{side}_count": count,
            levels: F.transform(
                rows,
                lambda row: F.struct(
                    to_decimal(F.get(row, 0)).alias("price"),
                    to_decimal(F.get(row, 1)).alias("quantity"),
                ),
            ),
            f"_{side}_pairs": F.forall(rows, lambda row: F.coalesce(F.size(row) == 2, F.lit(False))),
        }
    )
    bad_level = F.exists(
        levels, lambda level: F.coalesce(~(level["price"] > 0) | ~(level["quantity"] > 0), F.lit(True))
    )
    prices = F.col(levels)["price"]
    df = df.withColumn(
        reason,
        first_of(
            when(~F.col(f"_{side}_count").between(1, max_levels), f"{side}_count"),
            when(F.col(rows).isNull() | ~F.col(f"_{side}_pairs") | bad_level, f"{side}_level"),
            when(F.size(F.array_distinct(prices)) != F.size(prices), f"{side}_duplicate"),
            when(prices != F.sort_array(prices, asc=side == "asks"), f"{side}_unsorted"),
        ),
    )
    return df.withColumn(side, F.when(F.col(reason).isNull(), F.col(levels))).drop(
        rows, levels, f"_{side}_count", f"_{side}_pairs"
    )


def parse_depth(
    frames: DataFrame, max_levels: int = 20, chunk_rows: int = P.CHUNK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Partial depth, one to ``max_levels`` sorted levels a side, not crossed."""
    stream = P.SPOT_STREAMS["depth"]
    df, shared = _spot(frames, stream, "lastUpdateId")
    v = F.col("v")
    df = df.withColumn("update_no", V.positive_int_at(v, "$.data.lastUpdateId"))
    for side in ("bids", "asks"):
        df = _depth_side(df, v, side, max_levels)
    before = first_of(shared, when(F.col("update_no").isNull(), "invalid_update_id"))
    after = first_of(
        F.col("_bids_reason"),
        F.col("_asks_reason"),
        when(F.get("bids", 0)["price"] >= F.get("asks", 0)["price"], "crossed"),
    )
    df = ordered_reasons(
        df,
        before,
        after,
        "update_no",
        ["session_id"],
        strict=True,
        chunk_rows=chunk_rows,
        keep=F.col("stream") == stream,
    )
    payload = F.struct(
        F.lit(P.SPOT_SYMBOL).alias("symbol"),
        F.col("update_no").alias("last_update_id"),
        F.col("bids").alias("bids"),
        F.col("asks").alias("asks"),
    )
    columns = event_columns(
        _spot_event("binance_depth20", "depth20", "update_no", True) | {"p_depth": payload}
    )
    return split(df, columns)
