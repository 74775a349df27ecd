"""Quote, depth and window metrics (M1-M8, A3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = "decimal(38,12)"


def quotient(top: Column, bottom: Column, top_type: str, bottom_type: str) -> Column:
    """Quotient in the given types, which leave many digits; in full width where a value
    does not fit them. Null on a zero or null divisor or a result beyond 26 digits."""
    narrow = F.try_divide(top.try_cast(top_type), bottom.try_cast(bottom_type))
    return F.coalesce(narrow.try_cast(RATIO), F.try_divide(top, bottom).try_cast(RATIO))


def divide(top: Column, bottom: Column) -> Column:
    """Decimal quotient with at least eight digits (six beyond 16 integer digits)."""
    return quotient(top, bottom, "decimal(28,12)", "decimal(20,8)")


def spread(bid: Column, ask: Column) -> Column:
    return ask - bid


def mid(bid: Column, ask: Column) -> Column:
    return ((ask + bid) / F.lit(2)).cast("decimal(20,9)")


def spread_bps(bid: Column, ask: Column) -> Column:
    return (F.try_divide(spread(bid, ask).cast("decimal(20,8)"), mid(bid, ask)) * 10000).cast(RATIO)


def microprice(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> Column:
    return quotient(
        ask * bid_qty + bid * ask_qty, bid_qty + ask_qty, "decimal(34,14)", "decimal(19,8)"
    )


def imbalance(left: Column, right: Column) -> Column:
    return quotient(left - right, left + right, "decimal(24,8)", "decimal(24,8)").cast("decimal(18,12)")


def notional(levels: Column) -> Column:
    """A3: sum of price times quantity over a list of levels."""
    return F.aggregate(
        levels,
        F.lit(0).cast("decimal(38,10)"),
        lambda total, level: (total + level["price"] * level["quantity"]).cast("decimal(38,10)"),
    )


def with_quote_metrics(
    df: DataFrame,
    bid: str = "best_bid",
    ask: str = "best_ask",
    bid_qty: str = "best_bid_quantity",
    ask_qty: str = "best_ask_quantity",
) -> DataFrame:
    """M1-M5."""
    b, a, bq, aq = (F.col(c) for c in (bid, ask, bid_qty, ask_qty))
    return df.withColumns(
        {
            "mid_price": mid(b, a),
            "spread": spread(b, a),
            "spread_bps": spread_bps(b, a),
            "microprice": microprice(b, bq, a, aq),
            "top1_imbalance": imbalance(bq, aq),
        }
    )


def depth_notional(df: DataFrame, levels: str, name: str | None = None) -> DataFrame:
    """A3 as an operator on one levels column."""
    return df.withColumn(name or f"{levels}_notional", notional(F.col(levels)))


def with_depth_metrics(
    df: DataFrame, bids: str = "depth_bids", asks: str = "depth_asks"
) -> DataFrame:
    """M6-M7."""
    bid, ask = notional(F.col(bids)), notional(F.col(asks))
    return df.withColumns(
        {
            "top20_bid_notional": bid,
            "top20_ask_notional": ask,
            "top20_depth_imbalance": imbalance(bid, ask),
        }
    )


def floor_ms(delta_ns: Column) -> Column:
    """Nanoseconds to whole milliseconds, rounding down."""
    million = F.lit(1_000_000)
    return F.call_function("div", delta_ns - F.pmod(delta_ns, million), million)


def remaining_ms(end_ns: Column, now_ns: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), floor_ms(end_ns - now_ns))


def with_remaining(df: DataFrame, end: str = "end_timestamp_ns", now: str = "now_ns") -> DataFrame:
    """M8."""
    return df.withColumn("remaining_ms", remaining_ms(F.col(end), F.col(now)))
