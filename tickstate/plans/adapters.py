"""Market-data tables derived from the generic test tables.

``events`` gives ordered envelopes, trades, quotes and frames; ``lineitem`` gives
order-book messages; ``orders`` gives market metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstate.functions import calendar as C
from tickstate.operators.asof import SEQ
from tickstate.operators.ordered import kept_rows, number_rows
from tickstate.operators.ordering import ARRIVAL
from tickstate.params import RESOLUTION_SOURCE
from tickstate.schemas import DEC, WINDOW

LINE_ORDER = [
    "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_linestatus",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns_of(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, ns, at, user_id, event_type, price, k`` of every event."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        (F.col("event_id") + 1).alias("seq"),
        ns_of(F.col("ts")).alias("ns"),
        F.col("ts").cast("timestamp").alias("at"),
        "user_id",
        "event_type",
        F.col("value").cast(DEC).alias("price"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"),
    )


def value_text() -> Column:
    """The price with two decimals, as providers send it."""
    return F.col("price").cast("decimal(18,2)").cast("string")


def frames(ev: DataFrame, source: str, raw: Column) -> DataFrame:
    # landed frames are many files; the events are one, so they are spread first
    ev = ev.repartition(ev.sparkSession.sparkContext.defaultParallelism, "seq")
    return ev.select(
        F.lit(source).alias("source"),
        F.concat(F.lit("s"), F.expr("seq div 500").cast("string")).alias("session_id"),
        F.col("seq").alias(ARRIVAL),
        F.col("ns").alias("received_wall_ns"),
        F.col("ns").alias("received_monotonic_ns"),
        raw.alias("raw"),
    )


def trades(ev: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """Purchases buy, clicks sell; quantity k+1."""
    return ev.where(F.col("event_type").isin("purchase", "click")).select(
        *[F.col(c).alias(n) for n, c in (keys or {}).items()],
        F.col("seq").alias(SEQ),
        F.col("ns").alias("received_wall_timestamp_ns"),
        "price",
        (F.col("k") + 1).cast(DEC).alias("quantity"),
        F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("taker_side"),
    )


def quotes(ev: DataFrame) -> DataFrame:
    """Views are quotes: bid at the price, ask (k+1) cents above."""
    k = F.col("k")
    return ev.where(F.col("event_type") == "view").select(
        F.col("seq").alias(SEQ),
        "user_id",
        F.col("ns").alias("received_wall_timestamp_ns"),
        F.col("price").alias("best_bid"),
        (F.col("price") + ((k + 1) * F.lit(0.01).cast("decimal(4,2)"))).cast(DEC).alias("best_ask"),
        (k + 1).cast(DEC).alias("best_bid_quantity"),
        (100 - k).cast(DEC).alias("best_ask_quantity"),
    )


def ticks(ev: DataFrame) -> DataFrame:
    """Errors are ticks."""
    return ev.where(F.col("event_type") == "error").select(
        F.col("seq").alias(SEQ), "user_id", F.col("ns").alias("now_ns"), "k"
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item in one dense order."""
    li = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    return number_rows(li, LINE_ORDER, SEQ, kept_rows)


def line_ns() -> Column:
    return ns_of(F.col("l_shipdate"))


def level_price() -> Column:
    """One of eleven prices from 0.01 to 0.11."""
    return ((F.round(F.col("l_discount") * 100).cast("int") + 1) / F.lit(100)).cast(DEC)


def _level(price: Column, quantity: Column) -> Column:
    return F.struct(price.cast(DEC).alias("price"), quantity.cast(DEC).alias("quantity"))


def book_rows(li: DataFrame, *more: Column) -> DataFrame:
    """Order-book events of each supplier's book, with ``more`` columns of the lines.

    Line number 7 is a full book of one level a side, 1 to 4 change a level (no tax
    deletes it), 5 is a point where the book is read, 6 a published best price.
    """
    number = F.col("l_linenumber")
    stream = (
        F.when(number == 7, "clob_book")
        .when(number == 6, "clob_best_bid_ask")
        .when(number == 5, "point")
        .otherwise("clob_price_change")
    )
    price, quantity = level_price(), F.col("l_quantity")
    buys = F.col("l_linestatus") == "O"
    ask = price + F.lit(0.06).cast("decimal(4,2)")
    side_price = F.when(buys, price).otherwise(ask)
    shown = F.col("l_tax") < 0.04
    return li.select(
        SEQ,
        F.col("l_suppkey").cast("string").alias("asset_id"),
        stream.alias("stream"),
        F.lit("m").alias("market_id"),
        F.lit("c").alias("condition_id"),
        F.lit("5m").alias("timeframe"),
        F.lit("up").alias("outcome"),
        F.lit(None).cast("string").alias("source_session_id"),
        line_ns().alias("source_timestamp_ns"),
        line_ns().alias("received_wall_timestamp_ns"),
        F.when(
            number == 7,
            F.struct(
                F.array(_level(price, quantity)).alias("bids"),
                F.array(_level(ask, quantity)).alias("asks"),
                F.lit(None).cast("string").alias("book_hash"),
            ),
        ).alias("p_book"),
        F.when(
            number <= 4,
            F.struct(
                F.when(buys, "BUY").otherwise("SELL").alias("side"),
                side_price.cast(DEC).alias("price"),
                F.when(F.col("l_tax") == 0, F.lit(0)).otherwise(quantity).cast(DEC).alias("quantity"),
            ),
        ).alias("p_change"),
        F.when(
            number == 6,
            F.struct(
                F.when(shown, F.lit(0.11)).otherwise(price).cast(DEC).alias("best_bid"),
                F.when(shown, F.lit(0.07)).otherwise(ask).cast(DEC).alias("best_ask"),
                F.lit(None).cast(DEC).alias("spread"),
            ),
        ).alias("p_best"),
        F.when(
            number == 1, F.struct(side_price.cast(DEC).alias("price"))
        ).alias("p_last_trade"),
        F.when(
            number == 2, F.struct(price.alias("new_tick_size"))
        ).alias("p_tick_size"),
        *more,
    )


def market_window(timeframe: Column, start: Column, name: Column) -> Column:
    """A window struct with derived ids."""
    start_ns = F.unix_micros(start) * 1000
    return F.struct(
        timeframe.alias("timeframe"),
        F.concat(F.lit("m-"), name).alias("market_id"),
        F.concat(F.lit("c-"), name).alias("condition_id"),
        C.slug(timeframe, start).alias("slug"),
        start_ns.alias("start_timestamp_ns"),
        (start_ns + C.duration(timeframe) * 1_000_000_000).alias("end_timestamp_ns"),
        F.concat(name, F.lit("-up")).alias("up_token_id"),
        F.concat(name, F.lit("-down")).alias("down_token_id"),
        F.lit(RESOLUTION_SOURCE).alias("resolution_source"),
    ).cast(WINDOW)


def attempts(ev: DataFrame) -> DataFrame:
    """Each event tries to resolve the boundary after it; timeframe by user."""
    tf = F.when(F.col("user_id") % 2 == 0, "5m").otherwise("15m")
    rows = ev.withColumn("timeframe", tf)
    start = C.plus_windows(C.window_start(F.col("at"), F.col("timeframe")), F.col("timeframe"))
    rows = rows.withColumn("expected_start", start)
    micros = F.unix_micros("expected_start")
    asked = micros - 5_000_000 + (F.col("k") % 21) * 500_000
    name = F.unix_seconds("expected_start").cast("string")
    found = F.col("event_type").isin("view", "purchase", "click")
    rows = rows.withColumns(
        {
            "requested_at": F.timestamp_micros(asked),
            "resolved_at": F.timestamp_micros(asked + 100_000 + F.col("seq") % 1000 * 100),
        }
    )
    return rows.select(
        "seq",
        "timeframe",
        "expected_start",
        "requested_at",
        "resolved_at",
        F.when(found, "found").when(F.col("event_type") == "error", "error").otherwise("not_found").alias("outcome"),
        F.when(found, market_window(F.col("timeframe"), F.col("expected_start"), name)).alias("market"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("http "), F.col("k").cast("string"))).alias("error"),
    )
