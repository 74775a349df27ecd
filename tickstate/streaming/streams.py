"""Structured Streaming forms of the batch operators (ST1, ST2, ST4, ST8).

Every ``foreachBatch`` sink writes under ``batch=<id>`` in overwrite mode, so a
batch that runs twice leaves one result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickstate.operators.asof import SEQ
from tickstate.operators.ordered import materialize, number_rows
from tickstate.operators.ordering import ARRIVAL
from tickstate.operators.parse_books import parse_book_frames
from tickstate.operators.parse_prices import (
    parse_agg_trades,
    parse_book_ticker,
    parse_depth,
    parse_oracle_price,
)
from tickstate.params import Params
from tickstate.sources.frames import number_frames
from tickstate.streaming.files import begin, exists


def event_time(ns: str):
    return F.timestamp_micros(F.expr(f"`{ns}` div 1000"))


def with_event_time(df: DataFrame, ns: str = "received_wall_timestamp_ns") -> DataFrame:
    return df.withColumn("event_time", event_time(ns))


def parse_frames(frames: DataFrame, registry: DataFrame | None, params: Params) -> tuple[DataFrame, DataFrame]:
    """All parsers over numbered frames of any source: ``(events, rejects)``."""
    rows = params.chunk_rows
    limit = params.future_limit_s
    spot = frames.where(F.col("source") == "binance_spot")
    parsed = [
        parse_oracle_price(frames.where(F.col("source") == "chainlink_rtds"), limit, rows),
        parse_agg_trades(spot, "us", limit, rows),
        parse_book_ticker(spot, rows),
        parse_depth(spot, params.depth_levels, rows),
    ]
    if registry is not None:
        parsed.append(parse_book_frames(frames.where(F.col("source") == "clob"), registry))
    events = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [p[0] for p in parsed]
    )
    rejects = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [p[1] for p in parsed]
    )
    return events, rejects


ORACLE_STREAM = "chainlink_price"
SPOT_EVENT_STREAMS = ("binance_agg_trade", "binance_book_ticker", "binance_depth20")


def _marks(events: DataFrame) -> DataFrame:
    """``stream, mark_session, highest``: the largest accepted number of each ordered feed."""
    number = F.when(F.col("stream") == ORACLE_STREAM, F.col("source_timestamp_ns")).otherwise(
        F.col("source_sequence").cast("bigint")
    )
    session = F.when(F.col("stream") == ORACLE_STREAM, "").otherwise(F.col("session_id"))
    return (
        events.where(F.col("stream").isin(ORACLE_STREAM, *SPOT_EVENT_STREAMS))
        .groupBy("stream", session.alias("mark_session"))
        .agg(F.max(number).alias("highest"), F.max("received_wall_timestamp_ns").alias("seen_ns"))
    )


def _after_earlier_batches(
    accepted: DataFrame, marks: DataFrame | None, known: DataFrame | None
) -> DataFrame:
    """``accepted`` with ``reject_reason`` for rows that earlier batches or rows rule out.

    Inside a batch the parsers have already compared with the rows before; a row
    that those reject is not above the mark either, so both checks together are the
    check over all batches.
    """
    if marks is not None:
        session = F.when(F.col("stream") == ORACLE_STREAM, "").otherwise(F.col("session_id"))
        accepted = accepted.withColumn("mark_session", session).join(
            marks.select("stream", "mark_session", "highest"), ["stream", "mark_session"], "left"
        )
        oracle = F.col("stream") == ORACLE_STREAM
        spot = F.col("stream").isin(*SPOT_EVENT_STREAMS)
        number = F.when(spot, F.col("source_sequence")).cast("bigint")
        reason = F.when(oracle & (F.col("source_timestamp_ns") < F.col("highest")), "out_of_order").when(
            spot & (number <= F.col("highest")), "not_increasing"
        )
        accepted = accepted.withColumn("reject_reason", reason).drop("mark_session", "highest")
    else:
        accepted = accepted.withColumn("reject_reason", F.lit(None).cast("string"))
    good = accepted.where("reject_reason is null")
    first = good.groupBy("event_id").agg(F.min(ARRIVAL).alias("_first"))
    if known is not None:
        first = first.join(known.select("event_id"), "event_id", "left_anti")
    marked = accepted.join(first, "event_id", "left")
    repeated = F.col("reject_reason").isNull() & ~F.col("_first").eqNullSafe(F.col(ARRIVAL))
    return marked.withColumn(
        "reject_reason", F.when(repeated, "duplicate").otherwise(F.col("reject_reason"))
    ).drop("_first")


def stream_normalise(
    frames: DataFrame,
    events_dir: str,
    rejects_dir: str,
    checkpoint: str,
    registry: DataFrame | None = None,
    params: Params | None = None,
    trigger: dict | None = None,
    state_dir: str | None = None,
    horizon_s: int = 600,
) -> StreamingQuery:
    """ST1: landed frames to event and reject tables, with the order rules (P15, P16),
    duplicates (P19) and the sequence (P20) running on across batches.

    ``state_dir`` holds, per batch, the last arrival and sequence numbers, the
    largest number of each feed and the ids received in the last ``horizon_s``; the
    next batch starts from them and then they may be deleted.
    """
    params = params or Params()
    state_dir = state_dir or f"{checkpoint}-state"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = f"{state_dir}/{{}}/batch={batch_id - 1}"
        marks = known = None
        arrivals, sequence = 0, 0
        if batch_id > 0 and exists(spark, last.format("counters")):
            marks, known = (spark.read.parquet(last.format(n)) for n in ("marks", "known"))
            arrivals, sequence = spark.read.parquet(last.format("counters")).first()
        numbered = number_frames(batch)
        numbered = materialize(numbered.withColumn(ARRIVAL, F.col(ARRIVAL) + arrivals))
        parsed, rejects = parse_frames(numbered, registry, params)
        origin = numbered.select(ARRIVAL, "session_id", "raw", "received_wall_ns")
        checked = materialize(_after_earlier_batches(parsed.join(origin, ARRIVAL), marks, known))
        good = checked.where("reject_reason is null")
        events = number_rows(good.drop("reject_reason", "raw", "received_wall_ns", "ingest_sequence"), [ARRIVAL, "event_id"], SEQ)
        events = events.withColumn(SEQ, F.col(SEQ) + sequence)
        events.drop("session_id").write.mode("overwrite").parquet(f"{events_dir}/batch={batch_id}")
        late = checked.where("reject_reason is not null").select(*rejects.columns)
        rejects.unionByName(late).write.mode("overwrite").parquet(f"{rejects_dir}/batch={batch_id}")

        now = _marks(good)
        if marks is not None:
            now = now.unionByName(marks).groupBy("stream", "mark_session").agg(
                F.max("highest").alias("highest"), F.max("seen_ns").alias("seen_ns")
            )
        ids = good.select("event_id", F.col("received_wall_timestamp_ns").alias("seen_ns"))
        ids = ids if known is None else ids.unionByName(known)
        clock = ids.agg((F.max("seen_ns") - horizon_s * 1_000_000_000).alias("_since"))  # one row
        recent = ids.join(F.broadcast(clock)).where("seen_ns >= _since").drop("_since")
        done = numbered.agg(F.greatest(F.max(ARRIVAL), F.lit(arrivals)).cast("bigint").alias("arrivals")).join(
            good.agg((F.count("*") + sequence).alias("sequence"))
        )
        for name, df in (("marks", now), ("known", recent), ("counters", done)):
            df.write.mode("overwrite").parquet(f"{state_dir}/{name}/batch={batch_id}")

    return begin(frames.writeStream.foreachBatch(write), checkpoint, trigger)


def stream_dedup(
    events: DataFrame, horizon: str = "10 minutes", keys: tuple[str, ...] = ("event_id",)
) -> DataFrame:
    """ST2: first event of each id within the horizon; state older than it is dropped."""
    return (
        with_event_time(events)
        .withWatermark("event_time", horizon)
        .dropDuplicatesWithinWatermark(list(keys))
    )


def stream_rolling(
    trades: DataFrame,
    seconds: int,
    step_seconds: int = 1,
    lateness: str = "10 seconds",
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """ST4: volumes and VWAP on sliding windows aligned to ``step_seconds``."""
    buy = F.when(F.col("taker_side") == "buy", F.col("quantity"))
    sell = F.when(F.col("taker_side") != "buy", F.col("quantity"))
    notional = F.sum(F.col("price") * F.col("quantity"))
    out = (
        with_event_time(trades)
        .withWatermark("event_time", lateness)
        .groupBy(*keys, F.window("event_time", f"{seconds} seconds", f"{step_seconds} seconds"))
        .agg(
            F.sum(buy).alias("buy_volume"),
            F.sum(sell).alias("sell_volume"),
            F.try_divide(notional, F.sum("quantity")).alias("vwap"),
        )
    )
    return out.select(
        *keys,
        F.col("window.end").alias("window_end"),
        F.coalesce("buy_volume", F.lit(0)).alias("buy_volume"),
        F.coalesce("sell_volume", F.lit(0)).alias("sell_volume"),
        "vwap",
    )


def stream_health_counts(
    events: DataFrame, every: str = "1 second", lateness: str = "10 seconds"
) -> DataFrame:
    """ST8: events per source, stream and tumbling window (use update mode)."""
    return (
        with_event_time(events)
        .withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", every), "source", "stream")
        .agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("window_start"), "source", "stream", "events")
    )
