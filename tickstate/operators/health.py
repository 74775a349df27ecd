"""Source health at each tick (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstate.functions.metrics import floor_ms
from tickstate.operators.asof import SEQ
from tickstate.operators.ordered import Running, materialize, running, with_time_chunk
from tickstate.params import CHUNK_ROWS, SOURCES

COUNTS = ("reconnect", "invalid", "duplicate", "stale_session", "divergence")


def health_at(
    ticks: DataFrame,
    status: DataFrame,
    events: DataFrame,
    rejects: DataFrame | None = None,
    duplicates: DataFrame | None = None,
    stale: DataFrame | None = None,
    divergences: DataFrame | None = None,
    sources: tuple[str, ...] = SOURCES,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """A5: one row per tick and source.

    Everything up to the tick's time counts. ``rejects`` and ``duplicates`` have
    ``source, received_wall_ns``; ``events``, ``stale`` and ``divergences`` are
    event rows. A reconnect is a disconnect status. What happens to one source in
    the same nanosecond is combined first, so the scan is over distinct times.
    """
    received = F.col("received_wall_timestamp_ns")
    p = F.col("p_status")
    parts = [
        events.select("source", received.alias("_ns"), F.lit(True).alias("_message")),
        status.select(
            p["source"].alias("source"),
            received.alias("_ns"),
            F.when(p["connected"], True).alias("_message"),
            F.struct(
                F.col(SEQ).alias("at"),
                p["connected"].alias("connected"),
                p["session_id"].alias("session"),
            ).alias("_status"),
            F.when(~p["connected"], 1).alias("_reconnect"),
        ),
    ]
    for name, rows in (("invalid", rejects), ("duplicate", duplicates)):
        if rows is not None:
            parts.append(
                rows.select("source", F.col("received_wall_ns").alias("_ns"), F.lit(1).alias(f"_{name}"))
            )
    for name, rows in (("stale_session", stale), ("divergence", divergences)):
        if rows is not None:
            parts.append(rows.select("source", received.alias("_ns"), F.lit(1).alias(f"_{name}")))
    asked = ticks.select(F.col("now_ns").alias("_ns")).distinct()
    parts.append(
        asked.select(
            F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"),
            "_ns",
            F.lit(True).alias("_ask"),
        )
    )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    for name in ("_message", "_ask"):
        rows = rows.withColumn(name, F.col(name).cast("boolean"))
    for name in COUNTS:
        if f"_{name}" not in rows.columns:
            rows = rows.withColumn(f"_{name}", F.lit(0))
    rows = rows.groupBy("source", "_ns").agg(
        F.max("_message").alias("_message"),
        F.max("_ask").alias("_ask"),
        F.max("_status").alias("_status"),
        *[F.coalesce(F.sum(f"_{n}"), F.lit(0)).alias(f"_{n}") for n in COUNTS],
    )
    rows = with_time_chunk(materialize(rows), ["source"], "_ns", chunk_rows=chunk_rows)
    known = running(
        rows,
        ["source"],
        "_ns",
        {
            "_current": Running("last", F.col("_status")),
            "last_message_timestamp_ns": Running("last", F.when(F.col("_message"), F.col("_ns"))),
            **{f"{n}_count": Running("sum", F.col(f"_{n}")) for n in COUNTS},
        },
        chunked=True,
    ).where("_ask")
    connected = F.coalesce(F.col("_current.connected"), F.lit(False))
    last = F.col("last_message_timestamp_ns")
    age = F.greatest(F.lit(0).cast("bigint"), floor_ms(F.col("_ns") - last))
    health = known.select(
        "source",
        F.col("_ns").alias("now_ns"),
        connected.alias("connected"),
        (~connected).alias("stale"),
        F.col("_current.session").alias("current_session_id"),
        "last_message_timestamp_ns",
        F.when(last.isNotNull(), age).alias("age_ms"),
        *[F.col(f"{n}_count").cast("bigint").alias(f"{n}_count") for n in COUNTS],
        F.lit(0).cast("bigint").alias("protocol_error_count"),
    )
    return ticks.join(health, "now_ns")
