"""State as of a sequence: latest values, control state, references, sessions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickstate.functions.metrics import floor_ms
from tickstate.operators.ordered import Running, materialize, running
from tickstate.params import CHUNK_ROWS, SOURCES, TIMEFRAME_SECONDS

SEQ = "ingest_sequence"
MARK = "_mark"


def asof_latest(
    ticks: DataFrame,
    events: DataFrame,
    keys: list[str],
    value_cols: dict[str, Column] | list[str],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Each tick with the last non-null value of every column before it in ingest order."""
    values = (
        value_cols if isinstance(value_cols, dict) else {c: F.col(c) for c in value_cols}
    )
    any_value = reduce(or_, [F.col(f"_v_{n}").isNotNull() for n in values])
    marks = events.select(*keys, SEQ, *[c.alias(f"_v_{n}") for n, c in values.items()]).where(
        any_value
    )
    rows = ticks.withColumn("_tick", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    carried = running(
        rows,
        keys,
        SEQ,
        {n: Running("last", F.col(f"_v_{n}")) for n in values},
        chunk_rows=chunk_rows,
    )
    return carried.where("_tick").select(*ticks.columns, *values)


def with_age(df: DataFrame, ts_col: str, now_col: str, limit_ms: int) -> DataFrame:
    """Add ``age_ms`` and ``stale`` (no value counts as stale)."""
    age = F.greatest(F.lit(0).cast("bigint"), floor_ms(F.col(now_col) - F.col(ts_col)))
    age = F.when(F.col(ts_col).isNotNull(), age)
    return df.withColumns(
        {"age_ms": age, "stale": F.coalesce(age > F.lit(limit_ms), F.lit(True))}
    )


def market_states(events: DataFrame) -> DataFrame:
    return events.where(F.col("stream") == "market_window_state").select(
        SEQ, "received_wall_timestamp_ns", "p_market"
    )


def status_changes(events: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Status rows with ``invalidates``: the book connection was lost or has a new session."""
    status = events.where(F.col("stream") == "source_status").select(
        SEQ, "received_wall_timestamp_ns", "p_status"
    )
    of_books = F.col("p_status.source") == "clob"
    session = F.struct(F.col("p_status.session_id").alias("id"))
    status = running(
        status,
        [],
        SEQ,
        {"_before": Running("last", F.when(of_books & F.col("p_status.connected"), session))},
        chunk_rows=chunk_rows,
        exclusive=True,
    )
    changed = ~F.col("p_status.connected") | ~F.col("p_status.session_id").eqNullSafe(
        F.col("_before.id")
    )
    return status.withColumn("invalidates", of_books & changed).drop("_before")


def with_control(
    rows: DataFrame, events: DataFrame, chunk_rows: int = CHUNK_ROWS, since: int = 0
) -> DataFrame:
    """Attach the control state in force at each row, in one pass.

    Adds ``session`` (struct, null before the first connect), ``invalidations``
    (count so far), ``state_5m``/``state_15m`` (market state payloads) and
    ``connected_<source>``. Control rows are few, so the shuffle is that of ``rows``.
    Invalidations up to the sequence ``since`` are not counted.
    """
    status = status_changes(events, chunk_rows)
    p = F.col("p_status")
    session = F.when(
        (p["source"] == "clob") & p["connected"], F.struct(p["session_id"].alias("id"))
    )
    marks = status.select(
        SEQ,
        session.alias("_session"),
        (F.col("invalidates") & (F.col(SEQ) > since)).cast("bigint").alias("_inv"),
        *[
            F.when(p["source"] == s, p["connected"]).alias(f"_on_{s}")
            for s in SOURCES
        ],
    ).unionByName(
        market_states(events).select(
            SEQ,
            *[
                F.when(F.col("p_market.timeframe") == tf, F.col("p_market")).alias(f"_state_{tf}")
                for tf in TIMEFRAME_SECONDS
            ],
        ),
        allowMissingColumns=True,
    )
    both = rows.withColumn(MARK, F.lit(False)).unionByName(
        marks.withColumn(MARK, F.lit(True)), allowMissingColumns=True
    )
    carried = running(
        both,
        [],
        SEQ,
        {
            "session": Running("last", F.col("_session")),
            "invalidations": Running("sum", F.coalesce(F.col("_inv"), F.lit(0))),
            **{f"state_{tf}": Running("last", F.col(f"_state_{tf}")) for tf in TIMEFRAME_SECONDS},
            **{f"connected_{s}": Running("last", F.col(f"_on_{s}")) for s in SOURCES},
        },
        chunk_rows=chunk_rows,
    )
    added = [
        "session",
        "invalidations",
        *[f"state_{tf}" for tf in TIMEFRAME_SECONDS],
        *[f"connected_{s}" for s in SOURCES],
    ]
    return carried.where(~F.col(MARK)).select(*rows.columns, *added)


def asof_market_state(
    ticks: DataFrame, market_state: DataFrame, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Each tick with the last state of every timeframe (``state_5m``, ``state_15m``)."""
    values = {
        f"state_{tf}": F.when(F.col("p_market.timeframe") == tf, F.col("p_market"))
        for tf in TIMEFRAME_SECONDS
    }
    return asof_latest(ticks, market_state, [], values, chunk_rows)


def _ids(state: str) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.col(f"{state}.{window}.{side}_token_id")
                for window in ("current_market", "next_market")
                for side in ("up", "down")
            ]
        )
    )


def reference_lives(market_state: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Spans in which an asset is current or next in some timeframe.

    ``(asset_id, life, from_sequence, to_sequence)``; ``to_sequence`` is the state
    row that drops the asset, null while it is still wanted. State rows are
    numbered and the spans are the islands of consecutive numbers.
    """
    values = {
        f"state_{tf}": Running(
            "last", F.when(F.col("p_market.timeframe") == tf, F.col("p_market"))
        )
        for tf in TIMEFRAME_SECONDS
    }
    states = running(
        market_state.select(SEQ, "p_market", F.lit(1).alias("_one")),
        [],
        SEQ,
        {**values, "_no": Running("sum", F.col("_one"))},
        chunk_rows=chunk_rows,
    )
    wanted = F.array_distinct(
        F.flatten(F.array(*[F.coalesce(_ids(f"state_{tf}"), F.array().cast("array<string>"))
                            for tf in TIMEFRAME_SECONDS]))
    )
    states = states.select(SEQ, "_no", wanted.alias("_wanted"))
    later = states.select((F.col("_no") - 1).alias("_no"), F.col(SEQ).alias("_next_sequence"))
    assets = states.join(later, "_no", "left").select(
        SEQ, "_no", "_next_sequence", F.explode("_wanted").alias("asset_id")
    )
    island = F.col("_no") - F.row_number().over(Window.partitionBy("asset_id").orderBy("_no"))
    return (
        assets.withColumn("life", island)
        .groupBy("asset_id", "life")
        .agg(
            F.min(SEQ).alias("from_sequence"),
            F.max_by("_next_sequence", "_no").alias("to_sequence"),
        )
    )


def with_life(rows: DataFrame, lives: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``life`` of the row's asset, null where the asset is not referenced.

    Life starts and ends are merged into the asset's rows as markers, so a hot
    asset is scanned in chunks instead of being joined whole.
    """
    starts = lives.select(
        "asset_id", F.col("from_sequence").alias(SEQ), F.struct(F.col("life").alias("id")).alias(MARK)
    )
    ends = lives.where("to_sequence is not null").select(
        "asset_id",
        F.col("to_sequence").alias(SEQ),
        F.struct(F.lit(None).cast("bigint").alias("id")).alias(MARK),
    )
    both = rows.unionByName(starts.unionByName(ends), allowMissingColumns=True).withColumn(
        "_is_mark", F.col(MARK).isNotNull()
    )
    carried = running(
        both, ["asset_id"], SEQ, {"_life": Running("last", F.col(MARK))}, chunk_rows=chunk_rows
    )
    return carried.where(~F.col("_is_mark")).select(
        *rows.columns, F.col("_life.id").alias("life")
    )


def keep_referenced(
    events: DataFrame, market_state: DataFrame, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Book events of assets that are current or next at that sequence, with ``life``."""
    lives = reference_lives(market_state, chunk_rows)
    return with_life(events.where("asset_id is not null"), lives, chunk_rows).where(
        "life is not null"
    )


def filter_current_session(
    events: DataFrame, status: DataFrame, chunk_rows: int = CHUNK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """``(kept, stale)``; rows of another session are stale once a session is known."""
    p = F.col("p_status")
    marks = status.where((p["source"] == "clob") & p["connected"]).select(
        SEQ, F.struct(p["session_id"].alias("id")).alias(MARK)
    )
    carried = running(
        events.unionByName(marks, allowMissingColumns=True).withColumn(
            "_is_mark", F.col(MARK).isNotNull()
        ),
        [],
        SEQ,
        {"_session": Running("last", F.col(MARK))},
        chunk_rows=chunk_rows,
    ).where(~F.col("_is_mark"))
    stale = is_stale(F.col("_session"), F.col("source_session_id"))
    columns = events.columns
    return carried.where(~stale).select(*columns), carried.where(stale).select(*columns)


def is_stale(session: Column, row_session: Column) -> Column:
    return F.coalesce(
        session["id"].isNotNull() & ~row_session.eqNullSafe(session["id"]), F.lit(False)
    )


IDENTITY = ("market_id", "condition_id", "timeframe", "outcome")


def guard_identity(
    events: DataFrame, keys: tuple[str, ...] = ("asset_id", "life"), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Drop events that disagree with the first event of the asset's life."""
    identity = F.struct(*IDENTITY)
    complete = F.lit(True)
    for column in IDENTITY:
        complete = complete & F.col(column).isNotNull()
    checked = running(
        events,
        list(keys),
        SEQ,
        {"_identity": Running("first", F.when(complete, identity))},
        chunk_rows=chunk_rows,
    )
    return checked.where(complete & (identity == F.col("_identity"))).drop("_identity")


def tick_grid(
    spark: SparkSession, start_ns: int, end_ns: int, step_ms: int = 250
) -> DataFrame:
    """Regular ticks ``(snapshot_sequence, now_ns)``, generated in parallel."""
    if step_ms < 50:
        raise ValueError("step_ms must be at least 50")
    step = step_ms * 1_000_000
    return spark.range(0, max(0, (end_ns - start_ns) // step + 1)).select(
        (F.col("id") + 1).alias("snapshot_sequence"),
        (F.lit(start_ns) + F.col("id") * step).alias("now_ns"),
    )


def place_ticks(
    events: DataFrame, start_ns: int, end_ns: int, step_ms: int = 250, chunk_rows: int = CHUNK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """J8 with positions: ``(events, ticks)`` of an archive without tick rows, sequenced together.

    A tick stands after every event received up to its time, by the highest time
    so far, and before the next. How many ticks an event follows is arithmetic on the
    regular grid; how many events a tick follows is a running sum of the counts
    between ticks. Both keep one dense sequence, and nothing is sorted anew.
    """
    grid = tick_grid(events.sparkSession, start_ns, end_ns, step_ms)
    step = step_ms * 1_000_000
    ticks = max(0, (end_ns - start_ns) // step + 1)
    clock = F.col("_clock") - F.lit(start_ns)
    timed = running(
        events, [], SEQ, {"_clock": Running("max", F.col("received_wall_timestamp_ns"))}, chunk_rows=chunk_rows
    )
    passed = F.expr(f"({step - 1} + _clock - {start_ns}) div {step}")
    follows = F.when(clock <= 0, F.lit(0)).otherwise(F.least(F.lit(ticks), passed)).cast("bigint")
    timed = materialize(timed.withColumn("_ticks", follows).drop("_clock"))
    counts = timed.groupBy("_ticks").agg(F.count("*").alias("_n"))
    number = F.col("snapshot_sequence") - 1
    counted = grid.withColumn("_ticks", number).join(counts, "_ticks", "left").drop("_ticks")
    placed = running(
        counted, [], "snapshot_sequence", {"_events": Running("sum", F.coalesce("_n", F.lit(0)))}, chunk_rows=chunk_rows
    )
    moved = timed.withColumn(SEQ, F.col(SEQ) + F.col("_ticks")).drop("_ticks")
    return moved, placed.select((F.col("_events") + F.col("snapshot_sequence")).alias(SEQ), "snapshot_sequence", "now_ns")


def join_manifests(file_stats: DataFrame, segments: DataFrame) -> DataFrame:
    """Full outer join of measured files and manifests on the file path."""
    left = file_stats.select(
        "file_path", *[F.col(c).alias(f"file_{c}") for c in file_stats.columns if c != "file_path"]
    )
    right = segments.select(
        "file_path", *[F.col(c).alias(f"manifest_{c}") for c in segments.columns if c != "file_path"]
    )
    return left.join(right, "file_path", "full_outer")
