"""Shared shape of the frame parsers: one pass gives accepted events and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstate.operators.ordered import Running, materialize, running
from tickstate.operators.ordering import ARRIVAL
from tickstate.params import CHUNK_ROWS
from tickstate.schemas import EVENT_COLUMNS

REJECT_COLUMNS = ("source", "session_id", ARRIVAL, "received_wall_ns", "raw", "reject_reason")


def event_columns(given: dict[str, Column]) -> list[Column]:
    """The full event row; columns not given are null."""
    unknown = set(given) - set(EVENT_COLUMNS)
    if unknown:
        raise ValueError(f"not event columns: {sorted(unknown)}")
    return [
        (given[name].cast(kind) if name in given else F.lit(None).cast(kind)).alias(name)
        for name, kind in EVENT_COLUMNS.items()
    ]


def frame_envelope() -> dict[str, Column]:
    return {
        "schema_version": F.lit(2),
        "received_wall_timestamp_ns": F.col("received_wall_ns"),
        "received_monotonic_ns": F.col("received_monotonic_ns"),
    }


def first_of(*reasons: Column) -> Column:
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def when(condition: Column, reason: str) -> Column:
    """``reason`` where the condition holds or is unknown."""
    return F.when(F.coalesce(condition, F.lit(True)), reason)


def json_reason(raw: Column, value: Column) -> Column:
    return F.when(F.trim(raw).isin("PONG", "PING"), "control").when(value.isNull(), "not_json")


def ordered_reasons(
    df: DataFrame,
    before: Column,
    after: Column,
    number: str,
    keys: list[str],
    *,
    strict: bool,
    chunk_rows: int = CHUNK_ROWS,
    keep: Column | None = None,
) -> DataFrame:
    """Add ``reject_reason``: checks ``before``, then the order check, then checks ``after``.

    ``keep`` selects the rows this parser owns; it is applied after parsing, as a
    filter on a parsed field would parse the frame once more.
    """
    # parsed and checked once; the order check and both results read that
    df = materialize(df.withColumns({"_before": before, "_after": after}).drop("v"))
    if keep is not None:
        df = df.where(keep)
    valid = F.col("_before").isNull() & F.col("_after").isNull()
    df = running(
        df,
        keys,
        ARRIVAL,
        {"_highest": Running("max", F.when(valid, F.col(number)))},
        chunk_rows=chunk_rows,
        exclusive=True,
    )
    if strict:
        order = F.when(F.col(number) <= F.col("_highest"), "not_increasing")
    else:
        order = F.when(F.col(number) < F.col("_highest"), "out_of_order")
    return df.withColumn("reject_reason", first_of("_before", order, "_after")).drop(
        "_before", "_after", "_highest"
    )


def split(df: DataFrame, columns: list[Column]) -> tuple[DataFrame, DataFrame]:
    accepted = df.where(F.col("reject_reason").isNull()).select(ARRIVAL, *columns)
    rejected = df.where(F.col("reject_reason").isNotNull()).select(*REJECT_COLUMNS)
    return accepted, rejected
