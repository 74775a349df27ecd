"""Arrival-order rules: monotonic filters, duplicates, sequence, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstate.operators.ordered import Running, materialize, number_rows, running
from tickstate.params import CHUNK_ROWS

ARRIVAL = "arrival_no"


def _against_maximum(df, value, keys, order, chunk_rows, strict):
    """Reject rows not above (or at) the largest earlier accepted value.

    A rejected value never exceeds the maximum, so the maximum over all valid
    earlier rows is the maximum over the accepted ones.
    """
    valid = F.col("reject_reason").isNull() if "reject_reason" in df.columns else F.lit(True)
    checked = running(
        df,
        list(keys),
        order,
        {"_highest": Running("max", F.when(valid, F.col(value)))},
        chunk_rows=chunk_rows,
        exclusive=True,
    )
    current, highest = F.col(value), F.col("_highest")
    broken = (current <= highest) if strict else (current < highest)
    reason = F.when(valid & broken, "not_increasing" if strict else "out_of_order")
    if "reject_reason" in df.columns:
        reason = F.coalesce(F.col("reject_reason"), reason)
    return checked.withColumn("reject_reason", reason).drop("_highest")


def keep_increasing(
    df: DataFrame,
    id_col: str,
    keys: tuple[str, ...] = ("session_id", "stream"),
    order: str = ARRIVAL,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Reason ``not_increasing`` unless the id exceeds every accepted earlier id."""
    return _against_maximum(df, id_col, keys, order, chunk_rows, True)


def keep_non_decreasing(
    df: DataFrame,
    time_col: str,
    keys: tuple[str, ...] = (),
    order: str = ARRIVAL,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Reason ``out_of_order`` when the time is below an accepted earlier one."""
    return _against_maximum(df, time_col, keys, order, chunk_rows, False)


def in_ns(value: Column, factor: int | Column) -> Column:
    """``value`` in nanoseconds; null where that does not fit."""
    return F.try_multiply(value, F.lit(factor) if isinstance(factor, int) else factor)


def future_reason(time_ns: Column, now_ns: Column, limit_s: int = 5) -> Column:
    return F.when(time_ns > now_ns + F.lit(limit_s * 1_000_000_000), "future_time")


def reject_future(df: DataFrame, time_col: str, now_col: str, limit_s: int = 5) -> DataFrame:
    """Reason ``future_time`` for times more than ``limit_s`` ahead of arrival."""
    reason = future_reason(F.col(time_col), F.col(now_col), limit_s)
    if "reject_reason" in df.columns:
        reason = F.coalesce(F.col("reject_reason"), reason)
    return df.withColumn("reject_reason", reason)


def canonical_json(raw: Column) -> Column:
    """JSON text with sorted keys and no white space."""
    return F.to_json(F.try_parse_json(raw))


def keyed_id(provider: str, kind: str, *parts: Column) -> Column:
    """P18 for provider sequence numbers: ``provider:kind:...``."""
    head = [F.lit(provider)] + ([F.lit(kind)] if kind else [])
    return F.concat_ws(":", *head, *[p.cast("string") for p in parts])


def content_id(
    prefix: str, kind: Column, asset: Column, source_ns: Column, supplied: Column, body: Column
) -> Column:
    """P18 for messages: the supplied hash, else a digest of the canonical body text."""
    digest = F.sha2(F.concat_ws(":", asset, kind, source_ns.cast("string"), body), 256)
    has_hash = supplied.isNotNull() & (supplied != "")
    return F.concat_ws(":", F.lit(prefix), kind, asset, F.when(has_hash, supplied).otherwise(digest))


def with_event_id(
    df: DataFrame,
    prefix: str = "clob",
    kind: str = "event_type",
    asset: str = "asset_id",
    source_ns: str = "source_timestamp_ns",
    supplied: str = "hash",
    body: str = "raw",
) -> DataFrame:
    """P18 on columns of ``df``."""
    columns = [F.col(c) for c in (kind, asset, source_ns, supplied)]
    return df.withColumn("event_id", content_id(prefix, *columns, canonical_json(F.col(body))))


def dedup_events(
    df: DataFrame, keys: tuple[str, ...] = ("event_id",), order: str = ARRIVAL
) -> DataFrame:
    """The first arrival of each key.

    The minimum is combined map-side, so a key with very many copies costs one
    row per map task; the semi-join is on the unique arrival number.
    """
    first = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def dedup_horizon(
    df: DataFrame,
    horizon: int,
    keys: tuple[str, ...] = (),
    id_col: str = "event_id",
    order: str = ARRIVAL,
    chunk_rows: int = CHUNK_ROWS,
    most_rounds: int = 100,
) -> DataFrame:
    """P19 with a horizon by count: the rows whose id is not among the last ``horizon`` accepted ones.

    An id counts again once ``horizon`` other ids of its key were accepted after it,
    the oldest first. Whether a copy is accepted depends on how many were accepted
    before it, so the flags of the copies are recomputed, from the ranks that the
    flags before give, until they stay. The flags of the first rows depend on none
    and are right at once, then those that depend on these, so flags that stay are
    the sequential ones. Ids without copies only count: they are summed up once.
    """
    by = list(keys)
    counts = df.groupBy(*by, id_col).agg(F.count("*").alias("_copies"))
    repeated = counts.where("_copies > 1").drop("_copies")
    slim = df.select(*by, id_col, order)
    marked = slim.join(repeated.withColumn("_again", F.lit(True)), [*by, id_col], "left")
    single = F.col("_again").isNull()
    counted = running(
        marked, by, order, {"_singles": Running("sum", single.cast("bigint"))}, chunk_rows=chunk_rows
    )
    first = Running("first", F.col(order))
    copies = running(
        counted.where("_again").drop("_again"), [*by, id_col], order, {"_first": first}, chunk_rows=chunk_rows
    )
    copies = materialize(copies.select("*", (F.col("_first") == F.col(order)).alias("_fresh")).drop("_first"))
    for _ in range(most_rounds):
        ranked = running(
            copies, by, order, {"_accepted": Running("sum", F.col("_fresh").cast("bigint"))}, chunk_rows=chunk_rows
        ).withColumn("_rank", F.col("_singles") + F.col("_accepted"))
        seen = running(
            ranked, [*by, id_col], order, {"_last": Running("last", F.when(F.col("_fresh"), F.col("_rank")))},
            chunk_rows=chunk_rows, exclusive=True,
        )
        before = F.col("_rank") - F.col("_fresh").cast("bigint")
        now = F.coalesce(before - F.col("_last") >= horizon, F.lit(True))
        after = materialize(seen.select(*by, id_col, order, "_singles", now.alias("_fresh"), (now != F.col("_fresh")).alias("_moved")))
        copies = after.drop("_moved")
        if after.where("_moved").isEmpty():
            break
    else:
        raise RuntimeError(f"duplicates did not settle in {most_rounds} rounds")
    dropped = copies.where("not _fresh").select(order)
    return df.join(dropped, order, "left_anti")


def duplicates_of(
    df: DataFrame, keys: tuple[str, ...] = ("event_id",), order: str = ARRIVAL
) -> DataFrame:
    """The rows ``dedup_events`` drops."""
    first = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_anti")


def assign_sequence(df: DataFrame, order_cols: list[str], name: str = "ingest_sequence") -> DataFrame:
    """P20: contiguous 1..n over the accepted rows."""
    return number_rows(df, list(order_cols), name)


def to_ns(df: DataFrame, cols: list[str], unit_col: str) -> DataFrame:
    """Add ``<col>_ns`` from a column in ``us``, ``ms`` or ``s``; null where it does not fit."""
    factor = (
        F.when(F.col(unit_col) == "us", 1_000)
        .when(F.col(unit_col) == "ms", 1_000_000)
        .when(F.col(unit_col) == "s", 1_000_000_000)
        .cast("bigint")
    )
    return df.withColumns({f"{c}_ns": in_ns(F.col(c).cast("bigint"), factor) for c in cols})


def reject_summary(rejects: DataFrame) -> DataFrame:
    """Rejected rows by source and reason."""
    return rejects.groupBy("source", F.col("reject_reason").alias("reason")).agg(
        F.count("*").alias("rejected")
    )
