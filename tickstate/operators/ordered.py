"""Order-dependent scans that never put a whole key into one task.

``ingest_sequence`` is dense, so ``sequence div chunk_rows`` splits any key into
chunks of bounded size, however hot the key is. A running aggregate is then

1. a window inside (keys, chunk),
2. one summary row per (keys, chunk), combined map-side,
3. a window over the small summary, giving each chunk what came before it,
4. an equi-join on (keys, chunk) that reuses the partitioning of step 1.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickstate.params import CHUNK_ROWS

CHUNK = "_chunk"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(path)
    return context.getCheckpointDir()


def kept_rows(df: DataFrame) -> DataFrame:
    """Rows written as Parquet in the shared folder: cuts the lineage and survives executor loss.

    A checkpoint keeps whole rows, wide and mostly null, without compression; here
    nulls cost next to nothing, and a later step reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_paths = (path,)
    return kept


@contextmanager
def shuffles_removed(spark):
    """Writes made inside delete their shuffle files when they end, not when the driver next collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def holding(df: DataFrame, *kept: DataFrame) -> DataFrame:
    """``df``, whose ``release`` also deletes the rows of ``kept``, which only it reads."""
    paths = [p for d in (df, *kept) for p in d.__dict__.get("_kept_paths", ())]
    df._kept_paths = tuple(dict.fromkeys(paths))
    return df


def release(*kept: DataFrame) -> None:
    """Delete rows of ``kept_rows`` that nothing reads any more: what was made of them is kept itself."""
    for df in kept:
        for path in df.__dict__.pop("_kept_paths", ()):
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """``kept_rows``; a checkpoint where Parquet cannot hold a column's type or two columns' names."""
    names, types = {c.lower() for c in df.columns}, df.schema.simpleString()
    if df.columns and len(names) == len(df.columns) and not re.search(r":(void|interval)\b|<(void|interval)\b", types):
        return kept_rows(df)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``sum``, ``max``, ``last`` or ``first`` (non-null) of a column."""

    how: str
    column: Column

    def windowed(self, window) -> Column:
        if self.how == "sum":
            return F.sum(self.column).over(window)
        if self.how == "max":
            return F.max(self.column).over(window)
        if self.how == "last":
            return F.last(self.column, ignorenulls=True).over(window)
        if self.how == "first":
            return F.first(self.column, ignorenulls=True).over(window)
        raise ValueError(f"unknown running aggregate {self.how}")

    def summary(self, position: Column) -> Column:
        if self.how == "sum":
            return F.sum(self.column)
        if self.how == "max":
            return F.max(self.column)
        at = F.when(self.column.isNotNull(), position)
        pick = F.max_by if self.how == "last" else F.min_by
        return pick(self.column, at)

    def combine(self, inside: Column, before: Column) -> Column:
        if self.how == "sum":
            return F.coalesce(inside + before, inside, before)
        if self.how == "max":
            return F.greatest(inside, before)
        if self.how == "last":
            return F.coalesce(inside, before)
        return F.coalesce(before, inside)


def with_chunk(df: DataFrame, order: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return df.withColumn(CHUNK, F.expr(f"`{order}` div {int(chunk_rows)}"))


def chunks_needed(df: DataFrame, keys: list[str], chunk_rows: int | None = CHUNK_ROWS) -> int | None:
    """``chunk_rows`` when some key has more rows than that, else None: each key fits one task.

    A chunk of the whole sequence holds few rows of each key when keys are many, and its
    summaries are then nearly as many as the rows. ``df`` is read once, its keys only.
    """
    if chunk_rows is None:
        return None
    long = df.groupBy(*keys).count().where(F.col("count") > chunk_rows)
    return None if long.isEmpty() else chunk_rows


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    aggregates: dict[str, Running],
    *,
    chunk_rows: int | None = CHUNK_ROWS,
    exclusive: bool = False,
    chunked: bool = False,
    tie: str | None = None,
) -> DataFrame:
    """``df`` plus one running aggregate per name, over ``keys`` in ``order``.

    ``order`` must be dense enough for ``order div chunk_rows`` to bound a chunk
    (the ingest sequence is); pass ``chunked=True`` when ``df`` already has its
    own ``_chunk`` column.  ``tie`` breaks equal positions. Without ``chunk_rows``
    (see ``chunks_needed``) each key is one window.
    """
    if chunk_rows is None and keys and not chunked:
        last = -1 if exclusive else Window.currentRow
        whole = Window.partitionBy(*keys).orderBy(*([order] if tie is None else [order, tie]))
        whole = whole.rowsBetween(Window.unboundedPreceding, last)
        return df.select("*", *[a.windowed(whole).alias(n) for n, a in aggregates.items()])
    if not chunked:
        df = with_chunk(df, order, chunk_rows or CHUNK_ROWS)
    by = [*keys, CHUNK]
    ordering = [order] if tie is None else [order, tie]
    position = F.struct(*ordering)
    inside = Window.partitionBy(*by).orderBy(*ordering).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else Window.currentRow
    )
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK).rowsBetween(
        Window.unboundedPreceding, -1
    )
    summary = df.groupBy(*by).agg(
        *[a.summary(position).alias(f"_s_{n}") for n, a in aggregates.items()]
    )
    carry = summary.select(
        *by,
        *[
            Running(a.how, F.col(f"_s_{n}")).windowed(before).alias(f"_c_{n}")
            for n, a in aggregates.items()
        ],
    )
    local = df.select("*", *[a.windowed(inside).alias(f"_i_{n}") for n, a in aggregates.items()])
    joined = local.join(carry, by, "left")
    kept = [c for c in df.columns if c != CHUNK or chunked]
    return joined.select(
        *kept,
        *[
            a.combine(F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(n)
            for n, a in aggregates.items()
        ],
    )


def following(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    name: str,
    *,
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """``df`` plus ``name``: ``value`` of the next row, in ``order``, with the same keys."""
    if chunk_rows is None and keys:
        return df.withColumn(name, F.lead(value).over(Window.partitionBy(*keys).orderBy(order)))
    df = with_chunk(df, order, chunk_rows or CHUNK_ROWS)
    by = [*keys, CHUNK]
    starts = df.groupBy(*by).agg(F.min_by(value, order).alias("_start"))
    carry = starts.select(
        *by, F.lead("_start").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK)).alias("_f_later")
    )
    local = df.withColumn("_f_next", F.lead(value).over(Window.partitionBy(*by).orderBy(order)))
    return (
        local.join(carry, by, "left")
        .withColumn(name, F.coalesce("_f_next", "_f_later"))
        .drop(CHUNK, "_f_next", "_f_later")
    )


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], salt: Column, salts: int = 16, how: str = "left"
) -> DataFrame:
    """Equi-join with every key of ``big`` spread over ``salts`` tasks.

    ``small`` has one row per key and is replicated ``salts`` times.
    """
    copies = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return (
        big.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
        .join(copies, [*keys, "_salt"], how)
        .drop("_salt")
    )


def number_rows(df: DataFrame, order: list[str], name: str, keep=materialize) -> DataFrame:
    """Dense 1..n numbering by ``order``: one range shuffle, no single sorted task.

    The range partitioner samples the full ordering, so a hot first column is
    split too. The numbered rows are kept once, with ``keep``, because range bounds
    must not be sampled twice.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = keep(placed)
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per shuffle partition, so the broadcast is bounded by their number
    offsets = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(
                Window.partitionBy(F.lit(0))
                .orderBy("_part")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_offset"),
    )
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return holding(
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + inside + 1)
        .drop("_part", "_place", "_offset"),
        placed,
    )


# Widths of the nested time buckets: a minute, a second, a millisecond.
_WIDTHS = (60_000_000_000, 1_000_000_000, 1_000_000)


def with_time_chunk(
    df: DataFrame, keys: list[str], ns: str, *, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``_chunk``, the start of a time bucket that holds at most ``chunk_rows`` rows.

    Buckets are minutes; a minute with too many rows is split into seconds, a
    second with too many into milliseconds. The list of split buckets has at
    most ``rows / chunk_rows`` entries. Rows must be unique per (keys, ns), so a
    millisecond holds at most a million rows by construction. ``df`` is read twice,
    so it should be materialized.
    """
    starts = [F.expr(f"`{ns}` - pmod(`{ns}`, {w})") for w in _WIDTHS]
    marked = df.select("*", *[s.alias(f"_w{i}") for i, s in enumerate(starts)])
    counts = marked.groupBy(*keys, "_w0", "_w1").agg(F.count("*").alias("_n"))
    minutes = (
        counts.groupBy(*keys, "_w0").agg(F.sum("_n").alias("_n0")).where(F.col("_n0") > chunk_rows)
    )
    seconds = counts.where(F.col("_n") > chunk_rows).select(*keys, "_w0", "_w1", "_n")
    split = minutes.join(
        seconds.groupBy(*keys, "_w0").agg(F.collect_set("_w1").alias("_hot")),
        [*keys, "_w0"],
        "left",
    ).select(*keys, "_w0", F.lit(True).alias("_split"), "_hot")
    return (
        marked.join(split, [*keys, "_w0"], "left")
        .withColumn(
            CHUNK,
            F.when(F.col("_split").isNull(), F.col("_w0"))
            .when(F.array_contains("_hot", F.col("_w1")), F.col("_w2"))
            .otherwise(F.col("_w1")),
        )
        .drop("_w0", "_w1", "_w2", "_split", "_hot")
    )
