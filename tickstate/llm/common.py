"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstate.operators.ordered import checkpoint_dir, materialize

SLICE_BYTES = 1_000_000
ROWS_PER_FILE = 20_000


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows and 8 MB, unless the session asks for fewer.

    Whole texts are long, and a batch is held by the JVM and by Python at once.
    """
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.match(r"-?\d+", spark.conf.get(name))
        if not 0 < int(now[0] if now else 0) < most:
            spark.conf.set(name, str(most))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and whole ``text`` (null: empty) only, so other columns never clash."""
    return docs.select("doc_id", *more, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column (nulls: none) one after another, and the row bounds."""
    rows = column.to_pylist()
    lengths = np.fromiter((len(t) if t else 0 for t in rows), np.int64, len(rows))
    joined = "".join(t for t in rows if t)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum(lengths)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit values (the public splitmix64 finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the group bounds, from batches sorted by ``keys``.

    Only a batch and the group it begins with are held, so callers bound groups.
    """
    held: list[pa.Table] = []
    marks: list[np.ndarray] = []
    last = None

    def out() -> tuple[pa.Table, np.ndarray]:
        table = pa.concat_tables(held).combine_chunks()
        return table, np.append(np.flatnonzero(np.concatenate(marks)), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        opens = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            opens[1:] |= c[1:] != c[:-1]
        opens[0] = tuple(c[0] for c in columns) != last
        last = tuple(c[-1] for c in columns)
        starts = np.flatnonzero(opens)
        if not len(starts):
            held.append(table)
            marks.append(opens)
            continue
        cut = int(starts[-1])
        if cut:
            held.append(table.slice(0, cut))
            marks.append(opens[:cut])
        if held:
            yield out()
        held, marks = [table.slice(cut)], [opens[cut:]]
    if held:
        yield out()


def in_block_pairs(df: DataFrame, item: str, blocks: str, *, own_pairs: bool = False) -> DataFrame:
    """Send each row to every pair (x, y) of its group's blocks that holds its own block.

    A group of one block is the pair (0, 0). Pairs (x, x) of several blocks are
    made with ``own_pairs`` only, as (x, y) also brings the rows of x together.
    Column ``own`` is the row's block.
    """
    zero = F.lit(0).cast("long")
    every = F.sequence(zero, F.col(blocks) - 1)
    others = every if own_pairs else F.when(F.col(blocks) == 1, F.array(zero)).otherwise(
        F.array_remove(every, F.col("own"))
    )
    return (
        df.withColumn("own", F.pmod(F.xxhash64(item), F.col(blocks)))
        .withColumn("_other", F.explode(others))
        .withColumn("x", F.least("own", "_other"))
        .withColumn("y", F.greatest("own", "_other"))
        .drop("_other", blocks)
    )


class Forest:
    """Components of at most a block of items, by their positions."""

    def __init__(self, n: int):
        self.labels = np.arange(n)

    def union(self, i: int, others: np.ndarray) -> None:
        found = np.unique(np.append(self.labels[others], self.labels[i]))
        if len(found) > 1:
            self.labels[np.isin(self.labels, found)] = found[0]

    def outside_largest(self) -> np.ndarray:
        counts = np.bincount(self.labels, minlength=len(self.labels))
        return np.flatnonzero(self.labels != counts.argmax())


def link_block(n: int, linked) -> np.ndarray:
    """Component labels of ``n`` items; ``linked(i)`` gives the positions linked with item ``i``.

    Item 0 is compared with all; then every item outside the largest component
    is. A pair inside the largest component needs no comparison, and any other
    pair has an end that is compared, so no component is missed.
    """
    forest = Forest(n)
    if n:
        forest.union(0, linked(0))
        for i in forest.outside_largest():
            if i:
                forest.union(int(i), linked(int(i)))
    return forest.labels


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in partitions of ``ROWS_PER_FILE`` rows, about, of the ``rows`` it may have; one
    per core at least, and never more than it has. For narrow tables that are written after a
    shuffle with many partitions."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))


def components(edges: DataFrame, rows: int, most_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of ``edges`` (a, b).

    Alternates large-star and small-star steps, each a map-side combined minimum
    and an equi-join that AQE may split at a hot node. Every round is
    checkpointed; it ends when a round changes nothing. ``rows`` is about how many
    edges there may be.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    oriented = materialize(few_files(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows
    ))
    seen = None
    for _ in range(most_rounds):
        mark = oriented.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        both = oriented.unionByName(oriented.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(
            F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")
        )
        oriented = materialize(few_files(
            small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), mark[0]
        ))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return oriented.groupBy("u").agg(F.min("v").alias("m")).select(
        F.explode(
            F.array(F.struct(F.col("u").alias("n"), "m"), F.struct(F.col("m").alias("n"), "m"))
        ).alias("e")
    ).select(F.col("e.n").alias("node"), F.col("e.m").alias("component")).distinct()
