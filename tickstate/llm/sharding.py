"""Balanced shards by sampled splitters, with DataFrame functions only.

Rows are ordered by (hash of the text, doc_id). A sample drawn with weight by
size gives quantile splitters, which cut that order into fine ranges; exact
sizes of the ranges then place the shard borders. A range that a border crosses
is overfull and is subdivided at its own rows. A row counts for the shard in
which its middle byte lies, so shard sizes differ by about one row (law
``bytes``). Rows of equal text are neighbours and stay together unless they hold
more than 1/``GROUP_SHARE`` of a shard.

A splitter falls between texts, unless one text holds several splitters; then
these subdivide it by a hash of doc_id and row, so a hot text is no hot range.
Defined results: null text has size 1; a null doc_id sorts first; fully repeated
rows are spread like others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickstate.llm.common import staged

RANGES_PER_SHARD = 64
SAMPLE_PER_RANGE = 200
GROUP_SHARE = 200
_BUCKETS = 4096


def text_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _position(docs: DataFrame) -> DataFrame:
    """Sort position: 32 bits of the text's hash, then 31 bits that tell equal texts apart."""
    text_hash = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 33)
    inner = F.shiftrightunsigned(F.xxhash64("doc_id", "_row"), 33)
    return docs.withColumn("_at", F.shiftleft(text_hash, 31).bitwiseOR(inner))


def shards(
    docs: DataFrame, n_shards: int, *, carry: tuple[str, ...] = (), ranges_per_shard: int = RANGES_PER_SHARD
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs``, and a struct ``row``
    of the columns in ``carry`` if there are any (``carry=("text",)`` to write shard files)."""
    n_ranges = n_shards * ranges_per_shard
    payload = [F.struct(*carry).alias("row")] if carry else []
    rows = docs.select("doc_id", "text", *payload).withColumn("_row", F.monotonically_increasing_id())
    payload = ["row"] if carry else []
    slim = staged(
        _position(rows).select(
            "doc_id", "_at", "_row", text_size().alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), *payload,
        ),
        "shard-rows",
    )
    total = F.broadcast(slim.agg(F.sum("size").alias("_total")))  # one row
    draw = F.shiftrightunsigned(F.xxhash64("_at", "_row"), 11) / float(1 << 53)
    sample = slim.join(total).where(
        draw < F.col("size") * (n_ranges * SAMPLE_PER_RANGE) / F.col("_total")
    )
    cuts = ", ".join(str(i / n_ranges) for i in range(1, n_ranges))
    splitters = sample.agg(
        F.expr(f"percentile_approx(_at, array({cuts}), {n_ranges * 20})").alias("cuts")
    )
    splitters = splitters.select(F.expr(
        "transform(cuts, (c, i) -> if(shiftright(c, 31) <=> shiftright(get(cuts, i - 1), 31)"
        " or shiftright(c, 31) <=> shiftright(get(cuts, i + 1), 31), c, shiftleft(shiftright(c, 31), 31)))"
    ).alias("cuts"))
    # splitters by the leading bits of the position: a row meets only those of its own bucket
    width = 63 - (_BUCKETS.bit_length() - 1)
    by_bucket = splitters.select(
        F.explode(F.sequence(F.lit(0), F.lit(_BUCKETS - 1))).alias("_bucket"), "cuts"
    ).select(
        "_bucket",
        F.expr(f"size(filter(cuts, c -> shiftright(c, {width}) < _bucket))").alias("_below"),
        F.expr(f"filter(cuts, c -> shiftright(c, {width}) = _bucket)").alias("_cuts"),
    )
    ranged = (
        slim.withColumn("_bucket", F.shiftright("_at", width).cast("int"))
        .join(F.broadcast(by_bucket), "_bucket", "left")  # _BUCKETS rows
        .withColumn("_range", F.expr("coalesce(_below + size(filter(_cuts, c -> c <= _at)), 0)"))
        .drop("_bucket", "_below", "_cuts")
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: at most n_ranges
    sizes = ranged.groupBy("_range").agg(F.sum("size").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_range").orderBy("_at", "_row")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    group = Window.partitionBy("_range", F.shiftright("_at", 31))
    ends = ranged.withColumn("_upto", upto).withColumn("_end", F.max("_upto").over(group)).withColumn(
        "_all", F.sum("size").over(group)
    )
    together = F.col("_all") * (n_shards * GROUP_SHARE) <= F.col("_total")
    middle = 2 * F.col("_before") + F.when(together, 2 * F.col("_end") - F.col("_all")).otherwise(
        2 * F.col("_upto") - F.col("size")
    )
    placed = (
        ends.join(F.broadcast(sizes), "_range").join(total)
        .withColumn("shard", F.least(F.floor(middle * n_shards / (2 * F.col("_total"))), F.lit(n_shards - 1)).cast("int"))
    )
    counts = ranged_counts(placed)
    within = Window.partitionBy("_range", "shard").orderBy("_at", "_row")
    return (
        placed.withColumn("_nth", F.row_number().over(within) - 1)
        .join(F.broadcast(counts), ["_range", "shard"])
        .select(
            "doc_id", "size", "text_crc32", *payload, "shard", (F.col("_start") + F.col("_nth")).cast("long").alias("slot")
        )
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def ranged_counts(placed: DataFrame) -> DataFrame:
    """First slot of each (range, shard): at most one row per range and shard border."""
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return placed.groupBy("_range", "shard").agg(F.count("*").alias("_rows")).select(
        "_range", "shard", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
