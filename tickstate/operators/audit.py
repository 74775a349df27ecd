"""Archive integrity and run reports."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickstate.operators.asof import SEQ, join_manifests
from tickstate.operators.ordered import Running, following, materialize, number_rows, running
from tickstate.params import CHUNK_ROWS, STREAMS
from tickstate.schemas import SNAPSHOT_FILE
from tickstate.sources.archive import CORRUPT


def sequence_gaps(events: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Q1: gaps and duplicates of the global sequence.

    ``(kind, first_sequence, last_sequence, rows)``: the missing range of a gap,
    or the repeated value and its number of copies.
    """
    counts = events.groupBy(SEQ).agg(F.count("*").alias("_copies"))
    ordered = following(counts, [], SEQ, SEQ, "_next", chunk_rows=chunk_rows)
    gaps = ordered.where(F.col("_next") > F.col(SEQ) + 1).select(
        F.lit("gap").alias("kind"),
        (F.col(SEQ) + 1).alias("first_sequence"),
        (F.col("_next") - 1).alias("last_sequence"),
        (F.col("_next") - F.col(SEQ) - 1).alias("rows"),
    )
    duplicates = counts.where("_copies > 1").select(
        F.lit("duplicate").alias("kind"),
        F.col(SEQ).alias("first_sequence"),
        F.col(SEQ).alias("last_sequence"),
        F.col("_copies").alias("rows"),
    )
    return gaps.unionByName(duplicates)


def segment_overlaps(segments: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Q2: segments of a stream that start at or before the end of an earlier one."""
    ordered = running(
        segments,
        ["source", "stream"],
        "first_ingest_sequence",
        {"earlier_last_sequence": Running("max", F.col("last_ingest_sequence"))},
        chunk_rows=chunk_rows,
        exclusive=True,
        tie="file_path",
    )
    return ordered.where(F.col("earlier_last_sequence") >= F.col("first_ingest_sequence"))


def segment_stats(events_with_path: DataFrame) -> DataFrame:
    """Count, bounds and time range of each file; ``file_path`` is the file."""
    received = "received_wall_timestamp_ns"
    return events_with_path.groupBy("file_path").agg(
        F.count("*").alias("event_count"),
        F.min(SEQ).alias("first_ingest_sequence"),
        F.max(SEQ).alias("last_ingest_sequence"),
        F.min_by(received, SEQ).alias("first_received_timestamp_ns"),
        F.max_by(received, SEQ).alias("last_received_timestamp_ns"),
    )


COMPARED = ("event_count", "first_ingest_sequence", "last_ingest_sequence")


def manifest_mismatches(stats: DataFrame, segments: DataFrame) -> DataFrame:
    """Q3: files whose count or sequence bounds differ from the manifest, or lack a side."""
    path = _same_path("file_path")
    joined = join_manifests(stats.withColumn("file_path", path), segments.withColumn("file_path", path))
    reason = (
        F.when(F.col("manifest_event_count").isNull(), "manifest_missing")
        .when(F.col("file_event_count").isNull(), "file_missing")
        .when(F.col("file_event_count") != F.col("manifest_event_count"), "event_count")
    )
    for column in COMPARED[1:]:
        reason = reason.when(
            ~F.col(f"file_{column}").eqNullSafe(F.col(f"manifest_{column}")), column
        )
    return joined.withColumn("mismatch", reason).where("mismatch is not null").select(
        "file_path", "mismatch", *[f"{s}_{c}" for s in ("file", "manifest") for c in COMPARED]
    )


def read_files(spark: SparkSession, directory: str, glob: str = "*.jsonl.zst") -> DataFrame:
    """Whole files as ``file_path, content, bytes`` for hashing; rotation keeps them small."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(directory)
        .select(F.col("path").alias("file_path"), "content", F.col("length").alias("bytes"))
    )


def _same_path(column: str) -> Column:
    """``file:/x`` and ``file:///x`` name the same file."""
    return F.regexp_replace(F.col(column), "^file:/+", "file:/")


def hash_mismatches(files: DataFrame, segments: DataFrame) -> DataFrame:
    """Q4: files whose SHA-256 differs from the manifest, and manifests without a file."""
    hashes = files.select(
        _same_path("file_path").alias("file_path"), F.sha2("content", 256).alias("file_sha256")
    )
    wanted = segments.select(_same_path("file_path").alias("file_path"), "sha256")
    joined = wanted.join(hashes, "file_path", "left")
    reason = F.when(F.col("file_sha256").isNull(), "file_missing").when(
        F.col("file_sha256") != F.col("sha256"), "hash_mismatch"
    )
    return joined.withColumn("mismatch", reason).where("mismatch is not null")


def quarantine(raw_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q5: ``(good, bad)``; unreadable or truncated lines go aside with a reason and time."""
    bad = F.col(CORRUPT).isNotNull() | F.col("schema_version").isNull() | F.col("payload").isNull()
    text = F.trim(F.col(CORRUPT))
    reason = (
        F.when(text == "", "empty_line")
        .when(text.startswith("{") & ~text.endswith("}"), "truncated")
        .when(F.col(CORRUPT).isNotNull() & ~text.startswith("{"), "not_object")
        .when(F.col(CORRUPT).isNotNull(), "invalid_json")
        .otherwise("not_an_event")
    )
    path = F.col("file_path") if "file_path" in raw_df.columns else F.lit(None).cast("string")
    return (
        raw_df.where(~bad).drop(CORRUPT),
        raw_df.where(bad).select(
            path.alias("original_path"),
            reason.alias("reason"),
            F.col(CORRUPT).alias("line"),
            F.current_timestamp().alias("detected_at_utc"),
        ),
    )


def missing_segments(files: DataFrame, segments: DataFrame) -> DataFrame:
    """Q6: files without a manifest."""
    known = segments.select(_same_path("file_path").alias("_known"))
    return files.join(known, _same_path("file_path") == F.col("_known"), "left_anti")


def rebuild_segments(events_with_path: DataFrame, files: DataFrame, segments: DataFrame) -> DataFrame:
    """Q6: manifest rows for the files that have none, ready to append."""
    lost = missing_segments(files, segments).select(
        _same_path("file_path").alias("file_path"),
        F.sha2("content", 256).alias("sha256"),
        F.col("bytes").alias("compressed_bytes"),
    )
    stats = segment_stats(events_with_path).withColumn("file_path", _same_path("file_path"))
    return lost.join(stats, "file_path").withColumns(
        {
            "schema_version": F.lit(1),
            "relative_path": F.regexp_extract("file_path", "([^/]+)$", 1),
            "source": F.regexp_extract("file_path", "source=([^/]+)", 1),
            "stream": F.regexp_extract("file_path", "stream=([^/]+)", 1),
        }
    )


# Snapshot columns that are never null.
def snapshot_schema_issues(spark: SparkSession, directory: str, files_per_task: int = 32) -> DataFrame:
    """Q7: ``(file_path, issue, rows)`` for missing columns, empty and unreadable snapshot files.

    Tasks open the footers of a list of paths; no row is scanned. The folder must be on a
    file system that pyarrow opens by its address (local, HDFS, S3, GCS).
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(directory)
        .select(_same_path("path").alias("file_path"))
    )
    tasks = max(1, -(-files.count() // files_per_task))
    columns = list(SNAPSHOT_FILE)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("file_path").to_pylist():
                system, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                try:
                    with system.open_input_file(place) as file:
                        footer = parquet.read_metadata(file)
                except (OSError, pa.ArrowException):
                    out.append((path, "unreadable", None))
                    continue
                names = set(footer.schema.to_arrow_schema().names)
                issues = [f"missing_column:{c}" for c in columns if c not in names]
                issues += [] if footer.num_rows else ["no_rows"]
                out += [(path, issue, footer.num_rows) for issue in issues]
            kinds = (pa.string(), pa.string(), pa.int64())
            arrays = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["file_path", "issue", "rows"])

    return files.repartition(tasks).mapInArrow(footers, "file_path string, issue string, rows long")


def _leaves(kind: T.DataType, path: str) -> list[str]:
    """Paths of the fields of nested structs; arrays and maps are compared whole."""
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields for leaf in _leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]
    return [path]


def range_digests(df: DataFrame, key: str, range_rows: int) -> DataFrame:
    """``range, n, digest, total`` of each range of ``range_rows`` keys, independent of row order."""
    value = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return df.select(F.expr(f"`{key}` div {range_rows}").alias("range"), value.alias("v")).groupBy("range").agg(
        F.count("*").alias("n"), F.bit_xor("v").alias("digest"), F.sum(F.col("v").cast("decimal(20,0)")).alias("total")
    )


MOST_RANGES = 1000


def diff_nested(a: DataFrame, b: DataFrame, key: str = "snapshot_sequence", range_rows: int = 10_000) -> DataFrame:
    """Q9 on nested snapshots: keys that differ, with the paths of the differing fields.

    Both sides are reduced to digests of key ranges first. Only ranges whose digests
    differ are read again: up to ``MOST_RANGES`` as bounds on the key, which prune row
    groups of sorted files, more by a semi-join.
    """
    common = [c for c in a.columns if c in b.columns]
    a, b = a.select(*common), b.select(*common)
    left, right = range_digests(a, key, range_rows), range_digests(b, key, range_rows)
    same = reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("n", "digest", "total")])
    open_ranges = materialize(
        left.alias("l").join(right.alias("r"), "range", "full_outer").where(~same).select("range")
    )
    few = [r[0] for r in open_ranges.limit(MOST_RANGES + 1).collect()]
    if len(few) <= MOST_RANGES:
        inside = F.lit(False)
        for low, high in _joined_ranges(sorted(few)):
            inside |= F.col(key).between(low * range_rows, (high + 1) * range_rows - 1)
        a, b = a.where(inside), b.where(inside)
    else:
        a, b = (
            df.withColumn("range", F.expr(f"`{key}` div {range_rows}")).join(open_ranges, "range", "left_semi").drop("range")
            for df in (a, b)
        )
    paths = [p for c in common if c != key for p in _leaves(a.schema[c].dataType, c)]
    both = a.select(key, F.struct(*common).alias("a")).join(b.select(key, F.struct(*common).alias("b")), key, "full_outer")
    differing = F.array_compact(F.array(*[
        F.when(~F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")), F.lit(p)) for p in paths
    ]))
    difference = (
        F.when(F.col("a").isNull(), F.array(F.lit("only_in_second")))
        .when(F.col("b").isNull(), F.array(F.lit("only_in_first"))).otherwise(differing)
    )
    return both.select(key, difference.alias("differences")).where(F.size("differences") > 0)


def _joined_ranges(numbers: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers."""
    runs: list[tuple[int, int]] = []
    for n in numbers:
        if runs and n == runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], n)
        else:
            runs.append((n, n))
    return runs


def diff_snapshots(a: DataFrame, b: DataFrame, key: str = "snapshot_sequence") -> DataFrame:
    """Q9: snapshots that differ between two runs, with the names of the differing columns."""
    columns = [c for c in a.columns if c in b.columns and c != key]
    left = a.select(key, F.struct(*columns).alias("a"))
    right = b.select(key, F.struct(*columns).alias("b"))
    joined = left.join(right, key, "full_outer")
    differing = F.array_compact(
        F.array(
            *[
                F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c))
                for c in columns
            ]
        )
    )
    difference = (
        F.when(F.col("a").isNull(), F.array(F.lit("only_in_second")))
        .when(F.col("b").isNull(), F.array(F.lit("only_in_first")))
        .otherwise(differing)
    )
    return joined.select(key, difference.alias("differences")).where(F.size("differences") > 0)


def count_by_stream(events: DataFrame, streams: tuple[str, ...] = STREAMS) -> DataFrame:
    """A4: events per stream; streams without events count zero."""
    counts = events.groupBy("stream").agg(F.count("*").alias("_n"))
    names = events.sparkSession.createDataFrame([(s,) for s in streams], "stream string")
    return names.join(counts, "stream", "left").select(
        "stream", F.coalesce("_n", F.lit(0)).alias("events")
    )


def replay_summary(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row about a replay."""
    is_tick = F.col("stream") == "snapshot_tick"
    of_events = events.agg(
        F.count("*").alias("events_processed"),
        F.count_if(is_tick).alias("ticks_processed"),
        F.min(SEQ).alias("first_ingest_sequence"),
        F.max(SEQ).alias("last_ingest_sequence"),
    )
    of_snapshots = snapshots.agg(
        F.count("*").alias("snapshots_produced"),
        F.min("snapshot_sequence").alias("first_snapshot_sequence"),
        F.max("snapshot_sequence").alias("last_snapshot_sequence"),
    )
    # two single-row tables
    return of_events.withColumn("_k", F.lit(0)).join(
        of_snapshots.withColumn("_k", F.lit(0)), "_k"
    ).drop("_k")


def latency_percentiles(
    df: DataFrame,
    col: str,
    percents: tuple[float, ...] = (0.5, 0.95, 0.99),
    approximate: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(percent, value)`` with inclusive linear interpolation.

    Values are counted first, so repeated values are one row; ranks come from the
    running count over the sorted distinct values. ``approximate`` uses the
    built-in sketch instead.
    """
    values = df.where(F.col(col).isNotNull())
    points = F.array(*[F.lit(float(p)) for p in percents])
    if approximate:
        found = values.agg(F.percentile_approx(F.col(col).cast("double"), points).alias("_v"))
        return found.select(F.explode(F.arrays_zip(points.alias("percent"), F.col("_v").alias("value"))).alias("z")).select("z.*")
    counts = values.groupBy(F.col(col).cast("double").alias("_value")).agg(F.count("*").alias("_n"))
    ranked = running(
        number_rows(counts, ["_value"], "_order"),
        [],
        "_order",
        {"_upto": Running("sum", F.col("_n"))},
        chunk_rows=chunk_rows,
    )
    total = counts.agg(F.sum("_n").alias("_total"))
    wanted = total.select("_total", F.explode(points).alias("percent")).withColumn(
        "_at", F.col("percent") * (F.col("_total") - 1)
    )
    # the rows asked for are two per percentage, so this side is always tiny
    wanted = wanted.select(
        "percent",
        (F.col("_at") - F.floor("_at")).alias("_part"),
        F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank"),
    ).groupBy("percent", "_part", "_rank").agg(F.count("*").alias("_uses"))
    hit = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))
    picked = ranked.join(F.broadcast(wanted), hit)
    low, high = F.min("_value"), F.max("_value")
    return picked.groupBy("percent").agg(
        (low + (high - low) * F.max("_part")).alias("value")
    )


def coverage_report(snapshots: DataFrame, expected: int) -> DataFrame:
    """Delivery ratio, ready snapshots, distinct markets and book sessions."""
    sessions = F.array_distinct(
        F.array_compact(
            F.array(
                *[
                    F.col(f"market_5m.{side}.source_session_id")
                    for side in ("up", "down")
                ]
            )
        )
    )
    seen = snapshots.select(
        F.explode(
            F.concat(
                F.array(
                    F.struct(F.lit("5m").alias("kind"), F.col("market_5m.market_id").alias("id")),
                    F.struct(F.lit("15m").alias("kind"), F.col("market_15m.market_id").alias("id")),
                ),
                F.transform(
                    sessions, lambda s: F.struct(F.lit("session").alias("kind"), s.alias("id"))
                ),
            )
        ).alias("s")
    ).select("s.*").where("id is not null").distinct()
    kinds = seen.groupBy().pivot("kind", ["5m", "15m", "session"]).agg(F.count(F.lit(1)))
    totals = snapshots.agg(
        F.count("*").alias("snapshots"), F.count_if("ready_for_strategy").alias("ready_snapshots")
    )
    zero = F.lit(0)
    return totals.withColumn("_k", zero).join(kinds.withColumn("_k", zero), "_k", "left").select(
        "snapshots",
        "ready_snapshots",
        F.lit(expected).cast("bigint").alias("expected_snapshots"),
        F.round(F.try_divide(F.col("snapshots"), F.lit(expected)), 6).alias("delivery_ratio"),
        F.coalesce("5m", zero).alias("market_5m_ids"),
        F.coalesce("15m", zero).alias("market_15m_ids"),
        F.coalesce("session", zero).alias("book_sessions"),
    )


def criteria(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A10: named checks over a one-row report, plus the overall ``passed`` row."""
    values = {n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}
    everything = reduce(and_, values.values())
    rows = [
        F.struct(F.lit(n).alias("criterion"), c.alias("passed")) for n, c in values.items()
    ] + [F.struct(F.lit("passed").alias("criterion"), everything.alias("passed"))]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
