import glob
import os

from pyspark.sql import functions as F

from tickstate.operators.ordered import (
    SHUFFLE_CLEANUP, checkpoint_dir, holding, kept_rows, materialize, release, shuffles_removed,
)
from tickstate.plans.archive_fixture import archive_events
from tickstate.plans.snapshot import kept_snapshots


def test_kept_rows_take_little_disk(spark):
    """rows of many null columns are kept compressed, and come back as they were."""
    nulls = [F.lit(None).cast("decimal(38,18)").alias(f"n{i}") for i in range(100)]
    df = spark.range(20_000).select("id", F.struct(F.col("id").alias("a"), F.lit("x").alias("b")).alias("s"), *nulls)
    files = lambda: {f for f in glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/**", recursive=True) if os.path.isfile(f)}
    before = files()
    kept = kept_rows(df)
    assert sum(os.path.getsize(f) for f in files() - before) < 20_000 * 100
    assert kept.dtypes == df.dtypes and kept.exceptAll(df).isEmpty() and kept.count() == 20_000


def test_materialized_rows_take_little_disk(spark):
    """The copies of an archive are compressed; types that Parquet lacks still pass."""
    nulls = [F.lit(None).cast("decimal(38,18)").alias(f"n{i}") for i in range(100)]
    df = spark.range(20_000).select("id", *nulls)
    files = lambda: {f for f in glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/**", recursive=True) if os.path.isfile(f)}
    before = files()
    kept = materialize(df)
    assert sum(os.path.getsize(f) for f in files() - before) < 20_000 * 100
    assert kept.dtypes == df.dtypes and kept.count() == 20_000
    odd = spark.range(3).select("id", F.lit(None).alias("none"), F.struct(F.lit(None).alias("void")).alias("s"))
    assert materialize(odd).dtypes == odd.dtypes and materialize(odd).count() == 3
    twice = spark.range(3).select("id", F.col("id").alias("ID"))
    assert materialize(twice).columns == ["id", "ID"]


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    """Files of finished steps stayed until the driver collected garbage."""
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    registered = lambda: set(tracker.shuffleStatuses().keys().mkString(",").split(","))
    before = registered()
    kept = kept_rows(spark.range(1000).repartition(3, "id"))
    assert kept.count() == 1000
    wanted = spark.range(1000).repartition(3, "id")
    with shuffles_removed(spark):
        wanted.write.parquet(f"{tmp_path}/rows")
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
    assert len(registered() - before) <= 1  # that of the count


def test_released_rows_are_deleted_with_those_they_hold(spark):
    """Rows that nothing reads any more do not stay on disk."""
    inner, outer = kept_rows(spark.range(3)), kept_rows(spark.range(4))
    paths = [p for df in (inner, outer) for p in df._kept_paths]
    assert all(os.path.exists(p.removeprefix("file:")) for p in paths)
    release(holding(outer, inner))
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_snapshots_delete_what_they_were_made_of(spark):
    """of all the steps only the ticks, book rows and trades that the result reads stay."""
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    events = archive_events(spark, "/root/testdata/sf0.001")
    rows = kept_snapshots(events)
    release(events)
    assert rows.count() == 899
    left = {p for p in set(os.listdir(folder)) - before if p.startswith("rows-")}
    assert len(left) < 8
