"""Landed provider frames and market metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstate.operators.ordered import number_rows
from tickstate.operators.ordering import ARRIVAL
from tickstate.schemas import FRAMES, MARKET_PAYLOADS, ddl


def read_frames(
    spark: SparkSession,
    path: str | None = None,
    streaming: bool = False,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Landed frames, in batch or as a stream.

    ``fmt`` is a file format, or ``kafka`` with the usual options (the JSON value
    then holds the frame columns). ``landed_in`` and ``landed_at`` are the place of a
    row: file and row index of Parquet, topic partition and offset of Kafka; other
    formats have none.
    """
    reader = (spark.readStream if streaming else spark.read).options(**(options or {}))
    if fmt == "kafka":
        rows = reader.format("kafka").load()
        place = [F.format_string("%s-%010d", "topic", "partition").alias("landed_in"), F.col("offset").alias("landed_at")]
        return rows.select(F.from_json(F.col("value").cast("string"), ddl(FRAMES)).alias("f"), *place).select(
            "f.*", "landed_in", "landed_at"
        )
    rows = reader.schema(ddl(FRAMES)).format(fmt).load(path)
    if fmt != "parquet":
        return rows
    return rows.select(
        *FRAMES, F.col("_metadata.file_path").alias("landed_in"), F.col("_metadata.row_index").alias("landed_at")
    )


def number_frames(frames: DataFrame) -> DataFrame:
    """Dense arrival numbers 1..n, the order every frame rule refers to.

    Frames of one nanosecond keep the order of their landing; without a place, that of their text.
    """
    place = ["landed_in", "landed_at"] if "landed_in" in frames.columns else ["source", "session_id", "raw"]
    numbered = number_rows(frames, ["received_wall_ns", "received_monotonic_ns", *place], ARRIVAL)
    return numbered.drop("landed_in", "landed_at")


def read_market_payloads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Market objects as fetched; a null body means not found, ``error`` a failed fetch."""
    return spark.read.schema(ddl(MARKET_PAYLOADS)).format(fmt).load(path)
