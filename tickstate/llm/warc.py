"""Web archives in seekable Zstandard bundles.

Each page is one WARC/1.1 record. A bundle is a file of independent Zstandard
frames, each of whole records up to ``FRAME_BYTES``, with a seek table in a
skippable frame at its end (the public seekable format), so any tool that reads
``.warc.zst`` reads it and any frame can be read alone. ``index`` is a Parquet
table: record id, type and page of each record with bundle, frame, and the
record's offset and length inside the frame.

``pages`` is scanned twice, for digests and for writing; rows are matched by
their position, so it must be a table scan or another plan that gives the same
rows in the same partitions (pass ``staged`` output otherwise). Bundles are
written by the tasks with unique names and are part of the archive once the
index, which Spark commits, names them: a lost or repeated task leaves a file that
nothing reads.

Of records with equal payloads of ``LEAST_REVISIT`` bytes or more, the one with the
largest page_id (null: smallest; then the later row) is a response; the others
are revisits that refer to it and keep only their headers.

Defined results: a null html is an empty payload; repeated rows and null page_ids
give records of their own; control characters of a url are written as ``%XX`` and
a null url is left out; a text longer than a frame has a frame to itself; an empty
table gives an archive without bundles; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstate.llm.common import slices, small_batches

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
FRAMES_PER_TASK = 64
LEAST_REVISIT = 1000
LEVEL = 3
# fixed values of the public seekable Zstandard format
_SKIPPABLE, _SEEKABLE, _SEEK_FOOTER, _CHECKED = 0x184D2A5E, 0x8F92EAB1, 9, 0x80
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f1c3a52-2f52-5b0e-9d0f-0a3d5c1f7b11")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")

INDEX = "record_id string, record_type string, page_id long, bundle string, frame int, offset int, length int"


def record_id(page_id: int | None, row: int) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{row}')}"


def _check(plain: bytes) -> int:
    """A frame's checksum in the seek table."""
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, row`` with ``kept_page, kept_row`` of the response that a revisit refers to.

    The largest page of a payload is a map-side combined maximum over narrow rows
    (digest, page_id, row); html moves once, by the row's own number.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("row"),
    )
    large = rows.where(F.octet_length("html") >= LEAST_REVISIT).select(
        "row", "page_id", F.sha2(F.col("html").cast("binary"), 256).alias("payload")
    )
    best = (
        large.groupBy("payload").agg(F.max(F.struct("page_id", "row")).alias("best"), F.count("*").alias("n"))
        .where("n > 1").drop("n")
    )
    revisits = large.join(best, "payload").where("row <> best.row").select(
        "row", F.col("best.page_id").alias("kept_page"), F.col("best.row").alias("kept_row")
    )
    return rows.join(revisits, "row", "left")


def record(page_id: int | None, url: str | None, html: bytes, row: int, kept: tuple[int | None, int] | None, date: str) -> tuple[str, str, bytes]:
    """Id, type and bytes of one WARC record."""
    own, kind = record_id(page_id, row), "response" if kept is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(html).digest()).decode())
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if kept is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{record_id(*kept)}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if kept is not None else http + html
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return own, kind, "\r\n".join(head).encode() + block + b"\r\n\r\n"


class BundleWriter:
    """Records in frames of one file, with the seek table at the end."""

    def __init__(self, path: str):
        self.name = path
        system, place = _open(path)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self._file = system.open_output_stream(place, compression=None)
        self._zstd = pa.Codec("zstd", LEVEL)
        self._held: list[bytes] = []
        self._size, self._table, self.written = 0, [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset that the record gets."""
        if self._held and self._size + len(data) > FRAME_BYTES:
            self._flush()
        place = len(self._table), self._size
        self._held.append(data)
        self._size += len(data)
        return place

    def _flush(self) -> None:
        if self._held:
            plain = b"".join(self._held)
            packed = self._zstd.compress(plain, asbytes=True)
            self._file.write(packed)
            self._table.append((len(packed), self._size, _check(plain)))
            self.written += len(packed)
            self._held, self._size = [], 0

    def close(self) -> None:
        self._flush()
        entries = b"".join(struct.pack("<III", *e) for e in self._table)
        footer = struct.pack("<IBI", len(self._table), _CHECKED, _SEEKABLE)
        self._file.write(struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self._file.close()


class BundleReader:
    """Frames of one file by number, through its seek table."""

    def __init__(self, path: str):
        system, place = _open(path)
        self._file = system.open_input_file(place)
        size = self._file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - _SEEK_FOOTER, _SEEK_FOOTER))
        if magic != _SEEKABLE or flags != _CHECKED:
            raise ValueError(f"{path} has no seek table with checksums")
        table = self._at(size - _SEEK_FOOTER - 12 * count, 12 * count)
        self._places, start = [], 0
        for packed, plain, check in struct.iter_unpack("<III", table):
            self._places.append((start, packed, plain, check))
            start += packed

    def _at(self, start: int, size: int) -> bytes:
        self._file.seek(start)
        return self._file.read(size)

    def frame(self, number: int) -> bytes:
        start, packed, plain, check = self._places[number]
        data = pa.Codec("zstd").decompress(self._at(start, packed), plain, asbytes=True)
        if _check(data) != check:
            raise ValueError("a frame differs from its checksum")
        return data

    def close(self) -> None:
        self._file.close()


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block and end of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no record starts here")
    head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    start = end + 4
    stop = start + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return head, data[start:stop], stop + 4


def _row(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """Values of ``RECORDS`` after the place; a damaged payload raises."""
    cut = block.index(b"\r\n\r\n")
    declared = int(re.search(rb"Content-Length: (\d+)", block[:cut])[1])
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
    kind, payload = head["warc-type"], block[cut + 4 :]
    if kind == "response" and (len(payload) != declared or hashlib.sha1(payload).digest() != digest):
        raise ValueError("a payload differs from its digest")
    page = head.get("page-id")
    return (
        head["warc-record-id"].strip("<>"), kind, None if page is None else int(page), head.get("warc-target-uri"),
        declared, digest.hex(), head.get("warc-refers-to", "").strip("<>") or None,
        payload if with_payload and kind == "response" else None,
    )


RECORDS = (
    "bundle string, frame int, offset int, record_id string, record_type string, page_id long, url string, "
    "payload_bytes long, payload_digest string, refers_to_id string, payload binary"
)
_RECORDS = pa.schema([
    ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("record_id", pa.string()),
    ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary()),
])
_INDEX = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()),
    ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32()),
])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` (page_id, url, html) below ``path``, a shared folder."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, bundle = TaskContext.get().partitionId(), 0, None
        try:
            for batch in slices(batches, "html"):
                places = []
                for page, url, html, row, kept_page, kept_row in zip(*(c.to_pylist() for c in batch.columns)):
                    kept = None if kept_row is None else (kept_page, kept_row)
                    own, kind, data = record(page, url, html, row, kept, date)
                    if bundle is None:
                        bundle = BundleWriter(f"{path}/bundles/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.warc.zst")
                    frame, offset = bundle.add(data)
                    places.append((own, kind, page, bundle.name, frame, offset, len(data)))
                    if bundle.written >= BUNDLE_BYTES:
                        bundle.close()
                        bundle, number = None, number + 1
                yield _batch(places, _INDEX)
        finally:
            if bundle is not None:
                bundle.close()

    rows = with_revisits(pages).select(
        "page_id", "url", F.col("html").cast("binary").alias("html"), "row", "kept_page", "kept_row"
    )
    rows.mapInArrow(run, INDEX).write.parquet(f"{path}/index")


def read_frames(places: DataFrame, with_payload: bool) -> DataFrame:
    """``RECORDS`` of the frames named by ``places`` (bundle, frame, offsets: null for all records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one = None
        for batch in batches:
            for name, number, offsets in zip(*(c.to_pylist() for c in batch.columns)):
                if open_one is None or open_one[0] != name:
                    if open_one:
                        open_one[1].close()
                    open_one = name, BundleReader(name)
                data, out, at = open_one[1].frame(number), [], 0
                for at in [0] if offsets is None else sorted(offsets):
                    while at < len(data):
                        head, block, end = parse_record(data, at)
                        out.append((name, number, at, *_row(head, block, with_payload)))
                        at = end if offsets is None else len(data)
                yield _batch(out, _RECORDS)
        if open_one:
            open_one[1].close()

    return places.select("bundle", "frame", "offsets").mapInArrow(run, RECORDS)


def _dealt(frames: DataFrame) -> DataFrame:
    """Frames in tasks of ``FRAMES_PER_TASK``, about, each in file order."""
    count = frames.count()
    cores = frames.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(count, cores), -(-count // FRAMES_PER_TASK))
    return frames.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame")


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record of the archive, read from its bundles frame by frame."""
    frames = spark.read.schema(INDEX).parquet(f"{path}/index").groupBy("bundle", "frame").agg(
        F.lit(None).cast("array<int>").alias("offsets")
    )
    return read_frames(_dealt(frames), payload)


def find_records(spark: SparkSession, path: str, wanted: DataFrame, payload: bool = True) -> DataFrame:
    """The records of ``wanted`` (record_id): their frames are read and nothing else."""
    frames = (
        spark.read.schema(INDEX).parquet(f"{path}/index").join(wanted.select("record_id").distinct(), "record_id", "left_semi")
        .groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets"))
    )
    return read_frames(_dealt(frames), payload)


def with_referred_page(records: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Add ``refers_to``, the page_id of the response that a revisit names, from the index."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index").where("record_type = 'response'")
    named = index.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(named, "refers_to_id", "left")
