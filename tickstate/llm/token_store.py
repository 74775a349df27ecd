"""Token-id files: whole texts as ids in coded, independently readable frames.

Documents are range-partitioned by doc_id and encoded; a file row is one frame
of consecutive documents: a header, doc_ids and lengths, then blocks of coded
ids, each with its own checksum (see ``token_coder``). A frame ends at a document
border once it holds ``FRAME_IDS`` ids. Frames are stored as Parquet rows, so
writing is atomic per task and any frame can be read alone.

Frame: magic ``TKF1``, number of documents, of ids and of blocks (uint32 each),
doc_id validity bits, doc_ids (int64), lengths (uint32), block sizes (uint32),
block checksums (uint32), blocks. All little-endian.

Defined results: null or empty text is the end id alone; a very long text is encoded
whole and may exceed a frame; documents of equal
doc_id keep the order of their rows in the input; null doc_ids come first; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickstate.llm import token_coder
from tickstate.llm.common import slices, small_batches, texts

MAGIC = b"TKF1"
FRAME_IDS = 4_000_000
PART_BYTES = 24_000_000
_CACHED_WORDS, _CACHED_PIECES, _CACHED_LENGTH = 400_000, 800_000, 48


# a space that opens a word, and a space that white space follows
_WORD, _ODD, _SPACE = re.compile(r" (?=\S)"), re.compile(r" (?=\s|$)"), re.compile(r"\s")
# over Latin letters, ASCII digits, marks and white space this is the library's own pattern, whatever its Unicode version
_LATIN, _MARKS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F", r"!-/:-@\[-`{-~"
_LATIN_TEXT = re.compile(rf"[{_LATIN}0-9{_MARKS}\s]*", re.ASCII).fullmatch
_PIECES = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LATIN}]+| ?[0-9]+| ?[{_MARKS}]+|\s+(?!\S)|\s+", re.ASCII
).findall
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class Encoder:
    """Ids of whole texts by a tokenizers file, remembered by word.

    Byte-level BPE never merges across a space that a non-space follows, so a
    text is the concatenation of its parts cut there; equal parts are encoded
    once. A text that spells a token added to the vocabulary (``<|endoftext|>``) is
    encoded whole, as the library cuts it there first. ``words`` holds the ids of a part with its space,
    without the space in the key. A text of Latin letters, digits and ASCII marks is cut finer, into the
    ``pieces`` of the library's pattern, across which it never merges: they repeat far more often than words do.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) if added else r"(?!)")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        parts = json.loads(content)
        self.cut_latin = parts.get("normalizer") is None and parts.get("pre_tokenizer") == _BYTE_LEVEL

    def _encode(self, parts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint16).tobytes() for e in done]

    def _encode_lines(self, lines: list[str]) -> list[bytes]:
        """Ids of texts without white space, but for one space that may open them.

        They are encoded as lines of one text: a line break before one space or none is a
        token of its own, so the ids are cut there.
        """
        text = "\n".join(["", *lines, ""])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint16)
        cuts = np.flatnonzero(ids == self.line_break)
        if len(cuts) != len(lines) + 1:
            return self._encode(lines)
        raw = ids.tobytes()
        bounds = (2 * cuts).tolist()
        return [raw[lo + 2 : hi] for lo, hi in zip(bounds, bounds[1:])]

    def _encode_latin(self, rows: list[str]) -> list[bytes]:
        """Ids of texts that ``_LATIN_TEXT`` matches."""
        made = []
        for lo in range(0, len(rows), 100):
            cut = [_PIECES(t) for t in rows[lo : lo + 100]]
            if len(self.pieces) > _CACHED_PIECES:
                self.pieces = {}
            known = self.pieces
            flat = list(chain.from_iterable(cut))
            ids = list(map(known.get, flat))
            unknown = [i for i, found in enumerate(ids) if found is None]
            missing = list({flat[i] for i in unknown})
            lines = [p for p in missing if len(p) <= _CACHED_LENGTH and not p.isspace()]
            known.update(zip(lines, self._encode_lines(lines)))
            rest = [p for p in missing if p not in known]
            extra = dict(zip(rest, self._encode(rest)))
            for i in unknown:
                ids[i] = extra[flat[i]] if flat[i] in extra else known[flat[i]]
            at = 0
            for pieces in cut:
                made.append(b"".join(ids[at : at + len(pieces)]))
                at += len(pieces)
        return made

    def __call__(self, rows: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit integers."""
        whole = [i for i, t in enumerate(rows) if self.added.search(t)]
        done = dict(zip(whole, self._encode([rows[i] for i in whole])))
        if self.cut_latin:
            latin = [i for i, t in enumerate(rows) if i not in done and _LATIN_TEXT(t)]
            done.update(zip(latin, self._encode_latin([rows[i] for i in latin])))
        others = iter(self._encode_parts([t for i, t in enumerate(rows) if i not in done]))
        return [done[i] if i in done else next(others) for i in range(len(rows))]

    def _encode_parts(self, rows: list[str]) -> list[bytes]:
        cut = [_WORD.split(t) if _ODD.search(t) else t.split(" ") for t in rows]
        opening = self._encode([parts[0] for parts in cut])
        if len(self.words) > _CACHED_WORDS:
            self.words = {}
        known = self.words
        wanted = set()
        for parts in cut:
            wanted.update(parts[1:])
        missing = [w for w in wanted if w not in known]
        plain = [w for w in missing if len(w) <= _CACHED_LENGTH and not _SPACE.search(w)]
        for lo in range(0, len(plain), 5_000):
            part = plain[lo : lo + 5_000]
            known.update(zip(part, self._encode_lines([" " + w for w in part])))
        rest = [w for w in missing if w not in known]
        extra = dict(zip(rest, self._encode([" " + w for w in rest])))
        find = (lambda w: extra[w] if w in extra else known[w]) if extra else known.__getitem__
        return [o + b"".join(map(find, parts[1:])) for o, parts in zip(opening, cut)]


@lru_cache(maxsize=1)
def _encoder(content: str) -> Encoder:
    """One encoder, with the words it knows, for all tasks of a worker."""
    return Encoder(content)


def frame(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    blocks = token_coder.encode(ids)
    valid = np.array([d is not None for d in doc_ids], dtype=bool)
    return b"".join([
        MAGIC, np.array([len(doc_ids), len(ids), len(blocks)], dtype="<u4").tobytes(),
        np.packbits(valid).tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array(lengths, dtype="<u4").tobytes(),
        np.array([len(b) for b in blocks], dtype="<u4").tobytes(),
        token_coder.checksums(blocks).tobytes(), *blocks,
    ])


def read_frame(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a frame; raises on a damaged block."""
    if data[:4] != MAGIC:
        raise ValueError("not a frame of token ids")
    at = 16
    n_docs, n_ids, n_blocks = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    valid = np.unpackbits(take("u1", -(-n_docs // 8)))[:n_docs]
    doc_ids = [int(d) if v else None for d, v in zip(take("<i8", n_docs), valid)]
    lengths, sizes, sums = take("<u4", n_docs), take("<u4", n_blocks), take("<u4", n_blocks)
    blocks = []
    for size, check in zip(sizes, sums):
        blocks.append(data[at : at + int(size)])
        at += int(size)
        if zlib.crc32(blocks[-1]) != check:
            raise ValueError("a block of token ids is damaged")
    return doc_ids, lengths, token_coder.decode(blocks, n_ids)


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end_id: int) -> None:
    """Write ``part, frame, n_docs, n_ids, payload`` rows: all texts in ascending doc_id order.

    ``tokenizer`` is a file on the driver; its content, a few megabytes, is broadcast.
    """
    small_batches(docs.sparkSession)
    rows = texts(docs).withColumn("_row", F.monotonically_increasing_id())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with open(tokenizer, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], dtype=np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        held_ids = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype=np.uint16)
            data = frame(doc_ids, [len(h) // 2 for h in held], ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())],
                names=["part", "frame", "n_docs", "n_ids", "payload"],
            )

        for batch in slices(batches):
            made = encoder(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), made):
                doc_ids.append(doc_id)
                held.append(ids + end)
                held_ids += len(ids) // 2 + 1
                if held_ids >= FRAME_IDS:
                    yield flush()
                    doc_ids, held, held_ids, number = [], [], 0, number + 1
        if doc_ids:
            yield flush()

    # the row number parts rows that share a doc_id
    (
        rows.repartitionByRange(max(1, -(-size // PART_BYTES)), "doc_id", "_row")
        .sortWithinPartitions("doc_id", "_row").select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(run, "part int, frame int, n_docs long, n_ids long, payload binary")
        .write.option("compression", "none").parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, *, digest: bool = False) -> DataFrame:
    """``part, frame, doc_id, offset, n_tokens, ids`` of every document in the files.

    ``ids`` are little-endian unsigned 32-bit integers; with ``digest`` their
    ``ids_crc32`` stands in their place.
    """
    last, kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(batch.column(c).to_pylist() for c in ("part", "frame", "payload"))):
                doc_ids, lengths, ids = read_frame(data)
                raw = memoryview(ids.astype("<u4")).cast("B")
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                for lo in range(0, len(doc_ids), 2000):
                    of = slice(lo, lo + 2000)
                    blobs = [raw[4 * s : 4 * e] for s, e in zip(starts[of].tolist(), ends[of].tolist())]
                    out = [zlib.crc32(b) for b in blobs] if digest else [bytes(b) for b in blobs]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(out), pa.int32()), pa.array([number] * len(out), pa.int32()),
                         pa.array(doc_ids[of], pa.int64()), pa.array(starts[of]),
                         pa.array(lengths[of].astype(np.int64)), pa.array(out, kind)],
                        names=["part", "frame", "doc_id", "offset", "n_tokens", last],
                    )

    return spark.read.parquet(path).select("part", "frame", "payload").mapInArrow(
        run, f"part int, frame int, doc_id long, offset long, n_tokens long, {last} {'long' if digest else 'binary'}"
    )


def with_start(spark: SparkSession, path: str, read: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids before each document in all files."""
    frames = spark.read.parquet(path).select("part", "frame", "n_ids")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(
        # one row per file partition
        "part", F.coalesce(F.sum("_n").over(before(F.lit(0)).orderBy("part")), F.lit(0)).alias("_part")
    )
    starts = frames.select(
        "part", "frame", F.coalesce(F.sum("n_ids").over(before("part").orderBy("frame")), F.lit(0)).alias("_frame")
    ).join(parts, "part")
    return read.join(starts, ["part", "frame"]).withColumn(
        "start", F.col("_part") + F.col("_frame") + F.col("offset")
    ).drop("_part", "_frame")
