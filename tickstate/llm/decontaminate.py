"""Benchmark passages in documents by q-gram filtering and banded alignment.

A benchmark item (cut into overlapping probes if it is long) occurs in a text
with at most k edits only if they share at least m - q + 1 - k*q of the probe's
m - q + 1 q-grams on nearby diagonals. Shared q-grams are counted in bands of
2(k+1) diagonals that overlap by half, so any k+1 neighbouring diagonals lie in
one band; bands that reach the bound are verified by banded alignment.

Letters are compared in lower case and any white space is one space character.
The benchmark is read in blocks of ``BLOCK_PROBES`` probes, so what is broadcast
is bounded; each block is one pass over the texts, without a shuffle. Of several
blocks each pass is a job of its own that writes the rows with matches, so a task
holds one index at a time.

Items of more than ``PROBE`` characters are probes of that length every ``STRIDE``
characters, so a copied passage of ``PROBE + STRIDE - 1`` characters always holds a
whole probe; of shorter items, and shorter passages, the whole probe must occur.

Defined results: null or empty texts and items match nothing, and so do items
shorter than q characters; very long texts are compared whole; short items get fewer edits than ``max_error`` if the
bound needs it; repeated rows are judged each; an empty table gives an empty
result. Of overlapping matches of one probe the one with fewer edits, then the
first, is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstate.llm.common import code_points, slices, small_batches, staged

Q = 10
PROBE, STRIDE = 200, 50
BLOCK_PROBES = 5_000
_WINDOW = 64
_BITS = 22
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = 0x30000
LEAK = "struct<item_id: long, item_start: int, start: long, end: long, edits: int>"


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    table = np.arange(_PLAIN + 1, dtype=np.uint32)
    for c in range(_PLAIN):
        low = chr(c).lower()
        table[c] = 32 if chr(c).isspace() else ord(low) if len(low) == 1 else c
    return table


def fold(points: np.ndarray) -> np.ndarray:
    return np.where(points < _PLAIN, _fold_table()[np.minimum(points, _PLAIN)], points)


def _grams(points: np.ndarray) -> np.ndarray:
    """Hash of the Q code points from each position on."""
    with np.errstate(over="ignore"):
        one = points.astype(np.uint64) + np.uint64(1)
        two = one[:-1] * _STEP + one[1:]
        four = two[:-2] * (_STEP * _STEP) + two[2:]
        eight = four[:-4] * (_STEP ** np.uint64(4)) + four[4:]
        ten = eight[:-2] * (_STEP * _STEP) + two[8:]
    return ten


class ProbeIndex:
    """Sorted q-gram hashes of a block of probes, with their places."""

    def __init__(self, rows, max_error: float):
        self.rows = [(item, offset, fold(np.array(list(map(ord, text)), dtype=np.uint32)))
                     for item, offset, text in rows if len(text) >= Q]
        self.size = np.array([len(p) for _, _, p in self.rows], dtype=np.int64)
        self.edits = np.minimum((self.size * max_error).astype(np.int64), (self.size - Q) // Q)
        self.bound = self.size - Q + 1 - self.edits * Q
        grams = [_grams(p) for _, _, p in self.rows]
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else order
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(order))
        self.marks = np.zeros(1 << _BITS, dtype=bool)
        self.marks[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.reach = int((self.size + self.edits).max(initial=0))
        parts = -(-(self.size + self.edits) // _WINDOW)
        #: shared q-grams in some window of any occurrence
        self.dense = int((-(-self.bound // parts)).min()) if self.rows else 1

    def hits(self, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and gram numbers of q-grams in regions that are dense enough."""
        none = np.zeros(0, dtype=np.int64)
        if len(text) < Q or not self.rows:
            return none, none
        grams = _grams(text)
        at = np.flatnonzero(self.marks[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        number = np.searchsorted(self.hashes, grams[at])
        number[number == len(self.hashes)] = 0
        row_end = bounds[np.searchsorted(bounds, at, side="right")]
        good = (self.hashes[number] == grams[at]) & (at + Q <= row_end)
        at, number = at[good], number[good]
        # a hit that opens a dense window; regions around these are kept
        last = np.searchsorted(at, at + _WINDOW)
        dense = at[(last - np.arange(len(at))) >= self.dense]
        if not len(dense):
            return none, none
        before = np.searchsorted(dense, at, side="right") - 1
        after = np.minimum(before + 1, len(dense) - 1)
        far = self.reach + _WINDOW
        keep = ((before >= 0) & (at - dense[np.maximum(before, 0)] <= far)) | (
            (dense[after] >= at) & (dense[after] - at <= far))
        return at[keep], number[keep]

    def leaks(self, text: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, probe, start, end, edits) of every verified match, starts within the row."""
        at, number = self.hits(text, bounds)
        if not len(at):
            return []
        many = self.first[number + 1] - self.first[number]
        posting = np.repeat(self.first[number] - np.concatenate(([0], np.cumsum(many)[:-1])), many)
        posting += np.arange(many.sum())
        probe, at = self.owner[posting], np.repeat(at, many)
        row = np.searchsorted(bounds, at, side="right") - 1
        diagonal = at - bounds[row] - self.place[posting] + self.size[probe]  # never negative
        width = self.edits[probe] + 1
        band = diagonal // width
        # band b covers diagonals of b and b + 1; a q-gram counts once per band and place in the probe
        key = np.concatenate((np.stack([row, probe, band], 1), np.stack([row, probe, band - 1], 1)))
        order = np.lexsort(key.T[::-1])
        key = key[order]
        change = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        counts = np.diff(np.append(change, len(key)))
        places = self.place[posting][order % len(at)]
        found: list[tuple[int, int, int, int, int]] = []
        for start, n in zip(change, counts):
            r, p, b = key[start]
            if n < self.bound[p] or len(np.unique(places[start : start + n])) < self.bound[p]:
                continue
            low = b * (self.edits[p] + 1) - self.size[p]
            match = self._align(text[bounds[r] : bounds[r + 1]], p, int(low), int(low + 2 * self.edits[p] + 1))
            if match:
                found.append((int(r), int(p), *match))
        return _best(found)

    def _align(self, text: np.ndarray, p: int, low: int, high: int) -> tuple[int, int, int] | None:
        """Best occurrence of probe ``p`` that starts on diagonals ``low`` to ``high``."""
        probe, k = self.rows[p][2], int(self.edits[p])
        m = len(probe)
        first = max(low, 0)
        region = text[first : max(high, 0) + m]
        exact = region.tobytes().find(probe.tobytes())
        while exact >= 0 and exact % 4:
            exact = region.tobytes().find(probe.tobytes(), exact + 1)
        if exact >= 0:
            return first + exact // 4, first + exact // 4 + m, 0
        return banded(probe, text, low - k, high + k, k)


def banded(probe: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence with at most ``k`` edits inside the diagonal band.

    A cell holds edits and start as one number, so the least is the one with
    fewest edits, then the first start.
    """
    one = np.int64(1 << 40)
    far = np.int64(1 << 60)
    n, width = len(text), high - low + 1
    steps = np.arange(width, dtype=np.int64)
    end = steps + low  # text position reached in each cell before any probe character
    cell = np.where((end >= 0) & (end <= n), np.maximum(end, 0), far)
    padded = np.concatenate((text.astype(np.int64), [-1]))
    for i, c in enumerate(probe):
        end = steps + low + i + 1
        inside = (end >= 1) & (end <= n)
        taken = cell + np.where(inside & (padded[np.clip(end - 1, 0, n)] == c), 0, one)
        skipped = np.append(cell[1:], far) + one
        cell = np.where(inside, np.minimum(taken, skipped), np.where(end == 0, skipped, far))
        cell = np.minimum.accumulate(cell - steps * one) + steps * one
        cell = np.where((end >= 0) & (end <= n), cell, far)
    best = int(cell.argmin())
    edits, start = divmod(int(cell[best]), int(one))
    return (start, low + best + len(probe), edits) if edits <= k else None


def _best(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Per row and probe, matches that do not overlap; fewer edits first, then the first start."""
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    out = []
    for r, p, start, end, edits in sorted(set(found), key=lambda f: (f[0], f[1], f[4], f[2], f[3])):
        spans = taken.setdefault((r, p), [])
        if all(end <= s or start >= e for s, e in spans):
            spans.append((start, end))
            out.append((r, p, start, end, edits))
    return out


def probes(benchmark: DataFrame) -> DataFrame:
    """``item_id, offset, probe``: whole items, or overlapping pieces of long ones."""
    last = F.greatest(F.length("text") - PROBE, F.lit(0))
    starts = F.when(last == 0, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(STRIDE)), F.array(last)))
    )
    return (
        benchmark.where("text is not null")
        .select(F.col("item_id").cast("long").alias("item_id"), "text", F.explode(starts).alias("offset"))
        .select("item_id", "offset", F.expr(f"substring(text, offset + 1, {PROBE})").alias("probe"))
        .distinct()
    )


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ProbeIndex = shared.value
        for batch in slices(batches):
            points, bounds = code_points(batch.column("text"))
            leaks: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, probe, start, end, edits in index.leaks(fold(points), bounds):
                item, offset, _ = index.rows[probe]
                leaks[row].append(
                    {"item_id": item, "item_start": offset, "start": start, "end": end, "edits": edits}
                )
            at = batch.schema.get_field_index("leaks")
            yield batch.set_column(at, "leaks", pa.array(leaks, batch.schema.field(at).type))

    return run


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), max_error: float = 0.08
) -> DataFrame:
    """``keep`` columns and ``leaks``, an array of item_id, item_start, start, end, edits, per row."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = staged(probes(benchmark), "probes")
    blocks = max(1, -(-pieces.count() // BLOCK_PROBES))
    own = () if "text" in keep else ("text",)
    none = F.expr(f"cast(array() as array<{LEAK}>)")

    def passed(df: DataFrame, b: int) -> DataFrame:
        mine = pieces.where(F.pmod(F.xxhash64("item_id", "offset", "probe"), F.lit(blocks)) == b)
        index = ProbeIndex(sorted(map(tuple, mine.collect()), key=repr), max_error)
        df = df.withColumn("leaks", none)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(_find(spark.sparkContext.broadcast(index)), schema)

    if blocks == 1:
        return passed(docs.select(*keep, *own), 0).select(*keep, "leaks")
    rows = staged(docs.select(*keep, *own).withColumn("_row", F.monotonically_increasing_id()), "leak-texts")
    found = None
    for b in range(blocks):
        hits = staged(passed(rows.select("_row", "text"), b).where(F.size("leaks") > 0).drop("text"), "leaks")
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("_row").agg(F.flatten(F.collect_list("leaks")).alias("leaks"))
    return rows.join(found, "_row", "left").select(*keep, F.coalesce("leaks", none).alias("leaks"))
