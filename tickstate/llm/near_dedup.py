"""Near-duplicate documents: HyperMinHash registers, banding, verification on full sets.

A text's set holds the hashes of its distinct word shingles. Its sketch has 128
registers; a register keeps, of the smallest hash in its bucket, the number of
leading zeros and ten mantissa bits. Bands of four registers propose candidates;
a collision-corrected estimate on the registers decides which candidates form a
cluster; all links inside a cluster are confirmed on the full sets.

Nothing emits all pairs: equal sets are one class, buckets and clusters give
spanning edges, and both are cut into blocks of bounded size. Defined results:
null or blank text has an empty set and links with nothing; rows without doc_id
are kept and named by null; a repeated doc_id with another text is judged by its
own text; an empty table gives an empty result; ties go to the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstate.llm.common import components, few_files, in_block_pairs, link_block, mix64, slices, small_batches, staged, texts, whole_groups

REGISTERS, BAND, MANTISSA = 128, 4, 10
BUCKET_DOCS = 1024          # most documents of a bucket in one block
BLOCK_BYTES = 6_000_000     # most bytes of sets of a cluster in one block, about
FILTER_BITS = 26            # size of the candidate filter: 8 MB, whatever the input
_EMPTY = np.uint16(0xFFFF)
_REST = 57
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CACHED_WORDS, _CACHED_LENGTH = 200_000, 64
# for each register, the order in which it borrows from others when it is empty
_BORROW = np.stack([np.random.default_rng(i).permutation(REGISTERS) for i in range(REGISTERS)])


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _CACHED_LENGTH:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


def shingle_sets(rows: list[bytes | None], words: int, hashes: dict) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ASCII letters are lower-cased."""
    split = [r.lower().split() if r else [] for r in rows]
    flat = np.fromiter(
        (hashes[w] for r in split for w in r), np.uint64, sum(map(len, split))
    )
    with np.errstate(over="ignore"):
        rolled = flat.copy()
        for j in range(1, words):
            rolled[: len(flat) - j] = rolled[: len(flat) - j] * _STEP + flat[j:]
    mixed = mix64(rolled)
    sets, start = [], 0
    for r in split:
        n = len(r)
        if n >= words:
            sets.append(np.unique(mixed[start : start + n - words + 1]))
        elif n:
            with np.errstate(over="ignore"):
                whole = np.uint64(n)
                for h in flat[start : start + n]:
                    whole = whole * _STEP + h
            sets.append(mix64(np.array([whole ^ _STEP])))
        else:
            sets.append(flat[:0])
        start += n
    return sets


def registers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Registers of one sorted non-empty set, empty ones borrowed, and which were filled."""
    bucket = (hashes >> np.uint64(_REST)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = (hashes[first] & np.uint64((1 << _REST) - 1)).astype(np.float64)
    fraction, exponent = np.frexp(np.maximum(rest, 0.5))
    zeros = np.clip(_REST - exponent, 0, 62)
    mantissa = ((fraction - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64)
    out = np.full(REGISTERS, _EMPTY, dtype=np.uint16)
    out[bucket[first]] = ((zeros << MANTISSA) | mantissa).astype(np.uint16)
    filled = np.zeros(REGISTERS, dtype=bool)
    filled[bucket[first]] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _BORROW[empty]
        source = order[np.arange(len(empty)), filled[order].argmax(axis=1)]
        out[empty] = out[source]
    return out, filled


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles``, two fingerprints of the set, registers and their filled mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), words, hashes)
            with np.errstate(over="ignore"):
                prints = np.array(
                    [(s.sum(dtype=np.uint64), mix64(s).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64
                ).reshape(len(sets), 2).view(np.int64)
            made = [registers(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(prints[:, 0]), pa.array(prints[:, 1]),
                 pa.array([m and m[0].tobytes() for m in made], pa.binary()),
                 pa.array([m and np.packbits(m[1]).tobytes() for m in made], pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "print_a", "print_b", "registers", "filled"],
            )

    return docs.select("doc_id", text_hash().alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, print_a long, print_b long, registers binary, filled binary"
    )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = REGISTERS // BAND
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.frombuffer(b"".join(batch.column("registers").to_pylist()), dtype=np.uint64)
        with np.errstate(over="ignore"):
            keys = mix64(values.reshape(-1, bands) + np.arange(1, bands + 1, dtype=np.uint64) * _STEP)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel().view(np.int64)),
             pa.array(np.repeat(batch.column("rep").to_numpy(), bands))],
            names=["band", "rep"],
        )


def _chance(n: np.ndarray) -> np.ndarray:
    """Per set size, the probability of each leading-zero count in a filled register."""
    load = np.maximum(n, 1)[:, None] / REGISTERS
    steps = 2.0 ** -np.arange(_REST + 2)
    upto = np.exp(-load * steps)
    return np.diff(upto, axis=1) / -np.expm1(-load)


def _edges(rep: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    joined = labels != np.arange(len(labels))
    return rep[joined], rep[labels[joined]]


def _edge_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _near_edges(percent: int):
    """Spanning edges of a bucket's block over pairs whose estimate may reach the threshold."""
    t = percent / 100

    def block(rep, sizes, regs, filled) -> tuple[np.ndarray, np.ndarray]:
        chance = _chance(sizes)

        def linked(i: int) -> np.ndarray:
            same = ((regs == regs[i]) & filled & filled[i]).sum(axis=1)
            union = (filled | filled[i]).sum(axis=1)
            by_chance = chance @ chance[i] / (1 << MANTISSA)
            estimate = (same / union - by_chance) / (1 - by_chance)
            fits = 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
            return np.flatnonzero(fits & (estimate >= t - 4.5 * np.sqrt(t * (1 - t) / union)))

        return _edges(rep, link_block(len(rep), linked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, ["band", "x", "y"]):
            n = group.num_rows
            rep, sizes = group.column("rep").to_numpy(), group.column("n_shingles").to_numpy()
            regs = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(n, -1)
            filled = np.unpackbits(
                np.frombuffer(b"".join(group.column("filled").to_pylist()), np.uint8).reshape(n, -1), axis=1
            ).astype(bool)
            yield _edge_batch([
                block(rep[lo:hi], sizes[lo:hi], regs[lo:hi], filled[lo:hi])
                for lo, hi in zip(bounds[:-1], bounds[1:])
            ])

    return run


def _verified_edges(percent: int):
    """Spanning edges of a cluster's block over pairs confirmed on their full sets."""

    def block(rep: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = len(rep)
        sizes = np.array([len(s) for s in sets])
        _, place = np.unique(np.concatenate(sets), return_inverse=True)
        holders = np.repeat(np.arange(n), sizes)[np.argsort(place, kind="stable")]  # documents by shingle
        bounds = np.concatenate(([0], np.cumsum(np.bincount(place))))
        starts = np.concatenate(([0], np.cumsum(sizes)))

        def linked(i: int) -> np.ndarray:
            mine = place[starts[i] : starts[i + 1]]
            lengths = bounds[mine + 1] - bounds[mine]
            offsets = np.repeat(bounds[mine] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
            shared = np.bincount(holders[offsets + np.arange(lengths.sum())], minlength=n)
            return np.flatnonzero(100 * shared >= percent * (sizes + sizes[i] - shared))

        return _edges(rep, link_block(n, linked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, ["cluster", "x", "y"]):
            rep, column = group.column("doc_id").to_numpy(), group.column("hashes")
            yield _edge_batch([
                block(rep[lo:hi], [np.frombuffer(s, np.uint64) for s in column.slice(lo, hi - lo).to_pylist()])
                for lo, hi in zip(bounds[:-1], bounds[1:])
            ])

    return run


def _candidate_filter(nodes: DataFrame) -> np.ndarray:
    """A bit set of fixed size over the hashes of ``node``; false hits only cost time."""
    place = F.shiftrightunsigned(F.xxhash64("node"), 64 - FILTER_BITS)
    rows = (
        nodes.select(place.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``doc_id, hashes`` of documents that may be in ``nodes``; texts are not shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(_candidate_filter(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            place = batch.column("place").to_numpy()
            hit = (bits.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
            for part in slices(iter([batch.filter(pa.array(hit.astype(bool)))])):
                sets = shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), words, hashes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "hashes"],
                )

    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - FILTER_BITS)
    return (
        texts(docs.where("doc_id is not null")).select("doc_id", place.alias("place"), "text")
        .mapInArrow(run, "doc_id long, hashes binary")
    )


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` of every row of ``docs``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their
    shingle sets; a component is named by its smallest doc_id, which is kept.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    same = ["n_shingles", "print_a", "print_b"]
    sketched = staged(sketches(docs, words), "sketches")
    n_docs = sketched.count()
    classes = staged(few_files(
        sketched.where("doc_id is not null and n_shingles > 0")
        .groupBy(*same)
        .agg(F.min(F.struct("doc_id", "registers", "filled")).alias("m"))
        .select(*same, F.col("m.doc_id").alias("rep"), "m.registers", "m.filled"),
        n_docs,
    ), "classes")
    bands = classes.select("rep", "registers").mapInArrow(_bands, "band long, rep long")
    buckets = (
        bands.groupBy("band")
        .agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.bit_xor(F.xxhash64("rep")).alias("h"))
        .where("n > 1")
        .groupBy("n", "lo", "h").agg(F.min("band").alias("band"))  # one bucket per set of members
        .select("band", F.ceil(F.col("n") / BUCKET_DOCS).alias("blocks"))
    )
    members = in_block_pairs(bands.join(buckets, "band"), "rep", "blocks")
    near = (
        members.join(classes.select("rep", "n_shingles", "registers", "filled"), "rep")
        .repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "rep")
        .mapInArrow(_near_edges(percent), "a long, b long")
    )
    clusters = staged(few_files(
        components(near, n_docs).withColumnRenamed("component", "cluster"), n_docs
    ), "clusters")
    blocks = (
        clusters.join(classes.groupBy("rep").agg(F.max("n_shingles").alias("n")), F.col("node") == F.col("rep"))
        .groupBy("cluster").agg(F.ceil(F.sum("n") * 8 / BLOCK_BYTES).alias("blocks"))
    )
    wide = (
        _full_sets(docs, clusters, words)
        .join(clusters.join(blocks, "cluster").withColumnRenamed("node", "doc_id"), "doc_id")
    )
    verified = (
        in_block_pairs(wide, "doc_id", "blocks")
        .repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "doc_id")
        .mapInArrow(_verified_edges(percent), "a long, b long")
    )
    labels = components(verified, n_docs)
    reps = classes.select(*same, "rep").join(
        labels.withColumnRenamed("node", "rep"), "rep", "left"
    ).select(*same, F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        sketched.select("doc_id", "text_hash", *same).join(reps, same, "left")
        .select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
