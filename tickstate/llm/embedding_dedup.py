"""Near-duplicate vectors: random-hyperplane signs, exact cosine, components.

Vectors of one label and dimension are hashed by the signs of random projections
in several tables. Rows that share a bucket are screened by the Hamming distance
of a further sketch of 128 signs, and what is left is compared by cosine in double
precision. The number of sign bits follows the largest label, and the number of
tables follows from the bits so that a pair at the threshold is met with
probability ``recall``. With ``complete``, pairs that no table joined or the sketch
turned away are then looked for in block pairs of each label, so no link is lost;
this part is quadratic in a label's distinct vectors.

Equal vectors are one weighted class. A pair that shares buckets of several
tables is counted in the first of them only, so link counts are summed without
emitting pairs; big buckets are cut into block pairs. Defined results: vectors
that are null, zero or hold null or non-finite components, and those with a null
label, link with nothing; equal rows with different vec_id link (a tie at the
threshold is a link); vectors of different dimension do not; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstate.llm.common import components, few_files, in_block_pairs, staged, whole_groups

BUCKET_ROWS = 1024
BLOCK_BYTES = 16 << 20
SKETCH_BITS = 128
_SMALL = 48
_PAIRS = 200_000
_CELLS = 2_000_000


def hash_shape(largest_label: int, threshold: float, recall: float) -> tuple[int, int]:
    """Sign bits per table and number of tables."""
    bits = min(30, max(8, math.ceil(math.log2(max(largest_label, 2))) - 2))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def sketch_cut(threshold: float) -> int:
    """Differing sketch signs that a pair at the threshold stays within, by six deviations."""
    p = math.acos(threshold) / math.pi
    return min(SKETCH_BITS, math.floor(SKETCH_BITS * p + 6 * math.sqrt(SKETCH_BITS * p * (1 - p))))


def _unit(row, n: int) -> np.ndarray | None:
    if row is None or not n or any(x is None for x in row):
        return None
    vector = np.asarray(row, dtype=np.float64) + 0.0
    if not np.isfinite(vector).all():
        return None
    top = np.abs(vector).max()
    return vector if top > 0 else None


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("embedding").to_pylist()
        vectors = [_unit(r, len(r) if r is not None else 0) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), batch.column("vec_id"), batch.column("label"),
             pa.array([None if v is None else len(v) for v in vectors], pa.int32()),
             pa.array([None if v is None else v.tobytes() for v in vectors], pa.binary())],
            names=["row_id", "vec_id", "label", "dim", "vector"],
        )


def _normal(blob: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blob), dtype=np.float64).reshape(len(blob), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signs(bits: int, tables: int, seed: int):
    weights = (1 << np.arange(bits)).astype(np.int64)
    hashed = tables * bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column("dim").to_numpy()
            blobs = batch.column("vector").to_pylist()
            codes = np.empty((len(blobs), tables), dtype=np.int32)
            sketch = np.empty((len(blobs), SKETCH_BITS // 8), dtype=np.uint8)
            for dim in np.unique(dims):
                if dim not in planes:
                    rng = np.random.default_rng([seed, int(dim)])
                    planes[dim] = rng.standard_normal((dim, hashed + SKETCH_BITS))
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, max(1, len(at) // 2000)):
                    signs = _normal([blobs[i] for i in part]) @ planes[dim] > 0
                    codes[part] = signs[:, :hashed].reshape(len(part), tables, bits) @ weights
                    sketch[part] = np.packbits(signs[:, hashed:], axis=1)
            halves = sketch.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_id"), batch.column("label"), batch.column("dim"), batch.column("weight"),
                 batch.column("vector"), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                 pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(list(codes), pa.list_(pa.int32()))],
                names=["class_id", "label", "dim", "weight", "vector", "s0", "s1", "signs", "codes"],
            )

    return run


def _sketches(group: pa.Table) -> np.ndarray:
    return np.stack([group.column(c).to_numpy() for c in ("s0", "s1")], axis=1).view(np.uint64)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signs that differ between sketches."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _spans(bounds: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Bounds of the groups of more than ``least`` rows."""
    big = np.flatnonzero(np.diff(bounds) > least)
    return zip(bounds[big].tolist(), bounds[big + 1].tolist())


def _screened(cut: int):
    """Rows of buckets with another row of the bucket whose sketch is within ``cut``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, ["key", "table", "x", "y"]):
            n = group.num_rows
            sketch, own = _sketches(group), group.column("own").to_numpy()
            cross = group.column("x").to_numpy() != group.column("y").to_numpy()
            of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            size = np.diff(bounds)[of]
            near = np.zeros(n, dtype=bool)
            # small buckets all at once, by distance in the sorted rows
            small = size <= _SMALL
            for d in range(1, int(size[small].max()) if small.any() else 0):
                i = np.flatnonzero(small[:-d] & (of[:-d] == of[d:]))
                i = i[~cross[i] | (own[i] != own[i + d])]
                i = i[_differ(sketch[i], sketch[i + d]) <= cut]
                near[i] = near[i + d] = True
            for lo, hi in _spans(bounds, _SMALL):
                step = max(1, _CELLS // (2 * (hi - lo)))
                for a in range(lo, hi, step):
                    b = min(a + step, hi)
                    close = _differ(sketch[a:b, None], sketch[None, lo:hi]) <= cut
                    if cross[lo]:
                        close &= own[a:b, None] != own[None, lo:hi]
                    else:
                        close[np.arange(b - a), np.arange(a - lo, b - lo)] = False
                    near[a:b] |= close.any(axis=1)
            yield from group.select(["class_id", "key", "table", "x", "y", "own"]).filter(pa.array(near)).to_batches()

    return run


def _shares(a: np.ndarray, b: np.ndarray, tables: int) -> np.ndarray:
    """Which pairs of code rows agree in one of the first ``tables`` tables."""
    found = np.zeros(len(a), dtype=bool)
    left = np.arange(len(a))
    for t in range(tables):
        same = a[left, t] == b[left, t]
        found[left[same]] = True
        left = left[~same]
        if not len(left):
            break
    return found


def _cosine(unit: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", unit[i], unit[j])


def _pair_links(i, j, table, unit, codes, sketch, threshold, cut) -> np.ndarray:
    """Which pairs reach the threshold, pass the sketch and share no bucket of an earlier table."""
    good = np.zeros(len(i), dtype=bool)
    for lo in range(0, len(i), _PAIRS // 10):
        a, b = i[lo : lo + _PAIRS // 10], j[lo : lo + _PAIRS // 10]
        good[lo : lo + len(a)] = (_cosine(unit, a, b) >= threshold) & (_differ(sketch[a], sketch[b]) <= cut)
    for lo in range(0, len(i), _PAIRS):
        part = lo + np.flatnonzero(good[lo : lo + _PAIRS])
        for t in np.unique(table[part]):
            of = part[table[part] == t]
            good[of] = ~_shares(codes[i[of]], codes[j[of]], t)
    return good


def _batch_of(classes, weight, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Links of each class and a class that it reaches, of the linked positions."""
    if not pairs:
        return
    n = len(classes)
    i, j = (np.concatenate(side) for side in zip(*pairs))
    links = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
    low = np.arange(n)
    while True:  # smallest linked position, repeated until nothing changes
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            break
    hit = np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays(
        [pa.array(classes[hit]), pa.array(links[hit].astype(np.int64)), pa.array(classes[low[hit]])],
        names=["class_id", "links", "root"],
    )


def _read(group: pa.Table):
    codes = np.frombuffer(b"".join(group.column("signs").to_pylist()), np.int32).reshape(group.num_rows, -1)
    return group.column("class_id").to_numpy(), group.column("weight").to_numpy(), codes, _sketches(group)


def _links(threshold: float, cut: int):
    """Links of pairs that share a bucket, each in the first table that joins it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, ["key", "table", "label", "dim", "x", "y"]):
            n = group.num_rows
            classes, weight, codes, sketch = _read(group)
            table = group.column("table").to_numpy()
            cross = group.column("x").to_numpy() != group.column("y").to_numpy()
            own = group.column("own").to_numpy()
            dims = group.column("dim").to_numpy()
            blobs = group.column("vector").to_pylist()
            of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            size = np.diff(bounds)[of]
            for dim in np.unique(dims):
                unit = np.zeros((n, dim))
                at = np.flatnonzero(dims == dim)
                unit[at] = _normal([blobs[k] for k in at])
                pairs = []
                small = (dims == dim) & (size <= _SMALL)
                for d in range(1, int(size[small].max()) if small.any() else 0):
                    i = np.flatnonzero(small[:-d] & (of[:-d] == of[d:]))
                    i = i[~cross[i] | (own[i] != own[i + d])]
                    if len(i):
                        i = i[_pair_links(i, i + d, table[i], unit, codes, sketch, threshold, cut)]
                        pairs.append((i, i + d))
                for lo, hi in _spans(bounds, _SMALL):
                    if dims[lo] != dim:
                        continue
                    for a in range(lo, hi, BUCKET_ROWS):
                        near = unit[a : min(a + BUCKET_ROWS, hi)] @ unit[lo:hi].T >= threshold - 1e-9
                        i, j = np.nonzero(near)
                        i, j = i + a, j + lo
                        use = (i < j) & (~cross[lo] | (own[i] != own[j]))
                        i, j = i[use], j[use]
                        good = _pair_links(i, j, table[i], unit, codes, sketch, threshold, cut)
                        pairs.append((i[good], j[good]))
                yield from _batch_of(classes, weight, pairs)

    return run


def _missed_links(threshold: float, cut: int):
    """Links of pairs that share no bucket or that the sketch turns away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, ["label", "dim", "x", "y"]):
            for lo, hi in _spans(bounds, 1):
                part = group.slice(lo, hi - lo)
                classes, weight, codes, sketch = _read(part)
                unit = _normal(part.column("vector").to_pylist())
                own = part.column("own").to_numpy()
                x, y = part.column("x")[0].as_py(), part.column("y")[0].as_py()
                rows = len(own) if x == y else int(np.searchsorted(own, y))
                first = 0 if x == y else rows
                pairs = []
                step = max(1, _CELLS // (hi - lo))
                for a in range(0, rows, step):
                    i, j = np.nonzero(unit[a : min(a + step, rows)] @ unit[first:].T >= threshold - 1e-9)
                    i, j = i + a, j + first
                    i, j = i[i < j], j[i < j]
                    for at in range(0, len(i), _PAIRS):
                        u, v = i[at : at + _PAIRS], j[at : at + _PAIRS]
                        met = _shares(codes[u], codes[v], codes.shape[1]) & (_differ(sketch[u], sketch[v]) <= cut)
                        u, v = u[~met], v[~met]
                        good = _cosine(unit, u, v) >= threshold
                        if good.any():
                            pairs.append((u[good], v[good]))
                yield from _batch_of(classes, weight, pairs)

    return run


def near_duplicate_vectors(
    vectors: DataFrame, *, threshold: float = 0.93, recall: float = 0.9999, complete: bool = True, seed: int = 5
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (vec_id, embedding, label).

    Without ``complete`` a pair at the threshold is found with probability ``recall``.
    """
    rows = staged(
        vectors.select(
            F.monotonically_increasing_id().alias("row_id"), F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label").cast("string").alias("label"), "embedding",
        ).mapInArrow(_prepare, "row_id long, vec_id long, label string, dim int, vector binary"),
        "vectors",
    )
    same = ["label", "dim", "vector"]
    usable = rows.where("label is not null and vector is not null")
    n_rows = rows.count()
    classes = staged(few_files(
        usable.groupBy(*same).agg(
            F.min("row_id").alias("class_id"), F.count("*").alias("weight"), F.min("vec_id").alias("low_id")
        ),
        n_rows,
    ), "vector-classes")
    sizes = staged(classes.groupBy("label", "dim").count(), "vector-labels")
    largest = sizes.agg(F.max("count")).first()[0] or 1
    bits, tables = hash_shape(largest, threshold, recall)
    cut = sketch_cut(threshold)
    signed = staged(
        classes.select("class_id", "label", "dim", "weight", "vector").mapInArrow(
            _signs(bits, tables, seed),
            "class_id long, label string, dim int, weight long, vector binary, s0 long, s1 long, "
            "signs binary, codes array<int>",
        ),
        "signs",
    )
    placed = signed.select(
        "class_id", "label", "dim", "s0", "s1", F.posexplode("codes").alias("table", "code")
    ).select("class_id", "s0", "s1", "table", F.xxhash64("label", "dim", "table", "code").alias("key"))
    crowded = staged(
        placed.groupBy("key", "table").count().where(F.col("count") > BUCKET_ROWS)
        .select("key", "table", F.ceil(F.col("count") / BUCKET_ROWS).alias("blocks")),
        "crowded-buckets",
    )
    dealt = placed.join(crowded, ["key", "table"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    screened = staged(
        in_block_pairs(dealt, "class_id", "blocks", own_pairs=True)
        .repartition("key", "table", "x", "y").sortWithinPartitions("key", "table", "x", "y", "class_id")
        .mapInArrow(_screened(cut), "class_id long, key long, table int, x long, y long, own long"),
        "screened",
    )
    links = "class_id long, links long, root long"
    found = (
        screened.join(signed.drop("codes"), "class_id")
        .repartition("key", "table", "x", "y")
        .sortWithinPartitions("key", "table", "label", "dim", "x", "y", "class_id")
        .mapInArrow(_links(threshold, cut), links)
    )
    if complete:
        row_bytes = F.col("dim") * 8 + tables * 4
        blocks = sizes.select(
            "label", "dim", F.ceil(F.col("count") * row_bytes / BLOCK_BYTES).cast("long").alias("blocks")
        )
        found = found.unionByName(
            in_block_pairs(signed.drop("codes").join(blocks, ["label", "dim"]), "class_id", "blocks", own_pairs=True)
            .repartition("label", "dim", "x", "y")
            .sortWithinPartitions("label", "dim", "x", "y", "own", "class_id")
            .mapInArrow(_missed_links(threshold, cut), links)
        )
    found = staged(found, "vector-links")
    counts = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")), n_rows)
    low = (
        roots.join(classes.select(F.col("class_id").alias("node"), "low_id"), "node")
        .groupBy("component").agg(F.min("low_id").alias("low"))
    )
    named = (
        classes.join(counts, "class_id", "left")
        .join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
        .join(low, "component", "left")
        .select(
            *same, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("low", "low_id").alias("component_id"),
        )
    )
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return (
        rows.join(named, same, "left")
        .select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
