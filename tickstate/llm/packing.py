"""Best-fit packing of token sequences into bins of several permitted lengths.

Texts longer than the largest length are cut into pieces; pieces are dealt
evenly into groups of about ``GROUP_PIECES`` and each group is packed by best
fit, longest piece first. A new bin gets the permitted length of least cost per
token that it can expect to hold; every limit on that choice is tried and the
cheapest packing stays. Finally each bin shrinks to the smallest length that
holds its contents.

Defined results: a document without tokens still has its end token; repeated rows
are packed each; a null doc_id is packed and named by null; ties in length go by
doc_id and piece; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstate.llm.common import staged

GROUP_PIECES = 20_000
LENGTHS = (512, 1024, 2048, 4096)
SEQUENCE_COST = 16


def token_cost(length: int) -> float:
    """Cost of one sequence: its tokens, padding included, and a fixed part."""
    return length + SEQUENCE_COST


def best_fit(
    lengths: list[int], sizes: list[int], cost: Callable[[int], float]
) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (longest first), and the final size of each bin."""
    best: tuple[float, list[int], list[int], list[int]] | None = None
    total = sum(lengths)
    for most in range(len(sizes)):
        bins, offsets, used, opened = [], [], [], []
        free: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
        mask, rest = 0, total  # mask: which free spaces have a bin
        for n in lengths:
            fitting = mask >> n
            if fitting:
                space = n + (fitting & -fitting).bit_length() - 1
                b = free[space].pop()
                if not free[space]:
                    mask &= ~(1 << space)
            else:
                choice = [s for s in sizes[: most + 1] if s >= n] or [next(s for s in sizes if s >= n)]
                space = min(choice, key=lambda s: (cost(s) / min(s, rest), -s))
                b = len(used)
                used.append(0)
                opened.append(space)
            bins.append(b)
            offsets.append(used[b])
            used[b] += n
            rest -= n
            space -= n
            if space:
                free[space].append(b)
                mask |= 1 << space
        final = [next(s for s in sizes if s >= u) for u in used]
        price = sum(map(cost, final))
        if best is None or price < best[0]:
            best = price, bins, offsets, final
    return best[1:] if best else ([], [], [])


def pack(
    lengths: DataFrame, *, sizes: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = token_cost
) -> DataFrame:
    """Pieces of every row of ``lengths`` (doc_id, n_tokens, end token included) with their places.

    Columns: doc_id, piece, start, length, bin_id, capacity, position.
    """
    sizes = tuple(sorted(set(sizes)))
    top = sizes[-1]
    docs = staged(lengths.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens")), "lengths")
    pieces = docs.where("n_tokens > 0").select(
        "doc_id", "n_tokens", F.posexplode(F.expr(f"sequence(0L, n_tokens - 1, {top}L)")).alias("piece", "start")
    ).select("doc_id", "piece", "start", F.least(F.lit(top), F.col("n_tokens") - F.col("start")).cast("int").alias("length"))
    count = docs.agg(F.sum(F.ceil(F.col("n_tokens") / top))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        bins, offsets, final = best_fit(table.column("length").to_pylist(), list(sizes), cost)
        group = TaskContext.get().partitionId() << 32
        ids = np.asarray(bins, dtype=np.int64)
        table = (
            table.append_column("bin_id", pa.array(ids + group))
            .append_column("capacity", pa.array(np.asarray(final, dtype=np.int32)[ids]))
            .append_column("position", pa.array(offsets, pa.int32()))
        )
        yield from table.to_batches(max_chunksize=50_000)

    # dealt in turn, so no document or length gathers in one group
    dealt = pieces.repartition(max(1, -(-count // GROUP_PIECES))).sortWithinPartitions(
        F.desc("length"), "doc_id", "piece", "start"
    )
    kind = lengths.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length int, bin_id long, capacity int, position int"
    )
