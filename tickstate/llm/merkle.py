"""Merkle manifest of a table: a tree of digests per group and one over the groups.

Places come from ranks in bitmaps, not from a sort. The keys of a group are a
bitmap of 64-bit words, of which only those with a bit are kept; words of equal
(group, key div 64) are merged with ``or`` while they are counted, map-side
first. Running popcounts over words, and over three more levels of 2^10, 2^16 and
2^16 children, give each word the number of rows before it; no level puts more
than 65,537 rows into a window. A row's slot is that base plus the popcount of
the bits below its own. Each level of the tree is a shuffle by (group, slot div
16), where 16 keyed slots make one node.

A leaf is H of doc_id, source, lang, n_chars and text, each ``-`` if null, else
its UTF-8 length, ``:`` and the value. H is SHA-256 as lowercase hex, over
digests as hex text. In a group leaves ascend by key; while several nodes remain,
every ``FANOUT`` of them (the last run may be shorter, even one) become their H.
What remains is the group's subroot; subroots in order of the group (null first,
bytewise) become the root in the same way.

Defined results: null keys come first; rows of equal key are ordered by leaf, and
equal rows take slots of their own, so every input row has one result row; a lone
leaf is its group's subroot and a lone subroot the root; nulls in any column and
long texts enter the leaf whole; an empty table gives no rows and no root; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickstate.llm.common import staged
from tickstate.operators.ordered import materialize, number_rows

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# below every key div 64, so rows without key come first
_NO_KEY = -(1 << 58)


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    """Digest of a row's ``FIELDS``; ``changed`` stands in for columns of that name."""

    def part(name: str) -> Column:
        text = changed.get(name, F.col(name)).cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(*[part(f) for f in FIELDS])


def lower_cased(text: str = "text") -> Column:
    """The tampering of the check: A-Z in lower case."""
    return F.translate(F.col(text), _UPPER, _LOWER)


def _before(*by: str, order: str) -> Column:
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(window), F.lit(0))


def rank_directory(rows: DataFrame) -> DataFrame:
    """``g, word, bits, n, base, total`` of rows with ``g`` and ``key``.

    ``bits`` is the group's bitmap over keys ``64 * word`` and up, ``n`` the rows
    there, ``base`` those before them and ``total`` all rows of the group.
    """
    words = materialize(
        rows.select(
            "g", F.expr(f"coalesce(shiftright(key, 6), {_NO_KEY})").alias("word"),
            F.expr("coalesce(shiftleft(1L, cast(key & 63 as int)), 0L)").alias("bit"),
        ).groupBy("g", "word").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
    )
    inner = words.withColumn("low", F.shiftright("word", 10)).withColumn("b0", _before("g", "low", order="word"))
    low = (
        inner.groupBy("g", "low").agg(F.sum("n").alias("n"))
        .withColumn("mid", F.shiftright("low", 16)).withColumn("b1", _before("g", "mid", order="low"))
    )
    mid = (
        low.groupBy("g", "mid").agg(F.sum("n").alias("n"))
        .withColumn("high", F.shiftright("mid", 16)).withColumn("b2", _before("g", "high", order="mid"))
    )
    high = (
        mid.groupBy("g", "high").agg(F.sum("n").alias("n"))
        .withColumn("b3", _before("g", order="high")).withColumn("total", F.sum("n").over(Window.partitionBy("g")))
    )
    above = (
        low.drop("n").join(mid.drop("n"), ["g", "mid"]).join(high.drop("n"), ["g", "high"])
        .select("g", "low", (F.col("b1") + F.col("b2") + F.col("b3")).alias("b"), "total")
    )
    return inner.join(above, ["g", "low"]).select(
        "g", "word", "bits", "n", (F.col("b0") + F.col("b")).alias("base"), "total"
    )


def with_slots(rows: DataFrame, directory: DataFrame, ties: str = "digest") -> DataFrame:
    """Add ``slot`` (from 0) and ``total``: the place of each row in its group by ``key``, then ``ties``.

    Only rows in a word with repeated or missing keys are ordered, by a range
    shuffle that also splits a key with very many rows.
    """
    found = rows.withColumn("word", F.expr(f"coalesce(shiftright(key, 6), {_NO_KEY})")).join(directory, ["g", "word"])
    crowded = F.col("n") > F.bit_count("bits")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, cast(key & 63 as int)))")
    plain = found.where(~crowded).withColumn("slot", F.col("base") + below).drop("word", "bits", "n", "base")
    if directory.where(crowded).isEmpty():
        return plain
    repeated = found.where(crowded).withColumn("_tie", F.monotonically_increasing_id())
    repeated = number_rows(repeated, ["g", "word", "key", ties, "_tie"], "_n")
    first = repeated.groupBy("g", "word").agg(F.min("_n").alias("_first"))
    placed = repeated.join(first, ["g", "word"]).withColumn("slot", F.col("base") + F.col("_n") - F.col("_first"))
    return plain.unionByName(placed.select(*plain.columns))


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x["digest"]), "")


def reduce_levels(nodes: DataFrame, most: int, payload: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level of the trees of ``nodes`` (g, slot, digest, total), and their tops.

    A run has ``g, run, items`` (slot, digest and, in the first level, ``payload``)
    and ``total`` of its level. Tops are ``g, digest, height``. ``most`` is the
    largest total.
    """
    runs, tops, height = [], [nodes.where("total = 1").select("g", "digest", F.lit(0).alias("height"))], 0
    while most > 1:
        made = (
            nodes.where("total > 1").groupBy("g", F.expr(f"slot div {FANOUT}").alias("run"))
            .agg(F.array_sort(F.collect_list(F.struct("slot", "digest", *payload))).alias("items"), F.max("total").alias("total"))
        )
        runs.append(staged(made, "merkle-runs") if payload else materialize(made))
        nodes = runs[-1].select(
            "g", F.col("run").alias("slot"), digest(_joined(F.col("items"))).alias("digest"),
            F.expr(f"(total + {FANOUT - 1}) div {FANOUT}").alias("total"),
        )
        most, height, payload = -(-most // FANOUT), height + 1, ()
        tops.append(nodes.where("total = 1").select("g", "digest", F.lit(height).alias("height")))
    return runs, reduce(DataFrame.unionByName, tops)


def _siblings(items: Column, i: Column) -> Column:
    """The digests before and after item ``i`` of a run."""
    text = lambda part: _joined(part)
    return F.struct(
        text(F.slice(items, 1, i)).alias("left"), text(F.slice(items, i + 2, FANOUT)).alias("right")
    )


def runs_with_paths(runs: list[DataFrame], tops: DataFrame, down_to: int = 0) -> DataFrame:
    """``items`` of the first level with ``path`` and ``subroot`` of the node that they make.

    ``tops`` are ``g, height, path, subroot``. A path lists the siblings ``left``
    and ``right`` of a node and of all above it. Runs meet paths by their unique
    (g, slot), level by level from the top.
    """
    nodes = None
    for level in range(len(runs) - 1, -1, -1):
        parents = tops.where(F.col("height") == level + 1).select(
            "g", F.lit(0).cast("long").alias("run"), "path", "subroot"
        )
        parents = parents if nodes is None else parents.unionByName(nodes)
        joined = runs[level].join(parents, ["g", "run"])
        if level == 0:
            return joined.select("g", "items", "path", "subroot")
        nodes = joined.select("g", "items", "path", "subroot", F.posexplode("items").alias("i", "item")).select(
            "g", F.col("item.slot").alias("run"),
            F.concat(F.array(_siblings(F.col("items"), F.col("i"))), F.col("path")).alias("path"), "subroot",
        )
    return None


@dataclass(frozen=True)
class Manifest:
    """The trees of a table: runs of leaves and of nodes, subroots, and the root (None: no rows)."""

    lone: DataFrame
    runs: list[DataFrame]
    subroots: DataFrame
    top_runs: list[DataFrame]
    root: str | None
    payload: tuple[str, ...]


def build_manifest(docs: DataFrame, group: str = "source", key: str = "doc_id", **more: Column) -> Manifest:
    """Digest every row of ``docs`` and all levels above; ``more`` columns stay with the leaves."""
    rows = staged(
        docs.select(
            F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
            F.col(key).cast("long").alias("key"), leaf().alias("digest"), *[c.alias(n) for n, c in more.items()],
        ),
        "merkle-leaves",
    )
    directory = materialize(rank_directory(rows))
    most = directory.agg(F.max("total")).first()[0] or 0
    placed = with_slots(rows, directory)
    payload = ("key", *more)
    runs, tops = reduce_levels(placed, most, payload)
    tops = number_rows(tops, ["g"], "_n").withColumn("slot", F.col("_n") - 1)
    count = tops.count()
    above = tops.select(
        F.lit("").alias("g"), "slot", "digest", F.lit(count).cast("long").alias("total"), F.col("g").alias("of"), "height"
    )
    top_runs, root = reduce_levels(above, count, ("of", "height"))
    top = root.first()
    lone = placed.where("total = 1").select("g", "digest", *payload)
    return Manifest(lone, runs, tops.select("g", "digest", "height"), top_runs, top and top["digest"], payload)


def _subroot_paths(manifest: Manifest) -> DataFrame:
    """``g, height, path, subroot`` of every group."""
    empty = F.array().cast("array<struct<left:string,right:string>>")
    if not manifest.top_runs:  # one group: its subroot is the root
        return manifest.subroots.select("g", "height", empty.alias("path"), F.col("digest").alias("subroot"))
    root = manifest.top_runs[0].sparkSession.range(1).select(
        F.lit("").alias("g"), F.lit(len(manifest.top_runs)).alias("height"), empty.alias("path"), F.lit("").alias("subroot")
    )
    return runs_with_paths(manifest.top_runs, root).select(
        "items", "path", F.posexplode("items").alias("i", "item")
    ).select(
        F.col("item.of").alias("g"), F.col("item.height").alias("height"),
        F.concat(F.array(_siblings(F.col("items"), F.col("i"))), F.col("path")).alias("path"),
        F.col("item.digest").alias("subroot"),
    )


def proofs(manifest: Manifest, instead: str | None = None) -> DataFrame:
    """One row per leaf: ``key, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``folded_root`` is computed from the leaf, or from column ``instead`` where it
    is not null, and the siblings on the way to the root.
    """
    tops = materialize(_subroot_paths(manifest))
    own = lambda x: F.coalesce(x[instead], x["digest"]) if instead else x["digest"]
    beside = lambda path: F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")
    fold = lambda path, start: F.aggregate(
        path, start, lambda at, p: digest(p["left"], at, p["right"])
    )

    def row(item: Column, proof: Column, folded: Column) -> list[Column]:
        return [
            item["key"].alias("key"), item["digest"].alias("leaf"), F.col("subroot"),
            proof.alias("proof_sha256"), folded.alias("folded_root"),
        ]

    item = F.struct("digest", *manifest.payload)
    out = manifest.lone.join(tops, "g").select(
        *row(item, digest(beside(F.col("path"))), fold(F.col("path"), own(item)))
    )
    if manifest.runs:
        runs = runs_with_paths(manifest.runs, tops).withColumn("beside", beside(F.col("path")))
        # one row per run goes up the shared path; its leaves differ in their own siblings only
        made = F.transform(
            "items",
            lambda x, i: F.struct(*row(
                x, digest(_siblings(F.col("items"), i)["left"], _siblings(F.col("items"), i)["right"], F.col("beside")),
                fold(
                    F.col("path"),
                    digest(_siblings(F.col("items"), i)["left"], own(x), _siblings(F.col("items"), i)["right"]),
                ),
            )),
        )
        out = out.unionByName(runs.select(F.explode(made).alias("r")).select("r.*"))
    root = F.lit(manifest.root).cast("string")
    return out.withColumn("root", root).withColumn("verified", F.col("folded_root") == root)
