"""Language identification with interpolated Kneser-Ney character models.

One character model per language is fitted on a bounded sample of labelled texts
(``sample_chars`` characters a language, the documented bound). N-gram
probabilities of ``BLOCK`` languages stand side by side in sorted hash arrays; a text
gets the language of lowest cross-entropy per character. There may be any number of
languages: each block of them is one broadcast of bounded size and one pass over the
texts, and the passes are put together by row.

An answer is rejected if its cross-entropy lies far above the usual of its language:
beyond ``FOREIGN_SHARE`` of the way to what texts of other languages have under the same
model, and ``DEVIATIONS`` standard deviations of a text of that length further. So texts
with foreign passages stay, and texts mostly in no learned language go. Centre and
variances come from medians, so that single mislabelled texts do not move them, and all
figures of a language are drawn towards those of all languages by the number of texts
that it calibrates on; a language without any has theirs alone.

Texts are read as lower-case letters; every run of other characters is one
space. Defined results: null text or no letter gives ``und`` with score 0 and
is rejected; an empty training table makes every answer ``und`` and rejects only
texts without letters, and so does rejection if no language has two texts to
calibrate on; ties go to the smallest language; repeated rows
are judged each on its own; texts of any length are scored whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstate.llm.common import code_points, slices, small_batches, staged, work_path

UNKNOWN = "und"
SPACE, EDGE = 32, 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = 0x40000  # no letters beyond
# scoring holds some 200 bytes a character, so texts are scored in pieces of this many
PIECE = 200_000
# a language with more characters than the sample may hold gives this many texts at least
LEAST_TEXTS = 8
# languages of one broadcast: at a million characters each, some 100 MB
BLOCK = 8
FOREIGN_SHARE, DEVIATIONS = 0.75, 6.0
# tables of one row a language are broadcast up to this many rows, some 10 MB, else joined by a shuffle
MOST_BROADCAST = 100_000
# bits a character by which other languages lie higher, for want of other texts
USUAL_GAP = 2.0
# a language's variances weigh as much as those of all languages from this many texts on
PRIOR_TEXTS = 8
_LAST = (1 << 63) - 1


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Code point to its lower-case letter, else a space; NUL marks the edge of a text."""
    table = np.full(_PLAIN + 1, SPACE, dtype=np.uint32)
    for c in range(_PLAIN):
        char = chr(c)
        if char.isalpha():
            low = char.lower()
            table[c] = ord(low) if len(low) == 1 else c
    table[0] = EDGE
    return table


def _letters(column: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised characters with ``pad`` edges before each text, row bounds, letters per row."""
    edge = "\0" * pad
    padded = pa.array([edge + t.replace("\0", " ") if t else edge for t in column.to_pylist()])
    points, bounds = code_points(padded)
    chars = _letter_table()[np.minimum(points, _PLAIN)]
    keep = np.ones(len(chars), dtype=bool)
    keep[1:] = (chars[1:] != SPACE) | (chars[:-1] != SPACE)
    place = np.concatenate(([0], np.cumsum(keep)))
    chars, bounds = chars[keep], place[bounds]
    letter = np.concatenate(([0], np.cumsum((chars != SPACE) & (chars != EDGE))))
    return chars, bounds, letter[bounds[1:]] - letter[bounds[:-1]]


def _gram_keys(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """``keys[k][i]``: hash of the k+1 characters that end at position i."""
    with np.errstate(over="ignore"):
        keys = [chars.astype(np.uint64) + np.uint64(1)]
        for _ in range(1, order):
            longer = keys[0].copy()
            longer[1:] += keys[-1][:-1] * _STEP
            keys.append(longer)
    return keys


def _key(gram: str) -> int:
    value = 0
    for c in gram:
        value = (value * int(_STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return value


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of ``keys`` in the sorted ``table``; -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    at[table[at] != keys] = -1
    return at


@dataclass
class LanguageModel:
    """Sorted hash arrays: ``prob[k]`` of (k+1)-grams, ``left[k]`` back-off of (k+1)-character contexts."""

    languages: list[str]
    order: int
    keys: list[np.ndarray]
    prob: list[np.ndarray]
    contexts: list[np.ndarray]
    left: list[np.ndarray]
    unseen: np.ndarray

    def log2(self, keys: list[np.ndarray], at: np.ndarray, k: int) -> np.ndarray:
        """Probabilities of the (k+1)-grams that end at positions ``at``, per language."""
        if k < 0:
            return np.repeat(self.unseen[None, :], len(at), axis=0)
        found = _find(self.keys[k], keys[k][at])
        out = self.prob[k][found]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            value = self.log2(keys, at[missing], k - 1)
            if k:
                context = _find(self.contexts[k - 1], keys[k - 1][at[missing] - 1])
                value = value * np.where(context[:, None] < 0, 1, self.left[k - 1][context])
            out[missing] = value
        return out

    def cross_entropy(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per character of each row and language, scored characters, letters.

        Long texts are scored in pieces, each from a fresh context, and added up.
        """
        rows = column.to_pylist()
        pieces = [t[lo : lo + PIECE] for t in rows for lo in range(0, max(len(t or ""), 1), PIECE) if t] or [""]
        owner = np.array([i for i, t in enumerate(rows) for _ in range(0, len(t or ""), PIECE)] or [0])
        total, n, letters = np.zeros((len(rows), len(self.languages))), np.zeros(len(rows), int), np.zeros(len(rows), int)
        sizes = np.cumsum([len(p) for p in pieces]) // PIECE
        for group in np.split(np.arange(len(pieces)), np.flatnonzero(np.diff(sizes)) + 1):
            bits, count, found = self._bits(pa.array([pieces[i] for i in group], pa.string()))
            np.add.at(total, owner[group], bits)
            np.add.at(n, owner[group], count)
            np.add.at(letters, owner[group], found)
        return total / np.maximum(n, 1)[:, None], n, letters

    def _bits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each row in each language, scored characters, letters."""
        pad = self.order - 1
        chars, bounds, letters = _letters(column, pad)
        keys = _gram_keys(chars, self.order)
        starts, ends = bounds[:-1] + pad, bounds[1:]
        real = np.ones(len(chars), dtype=bool)
        real[np.minimum((bounds[:-1, None] + np.arange(pad)).ravel(), max(len(chars) - 1, 0))] = False
        at = np.flatnonzero(real)
        bits = -np.log2(np.maximum(self.log2(keys, at, self.order - 1), 1e-12))
        upto = np.concatenate((np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)))
        n = ends - starts
        first = np.concatenate(([0], np.cumsum(n)))
        return upto[first[1:]] - upto[first[:-1]], n, letters


@dataclass
class Languages:
    """Broadcast models of blocks of languages, and what turns their bits into answers."""

    names: list[list[str]]
    blocks: list[Broadcast]
    sharpness: float
    # per language: usual cross-entropy, how much higher other languages lie, variance, variance per 1/length
    usual: np.ndarray

    @property
    def languages(self) -> list[str]:
        return [lang for block in self.names for lang in block]


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by[lang].append(text)
            for lang, rows in by.items():
                chars, _, _ = _letters(pa.array(rows, pa.string()), order - 1)
                text = chars.tobytes().decode("utf-32-le", "surrogatepass")
                grams = Counter(text[i : i + order] for i in range(len(text) - order + 1))
                grams = [(g, c) for g, c in grams.items() if g[-1] != "\1"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()),
                     pa.array([[ord(x) for x in g] for g, _ in grams], pa.list_(pa.int32())),
                     pa.array([c for _, c in grams], pa.int64())],
                    names=["lang", "gram", "n"],
                )
    return run


def _discount(counts) -> float:
    seen = Counter(counts)
    return seen[1] / (seen[1] + 2 * seen[2]) if seen[1] and seen[2] else 0.5


def _kneser_ney(grams: dict[str, int], order: int) -> tuple[list[dict], list[dict], float]:
    """Interpolated probabilities by length, back-off weights by context length, floor."""
    levels = [Counter() for _ in range(order)]
    levels[order - 1].update(grams)
    for k in range(order - 1, 0, -1):  # continuation counts: distinct left neighbours
        for g in levels[k]:
            levels[k - 1][g[1:]] += 1
    types = len(levels[0])
    total, cut = sum(levels[0].values()), _discount(levels[0].values())
    floor = cut * types / total / (types + 1)
    prob = [{g: max(c - cut, 0) / total + floor for g, c in levels[0].items()}]
    left = []
    for k in range(1, order):
        cut = _discount(levels[k].values())
        sums, kinds = Counter(), Counter()
        for g, c in levels[k].items():
            sums[g[:-1]] += c
            kinds[g[:-1]] += 1
        weight = {h: cut * kinds[h] / sums[h] for h in sums}
        lower = prob[-1]
        prob.append({
            g: max(c - cut, 0) / sums[g[:-1]] + weight[g[:-1]] * lower[g[1:]]
            for g, c in levels[k].items()
        })
        left.append(weight)
    return prob, left, floor


def _build(rows, order: int) -> LanguageModel:
    by: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, gram, n in rows:
        by[lang]["".join(map(chr, gram))] = n
    languages = sorted(by)
    fitted = {l: _kneser_ney(by[l], order) for l in languages}
    unseen = np.array([fitted[l][2] for l in languages], dtype=np.float64)

    model = LanguageModel(languages, order, [], [], [], [], unseen)
    for k in range(order - 1):
        known = sorted({h for l in languages for h in fitted[l][1][k]}, key=_key)
        model.contexts.append(np.array([_key(h) for h in known], dtype=np.uint64))
        model.left.append(np.array(
            [[fitted[l][1][k].get(h, 1.0) for l in languages] for h in known], dtype=np.float32
        ).reshape(len(known), len(languages)))
    for k in range(order):  # every gram of any language, with its full value in each
        known = sorted({g for l in languages for g in fitted[l][0][k]}, key=_key)
        table = np.zeros((len(known), len(languages)), dtype=np.float32)
        for j, l in enumerate(languages):
            prob, left, floor = fitted[l]
            for i, g in enumerate(known):
                weight, value = 1.0, None
                for d in range(k, -1, -1):
                    tail = g[k - d :]
                    value = prob[d].get(tail)
                    if value is not None:
                        break
                    if d:
                        weight *= left[d - 1].get(tail[:-1], 1.0)
                table[i, j] = weight * (floor if value is None else value)
        model.keys.append(np.array([_key(g) for g in known], dtype=np.uint64))
        model.prob.append(table)
    return model


def _measure(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits, n, letters = model.value.cross_entropy(batch.column("text"))
            place = {l: j for j, l in enumerate(model.value.languages)}
            of = [place.get(l) for l in batch.column("lang").to_pylist()]  # null: a language of another block
            use = pa.array(letters > 0)
            yield pa.RecordBatch.from_arrays(
                [c.filter(use) for c in (
                    batch.column("lang"), batch.column("h"), pa.array(of, pa.int32()),
                    pa.array(list(bits), pa.list_(pa.float64())),
                    pa.array([None if j is None else b[j] for j, b in zip(of, bits)], pa.float64()),
                    pa.array(np.maximum(n, 1), pa.int64()),
                )],
                names=["lang", "h", "place", "bits", "own", "n"],
            )

    return run


def _spread(texts: pd.DataFrame) -> pd.DataFrame:
    """Texts, centre, variance and variance per 1/length of one language's cross-entropies."""
    texts = texts.sort_values(["n", "own"])
    h, n = texts["own"].to_numpy(), texts["n"].to_numpy(dtype=np.float64)
    by = np.argsort(h, kind="stable")
    upto = np.cumsum(n[by])
    centre = h[by][np.searchsorted(upto, upto[-1] / 2)]
    half = len(h) // 2
    # a normal deviation is 1.4826 median ones; short and long texts tell the two variances apart
    short, long = ((1.4826 * np.median(np.abs(h[part] - centre))) ** 2 if len(h[part]) else 0.0
                   for part in (slice(0, half), slice(half, None)))
    x_short, x_long = (np.median(1 / n[part]) if len(n[part]) else 0.0 for part in (slice(0, half), slice(half, None)))
    per = max((short - long) / (x_short - x_long), 0.0) if x_short > x_long else 0.0
    return pd.DataFrame({
        "lang": [texts["lang"].iloc[0]], "k": [len(h)], "centre": [centre],
        "a": [max(long - per * x_long, 0.0)], "b": [per],
    })


def _usual(languages: list[str], spreads, foreign) -> np.ndarray:
    """Centre, gap, variance and variance per 1/length of each language, drawn towards all languages'.

    ``foreign``: language number, texts of other languages, their mean cross-entropy.
    """
    k, centre, a, b, texts, other = (np.zeros(len(languages)) for _ in range(6))
    at = {l: j for j, l in enumerate(languages)}
    for r in spreads:
        j = at[r["lang"]]
        k[j], centre[j], a[j], b[j] = r["k"], r["centre"], r["a"], r["b"]
    for j, count, bits in foreign:
        texts[j], other[j] = count, bits
    free = np.maximum(k - 1, 0)
    if not free.sum():
        return np.stack([centre, np.full(len(k), USUAL_GAP), np.full(len(k), np.inf), np.zeros(len(k))], 1)
    all_a, all_b = max(np.average(a, weights=free), 1e-4), max(np.average(b, weights=free), 1e-4)
    mean = centre[k > 0].mean()
    between = max(centre[k > 0].var(), 1.0)
    a, b = ((free * own + PRIOR_TEXTS * every) / (free + PRIOR_TEXTS) for own, every in ((a, all_a), (b, all_b)))
    trust = k / (k + all_a / between)
    centre = trust * centre + (1 - trust) * mean
    gap = (texts * np.maximum(other - centre, 0) + PRIOR_TEXTS * USUAL_GAP) / (texts + PRIOR_TEXTS)
    return np.stack([centre, gap, np.maximum(a, 1e-4) + (1 - trust) * between, np.maximum(b, 1e-4)], 1)


def _calibrate(tests: DataFrame, names: list[list[str]], blocks: list[Broadcast]) -> tuple[float, np.ndarray]:
    """Score sharpness and usual cross-entropies from texts (lang, h, text) that were not counted."""
    firsts = np.cumsum([0, *map(len, names)])
    parts = staged(reduce(DataFrame.unionByName, [
        tests.select("lang", "h", "text").mapInArrow(
            _measure(block), "lang string, h long, place int, bits array<double>, own double, n long"
        ).withColumn("first", F.lit(int(first)))
        for block, first in zip(blocks, firsts)
    ]), "calibration")
    scored = parts.groupBy("lang", "h").agg(
        F.array_sort(F.flatten(F.collect_list("bits"))).alias("bits"), F.max("own").alias("own"),
        F.max("n").cast("double").alias("n"),
    )
    foreign = (
        parts.select("first", "place", F.posexplode("bits").alias("pos", "bit"))
        .where("place is null or place <> pos")
        .groupBy((F.col("first") + F.col("pos")).alias("j")).agg(F.count("*"), F.avg("bit")).collect()
    )
    gap = F.transform("bits", lambda x: F.col("n") * (x - F.col("bits")[0]))
    grid = [2.0**e for e in range(-10, 1)]

    def loss_at(s: float) -> Column:
        others = F.aggregate("gap", F.lit(0.0), lambda total, g: total + F.exp(-s * g))
        return F.avg(s * F.col("n") * (F.col("own") - F.col("bits")[0]) + F.log(others))

    loss = scored.withColumn("gap", gap).agg(*[loss_at(s).alias(f"s{i}") for i, s in enumerate(grid)]).first()
    sharpness = 0.02 if loss[0] is None else grid[int(np.argmin(np.round(list(loss), 6)))]
    spreads = scored.select("lang", "own", "n").groupBy("lang").applyInPandas(
        _spread, "lang string, k long, centre double, a double, b double"
    )
    return sharpness, _usual([lang for own in names for lang in own], spreads.collect(), foreign)


def _per_language(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= MOST_BROADCAST else df


def _draw(rows: DataFrame, sample_chars: int) -> list[tuple[str, int, int, int]]:
    """Language, last hash drawn, most characters of a text and first hash, from ``rows`` (lang, h, n).

    Distinct hashes are taken in order up to the bound. Sums by eighths of a power of
    two of the hash show where it is met; only the texts of that eighth are looked at one by one.
    """
    level = F.floor(F.log2(F.col("h").cast("double") + 1) * 8)
    texts = staged(
        rows.groupBy("lang", "h").agg(F.max("n").cast("long").alias("n")).withColumn("level", level), "drawn"
    )
    share = max(sample_chars // LEAST_TEXTS, 1)
    by = defaultdict(list)
    sums = texts.groupBy("lang", "level").agg(
        F.count("*").alias("texts"), F.sum("n").alias("n"), F.sum(F.least("n", F.lit(share))).alias("short"),
        F.min("h").alias("first"),
    )
    for r in sums.collect():
        by[r["lang"]].append(r)
    drawn, open_ = {}, {}
    for lang, levels in sorted(by.items()):
        levels.sort(key=lambda r: r["first"])
        count, first = sum(r["texts"] for r in levels), levels[0]["first"]
        drawn[lang] = (_LAST, sample_chars, first)
        if sum(r["n"] for r in levels) <= sample_chars:
            continue
        drawn[lang] = (_LAST, share if count > LEAST_TEXTS else max(sample_chars // count, 1), first)
        left = sample_chars
        for r in levels if count > LEAST_TEXTS else []:
            if r["short"] > left:
                open_[lang] = (r["level"], left)
                break
            left -= r["short"]
    if open_:
        near = _per_language(
            texts.sparkSession, [(lang, at) for lang, (at, _) in open_.items()], "lang string, level long"
        )
        members = defaultdict(list)
        for r in texts.join(near, ["lang", "level"], "left_semi").select("lang", "h", "n").collect():
            members[r["lang"]].append((r["h"], min(r["n"], share)))
        for lang, (_, left) in open_.items():
            for h, n in sorted(members[lang]):
                if n > left:
                    drawn[lang] = (h - 1, *drawn[lang][1:])
                    break
                left -= n
    return [(lang, *found) for lang, found in drawn.items()]


def train(labelled: DataFrame, *, order: int = 4, sample_chars: int = 1_000_000, block: int = BLOCK) -> Languages:
    """Fit on ``text`` and non-null ``lang`` of ``labelled``.

    Distinct texts with a letter are drawn by hash, at most ``sample_chars`` characters
    a language; where there are more, a text gives its first ``sample_chars`` /
    ``LEAST_TEXTS`` characters at most (of fewer texts: its even share). The first text
    of a language is always learned, and about a fifth of the others calibrates. The
    model of ``block`` languages is bounded by that sample and so may be broadcast; the
    driver builds one such model at a time.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", "text", F.shiftrightunsigned(F.xxhash64("text", F.lit(10)), 1).alias("h")
    )
    drawn = _draw(rows.select("lang", "h", F.length("text").alias("n")), sample_chars)
    if not drawn:
        return Languages([], [], 0.02, np.zeros((0, 4)))
    limits = _per_language(
        spark, [(lang, i // block, *found) for i, (lang, *found) in enumerate(sorted(drawn))],
        "lang string, block long, last long, cut long, first long",
    )
    part = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(5))
    # a cut text begins at its first letter
    text = F.when(F.length("text") > F.col("cut"), F.regexp_replace("text", r"^\P{L}+", "")).otherwise(F.col("text"))
    # copies of a text are one; what is read again below is bounded
    path = work_path(spark, "languages")
    (
        rows.join(limits, "lang").where("h <= last")
        .select("lang", "h", text.substr(F.lit(1), F.col("cut").cast("int")).alias("text"),
                ((part == 0) & (F.col("h") != F.col("first"))).alias("tests"), "block")
        .dropDuplicates(["lang", "h"])
        .repartition("block", F.pmod("h", F.lit(16)))
        .write.partitionBy("block").parquet(path)
    )
    sample = spark.read.schema("lang string, h long, text string, tests boolean, block long").parquet(path)
    names, blocks = [], []
    for i in range(-(-len(drawn) // block)):
        grams = (
            sample.where((F.col("block") == i) & ~F.col("tests"))
            .select("lang", "text")
            .mapInArrow(_count(order), "lang string, gram array<int>, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        )
        model = _build(grams.collect(), order)
        names.append(model.languages)
        blocks.append(spark.sparkContext.broadcast(model))
    return Languages(names, blocks, *_calibrate(sample.where("tests"), names, blocks))


_FOUND = "_low double, _block int, _lang string, _rejected boolean, _letters boolean, _total double, _n long"


def _judge(model: Languages, block: int | None, keep: int):
    """What one block of languages says of each text, behind its first ``keep`` columns."""
    held = None if block is None else model.blocks[block]
    sharpness = model.sharpness
    own = [] if block is None else model.names[block]
    first = sum(map(len, model.names[: block or 0]))
    usual = model.usual[first : first + len(own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            rows, text = batch.num_rows, batch.column("_text")
            if held is None:
                low, total, n = np.zeros(rows), np.full(rows, np.inf), np.zeros(rows, int)
                letters, names, far = _letters(text, 1)[2] > 0, [UNKNOWN] * rows, np.zeros(rows)
            else:
                bits, n, count = held.value.cross_entropy(text)
                letters, best = count > 0, bits.argmin(axis=1)
                low = bits[np.arange(rows), best]
                total = np.exp(-sharpness * n[:, None] * (bits - low[:, None])).sum(axis=1)
                centre, gap, a, b = usual[best].T
                far = (low - centre - FOREIGN_SHARE * gap) / np.sqrt(a + b / np.maximum(n, 1))
                names = [own[j] for j in best]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:keep], pa.array(low, pa.float64()), pa.array([block or 0] * rows, pa.int32()),
                 pa.array(names, pa.string()), pa.array(~letters | (far > DEVIATIONS), pa.bool_()),
                 pa.array(letters, pa.bool_()), pa.array(total, pa.float64()), pa.array(n, pa.int64())],
                names=[*batch.schema.names[:keep],
                       "_low", "_block", "_lang", "_rejected", "_letters", "_total", "_n"],
            )

    return run


def identify(docs: DataFrame, model: Languages, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` plus lang_pred, score, cross_entropy and rejected."""
    small_batches(docs.sparkSession)
    own = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    named = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    kept = [f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    if len(model.blocks) <= 1:
        judged = docs.select(*own, F.col("text").alias("_text")).mapInArrow(
            _judge(model, 0 if model.blocks else None, len(keep)), ", ".join([*kept, _FOUND])
        )
        total = F.col("_total")
    else:
        # one pass a block, each in tasks of its own; row numbers are drawn once and written
        rows = staged(docs.select(
            *own, F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_row")
        ), "judged")
        passes = [
            rows.select("_row", "_text").mapInArrow(_judge(model, b, 1), "_row long, " + _FOUND)
            for b in range(len(model.blocks))
        ]
        found = F.array_sort(F.collect_list(F.struct(*[c.split()[0] for c in _FOUND.split(", ")])))
        together = reduce(DataFrame.unionByName, passes).groupBy("_row").agg(found.alias("_found"))
        judged = (
            rows.drop("_text").join(together, "_row")
            .withColumn("_best", F.col("_found")[0]).select("*", "_best.*")
        )
        total = F.aggregate(
            "_found", F.lit(0.0),
            lambda sum_, f: sum_ + f["_total"] * F.exp(
                -model.sharpness * F.col("_n") * (f["_low"] - F.col("_low"))
            ),
        )
    return judged.select(
        *named, F.when(F.col("_letters"), F.col("_lang")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("_letters"), 1 / total).otherwise(F.lit(0.0)).alias("score"),
        F.col("_low").alias("cross_entropy"), F.col("_rejected").alias("rejected"),
    )
