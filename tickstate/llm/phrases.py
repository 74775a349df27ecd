"""Phrase collocations by multikey quicksort of suffix pointers.

A suffix starts at every word and is read up to ``MOST_WORDS`` words or the end of
its piece. A block of texts is sorted by multikey three-way quicksort: pointers are
parted by the word at the current depth into less, equal and greater, and the
equal part goes one word deeper; at the last depth the size of an equal part is
the count of its phrase. Parts of at most ``SMALL`` pointers are finished in one
joint sort, as is usual.

Infrequent parts are abandoned after their leading words were routed globally: a
first round counts the hashes of leading pairs over all texts, and the second
round follows a suffix only where its pair may be frequent, and its third word
only where the pair behind is. What may be frequent is a bit set of fixed size
(``FILTER_BITS``), so a hash that it lets through by chance costs time only. Blocks
then send each distinct suffix once, with its count, to the task of its two
leading words (three for very frequent pairs), where the same sort runs over
suffixes with weights and leaves parts below the least count. So frequencies are
exact, and a frequent word, pair or passage costs a row per block and task, not one
per occurrence.

Text: A-Z are lower-cased, pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are
``[^\\x20\\x09]+``. Defined results: a null text is empty, a null language ``und``;
phrases do not cross pieces or rows; repeated rows and overlapping occurrences
count each time; ties are broken by the count, then by the phrase's bytes; a very
long text is one block of its own; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickstate.llm.common import mix64, slices, small_batches, staged

MOST_WORDS = 3
SMALL = 1 << 17
BLOCK_BYTES = 8_000_000
PART_BYTES = 8_000_000
HELD_ROWS = 600_000
OUT_ROWS = 50_000
FILTER_BITS = 26
LEAST_HOT, MOST_HOT = 20_000, 1_000_000
TOP_SALTS = 32

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[list(b" \t")] = 1
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a column of texts: ``ids`` into ``vocabulary`` from 1, row and piece borders.

    ``symbols`` are the ids at a pointer's word and the words behind it, 0 past the
    end of the piece. ``first`` is each row's first word.
    """

    def __init__(self, texts: pa.StringArray):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[low:high] if high > low else np.empty(0, np.uint8)
        rows = offsets.astype(np.int64) - low
        kind = _CLASS[data]
        inside = kind == 0
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        borders = rows[1:-1]
        borders = borders[(borders > 0) & (borders < len(data))]
        opens[borders] = inside[borders]
        closes[borders - 1] = inside[borders - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
        bounds = np.zeros(len(starts) + 1, dtype=np.int32)
        np.cumsum(ends - starts + 1, out=bounds[1:])
        letters = _LOWER[data[inside]]
        column = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
        coded = column.dictionary_encode()
        self.vocabulary: pa.StringArray = coded.dictionary
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
        self.first = np.searchsorted(starts, rows[:-1])
        breaks = np.zeros(len(starts) + MOST_WORDS, dtype=bool)
        breaks[np.searchsorted(starts, np.flatnonzero(kind == 2))] = True
        breaks[self.first] = True
        breaks[len(starts) :] = True
        self.breaks = breaks

    def symbols(self) -> list[np.ndarray]:
        n = len(self.ids)
        padded = np.concatenate((self.ids, np.zeros(MOST_WORDS, dtype=np.int32)))
        out, ended = [self.ids], np.zeros(n, dtype=bool)
        for k in range(1, MOST_WORDS):
            ended = ended | self.breaks[k : n + k]
            out.append(np.where(ended, 0, padded[k : n + k]).astype(np.int32))
        return out


def suffix_groups(
    symbols: list[np.ndarray], pointers: np.ndarray, weights: np.ndarray | None = None, least: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """A pointer and the weight of every distinct suffix, by multikey three-way quicksort.

    With ``least``, equal parts of two or more words below that weight are left.
    """
    whole = lambda p: len(p) if weights is None else int(weights[p].sum())
    found, sums, small, stack = [], [], [], [(pointers, 0)]
    while stack:
        part, depth = stack.pop()
        if least and depth >= 2 and whole(part) < least:
            continue
        if depth == len(symbols):
            found.append(part[:1])
            sums.append(whole(part))
            continue
        if len(part) <= SMALL:
            small.append(part)
            continue
        at = symbols[depth][part]
        pivot = np.sort(at[:: len(at) // 9])[4]
        less, more = at < pivot, at > pivot
        for side in (less, more):
            if side.any():
                stack.append((part[side], depth))
        stack.append((part[~(less | more)], depth + 1))
    rest = np.concatenate(small) if small else np.empty(0, dtype=np.int64)
    order, new = _finished(symbols, rest)
    rest, cuts = rest[order], np.flatnonzero(new)
    if len(rest):
        own = np.ones(len(rest), dtype=np.int64) if weights is None else weights[rest]
        found.append(rest[cuts])
        sums.append(np.add.reduceat(own, cuts))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate([np.atleast_1d(s) for s in sums]).astype(np.int64)


def _finished(symbols: list[np.ndarray], part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``part`` by all symbols, and where a new suffix begins in it."""
    order, new = np.arange(len(part)), np.zeros(len(part), dtype=bool)
    new[:1] = True
    for s in symbols:
        group = np.cumsum(new).astype(np.int64)
        key = (group << 32) | s[part[order]]
        again = np.argsort(key, kind="quicksort")
        order, key = order[again], key[again]
        new = np.ones(len(part), dtype=bool)
        new[1:] = key[1:] != key[:-1]
    return order, new


def pair_sums(symbols: list[np.ndarray], at: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A pointer and the weight of each distinct leading pair of the suffixes at ``at``."""
    key = (symbols[0][at].astype(np.int64) << 32) | symbols[1][at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return at[order[cuts]], np.add.reduceat(sums[order], cuts) if len(cuts) else np.empty(0, np.int64)


class Routes:
    """Where suffixes go: a mix of the leading words' hashes."""

    def __init__(self, language: str, vocabulary: pa.StringArray):
        seed = xxhash.xxh64_intdigest(language)
        self.words = np.fromiter(
            (xxhash.xxh64_intdigest(w, seed) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary)
        )

    def pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix64(self.words[first - 1] + mix64(self.words[second - 1]))

    def suffix(self, symbols: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
        """Two leading words, and the third where the pair is hot."""
        pair = self.pair(symbols[0], symbols[1])
        third = np.append(self.words, np.uint64(0))[symbols[2] - 1]
        return np.where(is_in(pair, hot), mix64(pair + third), pair).view(np.int64)


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _phrases(words: Words, symbols: list[np.ndarray]) -> pa.Array:
    taken = [words.vocabulary.take(pa.array(s - 1, mask=s == 0)) for s in symbols]
    return pc.binary_join_element_wise(*taken, " ", null_handling="skip")


def _by_language(batch: pa.RecordBatch | pa.Table, column: str) -> Iterator[tuple[str, pa.Table]]:
    """The rows of each language."""
    table = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
    langs = pc.unique(table.column("lang")).to_pylist()
    for lang in langs:
        rows = table if len(langs) == 1 else table.filter(pc.equal(table.column("lang"), lang))
        yield lang, rows.select([column, *[c for c in rows.column_names if c not in ("lang", column)]]).combine_chunks()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``BLOCK_BYTES`` of text, or one text."""
    held, size = [], 0
    for batch in slices(batches, limit=BLOCK_BYTES):
        own = batch.column("text").nbytes
        if held and size + own > BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.Table.from_batches(held)


def _out(lang: str, phrases: pa.Array, words: np.ndarray | int, counts: np.ndarray, route: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    n = len(phrases)
    words = np.full(n, words, dtype=np.int32) if isinstance(words, int) else words.astype(np.int32)
    for lo in range(0, n, OUT_ROWS):
        of = slice(lo, lo + OUT_ROWS)
        size = len(counts[of])
        columns = [pa.array([lang] * size, pa.string()), phrases[of], pa.array(words[of]), pa.array(counts[of])]
        names = ["lang", "phrase", "words", "f"]
        if route is not None:
            columns, names = [*columns, pa.array(route[of])], [*names, "route"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def may_be(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether hashes are in a bit set."""
    words = bits[(values >> np.uint64(6)).astype(np.int64) & (len(bits) - 1)]
    return (words >> (values & np.uint64(63))) & np.uint64(1) == 1


def _count_block(hot: np.ndarray, bits: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Distinct words and suffixes of a block with their counts and routes."""
    for lang, rows in _by_language(table, "text"):
        for chunk in rows.column("text").chunks:
            words = Words(chunk)
            if not len(words.ids):
                continue
            routes = Routes(lang, words.vocabulary)
            single = np.bincount(words.ids, minlength=len(words.vocabulary) + 1)[1:]
            yield from _out(lang, words.vocabulary, 1, single, mix64(routes.words).view(np.int64))
            symbols = words.symbols()
            at = np.flatnonzero(symbols[1])
            follow = np.zeros(len(words.ids) + 1, dtype=bool)
            follow[at] = may_be(routes.pair(symbols[0][at], symbols[1][at]), bits)
            symbols[2] = np.where(follow[1:], symbols[2], 0)
            at, sums = suffix_groups(symbols, np.flatnonzero(follow))
            own = [s[at] for s in symbols]
            yield from _out(lang, _phrases(words, own), 2 + (own[2] > 0), sums, routes.suffix(own, hot))


def _merge_part(lang: str, rows: pa.Table, hot: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """Frequencies of a routed part: words, pairs and suffixes of ``least`` or more.

    Row ``words = 0`` is the number of word occurrences. Hot pairs are partial sums
    and kept at any size.
    """
    is_word = pc.equal(rows.column("words"), 1)
    single = rows.filter(is_word)
    if single.num_rows:
        coded = single.column("phrase").combine_chunks().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        sums = np.zeros(len(coded.dictionary), dtype=np.int64)
        np.add.at(sums, index, single.column("f").to_numpy())
        keep = sums >= least
        yield from _out(lang, pa.array([""]), 0, np.array([sums.sum()]), None)
        yield from _out(lang, coded.dictionary.filter(pa.array(keep)), 1, sums[keep], None)
    longer = rows.filter(pc.invert(is_word))
    if not longer.num_rows:
        return
    words = Words(longer.column("phrase").combine_chunks())
    symbols, weights = words.symbols(), np.zeros(len(words.ids), dtype=np.int64)
    weights[words.first] = longer.column("f").to_numpy()
    pairs = Routes(lang, words.vocabulary)
    firsts = [s[words.first] for s in symbols]
    is_hot = is_in(pairs.pair(firsts[0], firsts[1]), hot)
    for pointers, bound in ((words.first[~is_hot], least), (words.first[is_hot], 0)):
        at, sums = suffix_groups(symbols, pointers, weights, bound)
        leading, totals = pair_sums(symbols, at, sums)
        leading, totals = leading[totals >= bound], totals[totals >= bound]
        yield from _out(lang, _phrases(words, [s[leading] for s in symbols[:2]]), 2, totals, None)
        keep = (sums >= least) & (symbols[2][at] > 0)
        yield from _out(lang, _phrases(words, [s[at[keep]] for s in symbols]), 3, sums[keep], None)


def _compacted(table: pa.Table) -> pa.Table:
    return table.group_by(["lang", "phrase", "words"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "words", "f"])


def _merged(batches: Iterator[pa.RecordBatch], hot: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """A routed partition; copies are added up whenever ``HELD_ROWS`` more rows have come."""
    held, rows, most = [], 0, HELD_ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > most:
            table = _compacted(pa.Table.from_batches(held))
            held, rows = table.to_batches(), table.num_rows
            most = rows + HELD_ROWS
    if held:
        for lang, part in _by_language(pa.Table.from_batches(held), "phrase"):
            yield from _merge_part(lang, part, hot, least)


def pair_counts(rows: DataFrame, least: int) -> DataFrame:
    """``pair, n``: the hashes of leading pairs with ``least`` or more occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            for lang, own in _by_language(table, "text"):
                for chunk in own.column("text").chunks:
                    words = Words(chunk)
                    symbols = words.symbols()
                    at = np.flatnonzero(symbols[1])
                    pairs = np.sort(Routes(lang, words.vocabulary).pair(symbols[0][at], symbols[1][at]))
                    starts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))[: len(pairs)])
                    counts = np.diff(np.append(starts, len(pairs)))
                    pairs = pairs[starts].view(np.int64)
                    for lo in range(0, len(pairs), OUT_ROWS):
                        of = slice(lo, lo + OUT_ROWS)
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[of]), pa.array(counts[of])], names=["pair", "n"])

    counted = rows.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return staged(counted.where(F.col("n") >= least), "phrase-pairs")


def bit_set(pairs: DataFrame) -> np.ndarray:
    """The hashes as a bit set of 2^FILTER_BITS bits, at most that many bits on the driver."""
    words = pairs.select(
        F.shiftright("pair", 6).bitwiseAND((1 << FILTER_BITS - 6) - 1).alias("word"),
        F.expr("shiftleft(1L, cast(pair & 63 as int))").alias("bit"),
    ).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, dtype=np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


def hot_pairs(pairs: DataFrame, size: int) -> np.ndarray:
    """Hashes of the pairs that are routed by their third word too: at most ``MOST_HOT``, as a
    text of ``size`` bytes has half as many words."""
    bound = max(LEAST_HOT, size // (2 * MOST_HOT))
    hot = pairs.where(F.col("n") >= bound).select("pair").toArrow()["pair"].to_numpy()
    return np.sort(hot.view(np.uint64))


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, words, f`` of all words and phrases with ``least`` or more occurrences.

    ``words`` is 1 to ``MOST_WORDS``; rows with 0 words have the language's number of words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    pairs = pair_counts(rows, least)
    hot, bits = spark.sparkContext.broadcast(hot_pairs(pairs, size)), spark.sparkContext.broadcast(bit_set(pairs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            yield from _count_block(hot.value, bits.value, table)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _merged(batches, hot.value, least)

    schema = "lang string, phrase string, words int, f long"
    routed = rows.mapInArrow(count, schema + ", route long").repartition(parts, "route").drop("route")
    return (
        routed.mapInArrow(merge, schema).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
        .where(F.col("f") >= F.when(F.col("words") > 0, least).otherwise(1))
    )


def collocations(docs: DataFrame, least: int = 10, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two and three words of each language.

    A phrase of frequency a that a cut parts into words of l and r occurrences
    scores floor(10^6 a a / (l r)); its lowest-scoring cut counts, the first of
    equal ones. A phrase that makes up less than twice a longer candidate that
    holds it, or exactly that, is left out.
    """
    counts = staged(phrase_counts(docs, least), "phrase-counts")
    found = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    word = lambda i: F.element_at(F.split("phrase", " "), i + 1)
    two = lambda i: F.concat_ws(" ", word(i), word(i + 1))
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    cuts = found.select(
        "lang", "phrase", "words", "a",
        F.explode(
            F.when(F.col("words") == 2, F.array(cut(1, word(0), word(1))))
            .otherwise(F.array(cut(1, word(0), two(1)), cut(2, two(0), word(2))))
        ).alias("c"),
    ).select("lang", "phrase", "words", "a", "c.*")
    side = lambda name, value: counts.where("words in (1, 2)").select(
        "lang", F.col("phrase").alias(name), F.col("f").alias(value)
    )
    exact = "cast({} as decimal(19, 0))".format
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).withColumn(
        "score", F.expr(f"(1000000 * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})")
    )
    lowest = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    held = (
        found.where("words = 3").select("lang", "a", F.explode(F.array(two(0), two(1))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    kept = lowest.join(held, ["lang", "phrase"], "left").where("longer is null or words = 3 or 100 * longer < 50 * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score").withColumn(
        "_salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS))
    )
    for by in (["lang", "_salt"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
