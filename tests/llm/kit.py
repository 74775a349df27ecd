"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

CLASHING = (
    "size shard slot row _row _at rep node cluster band x y own blocks label dim table key links "
    "leaks pii n_tokens n_words length piece lang_pred score rejected text_hash registers part frame"
).split()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    base = words(1, 120)
    near = [*base[:60], "changed", *base[61:]]
    far = [w if i % 3 else "other" for i, w in enumerate(base)]
    long = " ".join(words(2, 30_000))
    rows = [
        (0, " ".join(base)), (1, None), (2, ""), (3, " \n\t "), (4, " ".join(near)), (5, " ".join(far)),
        (6, " ".join(base).upper()), (7, long), (8, long + " tail"), (9, "x" * 50_000), (10, "one"),
        (11, "one two"), (12, "One  TWO"), (13, "é ü 你好 \U0001f600 mail a.b@c.de, +49 30 1234567"),
        (None, " ".join(base)), (None, None), (14, "one two three"), (14, "one two three"),
        (15, "a\0b nul"), (16, "123 456"), (0, " ".join(base)),
    ]
    return [(d, t, "en" if t else None, None if d == 5 else "src", len(t) if t else None) for d, t in rows]


def documents(spark, rows=None, clash: bool = True):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, DOCUMENTS)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING]) if clash else df


def empty(spark):
    return documents(spark, [])


def same(got, want) -> None:
    assert sorted(map(repr, got)) == sorted(map(repr, want))


tokenizers = pytest.importorskip("public_tokenizers", reason="public vocabulary files are not installed")
