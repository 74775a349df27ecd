"""Personal data spans with DataFrame functions only.

Regular expressions propose spans, checksums and digit counts confirm them, and
words near a span adjust its score. Offsets are code points, the end exclusive.
Spans of one kind never overlap; they are the leftmost non-overlapping matches.

Each pattern is linear on long texts: where a match may start is tied to the
start of a run, which leaves the matches of the plain pattern unchanged.

Defined results: null or empty text has no span; repeated rows are judged each;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
ADDED_LIMIT = 50  # lowest score of a span of the added kinds


@dataclass(frozen=True)
class Kind:
    """Pattern, a cheap necessary condition, a check of the match ``v``, scores, nearby words."""

    name: str
    pattern: str
    hint: str
    valid: str
    score: int
    words: str
    added: bool = False


DIGITS = "regexp_replace(v, '[^0-9]', '')"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# the digits are taken out of the match once
_LUHN = (
    "element_at(transform(array({d}), d -> aggregate(sequence(1, length(d)), 0, (a, i) -> a + "
    "element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), 1 + cast(substring(d, -i, 1) as int)) * ((i + 1) % 2) + "
    "cast(substring(d, -i, 1) as int) * (i % 2)) % 10 = 0), 1)"
).format(d=DIGITS)
# letters count 10 to 35; the country and check digits go to the end
_MOD97 = (
    "aggregate(split(concat(substring(v, 5), substring(v, 1, 4)), ''), 0, (a, c) -> "
    "case when c = '' then a when c between '0' and '9' then (a * 10 + ascii(c) - 48) % 97 "
    "else (a * 100 + ascii(c) - 55) % 97 end) = 1"
)

KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "contains(text, '@')", "true", 90, "mail|contact|correo|courriel",
    ),
    Kind(
        "ip",
        r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
        "contains(text, '.')", rf"v rlike '^{_PART}(?:[.]{_PART}){{3}}$'", 60, "ip|host|server|address|addr",
    ),
    Kind(
        "card",
        r"[0-9](?<![0-9][\x20-]?[0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
        "true", _LUHN, 80, "card|visa|mastercard|karte|carte|tarjeta|payment",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "contains(text, '+')", f"length({DIGITS}) between 8 and 15", 60, "phone|tel|call|mobile|fax|movil",
    ),
    Kind(
        "iban",
        r"[A-Z]{2}(?<![A-Za-z0-9_][A-Z]{2})[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9_])",
        "true", _MOD97, 70, "iban|account|bank|konto|compte|cuenta", True,
    ),
    Kind(
        "ssn",
        r"[0-9]{3}(?<![A-Za-z0-9_][0-9]{3})-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
        "contains(text, '-')", "v rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'",
        30, "ssn|social|security|insurance", True,
    ),
)
BASE = tuple(k.name for k in KINDS if not k.added)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _ends(sizes: str) -> str:
    """Running sums of an array of lengths, in blocks of its square root: a list of n spans costs
    n^1.5 steps, since appending copies."""
    block = f"greatest(1, cast(sqrt(size({sizes})) as int))"
    blocks = f"sequence(0, (size({sizes}) - 1) div {block})"
    part = f"slice({sizes}, cast(b * {block} + 1 as int), {block})"
    add = "(a, x) -> struct(a.at + x as at, array_append(a.out, a.at + x) as out)"
    start = "struct({} as at, cast(array() as array<bigint>) as out)"
    before = (
        f"concat(array(0L), aggregate(transform({blocks}, b -> aggregate({part}, 0L, (a, x) -> a + x)), "
        f"{start.format('0L')}, {add}, a -> a.out))"
    )
    return (
        f"element_at(transform(array({before}), before -> flatten(transform({blocks}, b -> "
        f"aggregate({part}, {start.format('get(before, cast(b as int))')}, {add}, a -> a.out)))), 1)"
    )


def _spans(kind: Kind, at: int) -> Column:
    """Confirmed spans of one kind: match i ends where the gaps and matches up to it end."""
    m, g, e = f"_match_{kind.name}", f"_gap_{kind.name}", f"_end_{kind.name}"
    near = f"(?i)(?<![a-z])(?:{kind.words})"
    floor = ADDED_LIMIT if kind.added else 0
    return F.expr(f"""
      filter(transform(sequence(1, size({m})), i -> struct(
            '{kind.name}' as kind, {at} as at,
            get({e}, i - 1) - length(get({m}, i - 1)) as start,
            get({e}, i - 1) as end,
            {kind.score} + if(right(get({g}, i - 1), {CONTEXT}) rlike {_quoted(near)}
              or left(get({g}, i), {CONTEXT}) rlike {_quoted(near)}, 20, 0) as score,
            element_at(transform(array(get({m}, i - 1)), v -> {kind.valid.replace(chr(92), chr(92) * 2)}), 1) as valid)),
        s -> s.valid and s.score >= {floor})""")


def find_spans(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, whole ``text`` (null: empty) and ``pii``: array of kind, start, end, score."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    empty = "cast(array() as array<string>)"
    df = df.select("*", *[
        F.expr(f"if({k.hint}, regexp_extract_all(text, {_quoted(k.pattern)}, 0), {empty})").alias(f"_match_{k.name}")
        for k in KINDS
    ])
    df = df.select("*", *[
        F.expr(f"if(size(_match_{k.name}) > 0, split(text, {_quoted(k.pattern)}, -1), {empty})").alias(f"_gap_{k.name}")
        for k in KINDS
    ])
    df = df.select("*", *[
        F.expr(
            f"transform(_match_{k.name}, (m, i) -> cast(length(m) + length(get(_gap_{k.name}, i)) as bigint))"
        ).alias(f"_size_{k.name}")
        for k in KINDS
    ])
    df = df.select("*", *[
        F.expr(f"if(size(_size_{k.name}) > 0, {_ends(f'_size_{k.name}')}, null)").alias(f"_end_{k.name}") for k in KINDS
    ])
    found = F.concat(*[
        F.when(F.size(f"_match_{k.name}") > 0, _spans(k, i)).otherwise(F.expr(
            "cast(array() as array<struct<kind: string, at: int, start: bigint, end: bigint, score: int, valid: boolean>>)"
        ))
        for i, k in enumerate(KINDS)
    ])
    return df.select(*keep, "text", found.alias("_found")).select(
        *keep, "text",
        F.expr("transform(_found, s -> struct(s.kind, s.start, s.end, s.score))").alias("pii"),
    )


def span_digest(found: DataFrame) -> DataFrame:
    """Per row of ``find_spans``: counts, digest of the base spans, and all spans as text."""
    base = ", ".join(f"'{k}'" for k in BASE)
    count = lambda k: F.expr(f"cast(size(filter(pii, s -> s.kind = '{k.name}')) as long)").alias(f"n_{k.name}")
    listed = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS if not k.added],
        F.sha2(F.expr(listed.format(f"filter(pii, s -> s.kind in ({base}))")), 256).alias("base_sha256"),
        F.expr(listed.format("pii")).alias("spans"),
        *[count(k) for k in KINDS if k.added],
        F.expr("array_join(transform(pii, s -> cast(s.score as string)), ',')").alias("scores"),
    )


def masked(found: DataFrame) -> Column:
    """The text of ``find_spans`` with every span, overlapping ones joined, replaced by its kind."""
    return F.expr("""
      if(size(pii) = 0, text, aggregate(array_sort(transform(pii, s -> struct(s.start, s.end, s.kind))),
        struct(0L as pos, cast(array() as array<string>) as out),
        (a, s) -> struct(
          greatest(a.pos, s.end) as pos,
          case when s.start >= a.pos then concat(a.out, array(
              substring(text, cast(a.pos + 1 as int), cast(s.start - a.pos as int)), concat('<', upper(s.kind), '>')))
            else a.out end as out),
        a -> concat(array_join(a.out, ''), substring(text, cast(a.pos + 1 as int)))))""")
