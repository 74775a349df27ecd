"""Window, slug, ISO-8601, list and URL columns of the market calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickstate.functions import variants as V
from tickstate.params import SLUG_PREFIX, TIMEFRAME_SECONDS

ISO = (
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?"
    r"([Zz]|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)$"
)
NAIVE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?)?$"
URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def duration(timeframe: Column) -> Column:
    out = F.lit(None).cast("bigint")
    for name, seconds in TIMEFRAME_SECONDS.items():
        out = F.when(timeframe == name, F.lit(seconds).cast("bigint")).otherwise(out)
    return out


def window_start(at: Column, timeframe: Column) -> Column:
    """The 5 or 15 minute boundary at or before ``at``."""
    epoch = F.unix_seconds(at)
    return F.timestamp_seconds(epoch - F.pmod(epoch, duration(timeframe)))


def plus_windows(start: Column, timeframe: Column, count: int = 1) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + duration(timeframe) * (count * 1_000_000))


def slug(timeframe: Column, start: Column) -> Column:
    """D2."""
    return F.concat_ws("-", F.lit(SLUG_PREFIX), timeframe, F.unix_seconds(start).cast("string"))


def iso_utc(text: Column) -> Column:
    """D3: timestamp of ISO-8601 text that carries an offset, else null."""
    clean = F.trim(text)
    offset = F.regexp_extract(clean, r"([Zz]|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)$", 1)
    local = F.regexp_replace(F.substring(clean, F.lit(1), F.length(clean) - F.length(offset)), ",", ".")
    local = F.when(local.rlike(r"[T ]\d{2}$"), F.concat(local, F.lit(":00"))).otherwise(local)
    digits = F.regexp_replace(offset, "[^0-9]", "")
    zone = F.when(offset.rlike("^[Zz]$"), F.lit("+00:00")).otherwise(
        F.concat(
            F.substring(offset, 1, 1),
            F.substring(digits, 1, 2),
            F.lit(":"),
            F.when(F.length(digits) >= 4, F.substring(digits, 3, 2)).otherwise("00"),
        )
    )
    return F.when(clean.rlike(ISO), F.concat(local, zone).try_cast("timestamp"))


def iso_reason(text: Column, value: Column, field: str) -> Column:
    """Why ``text`` has no ``iso_utc`` value; null when it has one."""
    clean = F.trim(text)
    return (
        F.when(text.isNull() | (clean == ""), f"{field}_missing")
        .when(clean.rlike(NAIVE), f"{field}_without_offset")
        .when(value.isNull(), f"{field}_not_iso")
    )


def json_list(value: Column, path: str) -> Column:
    """A list, or a string holding a JSON list, as an array of variants."""
    inner = F.try_parse_json(V.text_at(value, path))
    encoded = F.when(V.kind_of(inner).startswith("ARRAY"), V.get(inner, "$", "array<variant>"))
    return F.coalesce(V.list_at(value, path), encoded)


def source_url(text: Column) -> Column:
    """Lower-case scheme and host, no trailing slash; null with a query or fragment."""
    clean = F.trim(text)

    def part(index: int) -> Column:
        return F.regexp_extract(clean, URL, index)

    scheme, host = F.lower(part(1)), F.lower(part(2))
    path = F.regexp_replace(part(3), "/+$", "")
    plain = (part(4) == "") & (part(5) == "")
    head = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise("")
    body = F.when(host != "", F.concat(F.lit("//"), host)).otherwise("")
    return F.when(plain & (clean != ""), F.concat(head, body, path))
