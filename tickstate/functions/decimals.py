"""Strict validation of decimal text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NOT_FINITE = r"(?i)^[+-]?(inf|infinity|s?nan[0-9]*)$"
TYPE = "decimal(18,8)"


def to_decimal(text: Column, type_name: str = TYPE) -> Column:
    """Exact value of decimal text, null when it is not a number or does not fit unrounded."""
    clean = F.trim(text)
    scale = F.lit(int(type_name.rstrip(")").split(",")[1]))
    value = clean.try_cast(type_name)
    point = F.instr(clean, ".")
    plain = ~(clean.contains("e") | clean.contains("E"))
    short = (point == 0) | (F.length(clean) - point <= scale)
    # only long fractions and exponents need a closer look
    fraction = F.regexp_replace(F.regexp_extract(clean, r"^[^eE.]*\.([0-9]*)", 1), "0+$", "")
    exact = value == clean.try_cast("decimal(38,18)")
    fits = (plain & short) | (exact & (~plain | (F.length(fraction) <= scale)))
    return F.when(fits, value)


def decimal_reason(
    text: Column, positive: bool = False, type_name: str = TYPE, value: Column | None = None
) -> Column:
    """Null for an acceptable value, else the first failing rule.

    Pass ``value`` when the decimal of ``text`` is already a column.
    """
    clean = F.trim(text)
    negative = clean.startswith("-") & clean.rlike("^[^eE]*[1-9]")
    zero = ~clean.rlike("^[^eE]*[1-9]")
    value = to_decimal(text, type_name) if value is None else value
    good = value > 0 if positive else value >= 0
    reason = (
        F.when(good, F.lit(None).cast("string"))
        .when(text.isNull(), "not_decimal")
        .when(clean.rlike(NOT_FINITE), "not_finite")
        .when(~clean.rlike(NUMBER), "not_decimal")
        .when(negative, "negative")
    )
    if positive:
        reason = reason.when(zero, "not_positive")
    return reason.when(value.isNull(), "decimal_out_of_range")


def validate_decimal(df: DataFrame, column: str, positive: bool = False) -> DataFrame:
    """Add ``<column>_dec`` and ``<column>_reason``."""
    value, reason = F.col(f"{column}_dec"), F.col(f"{column}_reason")
    df = df.withColumn(f"{column}_dec", to_decimal(F.col(column)))
    df = df.withColumn(f"{column}_reason", decimal_reason(F.col(column), positive, value=value))
    return df.withColumn(f"{column}_dec", F.when(reason.isNull(), value))


def text_of(value: Column) -> Column:
    """Plain decimal text without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
