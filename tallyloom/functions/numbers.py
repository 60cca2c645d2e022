"""Numeric functions."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_number(c: Column, kind: str = "double") -> Column:
    """TO_DECIMAL / TO_FLOAT / TO_INTEGER / ToNumber: NULL when the text is no number."""
    return F.trim(c.cast("string")).try_cast(kind)


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; NULL for a zero divisor."""
    return a % F.nullif(b, F.lit(0))


def pmod(a: Column, b: Column) -> Column:
    """Remainder that is never negative for a positive divisor."""
    return F.pmod(a, F.nullif(b, F.lit(0)))


def round_(c: Column, places: int = 0) -> Column:
    """Half away from zero."""
    return F.round(c, places)


def truncate(c: Column, places: int = 0) -> Column:
    """Toward zero."""
    scale = 10**places
    return F.signum(c) * F.floor(F.abs(c) * scale) / scale


def int_(c: Column) -> Column:
    """Largest whole number not above the value."""
    return F.floor(c)


def sqr(c: Column) -> Column:
    """Square root; NULL for a negative value."""
    return F.when(c >= 0, F.sqrt(c))


def exp(c: Column) -> Column:
    return F.exp(c)


def log(c: Column) -> Column:
    """Natural logarithm; NULL for zero and below."""
    return F.when(c > 0, F.ln(c))


def minimum(*cols: Column) -> Column:
    return F.least(*cols)


def maximum(*cols: Column) -> Column:
    return F.greatest(*cols)


def percentage(x: Column, y: Column) -> Column:
    """``x % y`` of the report dialect: x * 100 / y; NULL for a zero divisor."""
    return x * 100 / F.nullif(y, F.lit(0))


def average_of(*cols: Column) -> Column:
    """Mean of the columns that are not NULL."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(n > 0, total / n)


# fixed value: what counts as a number in running text
NUMBER_PATTERN = r"\(?-?[$€£]?\s?\d[\d,]*(?:\.\d+)?\)?"


@F.pandas_udf(T.StringType())
def _six_decimals(value: pd.Series) -> pd.Series:
    """``%.6f`` of the exact binary value: the JVM fills up with zeros behind the 17th digit and rounds the short form."""
    return value.map(lambda v: None if v is None or v != v else f"{v:.6f}")


def canonical_number(c: Column) -> Column:
    """``$ 1,234.50`` -> 1234.5, ``(42.00)`` -> -42, ``007`` -> 7; NULL when the text is no number."""
    s = F.trim(c)
    wrapped = s.startswith("(") & s.endswith(")")
    bare = F.regexp_replace(F.regexp_replace(s, r"^[()]+|[()]+$", ""), r"[,$€£ ]", "")
    negative = wrapped | bare.startswith("-")
    digits = F.regexp_replace(bare, "^-", "")
    value = F.when(digits.rlike(r"^\d+(?:\.\d+)?$"), digits.try_cast("double"))
    shown = _six_decimals(F.when(negative, -value).otherwise(value))
    short = F.regexp_replace(F.regexp_replace(shown, r"0+$", ""), r"\.$", "")
    return F.when(value.isNotNull(), F.when(short == "", "0").otherwise(short))


def decode_boolean(c: Column) -> Column:
    """``true`` and ``1`` are true, any other text is false."""
    return F.lower(F.trim(c)).isin("true", "1")


def format_pattern(c: Column, pattern: str) -> Column:
    """Number pattern such as ``$#,##0.00``: literal prefix and suffix, grouping, fixed decimals."""
    m = re.fullmatch(r"([^#0]*)([#0,]*)(?:\.([0#]+))?([^#0]*)", pattern)
    if not m:
        raise ValueError(f"unsupported number pattern {pattern!r}")
    prefix, whole, decimals, suffix = m.group(1), m.group(2), len(m.group(3) or ""), m.group(4)
    if "," in whole:
        shown = F.format_number(F.abs(c), decimals)
    else:
        shown = F.format_string(f"%.{decimals}f", F.abs(c).cast("double"))
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit(prefix), shown, F.lit(suffix))


# ---------------------------------------------------------------- seeded random values


def hashed(seed: int, *ids: Column) -> Column:
    """Non-negative pseudo-random long of a row id; the same id always gives the same value."""
    return F.shiftrightunsigned(F.xxhash64(*ids, F.lit(seed)), 1)


def random_int(low: int, high: int, seed: int, *ids: Column) -> Column:
    """Whole number in [low, high]."""
    return F.lit(low) + F.pmod(hashed(seed, *ids), F.lit(high - low + 1))


def random_unit(seed: int, *ids: Column) -> Column:
    """Double in [0, 1)."""
    return F.pmod(hashed(seed, *ids), F.lit(1 << 53)) / F.lit(float(1 << 53))


def random_text(length: int, seed: int, *ids: Column) -> Column:
    """Letters and digits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    return F.concat(
        *[F.substring(alphabet, (random_int(1, 62, seed + i, *ids)).cast("int"), F.lit(1)) for i in range(length)]
    )


def random_pick(words, seed: int, *ids: Column) -> Column:
    """One of the given words, e.g. first names or cities."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), random_int(1, len(words), seed, *ids).cast("int"))


def random_date(low: str, high: str, seed: int, *ids: Column) -> Column:
    """Date in [low, high]."""
    days = F.datediff(F.lit(high).cast("date"), F.lit(low).cast("date"))
    return F.date_add(F.lit(low).cast("date"), F.pmod(hashed(seed, *ids), days + 1).cast("int"))


def address_number(c: Column) -> Column:
    """A dotted IPv4 address as a number, so that address ranges are number ranges; NULL for anything else."""
    parts = F.split(F.trim(c), r"\.")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("long")
    valid = F.trim(c).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(parts, lambda x: x.try_cast("int") <= 255)
    return F.when(valid, ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3))
