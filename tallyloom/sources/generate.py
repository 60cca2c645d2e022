"""Deterministic synthetic rows from a schema.

A field's values come from a draw: a whole number below ``PRIME`` made of the row number by multiplications, with constants
that follow from seed and field name. It is plain integer arithmetic, so any engine can recompute it, and a row's values don't
depend on the rows around it. ``SPANS`` says what a draw becomes for each type; types that it doesn't list are text.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that synthetic text is made of.
WORDS = ["amber", "brook", "cedar", "dune", "elm", "fjord", "grove", "heath", "inlet", "juniper", "knoll", "larch", "meadow"]

#: Draws are below this prime; factors of the two steps.
PRIME, FACTORS = 2_147_483_647, (48_271, 69_621)

#: Spark type and inclusive range of each type that is a whole number underneath: numbers, seconds, or days since 1970.
SPANS = {
    "small integer": ("smallint", -9_999, 9_999),
    "integer": ("int", -50_000_000, 50_000_000),
    "bigint": ("bigint", 1, 2_000_000_000),
    "date/time": ("timestamp", 946_684_800, 1_893_455_999),
    "timestamp": ("timestamp", 946_684_800, 1_893_455_999),
    "date": ("date", 10_957, 21_914),
}
#: Range of floating-point values, and digits of a decimal that a draw fills.
REALS, DIGITS = (-1000.0, 1000.0), 9


@dataclass(frozen=True)
class Field:
    name: str
    datatype: str
    precision: int | None = None
    scale: int | None = None


def salt(name: str, seed: int) -> int:
    """The constant of a field's draws."""
    return zlib.crc32(f"{seed}/{name}".encode()) % PRIME


def draw(field: Field, seed: int, row: Column) -> Column:
    """A whole number from 0 to PRIME - 1 for one field of row number ``row``."""
    first = F.pmod(F.pmod(row.cast("long"), F.lit(PRIME)) * FACTORS[0] + salt(field.name, seed), F.lit(PRIME))
    return F.pmod(first.bitwiseXOR(F.shiftright(first, 13)) * FACTORS[1] + 1, F.lit(PRIME))


def synthetic_value(field: Field, seed: int, row: Column) -> Column:
    """A value for one field of row number ``row`` (from 0): a function of seed, field name and row alone."""
    kind, drawn = field.datatype.lower(), draw(field, seed, row)
    if kind in SPANS:
        spark_type, low, high = SPANS[kind]
        number = F.pmod(drawn, F.lit(high - low + 1)) + low
        return {"timestamp": F.timestamp_seconds, "date": lambda n: F.date_from_unix_date(n.cast("int"))}.get(spark_type, lambda n: n.cast(spark_type))(number)
    if kind == "decimal":
        precision, scale = min(field.precision or 12, 38), field.scale or 0
        units = F.pmod(drawn, F.lit(10 ** min(precision, DIGITS)))
        return (units.cast("decimal(38,0)") / F.lit(10**scale).cast("decimal(38,0)")).cast(f"decimal({precision},{scale})")
    if kind in ("double", "real"):
        return F.lit(REALS[0]) + drawn / F.lit(float(PRIME)) * F.lit(REALS[1] - REALS[0])
    text = F.concat_ws("-", F.get(F.array(*map(F.lit, WORDS)), F.pmod(drawn, F.lit(len(WORDS))).cast("int")), F.lower(F.hex(row.cast("long"))))
    return text if field.precision is None else F.left(text, F.lit(field.precision))


def generate_rows(spark: SparkSession, schema: Sequence[Field], n: int = 100, seed: int = 1) -> DataFrame:
    """``n`` rows; the same seed gives the same rows on any number of partitions."""
    return synthetic_like(spark.range(n), "id", schema, seed)


def synthetic_like(df: DataFrame, row: str, schema: Sequence[Field], seed: int = 1, keep: bool = False) -> DataFrame:
    """One synthetic row per input row, its row number taken from ``row``, which stays with ``keep``."""
    kept = [row] if keep else []
    return df.select(*kept, *[synthetic_value(f, seed, F.col(row)).alias(f.name) for f in schema])
