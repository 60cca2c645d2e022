"""Sorting, set operations and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import join_back, names, order_columns, sort_keys
from tallyloom.operators.ordered import _order_struct


def _sort_column(df: DataFrame, column: str, desc: bool, kind: str | None, case_sensitive: bool) -> Column:
    c = F.col(column)
    if kind == "num":
        c = c.try_cast("double")
    elif kind == "date":
        c = c.try_cast("timestamp")
    elif isinstance(df.schema[column].dataType, T.StringType) or kind == "alpha":
        c = c.cast("string") if case_sensitive else F.lower(c.cast("string"))
    return c.desc_nulls_last() if desc else c.asc_nulls_first()


def _tie_break(df: DataFrame) -> list[Column]:
    # maps and variants cannot be hashed, wherever they are nested
    plain = [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return [F.xxhash64(*plain)] if plain else []


def sort_rows(df: DataFrame, keys: Sequence[tuple], case_sensitive: bool = False) -> DataFrame:
    """Sort by ``(column, "asc"|"desc"[, "alpha"|"num"|"date"])``; text ignores case unless told otherwise.

    Rows that tie are told apart by a hash, so that a key value many rows share is still sorted by many tasks.
    """
    sorts = [_sort_column(df, k[0], k[1] == "desc", k[2] if len(k) > 2 else None, case_sensitive) for k in keys]
    return df.orderBy(*sorts, *_tie_break(df))


def report_order(df: DataFrame, groups: Sequence[tuple[str, bool]], record_sorts: Sequence[tuple[str, bool]] = (),
                 first: Sequence[str] = ()) -> DataFrame:
    """Group keys with their direction, then record sorts that are not group keys; ``first`` goes before both."""
    grouped = {c for c, _ in groups}
    tail = [(c, d) for c, d in record_sorts if c not in grouped]
    return df.orderBy(*order_columns([*[(c, False) for c in first], *groups, *tail]), *_tie_break(df))


def sort_distinct(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorter with the distinct option: whole duplicate rows go, then sort."""
    return df.distinct().orderBy(*keys)


class LayoutMismatch(ValueError):
    """Streams to be united differ in their columns."""


def unite(flows: Sequence[DataFrame], by: str = "name") -> DataFrame:
    """Append streams of the same layout, columns matched by name or by position."""
    first = flows[0]
    for other in flows[1:]:
        same = set(first.columns) == set(other.columns) if by == "name" else len(first.columns) == len(other.columns)
        if not same:
            raise LayoutMismatch(f"{first.columns} does not match {other.columns}")
    out = first
    for other in flows[1:]:
        out = out.unionByName(other) if by == "name" else out.union(other)
    return out


def union_all(*flows: DataFrame) -> DataFrame:
    return unite(flows, by="position")


def union_distinct(*flows: DataFrame) -> DataFrame:
    return unite(flows, by="position").distinct()


def unique_rows(df: DataFrame, keys, order, case_sensitive: bool = True, once_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(unique, duplicates): the first row per key along ``order``, which must be total, and the other rows.

    With ``once_only`` the duplicates flow shows each repeated key once, by its second row. First rows come from a
    map-side combined minimum, so a key that fills a third of the table costs each task one row.
    """
    by = sort_keys(order, "unique_rows")
    marks = {
        f"__k{i}": F.lower(k) if not case_sensitive and isinstance(df.schema[k].dataType, T.StringType) else F.col(k)
        for i, k in enumerate(names(keys))
    }
    src = df.withColumns({**marks, "__at": _order_struct(df, by)})
    row = F.struct(*df.columns)
    unique = src.groupBy(*marks).agg(F.min_by(row, "__at").alias("__row")).select("__row.*")
    firsts = src.groupBy(*marks).agg(F.min("__at").alias("__first"))
    later = join_back(src, firsts, list(marks)).filter(F.col("__at") > F.col("__first"))
    if once_only:
        return unique, later.groupBy(*marks).agg(F.min_by(row, "__at").alias("__row")).select("__row.*")
    return unique, later.select(*df.columns)


def _counted(df: DataFrame, out: str) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(out))


def _multiset(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    both = join_back(_counted(a, "__na"), _counted(b, "__nb"), a.columns)
    nb = F.coalesce("__nb", F.lit(0))
    n = F.col("__na") - nb if how == "minus" else F.least(F.col("__na"), nb)
    return both.select(*a.columns, n.alias("occurrences")).filter(F.col("occurrences") > 0)


def multiset_minus(a: DataFrame, b: DataFrame, counted: bool = False) -> DataFrame:
    """Rows of ``a`` with the occurrences in ``b`` taken off; ``counted`` gives one row with its count instead."""
    return _multiset(a, b, "minus") if counted else a.exceptAll(b)


def multiset_intersect(a: DataFrame, b: DataFrame, counted: bool = False) -> DataFrame:
    """Rows both have, as often as both have them."""
    return _multiset(a, b, "both") if counted else a.intersectAll(b)
