"""Conditional and NULL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.core import is_true


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def iif(condition: Column, yes, no=None, kind: str | None = None) -> Column:
    """IIF / If-Then-Else. Without an else branch the result is '' for text (``kind="string"``) or 0 for numbers."""
    if no is None and kind is not None:
        no = "" if kind == "string" else 0
    out = F.when(is_true(condition), _lit(yes))
    return out if no is None else out.otherwise(_lit(no))


def is_null(c: Column, blank: bool = False) -> Column:
    """NULL test; ``blank`` also counts empty text."""
    return c.isNull() | (F.trim(c.cast("string")) == "") if blank else c.isNull()


def decode(value: Column, *pairs) -> Column:
    """DECODE(x, v1, r1, .., default): NULL equals NULL."""
    default = pairs[-1] if len(pairs) % 2 else None
    out = None
    for v, r in zip(pairs[0 : len(pairs) - len(pairs) % 2 : 2], pairs[1::2], strict=True):
        test = value.eqNullSafe(_lit(v))
        out = F.when(test, _lit(r)) if out is None else out.when(test, _lit(r))
    return out if default is None else out.otherwise(_lit(default))


def switch(*pairs) -> Column:
    """Switch(c1, v1, c2, v2, ..): NULL when nothing matches."""
    if len(pairs) < 2 or len(pairs) % 2:
        raise ValueError("switch needs condition/value pairs")
    out = None
    for c, v in zip(pairs[::2], pairs[1::2], strict=True):
        out = F.when(is_true(c), _lit(v)) if out is None else out.when(is_true(c), _lit(v))
    return out


def compare(left: Column, op: str, right) -> Column:
    right = _lit(right)
    return {
        "=": left == right, "<>": left != right, "<": left < right,
        ">": left > right, "<=": left <= right, ">=": left >= right,
    }[op]
