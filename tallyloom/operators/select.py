"""Projection, predicates and routing."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.core import all_of, any_of, is_true, names

# ---------------------------------------------------------------- projection


def select_columns(df: DataFrame, keep: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Column subset, order and renames."""
    rename = rename or {}
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in keep])


def convert_types(df: DataFrame, types: Mapping[str, str], on_error: str = "reject") -> tuple[DataFrame, DataFrame]:
    """Per-column conversion: (good, reject).

    A row is rejected when a column that held a value cannot be converted. Rejects keep their original columns and
    name the failing ones in ``reject_columns``. ``on_error="null"`` keeps such rows with NULL instead.
    """
    if on_error not in ("reject", "null"):
        raise ValueError("on_error must be 'reject' or 'null'")
    cast = {c: F.col(c).try_cast(t) for c, t in types.items()}
    failed = {c: F.col(c).isNotNull() & v.isNull() for c, v in cast.items()}
    bad = any_of(failed.values())
    good = df if on_error == "null" else df.filter(~bad)
    listed = F.concat_ws(",", *[F.when(f, F.lit(c)) for c, f in failed.items()])
    reject = df.filter(bad if on_error == "reject" else F.lit(False)).withColumn("reject_columns", listed)
    return good.withColumns(cast), reject


def derive(df: DataFrame, outputs: Sequence[tuple[str, str | Column]], drop: Iterable[str] = ()) -> DataFrame:
    """Output ports in order: each expression may use the ones before it (variable ports)."""
    for name, expression in outputs:
        df = df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)
    return df.drop(*drop)


# ---------------------------------------------------------------- predicates


@dataclass(frozen=True)
class Condition:
    """``function(column) op value``; an empty value means IS NULL (``==``) or IS NOT NULL (``!=``)."""

    column: str
    op: str
    value: Any = None
    function: str | None = None


def _left(condition: Condition) -> Column:
    c = F.col(condition.column)
    functions = {None: lambda x: x, "length": F.length, "lower": F.lower, "upper": F.upper, "abs": F.abs}
    if condition.function not in functions:
        raise ValueError(f"unknown condition function {condition.function!r}")
    return functions[condition.function](c)


def condition_column(condition: Condition) -> Column:
    if condition.function == "matches":
        hit = F.col(condition.column).rlike(f"^(?:{condition.value})$")
        return ~is_true(hit) if condition.op == "!=" else hit
    left = _left(condition)
    if condition.value is None or condition.value == "":
        if condition.op not in ("==", "!="):
            raise ValueError("an empty value can only be compared with == or !=")
        return left.isNull() if condition.op == "==" else left.isNotNull()
    tests = {
        "==": left == condition.value,
        "!=": left != condition.value,
        ">": left > condition.value,
        "<": left < condition.value,
        ">=": left >= condition.value,
        "<=": left <= condition.value,
    }
    if condition.op not in tests:
        raise ValueError(f"unknown operator {condition.op!r}")
    # NULL on the left is never true; left as it is, the test can be pushed into the scan
    return tests[condition.op]


def filter_condition(conditions: Sequence[Condition], logical: str = "and") -> Column:
    tests = [condition_column(c) for c in conditions]
    return all_of(tests) if logical.lower() == "and" else any_of(tests)


def filter_rows(df: DataFrame, conditions: Sequence[Condition], logical: str = "and") -> DataFrame:
    """Condition list joined by AND or OR."""
    return df.filter(filter_condition(conditions, logical))


def split_filter(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(pass, reject); a NULL condition goes to reject."""
    return df.filter(condition), df.filter(~is_true(condition))


def route(df: DataFrame, groups: Mapping[str, Column], default: str = "default") -> dict[str, DataFrame]:
    """Router: a row goes to every group whose condition holds, to ``default`` when none does."""
    flows = {name: df.filter(c) for name, c in groups.items()}
    flows[default] = df.filter(~any_of([is_true(c) for c in groups.values()]))
    return flows


def switch(df: DataFrame, expression: str | Column, cases: Mapping[Any, str], default: str = "default") -> dict[str, DataFrame]:
    """Exclusive routing by value; the first matching case takes the row."""
    value = F.expr(expression) if isinstance(expression, str) else expression
    branch = None
    for key, name in cases.items():
        test = value.eqNullSafe(F.lit(key))
        branch = F.when(test, F.lit(name)) if branch is None else branch.when(test, F.lit(name))
    branch = branch.otherwise(F.lit(default))
    return {name: df.filter(branch == name) for name in dict.fromkeys([*cases.values(), default])}


@dataclass(frozen=True)
class Clause:
    """``field op literal`` or ``field op {?param}``."""

    field: str
    op: str
    value: Any = None
    param: str | None = None


@dataclass(frozen=True)
class Parameter:
    name: str
    default: Any = None
    multi_value: bool = False
    optional: bool = False


def record_selection(
    df: DataFrame,
    clauses: Sequence[Clause],
    parameters: Sequence[Parameter] = (),
    values: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Conjunction of simple comparisons; a multi-value parameter is an IN list and allows ``=`` only.

    An optional parameter without a value drops its clause.
    """
    known, values = {p.name: p for p in parameters}, dict(values or {})
    tests = []
    for clause in clauses:
        value, many = clause.value, False
        if clause.param is not None:
            parameter = known.get(clause.param)
            if parameter is None:
                raise ValueError(f"unknown parameter {clause.param!r}")
            many = parameter.multi_value
            if many and clause.op != "=":
                raise ValueError(f"multi-value parameter {clause.param!r} allows only '='")
            value = values.get(clause.param, parameter.default)
            if value is None or value == []:
                if parameter.optional:
                    continue
                raise ValueError(f"parameter {clause.param!r} has no value")
        c = F.col(clause.field)
        if many:
            tests.append(c.isin(list(value)))
            continue
        ops = {"=": c == value, "<>": c != value, "<": c < value, ">": c > value, "<=": c <= value, ">=": c >= value}
        if clause.op not in ops:
            raise ValueError(f"unknown operator {clause.op!r}")
        tests.append(ops[clause.op])
    return df.filter(all_of(tests)) if tests else df


_PLACEHOLDER = re.compile(r"\$\{(\w+)\}")
_NUMERIC = re.compile(r"-?\d+(\.\d+)?")


def bind_params(sql: str, params: Mapping[str, Any]) -> tuple[str, dict[str, Any]]:
    """``${name}`` placeholders as Spark named parameters: (sql, args) for ``spark.sql(sql, args=args)``.

    Blank becomes NULL, numeric text stays a number, everything else is passed as a string value.
    """
    args: dict[str, Any] = {}
    for name in _PLACEHOLDER.findall(sql):
        text = str(params.get(name, "") if params.get(name) is not None else "")
        if text == "":
            args[name] = None
        elif _NUMERIC.fullmatch(text):
            args[name] = float(text) if "." in text else int(text)
        else:
            args[name] = text
    return _PLACEHOLDER.sub(r":\1", sql), args


def pick_list(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct prompt values of one column."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def static_pick_list(spark, values: Sequence[Any], column: str = "value") -> DataFrame:
    """Literal prompt values in the given order."""
    literals = F.array(*[F.lit(v) for v in values])
    return spark.range(1).select(F.posexplode(literals).alias("pos", column)).select("pos", column)


@dataclass(frozen=True)
class Case:
    """One value test: a literal, an inclusive range or an ``Is op value`` comparison."""

    value: Any = None
    low: Any = None
    high: Any = None
    op: str | None = None


def in_range(column: str | Column, low: Any, high: Any) -> Column:
    """Inclusive range test."""
    c = F.col(column) if isinstance(column, str) else column
    return c.between(low, high)


def select_case(column: str | Column, branches: Sequence[tuple[Sequence[Any], Any]], default: Any = None) -> Column:
    """Select Case: the first branch with a matching test gives the result; no match and no default is NULL."""
    c = F.col(column) if isinstance(column, str) else column

    def test(case: Any) -> Column:
        if not isinstance(case, Case):
            return c == case
        if case.op:
            v = case.value
            return {"=": c == v, "<>": c != v, "<": c < v, ">": c > v, "<=": c <= v, ">=": c >= v}[case.op]
        if case.low is not None:
            return in_range(c, case.low, case.high)
        return c == case.value

    def as_column(v: Any) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    out = None
    for tests, result in branches:
        hit = any_of([test(t) for t in tests])
        out = F.when(hit, as_column(result)) if out is None else out.when(hit, as_column(result))
    return out.otherwise(as_column(default)) if default is not None else out


def preview(df: DataFrame, n: int = 50) -> tuple[DataFrame, bool]:
    """First ``n`` rows and whether there were more."""
    more = len(df.limit(n + 1).select(F.lit(1)).collect()) > n
    return df.limit(n), more


def conditional_columns(
    df: DataFrame,
    rules: Mapping[str, Column],
    suppress: Column | None = None,
    style: Column | None = None,
) -> DataFrame:
    """Format columns driven by data.

    ``rules`` give one attribute each; a ``when`` without ``otherwise`` leaves NULL, meaning the static value stays.
    ``suppress`` is inverted into ``visible``. ``style`` takes regular, bold, italic or bolditalic and is spread over
    ``bold`` and ``italic``.
    """
    extra = dict(rules)
    if suppress is not None:
        extra["visible"] = ~is_true(suppress)
    if style is not None:
        extra["bold"] = style.isin("bold", "bolditalic")
        extra["italic"] = style.isin("italic", "bolditalic")
    return df.withColumns(extra)


def row_shading(record: str | Column, colors: Sequence[str], every: int = 1) -> Column:
    """Alternating row colour from a 1-based record number."""
    n = F.col(record) if isinstance(record, str) else record
    slot = F.pmod(F.floor((n - 1) / every), F.lit(len(colors)))
    return F.element_at(F.array(*[F.lit(c) for c in colors]), (slot + 1).cast("int"))


def color_by(flag: str | Column, color_true: str, color_false: str) -> Column:
    """Colour by a boolean field; NULL counts as false."""
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.when(is_true(c), F.lit(color_true)).otherwise(F.lit(color_false))


def show_if_data(df: DataFrame, banner: str = "no data") -> DataFrame:
    """One row: show the body when the query returned rows, the banner otherwise."""
    found = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return found.select((F.col("n") > 0).alias("show_body"), F.when(F.col("n") == 0, F.lit(banner)).alias("banner"))


def pattern_check(df: DataFrame, column: str, regex: str) -> tuple[DataFrame, DataFrame]:
    """(conforming, not conforming); the whole value must match and NULL does not conform."""
    return split_filter(df, F.col(column).rlike(f"^(?:{regex})$"))


def mask(df: DataFrame, methods: Mapping[str, str], salt: str = "") -> DataFrame:
    """Masking of sensitive columns: ``chars``, ``hash``, ``last4``, ``email``, ``null``."""

    def apply(column: str, method: str) -> Column:
        c = F.col(column).cast("string")
        if method == "chars":
            return F.mask(c)
        if method == "hash":
            return F.sha2(F.concat(F.lit(salt), c), 256)
        if method == "last4":
            return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(c) - 4, F.lit(0))), F.right(c, F.lit(4)))
        if method == "email":
            return F.regexp_replace(c, r"^(.).*(@.*)$", "$1***$2")
        if method == "null":
            return F.lit(None).cast(df.schema[column].dataType)
        raise ValueError(f"unknown masking method {method!r}")

    return df.withColumns({c: apply(c, m) for c, m in methods.items()})


def assert_rows(df: DataFrame, condition: Column, action: str = "fail", message: str = "assertion failed"):
    """Check every row. ``fail`` stops the job at the first bad row, ``drop`` removes bad rows,
    ``count`` returns (df, Observation) whose ``bad_rows`` is filled by the next action."""
    good = is_true(condition)
    if action == "fail":
        return df.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
    if action == "drop":
        return df.filter(condition)
    if action == "count":
        seen = Observation()
        return df.observe(seen, F.count_if(~good).alias("bad_rows"), F.count(F.lit(1)).alias("rows")), seen
    raise ValueError("action must be 'fail', 'drop' or 'count'")


def replicate(df: DataFrame, copies: int) -> list[DataFrame]:
    """The same flow for several consumers; a DataFrame is a plan, so nothing is copied."""
    return [df] * copies


def flow_union(flows: Mapping[str, DataFrame], tag: str = "flow") -> DataFrame:
    """Put routed flows together again, each row tagged with its flow."""
    out = None
    for name, flow in flows.items():
        tagged = flow.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("names",)]
