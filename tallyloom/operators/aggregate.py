"""Aggregation, cross-tabs, nested totals, chart series and portfolio roll-ups.

Totals attached to rows are aggregated first (map-side combined) and joined back, so a group that holds a large part
of the table never meets in one window. Nested levels are rolled up from the finest level, not from the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import any_of, is_true, join_back, names, order_columns, sort_keys
from tallyloom.operators.ordered import _order_struct, row_hash, running, sequence


@dataclass(frozen=True)
class Agg:
    """``out = fn(arg)`` with an optional row condition; ``arg`` is a column, an expression or a Column.

    Functions: sum, count, count_rows, average, minimum, maximum, first, last (both need ``order``), count_distinct
   (also spelled distinct), approx_distinct, std_dev, std_dev_pop, variance, variance_pop.
    """

    out: str
    fn: str
    arg: str | Column | None = None
    condition: str | Column | None = None
    order: object = None


_ALIAS = {
    "avg": "average", "min": "minimum", "max": "maximum", "distinct": "count_distinct", "stddev": "std_dev",
    "mean": "average",
}


def _column(value: str | Column | None) -> Column | None:
    return F.expr(value) if isinstance(value, str) else value


def agg_column(df: DataFrame, spec: Agg) -> Column:
    fn = _ALIAS.get(spec.fn.lower(), spec.fn.lower())
    arg, condition = _column(spec.arg), _column(spec.condition)
    if fn == "count_rows":
        return (F.count(F.lit(1)) if condition is None else F.count_if(F.coalesce(condition, F.lit(False)))).alias(spec.out)
    if condition is not None:
        arg = F.when(condition, arg)
    if fn in ("first", "last"):
        at = _order_struct(df, sort_keys(spec.order, fn))
        if condition is not None:
            at = F.when(condition, at)
        return (F.min_by if fn == "first" else F.max_by)(arg, at).alias(spec.out)
    simple = {
        "sum": F.sum, "count": F.count, "average": F.avg, "minimum": F.min, "maximum": F.max,
        "count_distinct": F.countDistinct, "approx_distinct": F.approx_count_distinct,
        "std_dev": F.stddev_samp, "std_dev_pop": F.stddev_pop, "variance": F.var_samp, "variance_pop": F.var_pop,
    }
    if fn == "list":
        raise ValueError("a list of unbounded length does not fit one cell; use list_values")
    if fn == "median":
        raise ValueError("an exact median needs the whole group in order; use median_values")
    if fn not in simple:
        raise ValueError(f"unknown aggregate {spec.fn!r}")
    return simple[fn](arg).alias(spec.out)


def aggregate(df: DataFrame, keys, aggs: Sequence[Agg]) -> DataFrame:
    """Group by ``keys`` (NULL is a group of its own) and aggregate; no keys gives the grand total."""
    return df.groupBy(*names(keys)).agg(*[agg_column(df, a) for a in aggs])


def grand_total(df: DataFrame, aggs: Sequence[Agg]) -> DataFrame:
    return aggregate(df, [], aggs)


def list_values(
    df: DataFrame,
    keys,
    col: str,
    out: str,
    sep: str = ",",
    distinct: bool = False,
    order=None,
    part_items: int = 100_000,
    **limits,
) -> DataFrame:
    """Values of a group as delimited text: (keys, part, out).

    Values are sorted, or follow ``order`` (total within the group). Lists longer than ``part_items`` go on in
    further parts, so no cell and no task has to hold an unbounded group; joining the parts gives the whole list.
    NULL values are left out.
    """
    keys = names(keys)
    src = df.filter(F.col(col).isNotNull())
    if distinct:
        by = [(col, False)]
        numbered = sequence(src.select(*keys, col).distinct(), "__nth", by, by=keys, **limits)
    elif order is None:
        # equal values are counted first, so sorting needs no tie break and repeats travel once
        counted = src.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("__n"))
        upto = running(counted, "sum", "__n", "__upto", col, keys, **limits)
        first_part = F.floor((F.col("__upto") - F.col("__n")) / part_items).cast("int") + 1
        last_part = F.floor((F.col("__upto") - 1) / part_items).cast("int") + 1
        spread = upto.withColumn("part", F.explode(F.sequence(first_part, last_part)))
        low = F.greatest(F.col("__upto") - F.col("__n"), (F.col("part") - 1).cast("long") * part_items)
        high = F.least(F.col("__upto"), F.col("part").cast("long") * part_items)
        piece = F.array_join(F.array_repeat(F.col(col).cast("string"), (high - low).cast("int")), sep)
        ordered = F.array_sort(F.collect_list(F.struct(F.col("__upto"), piece.alias("t"))))
        return (
            spread.groupBy(*keys, "part").agg(ordered.alias("__a"))
            .select(*keys, "part", F.array_join(F.transform("__a", lambda x: x["t"]), sep).alias(out))
        )
    else:
        numbered = sequence(src, "__nth", order, by=keys, **limits)
    part = F.floor((F.col("__nth") - 1) / part_items).cast("int") + 1
    items = F.array_sort(F.collect_list(F.struct("__nth", F.col(col).cast("string").alias("t"))))
    return (
        numbered.groupBy(*keys, part.alias("part")).agg(items.alias("__a"))
        .select(*keys, "part", F.array_join(F.transform("__a", lambda x: x["t"]), sep).alias(out))
    )


def median_values(df: DataFrame, keys, col: str, out: str = "median", **limits) -> DataFrame:
    """Exact median per group, the mean of the two middle values for an even count.

    Values are counted first and the counts run along the value order; a group is never held in one task.
    """
    keys = names(keys)
    counted = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias("__v")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    upto = running(counted, "sum", "__n", "__upto", "__v", keys, **limits)
    total = counted.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    both = join_back(upto, total, keys) if keys else upto.join(F.broadcast(total), F.lit(True), "left")
    before, low = F.col("__upto") - F.col("__n"), F.floor((F.col("__all") + 1) / 2)
    high = F.floor(F.col("__all") / 2) + 1
    middle = [F.max(F.when((before < at) & (F.col("__upto") >= at), F.col("__v"))) for at in (low, high)]
    return both.groupBy(*keys).agg(((middle[0] + middle[1]) / 2).alias(out))


def denormalize_list(df: DataFrame, keys, col: str, delim: str = ",", merge: bool = False, out: str | None = None,
                     **options) -> DataFrame:
    """Group values into delimited text; ``merge`` keeps each value once."""
    return list_values(df, keys, col, out or col, delim, merge, **options)


def denormalize_keys(df: DataFrame, keys, key_col: str, value_col: str, targets: Mapping[str, str],
                     order=None) -> DataFrame:
    """Key/value rows to named columns ``{key value: column}``; several values for one target need ``order`` (last
    wins), without it the largest is taken."""
    def pick(value: str) -> Column:
        hit = F.col(key_col) == F.lit(value)
        if order is None:
            return F.max(F.when(hit, F.col(value_col)))
        return F.max_by(F.when(hit, F.col(value_col)), F.when(hit, _order_struct(df, sort_keys(order, "denormalize_keys"))))

    return df.groupBy(*names(keys)).agg(*[pick(v).alias(c) for v, c in targets.items()])


# ---------------------------------------------------------------- report summaries


@dataclass(frozen=True)
class Summary:
    """A report summary of a field: Sum, Count, Average, Minimum, Maximum, DistinctCount, StdDev, Variance, PopStdDev or
    PopVariance."""

    out: str
    op: str
    field: str


#: Summaries that can't be put together from those of finer groups.
_WHOLE = {
    "distinctcount": F.count_distinct, "stddev": F.stddev_samp, "variance": F.var_samp, "popstddev": F.stddev_pop,
    "popvariance": F.var_pop,
}


def _by_parts(summaries: Sequence[Summary]) -> tuple[list[Summary], list[Column]]:
    """Summaries that finer totals add up to, and the others as aggregates of the rows."""
    whole = [s for s in summaries if s.op.lower() in _WHOLE]
    return [s for s in summaries if s not in whole], [_WHOLE[s.op.lower()](s.field).alias(s.out) for s in whole]


def _partials(summaries: Sequence[Summary]) -> list[Column]:
    parts = {}
    for s in summaries:
        op, v = s.op.lower(), F.col(s.field)
        if op in ("sum", "average", "avg"):
            parts[f"__sum_{s.field}"] = F.sum(v)
        if op in ("count", "average", "avg"):
            parts[f"__cnt_{s.field}"] = F.count(v)
        if op in ("minimum", "min"):
            parts[f"__min_{s.field}"] = F.min(v)
        if op in ("maximum", "max"):
            parts[f"__max_{s.field}"] = F.max(v)
        if op not in ("sum", "count", "average", "avg", "minimum", "min", "maximum", "max"):
            raise ValueError(f"unsupported summary operation {s.op!r}")
    return [c.alias(n) for n, c in parts.items()]


def _merged(s: Summary) -> Column:
    op, f = s.op.lower(), s.field
    return {
        "sum": lambda: F.sum(f"__sum_{f}"),
        "count": lambda: F.sum(f"__cnt_{f}"),
        "average": lambda: F.try_divide(F.sum(f"__sum_{f}").cast("double"), F.sum(f"__cnt_{f}")),
        "minimum": lambda: F.min(f"__min_{f}"),
        "maximum": lambda: F.max(f"__max_{f}"),
    }[_ALIAS.get(op, op)]().alias(s.out)


def group_totals(df: DataFrame, groups: Sequence[str], summaries: Sequence[Summary],
                 levels: Sequence[int] | None = None) -> DataFrame:
    """Totals of each nested group on every row as ``<out>_g1 ..`` (outermost 1); level 0 is the report total."""
    levels = list(levels if levels is not None else range(1, len(groups) + 1))
    merged, whole = _by_parts(summaries)
    finest = df.groupBy(*groups).agg(*_partials(merged)) if merged else df
    out = df
    for level in levels:
        keys = list(groups[:level])
        total = finest.groupBy(*keys).agg(*([_merged(s) for s in merged] or whole))
        if merged and whole:
            more = df.groupBy(*keys).agg(*whole)
            total = join_back(total, more, keys) if keys else total.join(F.broadcast(more), F.lit(True), "left")
        total = total.withColumnsRenamed({s.out: f"{s.out}_g{level}" for s in summaries})
        if keys:
            out = join_back(out, total, keys)
        else:
            # one row
            out = out.join(F.broadcast(total), F.lit(True), "left")
    return out


SPREAD = {
    "stddev": "std_dev", "variance": "variance", "popstddev": "std_dev_pop", "popvariance": "variance_pop",
}


def spread_columns(df: DataFrame, col: str, group, fns: Mapping[str, str]) -> DataFrame:
    """StdDev, Variance (sample) and PopStdDev, PopVariance per group on each row: ``{output: function}``.

    A sample figure of a one-row group is NULL.
    """
    keys = names(group)
    aggs = [Agg(out, SPREAD[fn.lower()], F.col(col)) for out, fn in fns.items()]
    total = aggregate(df, keys, aggs)
    return join_back(df, total, keys) if keys else df.join(F.broadcast(total), F.lit(True), "left")


def percent_of_sum(df: DataFrame, measure: str, group, outer=(), out: str = "percent") -> DataFrame:
    """Each group's share of the outer group's (or the report's) sum times 100; 0 where the whole is 0 or missing."""
    keys, outer = [*names(outer), *[g for g in names(group) if g not in names(outer)]], names(outer)
    parts = df.groupBy(*keys).agg(F.sum(measure).alias("__part"))
    whole = parts.groupBy(*outer).agg(F.sum("__part").alias("__whole"))
    both = join_back(parts, whole, outer) if outer else parts.join(F.broadcast(whole), F.lit(True), "left")
    share = F.when(F.coalesce(F.col("__whole"), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.col("__part") * 100.0 / F.col("__whole")
    )
    return both.select(*keys, share.alias(out))


def subtotals(df: DataFrame, groups: Sequence[str], summaries: Sequence[Summary], level: str = "level") -> DataFrame:
    """Footers of every nested level plus the report total; ``level`` counts the group columns that are set.

    The rollup runs over the finest totals; only figures that these don't add up to are rolled up from the rows.
    """
    merged, whole = _by_parts(summaries)

    def rolled(rows: DataFrame, columns: Sequence[Column]) -> DataFrame:
        return rows.rollup(*groups).agg(*columns, F.grouping_id().alias("__gid"))

    finest = df.groupBy(*groups).agg(*_partials(merged)) if merged else df
    out = rolled(finest, [_merged(s) for s in merged] or whole)
    if merged and whole:
        out = join_back(out, rolled(df, whole), [*groups, "__gid"])
    ones = F.length(F.regexp_replace(F.bin("__gid"), "0", ""))
    return out.withColumn(level, (F.lit(len(groups)) - ones).cast("int")).drop("__gid")


MAX_PIVOT_VALUES = 1000


@dataclass(frozen=True)
class Measure:
    field: str
    op: str = "sum"
    label: str | None = None


def crosstab(
    df: DataFrame,
    rows: Sequence[str],
    cols: Sequence[str],
    measures: Sequence[Measure],
    values: Sequence[str | tuple] | None = None,
    label_sep: str = "|",
) -> DataFrame:
    """Pivot with several row and column dimensions and measures Sum, Count, Average, Maximum, Minimum.

    A level named twice counts once. Column labels join the column dimensions, NULL as ''; pass ``values``, labels or
    tuples of the dimensions' values, to fix them and save a pass. Without them the dimensions are read first, and more
    than MAX_PIVOT_VALUES is an error, not a cut. Different cells under one label are an error, never one of them.
    """
    rows, cols, cells = _cells(df, rows, cols, measures, label_sep)
    if values is None:
        found = cells.select(*cols).distinct().limit(MAX_PIVOT_VALUES + 1).collect()
        if len(found) > MAX_PIVOT_VALUES:
            raise ValueError(f"more than {MAX_PIVOT_VALUES} column labels; pass values=[...] or use crosstab_long")
        shown = cells.select(F.struct(*cols).alias("v"), "__label").distinct().collect()
        values = [tuple(v) for v, _ in sorted(shown, key=lambda r: r["__label"])]
        labels = [r["__label"] for r in sorted(shown, key=lambda r: r["__label"])]
    else:
        labels = [v if isinstance(v, str) else label_sep.join("" if x is None else str(x) for x in v) for v in values]
    if len(set(labels)) < len(labels):
        raise ValueError("different column values have the same label; use another label_sep or replace NULLs")
    exact = [None if isinstance(v, str) else F.struct(*[F.lit(x).cast(cells.schema[c].dataType).alias(c) for c, x in zip(cols, v, strict=True)]) for v in values]
    kind = cells.select(F.struct(*cols).alias("v")).schema["v"].dataType
    listed = F.array(*[F.lit(None).cast(kind) if e is None else e.cast(kind) for e in exact])
    by_label = F.create_map(*[F.lit(x) for k, label in enumerate(labels) for x in (label, k)])
    # the column of a cell is looked up once; a label that stands for values given as a tuple must stand for just these
    code = F.try_element_at(by_label, F.col("__label")) if labels else F.lit(None).cast("int")
    wanted = F.get(listed, F.col("__code"))
    placed = cells.withColumn("__code", code)
    if any(e is not None for e in exact):
        placed = placed.withColumn("__code", F.when(wanted.isNull() | wanted.eqNullSafe(F.struct(*cols)), F.col("__code")))
    several = F.raise_error(F.lit("different column values have the same label"))
    figures = [F.when(F.count(F.lit(1)) > 1, several).otherwise(F.max(f"__m{i}")).alias(f"__m{i}") for i in range(len(measures))]
    # cells without a column keep their row in the result
    once = placed.groupBy(*rows, "__code").agg(*[F.when(F.col("__code").isNotNull(), f).alias(f"__m{i}") for i, f in enumerate(figures)])
    spread = once.groupBy(*rows).pivot("__code", list(range(len(labels)))).agg(*[F.max(f"__m{i}").alias(f"__m{i}") for i in range(len(measures))])

    def name(label: str, m: Measure) -> str:
        return label if len(measures) == 1 else f"{label}_{m.label or m.op + '_' + m.field}"

    given = lambda k, i: str(k) if len(measures) == 1 else f"{k}___m{i}"
    return spread.select(*rows, *[F.col(f"`{given(k, i)}`").alias(name(label, m)) for k, label in enumerate(labels) for i, m in enumerate(measures)])


def _cells(
    df: DataFrame, rows: Sequence[str], cols: Sequence[str], measures: Sequence[Measure], label_sep: str
) -> tuple[list[str], list[str], DataFrame]:
    """One row per cell, with its label and measures, before labels are spread over columns."""
    rows, cols = list(dict.fromkeys(rows)), list(dict.fromkeys(cols))
    for m in measures:
        if _ALIAS.get(m.op.lower(), m.op.lower()) not in ("sum", "count", "average", "maximum", "minimum"):
            raise ValueError(f"unsupported cross-tab operation {m.op!r}")
    label = F.concat_ws(label_sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    cells = aggregate(df, [*rows, *cols], [Agg(f"__m{i}", m.op, F.col(m.field)) for i, m in enumerate(measures)])
    return rows, cols, cells.withColumn("__label", label)


def crosstab_long(
    df: DataFrame, rows: Sequence[str], cols: Sequence[str], measures: Sequence[Measure], label_sep: str = "|", column: str = "column_no", label: str = "column_label"
) -> DataFrame:
    """A cross-tab of any number of columns, one row per cell: rows, ``column`` (numbered from 1 along the column dimensions,
    without gaps), ``label`` and a column per measure. Nothing about the columns passes the driver."""
    rows, cols, cells = _cells(df, rows, cols, measures, label_sep)
    numbered = sequence(cells.select(*cols).distinct(), column, cols)
    named = [F.col(f"__m{i}").alias(m.label or f"{m.op}_{m.field}") for i, m in enumerate(measures)]
    return join_back(cells, numbered, cols).select(*rows, column, F.col("__label").alias(label), *named)


def date_dimension(year: Column, month: Column, day: Column | int = 1) -> Column:
    """Computed cross-tab dimension: a date from its parts, NULL when they make no date."""
    day = F.lit(day) if isinstance(day, int) else day
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text.try_cast("date"))


# ---------------------------------------------------------------- chart series


def category_series(df: DataFrame, category: str, values: Mapping[str, str], op: str = "sum") -> DataFrame:
    """Category chart: several value columns in long form (category, series, value); ``{column: series name}``."""
    totals = aggregate(df, category, [Agg(s, op, F.col(c)) for c, s in values.items()])
    return totals.unpivot(category, list(values.values()), "series", "value")


def pie_series(df: DataFrame, series: str, value: str) -> DataFrame:
    """Slice totals with their share of the pie in percent."""
    slices = df.groupBy(series).agg(F.sum(value).alias("total"))
    return join_back(slices, percent_of_sum(df, value, series, out="share"), [series])


def xy_series(df: DataFrame, series: str | None, x: str, y: str, z: str | None = None, label: str = "series 0") -> DataFrame:
    """XY or bubble points (series, x, y[, z]); the series is a column's values or a fixed label."""
    name = F.col(series) if series else F.lit(label)
    points = [name.alias("series"), F.col(x).alias("x"), F.col(y).alias("y")]
    points += [F.col(z).alias("z")] if z else []
    return df.select(*points).filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def time_series(df: DataFrame, series: str, t: str, value: str, period: str = "month", op: str = "sum") -> DataFrame:
    """Values per series and time period (second .. year)."""
    stamped = df.withColumn("period", F.date_trunc(period, t))
    return aggregate(stamped, [series, "period"], [Agg("value", op, F.col(value))])


# ---------------------------------------------------------------- portfolio roll-ups


def binned_counts(df: DataFrame, col: str, bins: Sequence[tuple[str, float, float | None]]) -> DataFrame:
    """Histogram over labelled inclusive bins ``(label, low, high or None)``; empty bins count 0."""
    label = F.lit(None).cast("string")
    for name, low, high in reversed(bins):
        hit = F.col(col) >= low if high is None else F.col(col).between(low, high)
        label = F.when(hit, F.lit(name)).otherwise(label)
    counted = df.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("bin").isNotNull())
    spots = F.array(*[F.struct(F.lit(i).alias("bin_no"), F.lit(b[0]).alias("bin")) for i, b in enumerate(bins)])
    axis = df.sparkSession.range(1).select(F.inline(spots))
    return axis.join(counted, "bin", "left").select("bin_no", "bin", F.coalesce("__n", F.lit(0)).alias("rows"))


# fixed values: load bins of the portfolio report
LOAD_BINS = [("0 (hand over)", 0, 0), ("1", 1, 1), ("2", 2, 2), ("3-5", 3, 5), ("6+", 6, None)]


def coverage_report(df: DataFrame, kind: str, status: str, mapped: str) -> DataFrame:
    """Frequency per type with its mapping and status: unmapped types first, then by count."""
    per = df.groupBy(kind).agg(
        F.count(F.lit(1)).alias("rows"), F.min(mapped).alias(mapped), F.min(status).alias(status)
    )
    return per.orderBy(F.col(mapped).isNotNull(), F.col("rows").desc(), kind)


def status_rates(df: DataFrame, status: str, statuses: Sequence[str]) -> DataFrame:
    """One row: total, count and rate of each status; rates are 0 for an empty input."""
    total = F.count(F.lit(1))
    counts = {s: F.count_if(F.col(status) == s) for s in statuses}
    return df.agg(
        total.alias("total"),
        *[c.alias(s) for s, c in counts.items()],
        *[F.coalesce(F.try_divide(c.cast("double"), total), F.lit(0.0)).alias(f"{s}_rate") for s, c in counts.items()],
    )


# fixed values: grade thresholds, lowest score of each grade
GRADES = [(85, "A"), (70, "B"), (55, "C"), (40, "D"), (0, "E")]


@dataclass(frozen=True)
class Factor:
    """Mean of ``value`` per entity as a 0-100 factor; ``empty`` is the score of an entity without values."""

    name: str
    value: str | Column
    weight: float
    empty: float = 0.0


def _sums_in_order(rows: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Sums (keys, ``sum_`` and the value's name) of doubles added up row by row in the order, rows equal in it by their hash."""
    at = Window.partitionBy(*keys).orderBy(*order_columns(order), row_hash(rows))
    running_sums = F.struct(*[F.sum(v).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"sum_{v}") for v in values])
    numbered = rows.select(*keys, F.row_number().over(at).alias("__n"), running_sums.alias("__sums"))
    return numbered.groupBy(*keys).agg(F.max_by("__sums", "__n").alias("__sums")).select(*keys, "__sums.*")


def weighted_score(df: DataFrame, keys, factors: Sequence[Factor], order, grades: Sequence[tuple[int, str]] = GRADES) -> DataFrame:
    """Per entity: factor scores (rounded), weighted total 0-100 and grade.

    A sum of doubles depends on the order of its terms, and a mean that lies on a half is rounded either way for its last bit.
    So means count as added up in the given order, however rows are dealt to tasks. Most means are too far from a half for any order
    to matter: they come from sums combined on the map side, and only entities with a mean close to one are added up again.
    """
    keys, order = names(keys), sort_keys(order, "weighted_score")
    values = [f"__value{n}" for n in range(len(factors))]
    rows = df.select(
        *keys, *[F.col(c).alias(f"__order{n}") for n, (c, _) in enumerate(order)],
        *[_column(f.value).cast("double").alias(v) for f, v in zip(factors, values)],
    )
    means = rows.groupBy(*keys).agg(
        *[c for v in values for c in (F.avg(v).alias(f"mean{v}"), F.count(v).alias(f"count{v}"), F.sum(F.abs(F.col(v))).alias(f"size{v}"))]
    )

    def near_half(v: str) -> Column:
        # two orders of n terms give sums that differ by 2 * (n - 1) * 2 ** -53 of the terms' sizes at most; twice that has room for the rest
        percent = F.col(f"mean{v}") * 100
        return is_true(F.abs(F.abs(percent - F.rint(percent)) - 0.5) <= F.col(f"size{v}") * (100 * 2.0**-51))

    near = means.filter(any_of([near_half(v) for v in values])).select(*keys)
    again = _sums_in_order(
        join_back(rows, near, keys, "left_semi"), keys, values, [(f"__order{n}", desc) for n, (_, desc) in enumerate(order)]
    )
    sums = join_back(means, again, keys)
    scored = sums.select(
        *keys,
        *[
            F.bround(F.coalesce(F.col(f"sum_{v}") / F.col(f"count{v}"), F.col(f"mean{v}"), F.lit(f.empty)) * 100).cast("int").alias(f.name)
            for f, v in zip(factors, values)
        ],
    )
    total = sum((F.col(f.name) * F.lit(f.weight) for f in factors), F.lit(0.0))
    scored = scored.withColumn("score", F.bround(F.round(total, 9)).cast("int"))
    grade = None
    for threshold, letter in grades:
        hit = F.col("score") >= threshold
        grade = F.when(hit, letter) if grade is None else grade.when(hit, letter)
    return scored.withColumn("grade", grade)


def volume(count: Column, exponent: float = 0.8) -> Column:
    """Sub-linear volume of repeated work: ``n ** exponent``, 0 for nothing."""
    return F.when(count > 0, F.pow(count.cast("double"), F.lit(exponent))).otherwise(F.lit(0.0))


def half_hours(hours: Column) -> Column:
    """Rounded to half hours (ties to even), at least one half."""
    return F.greatest(F.bround(hours * 2) / 2, F.lit(0.5))


def discounted_hours(count: Column, per: float, discount: float = 0.6) -> Column:
    """First item at full price, the others discounted."""
    more = F.lit(per) + F.lit(per * discount) * (count - 1)
    return F.round(F.when(count <= 1, F.lit(per) * count).otherwise(more), 2)


# fixed values: hours per first instance; "assisted" works on converted output, "rebuild" starts from scratch
ASSISTED = {"base": 0.35, "auto": 0.03, "review": 0.3, "manual": 1.5, "untranslated": 0.1, "reviewed_exprs": 0.03}
ASSISTED_OVERHEAD = 0.15
REBUILD = {"base": 0.75, "steps": 1.0, "total_exprs": 0.15}
REBUILD_OVERHEAD = 0.20


def effort_rollup(
    df: DataFrame,
    assisted: Mapping[str, float] = ASSISTED,
    rebuild: Mapping[str, float] = REBUILD,
    overheads: tuple[float, float] = (ASSISTED_OVERHEAD, REBUILD_OVERHEAD),
    exponent: float = 0.8,
    outs: tuple[str, str] = ("assisted_hours", "manual_hours"),
) -> DataFrame:
    """Hours with and without assistance, hours saved and percent saved, from the count columns named in the rates."""

    def cost(rates: Mapping[str, float], overhead: float) -> Column:
        parts = [volume(F.col(c), exponent) * F.lit(r) for c, r in rates.items() if c != "base"]
        return half_hours(sum(parts, F.lit(rates.get("base", 0.0))) * F.lit(1 + overhead))

    a, m = outs
    out = df.withColumn(a, cost(assisted, overheads[0]))
    out = out.withColumn(m, F.greatest(cost(rebuild, overheads[1]), F.col(a)))
    saved = F.col(m) - F.col(a)
    percent = F.when(F.col(m) > 0, F.bround(saved / F.col(m) * 100).cast("int")).otherwise(F.lit(0))
    return out.withColumns({"saved_hours": saved, "saved_pct": percent})


def rollup_by_kind(df: DataFrame, by: Sequence[str], entity: str, items: str, hours: str) -> DataFrame:
    """Per kind of work: entities touched, items and hours, ordered by the first key and then by hours."""
    rolled = df.groupBy(*by).agg(
        F.countDistinct(entity).alias("entities"), F.sum(items).alias("items"), F.round(F.sum(hours), 2).alias("hours")
    )
    return rolled.orderBy(by[0], F.col("hours").desc(), *by[1:])
