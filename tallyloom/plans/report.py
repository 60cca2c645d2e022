"""The whole report query in one call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from tallyloom.core import join_back, written
from tallyloom.operators.aggregate import Summary, group_totals, percent_of_sum, spread_columns
from tallyloom.operators.ordered import running_values
from tallyloom.operators.select import Clause, Parameter, record_selection
from tallyloom.operators.sets import report_order
from tallyloom.operators.topn import TopN, top_n_others


@dataclass(frozen=True)
class Running:
    out: str
    op: str
    field: str
    reset_by: str | None = None


@dataclass(frozen=True)
class Spread:
    """``fns`` maps outputs to StdDev, Variance, PopStdDev or PopVariance."""

    field: str
    fns: Mapping[str, str]
    group: str | None = None


@dataclass(frozen=True)
class Percent:
    out: str
    measure: str
    group: str
    outer: str | None = None


@dataclass
class Report:
    """A report query, applied in this order: selection, columns, spread, running values, group totals, percents,
    Top-N, order. ``groups`` are (column, descending) from the outermost inwards. ``stage`` writes the selected rows to
    the shared folder first; switch it off when the input is a plain table scan."""

    select: Mapping[str, str | Column] | None = None
    where: Sequence[Clause] = ()
    parameters: Sequence[Parameter] = ()
    groups: Sequence[tuple[str, bool]] = ()
    sorts: Sequence[tuple[str, bool]] = ()
    summaries: Sequence[Summary] = ()
    running: Sequence[Running] = ()
    spread: Sequence[Spread] = ()
    percent: Sequence[Percent] = ()
    top_n: Sequence[TopN] = ()
    limits: Mapping[str, int] = field(default_factory=dict)
    stage: bool = True


def grouped_report(df: DataFrame, report: Report, values: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows of a report with everything its bands show. Running values need a total order from groups and sorts."""
    from pyspark.sql import functions as F

    out = record_selection(df, report.where, report.parameters, values)
    if report.select:
        out = out.select(*[(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in report.select.items()])
    if report.stage:
        # totals, ranks and running values all read these rows: join and filter them once
        out = written(out, "report")
    group_names = [g for g, _ in report.groups]
    for s in report.spread:
        outer = group_names[: group_names.index(s.group) + 1] if s.group else []
        out = spread_columns(out, s.field, outer, s.fns)
    order = [*report.groups, *[s for s in report.sorts if s[0] not in group_names]]
    for reset_by in dict.fromkeys(r.reset_by for r in report.running):
        # running values of one reset group share a window
        reset = group_names[: group_names.index(reset_by) + 1] if reset_by else []
        specs = [(r.op, r.field, r.out) for r in report.running if r.reset_by == reset_by]
        out = running_values(out, specs, order, reset, **report.limits)
    if report.summaries:
        out = group_totals(out, group_names, report.summaries)
    for p in report.percent:
        outer = group_names[: group_names.index(p.outer) + 1] if p.outer else []
        keys = group_names[: group_names.index(p.group) + 1]
        out = join_back(out, percent_of_sum(out, p.measure, keys, outer, p.out), keys)
    first: list[str] = []
    if report.top_n:
        out, first = top_n_others(out, group_names, report.top_n)
    ranked = {t.group for t in report.top_n}
    ordered = report_order(out, [g for g in report.groups if g[0] not in ranked], report.sorts, first)
    return ordered.drop(*first)
