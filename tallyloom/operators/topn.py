"""Top-N groups with an "Others" bucket."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import fresh, join_back, written
from tallyloom.operators.ordered import first_n

OTHERS_LAST = 2_147_483_647


@dataclass(frozen=True)
class TopN:
    """Keep the ``n`` best values of ``group`` by ``op(measure)``, call the rest ``others_label``."""

    group: str
    measure: str
    op: str = "sum"
    n: int = 5
    desc: bool = True
    others_label: str = "Others"


def top_n_others(df: DataFrame, groups: Sequence[str], specs: Sequence[TopN]) -> tuple[DataFrame, list[str]]:
    """Relabel the groups beyond the best n, outer group first: (rows, sort columns).

    A group is ranked by DENSE_RANK of its total within its parent groups, which already carry their relabelled
    values. The added sort columns hold the rank, Others last.

    The rows are aggregated once, by all groups; every level is ranked on that table, which is written after each level
    so that plans stay short, and the rows get all their labels in one join. Ranking happens on the distinct totals per
    parent, of which every task passes on at most n; what finds no partner among the groups that stay is "Others".
    """
    groups = list(groups)
    levels = sorted(specs, key=lambda s: groups.index(s.group))
    ops = [{"avg": "average", "max": "maximum", "min": "minimum"}.get(s.op.lower(), s.op.lower()) for s in levels]
    parts = {"sum": [F.sum], "average": [F.sum, F.count], "count": [F.count], "maximum": [F.max], "minimum": [F.min]}
    for spec, op in zip(levels, ops, strict=True):
        if op not in parts:
            raise ValueError(f"unsupported Top-N operation {spec.op!r}")
    if not levels:
        return df, []
    was = {g: fresh(df, f"was_{g}") for g in groups}
    cells = [f(s.measure).alias(f"__{i}_{k}") for i, (s, op) in enumerate(zip(levels, ops, strict=True)) for k, f in enumerate(parts[op])]
    known = written(df.groupBy(*groups).agg(*cells).withColumns({w: F.col(g) for g, w in was.items()}), "groups")
    ranks: list[str] = []
    for i, (spec, op) in enumerate(zip(levels, ops, strict=True)):
        parents, first, second = groups[: groups.index(spec.group)], f"__{i}_0", f"__{i}_1"
        whole = {
            "sum": lambda: F.sum(first), "count": lambda: F.sum(first), "maximum": lambda: F.max(first), "minimum": lambda: F.min(first),
            "average": lambda: F.try_divide(F.sum(first), F.sum(second)),
        }[op]()
        totals = known.groupBy(*parents, spec.group).agg(whole.alias("__total"))
        if isinstance(totals.schema["__total"].dataType, (T.DoubleType, T.FloatType)):
            # sums of doubles depend on the order of addition; equal totals stay equal in twelve digits, of any size
            totals = totals.withColumn("__total", F.format_string("%.11e", F.col("__total").cast("double")).cast("double"))
        rank = fresh(df, f"rank_{spec.group}")
        # groups without any measure come last either way
        steps = totals.select(*parents, "__total").distinct().withColumn("__gap", F.col("__total").isNull())
        ladder = first_n(steps, parents, [("__gap", False), ("__total", spec.desc)], spec.n, rank).drop("__gap")
        kept = join_back(totals, ladder, [*parents, "__total"], "inner").select(*parents, spec.group, rank)
        label = F.when(F.col(rank).isNotNull(), F.col(spec.group).cast("string")).otherwise(F.lit(spec.others_label))
        labelled = join_back(known, kept, [*parents, spec.group])
        known = written(labelled.withColumns({spec.group: label, rank: F.coalesce(F.col(rank), F.lit(OTHERS_LAST))}), "groups")
        ranks.append(rank)
    shown = {s.group: fresh(df, f"label_{s.group}") for s in levels}
    labels = known.select(*[F.col(w).alias(g) for g, w in was.items()], *[F.col(g).alias(n) for g, n in shown.items()], *ranks)
    out = join_back(df, labels, groups)
    return out.select(*[F.col(shown[c]).alias(c) if c in shown else F.col(f"`{c}`") for c in df.columns], *ranks), ranks
