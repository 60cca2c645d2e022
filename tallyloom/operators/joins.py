"""Joins, lookups, interval and fuzzy matching.

No operator forces a broadcast on a side of unknown size: the optimizer and AQE broadcast a side when its measured
size is below ``spark.sql.autoBroadcastJoinThreshold``, split skewed partitions of sort-merge joins otherwise.
Reference sides are made unique by map-side combined aggregates, never by windows over their keys.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import OrderRequired, all_of, any_of, fresh, is_true, join_back, match_on, names, sort_keys
from tallyloom.operators.ordered import _order_struct, sequence

HOW = {"normal": "inner", "left": "left", "right": "right", "full": "full"}


def joiner(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "normal") -> DataFrame:
    """Equi-join on column pairs. ``left``/``right`` name the preserved side, so a master/detail flip cannot happen."""
    if how not in HOW:
        raise ValueError(f"how must be one of {sorted(HOW)}")
    return left.join(right, match_on(left, right, on), HOW[how])


def one_per_key(ref: DataFrame, keys: Sequence[str], policy: str, order=None) -> DataFrame:
    """Reference rows with unique keys by match policy: first, last, any or error."""
    others = [c for c in ref.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in others]) if others else F.struct(F.lit(True).alias("__hit"))
    grouped = ref.groupBy(*keys)
    if policy in ("first", "last"):
        at = _order_struct(ref, sort_keys(order, f"match policy {policy!r}"))
        picked = grouped.agg((F.min_by if policy == "first" else F.max_by)(row, at).alias("__row"))
    elif policy == "any":
        # the smallest row is as good as any other and makes reruns agree
        picked = grouped.agg(F.min(row).alias("__row"))
    elif policy == "error":
        picked = grouped.agg(F.min(row).alias("__row"), F.count(F.lit(1)).alias("__n"))
        clash = F.raise_error(F.lit("several reference rows for one lookup key")).cast("boolean")
        picked = picked.filter(F.when(F.col("__n") == 1, F.lit(True)).otherwise(clash)).drop("__n")
    else:
        raise ValueError("policy must be 'first', 'last', 'any' or 'error'")
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])


def lookup(
    df: DataFrame,
    ref: DataFrame,
    keys: Sequence[tuple[str, str]],
    values: Mapping[str, str] | Sequence[str],
    default: Mapping[str, object] | None = None,
    on_multiple: str = "any",
    order=None,
    inner: bool = False,
    found: str | None = None,
) -> DataFrame:
    """Left lookup returning reference ``values`` (name or ``{reference column: output name}``).

    At most one match per row, so the row count of the flow never changes (``inner`` drops unmatched rows).
    ``default`` fills outputs of unmatched rows; ``found`` adds a match flag.
    """
    outputs = dict(values) if isinstance(values, Mapping) else {v: v for v in values}
    ref_keys = [b for _, b in keys]
    sort_cols = [c for c, _ in sort_keys(order, "lookup")] if order else []
    extra = [c for c in dict.fromkeys([*outputs, *sort_cols]) if c not in ref_keys]
    unique = one_per_key(ref.select(*dict.fromkeys([*ref_keys, *extra])), ref_keys, on_multiple, order)
    hit = fresh(df, "hit")
    side = unique.select(
        *[F.col(b).alias(f"__lk{i}") for i, b in enumerate(ref_keys)],
        *[F.col(c).alias(f"__lv{i}") for i, c in enumerate(outputs)],
        F.lit(True).alias(hit),
    )
    joined = df.join(
        side, match_on(df, side, [(a, f"__lk{i}") for i, (a, _) in enumerate(keys)]), "inner" if inner else "left"
    )
    filled = {}
    for i, out in enumerate(outputs.values()):
        value = F.col(f"__lv{i}")
        if default and out in default:
            value = F.when(F.col(hit).isNull(), F.lit(default[out])).otherwise(value)
        filled[out] = value
    if found:
        filled[found] = F.col(hit).isNotNull()
    kept = [F.col(c) for c in df.columns if c not in filled]
    return joined.select(*kept, *[v.alias(o) for o, v in filled.items()])


def unconnected_lookup(df: DataFrame, ref: DataFrame, keys, value: str, out: str, default=None, **how) -> DataFrame:
    """A lookup called from an expression: looked up first, then usable by later expressions as ``out``."""
    return lookup(df, ref, keys, {value: out}, {out: default} if default is not None else None, **how)


@dataclass(frozen=True)
class Lookup:
    """One lookup of a mapping component. ``match``: unique (the last row by ``order`` wins; without an order several rows
    for a key are an error), first (needs an order), all; every pair with ``all_rows`` (needs ``allow_pairs``)."""

    ref: DataFrame
    keys: Sequence[tuple[str, str]]
    values: Mapping[str, str]
    match: str = "unique"
    inner: bool = False
    order: object = None
    all_rows: bool = False
    allow_pairs: bool = False


@dataclass(frozen=True)
class Output:
    """One output of a mapping component: optional filter, columns, and what rejects it catches."""

    columns: Mapping[str, str | Column]
    condition: Column | None = None
    catch_rejects: bool = False


def all_matches(df: DataFrame, ref: DataFrame, keys: Sequence[tuple[str, str]], values: Mapping[str, str],
                inner: bool = False) -> DataFrame:
    """Lookup that keeps every match, so a row may multiply."""
    side = ref.select(
        *[F.col(b).alias(f"__lk{i}") for i, (_, b) in enumerate(keys)],
        *[F.col(c).alias(o) for c, o in values.items()],
    )
    on = match_on(df, side, [(a, f"__lk{i}") for i, (a, _) in enumerate(keys)])
    return df.join(side, on, "inner" if inner else "left").drop(*[f"__lk{i}" for i in range(len(keys))])


def multi_lookup(df: DataFrame, lookups: Sequence[Lookup], outputs: Mapping[str, Output]) -> dict[str, DataFrame]:
    """Several lookups in turn, then several filtered outputs.

    Rows that no filtered output takes go to the outputs that catch rejects.
    """
    for one in lookups:
        if one.all_rows:
            df = cross(df, one.ref.select(*[F.col(c).alias(o) for c, o in one.values.items()]), one.allow_pairs)
        elif one.match == "all":
            df = all_matches(df, one.ref, one.keys, one.values, one.inner)
        else:
            if one.match == "first" and not one.order:
                raise OrderRequired("the first of several matches depends on row order: pass order=[...]")
            policy = {"unique": "last", "first": "first"}[one.match] if one.order else "error"
            df = lookup(df, one.ref, one.keys, one.values, on_multiple=policy, order=one.order, inner=one.inner)
    accepted = [is_true(o.condition) for o in outputs.values() if o.condition is not None and not o.catch_rejects]
    flows = {}
    for name, output in outputs.items():
        if output.catch_rejects:
            flow = catch_output_reject(df, accepted)
        else:
            flow = df if output.condition is None else df.filter(output.condition)
        flows[name] = flow.select(
            *[(F.expr(e) if isinstance(e, str) else e).alias(c) for c, e in output.columns.items()]
        )
    return flows


def catch_output_reject(df: DataFrame, filters: Sequence[Column]) -> DataFrame:
    """Rows that no output filter accepted."""
    return df.filter(~any_of([is_true(f) for f in filters])) if filters else df.limit(0)


def inner_reject(df: DataFrame, ref: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows without a match; NULL keys never match."""
    return df.join(ref, match_on(df, ref, keys), "left_anti")


def semi_filter(df: DataFrame, ref: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows that have a match, not multiplied by it."""
    return df.join(ref, match_on(df, ref, keys), "left_semi")


def simple_join(
    df: DataFrame,
    ref: DataFrame,
    keys: Sequence[tuple[str, str]],
    inner: bool = True,
    lookup_cols: Mapping[str, str] | None = None,
    on_multiple: str = "any",
    order=None,
) -> tuple[DataFrame, DataFrame]:
    """(main, reject): exact match with optional lookup columns. An inner join sends unmatched rows to reject."""
    if lookup_cols:
        main = lookup(df, ref, keys, lookup_cols, on_multiple=on_multiple, order=order, inner=inner)
    else:
        main = semi_filter(df, ref, keys) if inner else df
    return main, inner_reject(df, ref, keys) if inner else df.limit(0)


def _on_scale(df: DataFrame, col: str) -> Column:
    """A number, date (days) or timestamp (seconds) as a double."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp")) / F.lit(1e6)
    return F.col(col).cast("double")


def interval_match(
    df: DataFrame,
    col: str,
    ref: DataFrame,
    lo: str,
    hi: str,
    values: Mapping[str, str],
    lo_strict: bool = False,
    hi_strict: bool = False,
    how: str = "left",
) -> DataFrame:
    """Range lookup: every interval of ``ref`` that contains ``col``; strict bounds exclude their end.

    Values and bounds are numbers, dates or timestamps, and of one kind; addresses in dotted text become numbers by
    ``functions.numbers.address_number`` first.

    Each interval is filed under the power of two next above its length, in the two cells of that width it can
    touch. A value looks into one cell per width in use, so the range condition becomes an equi-join and only the
    bounds are left to check. Intervals of one width overlap a cell only if they cover much of it, so candidates
    stay within a constant factor of the matches. Distinct values are matched once and joined back.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    low, high, v = F.col("__lo"), F.col("__hi"), F.col("__v")
    spans = ref.select(
        _on_scale(ref, lo).alias("__dlo"),
        _on_scale(ref, hi).alias("__dhi"),
        F.col(lo).alias("__lo"),
        F.col(hi).alias("__hi"),
        *[F.col(c).alias(o) for c, o in values.items()],
    ).filter(F.col("__lo").isNotNull() & F.col("__hi").isNotNull() & (low <= high))
    length = F.col("__dhi") - F.col("__dlo")
    # widths below 2^-20 share one class, so there are at most a thousand or so of them
    spans = spans.withColumn(
        "__w", F.when(length > F.lit(2.0**-20), F.ceil(F.log2(length))).otherwise(F.lit(-20)).cast("int")
    )
    widths = [r["__w"] for r in spans.select("__w").distinct().collect()]

    def cell(x: Column, w: Column) -> Column:
        return F.floor(x / F.pow(F.lit(2.0), w))

    filed = spans.withColumn(
        "__cell", F.explode(F.sequence(cell(F.col("__dlo"), F.col("__w")), cell(F.col("__dhi"), F.col("__w"))))
    )
    seen = df.select(F.col(col).alias("__v"), _on_scale(df, col).alias("__dv")).filter(F.col(col).isNotNull()).distinct()
    probes = seen.withColumn("__w", F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<int>"))).withColumn(
        "__cell", cell(F.col("__dv"), F.col("__w"))
    )
    inside = (v > low if lo_strict else v >= low) & (v < high if hi_strict else v <= high)
    hits = probes.join(filed, ["__w", "__cell"]).filter(inside).select("__v", *values.values())
    return df.join(hits, df[col] == hits["__v"], how).drop("__v")


def link_tables(
    tables: Mapping[str, DataFrame],
    links: Sequence[tuple[tuple[str, str], tuple[str, str]]],
    allow_pairs: bool = False,
) -> DataFrame:
    """Join named tables along declared links, breadth first from the first table.

    A table is joined on all links between it and the tables joined so far, so a second link between two tables is one
    more condition, and a link of a table to itself filters it. Links that name other tables are passed over. A table
    that no link reaches would need every pair of rows; that is refused unless ``allow_pairs`` is set.
    """
    near: dict[str, list[tuple[str, str, str]]] = {name: [] for name in tables}
    sources = dict(tables)
    for (a, a_column), (b, b_column) in links:
        if a == b and a in sources:
            sources[a] = sources[a].filter(F.col(a_column) == F.col(b_column))
        elif a in near and b in near:
            near[a].append((a_column, b, b_column))
            near[b].append((b_column, a, a_column))
    joined: DataFrame | None = None
    reached: set[str] = set()
    for root in sources:
        if root in reached:
            continue
        joined = sources[root] if joined is None else cross(joined, sources[root], allow_pairs)
        reached.add(root)
        waiting = deque([root])
        while waiting:
            for _, name, _ in near[waiting.popleft()]:
                if name not in reached:
                    matches = [sources[name][own] == sources[to][column] for own, to, column in near[name] if to in reached]
                    joined = joined.join(sources[name], all_of(matches))
                    reached.add(name)
                    waiting.append(name)
    return joined


def cross(df: DataFrame, other: DataFrame, allow_pairs: bool = False) -> DataFrame:
    """All pairs, for callers who want exactly that: the result has rows(df) x rows(other) rows."""
    if not allow_pairs:
        raise ValueError("this joins every row with every row; pass allow_pairs=True if that is wanted")
    return df.crossJoin(other)


def nest_children(
    parent: DataFrame,
    child: DataFrame,
    links: Sequence[tuple[str, str]],
    order,
    child_cols: Sequence[str] | None = None,
    part_rows: int = 10_000,
    **limits,
) -> DataFrame:
    """Linked sub-query: every parent row with its child rows, ordered, as an array column ``children``.

    Children are numbered per link value and nested in parts of ``part_rows``, one output row per part, so no parent
    collects an unbounded list. Parents without children come out once, with part 1 and an empty list.
    """
    child_keys = [c for _, c in links]
    columns = list(child_cols or [c for c in child.columns if c not in child_keys])
    known = child.filter(F.col(child_keys[0]).isNotNull())
    numbered = sequence(known, "__nth", order, by=child_keys, **limits)
    parts = (
        numbered.withColumn("part", F.floor((F.col("__nth") - 1) / part_rows).cast("int") + 1)
        .groupBy(*[F.col(k).alias(f"__ck{i}") for i, k in enumerate(child_keys)], "part")
        .agg(F.array_sort(F.collect_list(F.struct("__nth", *columns))).alias("__rows"))
        .withColumn("children", F.transform("__rows", lambda r: F.struct(*[r[c].alias(c) for c in columns])))
        .drop("__rows")
    )
    on = match_on(parent, parts, [(p, f"__ck{i}") for i, (p, _) in enumerate(links)])
    joined = parent.join(parts, on, "left").drop(*[f"__ck{i}" for i in range(len(links))])
    empty = F.array().cast(joined.schema["children"].dataType)
    return joined.withColumns(
        {"part": F.coalesce("part", F.lit(1)), "children": F.coalesce("children", empty)}
    )


# ---------------------------------------------------------------- approximate matching


def _deletions(text: Column, distance: int) -> Column:
    """All variants of ``text`` with up to ``distance`` characters removed."""

    def drop_one(t: Column) -> Column:
        cut = F.transform(
            F.sequence(F.lit(1), F.length(t)),
            lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))),
        )
        return F.when(F.length(t) > 0, cut).otherwise(F.array().cast("array<string>"))

    level = F.array(text)
    every = level
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, drop_one)))
        every = F.array_union(every, level)
    return every


def fuzzy_pairs(left: DataFrame, right: DataFrame, left_col: str, right_col: str, max_distance: int,
                min_distance: int = 0) -> DataFrame:
    """Distinct value pairs within a Levenshtein distance: (left value, right value, distance).

    Two strings within distance d share a string reachable from both by at most d deletions. Joining on those is
    an equi-join that misses no pair, needs no blocking key and compares only strings within 2d of each other.
    """
    a = left.select(F.col(left_col).alias("value")).filter(F.col(left_col).isNotNull()).distinct()
    b = right.select(F.col(right_col).alias("match")).filter(F.col(right_col).isNotNull()).distinct()
    va = a.withColumn("__key", F.explode(_deletions(F.col("value"), max_distance)))
    vb = b.withColumn("__key", F.explode(_deletions(F.col("match"), max_distance)))
    pairs = va.join(vb, "__key").select("value", "match").distinct()
    return pairs.withColumn("distance", F.levenshtein("value", "match")).filter(
        F.col("distance").between(min_distance, max_distance)
    )


def fuzzy_match(
    df: DataFrame,
    ref: DataFrame,
    col: str,
    ref_col: str,
    algo: str = "levenshtein",
    max_distance: int = 2,
    min_distance: int = 0,
) -> DataFrame:
    """Best approximate reference value per row as ``match`` and ``distance`` (NULL without a match).

    ``levenshtein`` takes the nearest value, the alphabetically first of equally near ones; ``soundex`` takes the
    alphabetically first value that sounds alike.
    """
    if algo == "levenshtein":
        pairs = fuzzy_pairs(df, ref, col, ref_col, max_distance, min_distance)
        best = pairs.groupBy("value").agg(F.min(F.struct("distance", "match")).alias("__b"))
        best = best.select(F.col("value").alias("__value"), "__b.match", "__b.distance")
    elif algo == "soundex":
        codes = ref.filter(F.col(ref_col).isNotNull()).groupBy(F.soundex(ref_col).alias("__code")).agg(
            F.min(ref_col).alias("match")
        )
        values = df.select(F.col(col).alias("__value")).filter(F.col(col).isNotNull()).distinct()
        best = values.join(codes, F.soundex("__value") == F.col("__code")).select(
            "__value", "match", F.levenshtein("__value", "match").alias("distance")
        )
    else:
        raise ValueError("algo must be 'levenshtein' or 'soundex'")
    return df.join(best, df[col] == best["__value"], "left").drop("__value")


#: Characters of the grams that similar values are sought by.
Q = 2
_EDGE = "\x01"


def _gram_tokens(values: DataFrame, percent: int) -> DataFrame:
    """Values (value) with their padded grams, each with its place and which of its equals it is, and the most edits ``most``
    between a value and one that is similar."""
    padded = F.concat(F.lit(_EDGE * (Q - 1)), F.col("value"), F.lit(_EDGE * (Q - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.length("value") + Q - 1), lambda i: F.substring("__p", i, F.lit(Q)))
    out = values.filter(F.length("value") > 0).withColumn("__p", padded).withColumn("__g", grams)
    nth = lambda g, i: F.size(F.filter(F.slice("__g", F.lit(1), i), lambda h: h == g))
    out = out.withColumn("__t", F.transform("__g", lambda g, i: F.struct(g.alias("gram"), nth(g, i).alias("nth"), i.alias("pos"))))
    longest = F.floor(F.length("value") * 100 / percent)
    return out.withColumn("most", F.floor(longest * (100 - percent) / 100).cast("int")).select("value", "most", F.explode("__t").alias("t")).select(
        "value", "most", "t.gram", "t.nth", "t.pos")


def fuzzy_top_k(df: DataFrame, ref: DataFrame, col: str, ref_col: str, percent: int = 80, k: int = 3) -> DataFrame:
    """The best reference values for each value of ``df``: (value, rank, match, distance, similarity).

    Similarity is 1 - distance / length of the longer value, the distance being Levenshtein's; matches have ``percent`` of it or
    more, the ``k`` best come in order, equally near ones alphabetically. Empty values have no match.

    Two values within d edits have all but d * Q of their grams in common, so they share one of the d * Q + 1 rarest of either,
    at places no more than d apart. Only these meet, in an equi-join, and only pairs that met are compared. That holds for
    similarities of more than 1 - 1 / Q.
    """
    if not (100 - percent) * Q < 100 or percent > 100:
        raise ValueError(f"percent must be more than {100 - 100 // Q} and at most 100")
    side = lambda t, c: t.select(F.col(c).cast("string").alias("value")).filter(F.length(c) > 0).distinct()
    a, b = _gram_tokens(side(df, col), percent), _gram_tokens(side(ref, ref_col), percent)
    frequency = a.select("gram", "nth").unionByName(b.select("gram", "nth")).groupBy("gram", "nth").agg(F.count(F.lit(1)).alias("f"))

    def prefix(tokens: DataFrame) -> DataFrame:
        rated = tokens.join(frequency, ["gram", "nth"]).groupBy("value", "most").agg(F.array_sort(F.collect_list(F.struct("f", "gram", "nth", "pos"))).alias("t"))
        return rated.select("value", "most", F.explode(F.slice("t", F.lit(1), F.col("most") * Q + 1)).alias("t")).select("value", "most", "t.gram", "t.nth", "t.pos")

    others = prefix(b).select(F.col("value").alias("match"), F.col("most").alias("most_b"), "gram", "nth", F.col("pos").alias("pos_b"))
    met = prefix(a).join(others, ["gram", "nth"]).filter(F.abs(F.col("pos") - F.col("pos_b")) <= F.least("most", "most_b"))
    longer = F.greatest(F.length("value"), F.length("match"))
    pairs = met.select("value", "match").distinct().withColumn("distance", F.levenshtein("value", "match"))
    pairs = pairs.filter(F.col("distance") * 100 <= longer * (100 - percent))
    best = Window.partitionBy("value").orderBy((F.col("distance") / longer), "match")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("value", "rank", "match", "distance", F.round(1 - F.col("distance") / longer, 4).alias("similarity"))


# ---------------------------------------------------------------- change detection


def diff_rows(old: DataFrame, new: DataFrame, keys, compare: Sequence[str] | None = None,
              flag: str = "flag") -> DataFrame:
    """Row flags identical / changed / new / deleted by key; a deleted row shows its old values."""
    keys = names(keys)
    compare = list(compare or [c for c in new.columns if c not in keys])
    a = old.select(*[F.col(k).alias(f"__o_{k}") for k in keys], *[F.col(c).alias(f"__o_{c}") for c in compare],
                   F.lit(True).alias("__in_old"))
    b = new.select(*keys, *compare, F.lit(True).alias("__in_new"))
    both = b.join(a, match_on(b, a, [(k, f"__o_{k}") for k in keys], null_safe=True), "full")
    changed = any_of([~F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in compare]) if compare else F.lit(False)
    state = (
        F.when(F.col("__in_old").isNull(), "new")
        .when(F.col("__in_new").isNull(), "deleted")
        .when(changed, "changed")
        .otherwise("identical")
    )
    shown = [
        F.when(F.col("__in_new").isNull(), F.col(f"__o_{c}")).otherwise(F.col(c)).alias(c) for c in [*keys, *compare]
    ]
    return both.select(*shown, state.alias(flag))
