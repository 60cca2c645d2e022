"""Table comparison, number parity, key checks, classification and graph checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.core import join_back, match_on, names, sort_keys, written
from tallyloom.functions.numbers import NUMBER_PATTERN, canonical_number
from tallyloom.operators.joins import one_per_key
from tallyloom.operators.ordered import sequence

# fixed values: numeric tolerance, sample size and verdict limits
TOLERANCE = 1e-9
SAMPLES = 20
PASS_PARITY, NEAR_PARITY, NEAR_NUMBERS = 0.999, 0.95, 0.9


def number_of(c: Column) -> Column:
    """Text of a plain number as a double, else NULL: a cast alone would also take type suffixes such as ``1d``."""
    return F.when(c.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), c.try_cast("double"))


def values_equal(expected: Column, actual: Column, tolerance: float = TOLERANCE) -> Column:
    """Equal as trimmed text, or both numbers within the tolerance; NULL counts as empty text."""
    e = F.trim(F.coalesce(expected.cast("string"), F.lit("")))
    a = F.trim(F.coalesce(actual.cast("string"), F.lit("")))
    near = F.abs(number_of(e) - number_of(a)) <= tolerance
    return (e == a) | F.coalesce(near, F.lit(False))


def verdict(parity: Column, counts_match: Column) -> Column:
    return (
        F.when((parity >= PASS_PARITY) & counts_match, "PASS").when(parity >= NEAR_PARITY, "NEAR").otherwise("FAIL")
    )


@dataclass
class DiffResult:
    """``report`` has one row, ``columns`` one row per differing column, ``mismatches`` one row per differing cell, of which
    ``samples`` are the first few along their rows."""

    report: DataFrame
    columns: DataFrame
    samples: DataFrame
    mismatches: DataFrame


def _shared(expected: DataFrame, actual: DataFrame) -> list[str]:
    shared = [c for c in expected.columns if c in set(actual.columns)]
    if not shared:
        raise ValueError("the two tables share no column names")
    return shared


def _diff(paired: DataFrame, shared: Sequence[str], tolerance: float, extra_counts: DataFrame, samples: int) -> DiffResult:
    """``paired`` holds ``__row``, ``__e_<c>``, ``__a_<c>``, ``__in_e`` and ``__in_a``."""
    both = F.col("__in_e") & F.col("__in_a")
    off = {c: ~values_equal(F.col(f"__e_{c}"), F.col(f"__a_{c}"), tolerance) for c in shared}
    any_off = F.lit(False)
    for test in off.values():
        any_off = any_off | test
    counts = paired.agg(
        F.count_if(F.col("__in_e")).alias("expected_rows"),
        F.lit(0).cast("long").alias("actual_rows"),
        F.count_if(both & ~any_off).alias("matching_rows"),
        F.count_if(both & any_off).alias("mismatched_rows"),
        F.count_if(F.col("__in_e") & ~F.col("__in_a")).alias("missing_rows"),
        F.count_if(~F.col("__in_e") & F.col("__in_a")).alias("extra_rows"),
        *[F.count_if(both & t).alias(f"__off_{c}") for c, t in off.items()],
    )
    # every number comes from its own one-row total; adding the rows up puts them side by side
    figures = ["expected_rows", "actual_rows", "matching_rows", "mismatched_rows", "missing_rows", "extra_rows"]
    merged = counts.select(*figures).unionByName(extra_counts.select(*figures))
    total = merged.agg(*[F.sum(c).alias(c) for c in figures])
    ratio = F.col("matching_rows") / F.greatest("expected_rows", "actual_rows", F.lit(1))
    same = F.col("expected_rows") == F.col("actual_rows")
    report = total.select(
        "expected_rows", "actual_rows", same.alias("row_count_match"),
        (F.col("matching_rows") + F.col("mismatched_rows")).alias("compared_rows"),
        "matching_rows", "mismatched_rows", "missing_rows", "extra_rows",
        F.round(ratio, 4).alias("parity"), verdict(ratio, same).alias("verdict"),
    )
    columns = counts.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__off_{c}").alias("mismatches")) for c in shared]))
    ).filter(F.col("mismatches") > 0)
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("pos"), F.lit(c).alias("column_name"), F.col(f"__e_{c}").cast("string").alias("expected"),
            F.col(f"__a_{c}").cast("string").alias("actual"), off[c].alias("differs"),
        )
        for i, c in enumerate(shared)
    ])
    found = paired.filter(both & any_off).select(F.col("__row").alias("row_id"), F.inline(cells)).filter("differs")
    shown = ["row_id", "column_name", "expected", "actual"]
    return DiffResult(report, columns, found.orderBy("row_id", "pos").limit(samples).select(*shown), found.select(*shown))


def _figures(df: DataFrame, **values: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    all_names = ["expected_rows", "actual_rows", "matching_rows", "mismatched_rows", "missing_rows", "extra_rows"]
    return df.agg(*[values.get(n, zero).alias(n) for n in all_names])


def diff_keyed(expected: DataFrame, actual: DataFrame, key, order=None, tolerance: float = TOLERANCE, samples: int = SAMPLES) -> DiffResult:
    """Compare by key over the shared columns.

    Each expected row meets the actual row of its key; of several actual rows the last by ``order`` counts (without
    an order duplicates are an error).
    """
    keys, shared = names(key), _shared(expected, actual)
    for k in keys:
        if k not in shared:
            raise ValueError(f"key column {k!r} is not in both tables")
    others = [c for c in shared if c not in keys]
    wanted = list(dict.fromkeys([*shared, *([c for c, _ in sort_keys(order, "diff_keyed")] if order else [])]))
    unique = one_per_key(actual.select(*wanted), keys, "last" if order else "error", order)
    right = unique.select(*[F.col(c).alias(f"__a_{c}") for c in shared], F.lit(True).alias("__hit"))
    left = expected.select(*[F.col(c).alias(f"__e_{c}") for c in shared])
    on = match_on(left, right, [(f"__e_{k}", f"__a_{k}") for k in keys], null_safe=True)
    paired = left.join(right, on, "left").withColumns(
        {
            "__in_e": F.lit(True),
            "__in_a": F.coalesce("__hit", F.lit(False)),
            "__row": F.concat_ws("|", *[F.col(f"__e_{k}").cast("string") for k in keys]),
        }
    )
    extra = right.join(left, on, "left_anti")
    counts = _figures(actual, actual_rows=F.count(F.lit(1))).unionByName(
        _figures(extra, extra_rows=F.count(F.lit(1)))
    )
    return _diff(paired, [*keys, *others], tolerance, counts, samples)


def diff_positional(expected: DataFrame, actual: DataFrame, order_expected, order_actual=None,
                    tolerance: float = TOLERANCE, samples: int = SAMPLES, **limits) -> DiffResult:
    """Compare row i with row i along the given orders, up to the shorter table; surplus rows only count."""
    shared = _shared(expected, actual)
    left = sequence(expected, "__i", order_expected, **limits)
    right = sequence(actual, "__i", order_actual or order_expected, **limits)
    left = left.select(F.col("__i"), *[F.col(c).alias(f"__e_{c}") for c in shared])
    right = right.select(F.col("__i").alias("__j"), *[F.col(c).alias(f"__a_{c}") for c in shared])
    paired = left.join(right, left["__i"] == right["__j"]).withColumns(
        {"__in_e": F.lit(True), "__in_a": F.lit(True), "__row": F.col("__i").cast("string")}
    )
    result = _diff(paired, shared, tolerance, _figures(actual, actual_rows=F.count(F.lit(1))), samples)
    # rows beyond the shorter table are not compared, but they are counted
    rows = expected.agg(F.count(F.lit(1)).alias("__n"))
    ratio = F.col("matching_rows") / F.greatest("__n", "actual_rows", F.lit(1))
    same = F.col("__n") == F.col("actual_rows")
    result.report = result.report.join(F.broadcast(rows), F.lit(True), "left").withColumns(
        {"expected_rows": F.col("__n"), "row_count_match": same, "parity": F.round(ratio, 4), "verdict": verdict(ratio, same)}
    ).drop("__n")
    return result


# ---------------------------------------------------------------- numbers in text


# fixed value: dates that two renderers format differently
DATE_PATTERN = r"\b\d{1,4}[-/]\d{1,2}[-/]\d{1,4}\b|\b[A-Z][a-z]{2,8} \d{1,2}, \d{4}\b"


def numbers_in_text(df: DataFrame, col: str, keys=(), strip_dates: bool = False) -> DataFrame:
    """Every number of a text as (keys, number, n): a normalised multiset, counted on the map side."""
    body = F.regexp_replace(F.col(col), DATE_PATTERN, " ") if strip_dates else F.col(col)
    tokens = df.select(*names(keys), F.explode(F.regexp_extract_all(body, F.lit(NUMBER_PATTERN), 0)).alias("__t"))
    return (
        tokens.select(*names(keys), canonical_number(F.col("__t")).alias("number"))
        .filter(F.col("number").isNotNull())
        .groupBy(*names(keys), "number").agg(F.count(F.lit(1)).alias("n"))
    )


def _number_counts(reference: DataFrame, rendered: DataFrame, col: str, keys: Sequence[str], strip_dates: bool) -> DataFrame:
    """How often each number stands in either text: (keys, number, r, c)."""
    a = numbers_in_text(reference, col, keys, strip_dates).withColumnRenamed("n", "n_ref")
    b = numbers_in_text(rendered, col, keys, strip_dates).withColumnRenamed("n", "n_ren")
    zero = F.lit(0).cast("long")
    # a union and one aggregate take the place of a full join
    both = a.withColumn("n_ren", zero).unionByName(b.withColumn("n_ref", zero))
    return both.groupBy(*keys, "number").agg(F.sum("n_ref").alias("r"), F.sum("n_ren").alias("c"))


def number_differences(reference: DataFrame, rendered: DataFrame, col: str, keys=(), strip_dates: bool = False) -> DataFrame:
    """The numbers themselves that one text has more often than the other: (keys, number, state, n), state being missing
    (from the rendered text) or extra."""
    keys, more = names(keys), F.col("r") - F.col("c")
    both = _number_counts(reference, rendered, col, keys, strip_dates).filter(more != 0)
    return both.select(*keys, "number", F.when(more > 0, "missing").otherwise("extra").alias("state"), F.abs(more).alias("n"))


def number_parity(
    reference: DataFrame, rendered: DataFrame, col: str, keys=(), strip_dates: bool = False,
    near: float = NEAR_NUMBERS,
) -> DataFrame:
    """Do the reference's numbers appear in the rendered text? One row (per key): matched, missing, extra, verdict."""
    keys = names(keys)
    zero = F.lit(0).cast("long")
    both = _number_counts(reference, rendered, col, keys, strip_dates)
    totals = both.groupBy(*keys).agg(
        F.coalesce(F.sum(F.least("r", "c")), zero).alias("matched"),
        F.coalesce(F.sum("r"), zero).alias("reference_total"),
        F.coalesce(F.sum("c"), zero).alias("rendered_total"),
    )
    missing = F.col("reference_total") - F.col("matched")
    state = (
        F.when(F.col("reference_total") == 0, "FAIL").when(missing == 0, "PASS")
        .when(F.col("matched") / F.col("reference_total") >= near, "NEAR").otherwise("FAIL")
    )
    return totals.select(
        *keys, "matched", "reference_total", "rendered_total", missing.alias("missing"),
        (F.col("rendered_total") - F.col("matched")).alias("extra"), state.alias("verdict"),
    )


# ---------------------------------------------------------------- keys and references


def check_keys(df: DataFrame, keys) -> DataFrame:
    """Key values that are not unique or hold a NULL: (keys, occurrences)."""
    keys = names(keys)
    gap = F.lit(False)
    for k in keys:
        gap = gap | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter((F.col("occurrences") > 1) | gap)


def check_references(child: DataFrame, parent: DataFrame, links: Sequence[tuple[str, str]]) -> DataFrame:
    """Child rows whose foreign key has no parent; a NULL foreign key refers to nothing and is fine."""
    filled = child.dropna(subset=[c for c, _ in links])
    return filled.join(parent, match_on(filled, parent, links), "left_anti")


# ---------------------------------------------------------------- classification


def classify_text(df: DataFrame, col: str, rules: Sequence[tuple[str, str]], default: str, out: str = "kind",
                  ignore_case: bool = True) -> DataFrame:
    """Ordered ``(kind, regex)`` rules: the first that is found wins, anything else (NULL too) is ``default``."""
    prefix = "(?i)" if ignore_case else ""
    kind = None
    for name, regex in rules:
        hit = F.coalesce(F.col(col).rlike(prefix + regex), F.lit(False))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return df.withColumn(out, F.lit(default) if kind is None else kind.otherwise(default))


def tag_features(df: DataFrame, tags: Mapping[str, Column], out: str = "tags") -> DataFrame:
    """Boolean features of each row as an array of tags."""
    hits = [F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for t, c in tags.items()]
    return df.withColumn(out, F.array_compact(F.array(*hits)))


def tag_counts(df: DataFrame, tags: Mapping[str, Column]) -> DataFrame:
    """How many rows carry each tag: (tag, rows)."""
    tagged = tag_features(df.select("*"), tags, "__tags")
    return tagged.select(F.explode("__tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- flow graphs


def edge_lint(nodes: DataFrame, edges: DataFrame, node: str = "name", source: str = "from_step",
              target: str = "to_step") -> DataFrame:
    """Findings (code, item): ends of edges that are no nodes, and nodes without any edge."""
    known = nodes.select(F.col(node).alias("item"), F.lit(True).alias("known"), F.lit(False).alias("used"))
    ends = edges.select(F.explode(F.array(source, target)).alias("item"), F.lit(False).alias("known"), F.lit(True).alias("used"))
    # one aggregate, combined in the tasks that read; a NULL end refers to no node, not to one named NULL either
    seen = known.unionByName(ends).groupBy("item").agg(F.max("known").alias("known"), F.max("used").alias("used"))
    codes = F.array_compact(F.array(
        F.when(F.col("used") & (~F.col("known") | F.col("item").isNull()), "unknown-node"),
        F.when(F.col("known") & (~F.col("used") | F.col("item").isNull()), "isolated"),
    ))
    return seen.select(F.explode(codes).alias("code"), "item")


def _follow(pointers: DataFrame) -> DataFrame:
    """Each node's pointer (__t to __s) moved to where the pointers from there end, doubling the way in every round.

    Rounds are the logarithm of the longest way; nodes that lead into a circle of pointers keep pointing into it.
    """
    current = written(pointers.select("__t", "__s"), "pointers")
    for _ in range(max(1, current.count()).bit_length() + 1):
        ahead = current.select(F.col("__t").alias("__via"), F.col("__s").alias("__to"))
        moved = current.join(ahead, F.col("__s") == F.col("__via"), "left")
        current = written(moved.select("__t", F.coalesce("__to", "__s").alias("__s"), F.col("__to").isNotNull().alias("__moved")), "pointers")
        if not current.filter("__moved").limit(1).count():
            break
        current = current.select("__t", "__s")
    return current.select("__t", "__s")


def has_upstream(
    nodes: DataFrame, edges: DataFrame, goal: Column, stop: Column, node: str = "name", source: str = "from_step",
    target: str = "to_step", out: str = "reached",
) -> DataFrame:
    """Does some path upward from a node, itself included, meet a goal node before a stop node?

    A stop node neither takes nor passes the answer, so edges out of stop nodes and into goals don't count. A node that one
    edge leads to has the answer of the node that it comes from: such chains and trees, of any depth, are contracted by
    following pointers with doubled steps, and the edges into other nodes then come from where the chains begin; that is
    repeated while nodes are left with one source. What remains is solved downstream from the goals, a round for each
    further node where paths meet. Circles that no goal leads into end by themselves, without the answer.
    """
    marked = nodes.select(
        F.col(node).alias("__n"), F.coalesce(goal, F.lit(False)).alias("__goal"),
        (F.coalesce(stop, F.lit(False)) & ~F.coalesce(goal, F.lit(False))).alias("__stop"),
    )
    passing = marked.filter("not __stop").select(F.col("__n").alias("__s")).distinct()
    takers = marked.filter("not __goal and not __stop").select(F.col("__n").alias("__t")).distinct()
    steps = edges.select(F.col(source).alias("__s"), F.col(target).alias("__t")).filter("__s <> __t").distinct()
    steps = written(steps.join(takers, "__t", "left_semi").join(passing, "__s", "left_semi").select("__s", "__t"), "steps")
    roots = None
    while True:
        sources = steps.groupBy("__t").agg(F.count(F.lit(1)).alias("__k"), F.min("__s").alias("__s")).filter("__k = 1")
        sources = written(sources.select("__t", "__s"), "sources")
        if not sources.limit(1).count():
            break
        begin = _follow(sources)
        of_source = begin.select(F.col("__t").alias("__via"), F.col("__s").alias("__from"))
        later = begin if roots is None else roots.join(of_source, F.col("__s") == F.col("__via"), "left").select(
            "__t", F.coalesce("__from", "__s").alias("__s")).unionByName(begin)
        roots = written(later, "roots")
        left = steps.join(sources.select("__t"), "__t", "left_anti").join(of_source, F.col("__s") == F.col("__via"), "left")
        steps = written(left.select(F.coalesce("__from", "__s").alias("__s"), "__t").filter("__s <> __t").distinct(), "steps")
    reached = written(marked.filter("__goal").select("__n").distinct(), "reached")
    frontier = reached
    while True:
        ahead = steps.join(frontier.withColumnRenamed("__n", "__s"), "__s", "left_semi").select(F.col("__t").alias("__n")).distinct()
        frontier = written(ahead.join(reached, "__n", "left_anti"), "frontier")
        if not frontier.limit(1).count():
            break
        reached = written(reached.unionByName(frontier), "reached")
    if roots is not None:
        found = roots.join(reached.withColumnRenamed("__n", "__s"), "__s", "left_semi").select(F.col("__t").alias("__n"))
        reached = reached.unionByName(found)
    hit = reached.distinct().withColumn("__hit", F.lit(True)).withColumnRenamed("__n", "__r")
    return (
        nodes.join(hit, nodes[node] == hit["__r"], "left").drop("__r")
        .withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__hit")
    )


# ---------------------------------------------------------------- metering


def flow_metrics(df: DataFrame, name: str, **sums: str) -> tuple[DataFrame, Observation]:
    """Row count (and sums) of a flow, measured while an action runs over it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(o) for o, c in sums.items()]), seen
