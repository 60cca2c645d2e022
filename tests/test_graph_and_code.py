"""Upstream goals in deep graphs, aggregates in Python, and comparisons that give all they find."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.core import OrderRequired
from tallyloom.operators import compare, joins, usercode
from tallyloom.operators.joins import Lookup, Output, multi_lookup


def upward(kinds, edges):
    """Nodes with a goal before a stop on some way up, by walking."""
    above = {}
    for a, b in edges:
        above.setdefault(b, set()).add(a)
    found = set()
    for start in kinds:
        seen, todo = set(), [start]
        while todo:
            n = todo.pop()
            if n in seen or n not in kinds:
                continue
            seen.add(n)
            if kinds[n] == "goal":
                found.add(start)
                break
            if kinds[n] != "stop":
                todo += above.get(n, ())
    return found


def reached(spark, kinds, edges):
    nodes = spark.createDataFrame(list(kinds.items()), "name int, kind string")
    out = compare.has_upstream(nodes, spark.createDataFrame(edges, "from_step int, to_step int"), F.col("kind") == "goal", F.col("kind") == "stop")
    rows = out.collect()
    assert len(rows) == len(kinds)
    return {r.name for r in rows if r.reached}


def test_upstream_goals_equal_walking(spark):
    rng = random.Random(1)
    kinds, edges = {}, []
    for part in range(30):  # graphs of chains, trees, merges and circles side by side
        base, n = part * 40, rng.randint(2, 30)
        kinds |= {base + k: rng.choice(["goal", "stop", *["x"] * 12]) for k in range(n)}
        edges += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(rng.randint(1, int(n * 1.4)))]
        edges += [(base + k, base + k + 1) for k in range(n - 1) if rng.random() < 0.6]
    edges += [(9999, 0)]  # no such node
    found = reached(spark, kinds, edges)
    assert found == upward(kinds, edges) and 30 < len(found) < len(kinds)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, plain = [], compare.written

    def counted(df, stem="step"):
        rounds.append(stem)
        return plain(df, stem)

    monkeypatch.setattr(compare, "written", counted)
    n = 100_000
    nodes = spark.range(n).select("id", (F.col("id") == 0).alias("goal"), (F.col("id") == n // 2).alias("stop"))
    edges = spark.range(n - 1).select(F.col("id").alias("from_step"), (F.col("id") + 1).alias("to_step"))
    out = compare.has_upstream(nodes, edges, F.col("goal"), F.col("stop"), node="id")
    assert out.filter("reached").count() == n // 2
    assert rounds.count("pointers") <= 20 and len(rounds) <= 28


def test_custom_aggregate_merges_states(spark, monkeypatch):
    monkeypatch.setattr(usercode, "STATES", 7)
    monkeypatch.setattr(usercode, "UPDATE_ROWS", 100)
    longest = []

    def take(state, v):
        longest.append(len(v))
        assert len(v) <= 100
        return np.sort(np.concatenate([state, v]))[::-1][:3]

    top = usercode.Aggregate(lambda: np.empty(0), take, lambda a, b: np.sort(np.concatenate([a, b]))[::-1][:3], lambda s: [float(x) for x in s])
    rows = [(k % 40, "a" if k % 3 else None, float(k % 1000)) for k in range(6000)] + [(99, "hot", 1.0)] * 5000 + [(98, None, None)]
    df = spark.createDataFrame(rows, "k int, t string, v double").repartition(6)
    out = usercode.custom_aggregate(df, ["k", "t"], "top", top, "v", "array<double>")
    wanted = {}
    for k, t, v in rows:
        wanted.setdefault((k, t), []).extend([] if v is None else [v])
    assert {(r.k, r.t): list(r.top) for r in out.collect()} == {g: sorted(v, reverse=True)[:3] for g, v in wanted.items()}
    whole = usercode.custom_aggregate(df, [], "top", top, "v", "array<double>").collect()
    assert [list(r.top) for r in whole] == [[999.0, 999.0, 999.0]]
    assert usercode.custom_aggregate(df.limit(0), "k", "top", top, "v", "array<double>").collect() == []


def test_differences_themselves(spark):
    a = spark.createDataFrame([("x", "10 of 12, 12 and 7"), ("y", "1")], "k string, t string")
    b = spark.createDataFrame([("x", "10 of 12 and 8 and 8"), ("z", "5")], "k string, t string")
    found = sorted((r.k, r.number, r.state, r.n) for r in compare.number_differences(a, b, "t", "k").collect())
    assert found == [("x", "12", "missing", 1), ("x", "7", "missing", 1), ("x", "8", "extra", 2), ("y", "1", "missing", 1), ("z", "5", "extra", 1)]
    e = spark.createDataFrame([(k, k, "v") for k in range(50)], "k int, a int, b string")
    result = compare.diff_keyed(e, e.withColumn("a", F.col("a") + 1), "k", samples=3)
    assert result.samples.count() == 3 and result.mismatches.count() == 50


def test_ambiguous_matches_are_refused(spark):
    df = spark.createDataFrame([(1,)], "k int")
    ref = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    outputs = {"o": Output({"k": "k", "v": "v"})}
    with pytest.raises(OrderRequired):
        multi_lookup(df, [Lookup(ref, [("k", "k")], {"v": "v"}, match="first")], outputs)
    with pytest.raises(Exception, match="several reference rows"):
        multi_lookup(df, [Lookup(ref, [("k", "k")], {"v": "v"})], outputs)["o"].collect()
    last = multi_lookup(df, [Lookup(ref, [("k", "k")], {"v": "v"}, order="v")], outputs)["o"].collect()
    assert [tuple(r) for r in last] == [(1, "b")]


@pytest.mark.parametrize("percent", [51, 75, 100])
def test_similar_values_equal_brute_force(spark, percent):
    rng = random.Random(percent)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 9)))
    left, right = [word() for _ in range(80)], [word() for _ in range(80)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    wanted = []
    for a in set(left) - {""}:
        near = sorted((distance(a, b) / max(len(a), len(b)), b, distance(a, b)) for b in set(right) - {""})
        near = [n for n in near if n[2] * 100 <= max(len(a), len(n[1])) * (100 - percent)]
        wanted += [(a, k, b, d) for k, (_, b, d) in enumerate(near[:3], 1)]
    frame = lambda words: spark.createDataFrame([(w,) for w in [*words, None]], "w string")
    out = joins.fuzzy_top_k(frame(left), frame(right), "w", "w", percent)
    assert sorted((r.value, r["rank"], r.match, r.distance) for r in out.collect()) == sorted(wanted) and wanted


def test_edge_lint_is_one_aggregate(spark, listed):
    """Unknown ends and nodes without edges come from one aggregate without joins; a NULL end refers to no node."""
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "name string")
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("x", None), ("a", "b")], "from_step string, to_step string")
    found = compare.edge_lint(nodes, edges)
    assert listed(found) == sorted([("unknown-node", "x"), ("unknown-node", None), ("isolated", "c"), ("isolated", None)], key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Join" not in plan
