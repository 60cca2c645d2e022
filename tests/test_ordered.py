"""Order-dependent operators: cut groups must give what one window gives."""

import itertools

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.core import OrderRequired, order_columns, sort_keys
from tallyloom.operators import ordered

SCHEMA = "g string, t int, id int, v double, word string"


@pytest.fixture(scope="module")
def data(spark):
    """One group holds most rows; NULL groups, NULL order values, ties, NULL and negative measures."""
    rows = []
    for i in range(600):
        g = "hot" if i % 3 else (None if i % 9 == 0 else f"g{i % 7}")
        t = None if i % 41 == 0 else (i * 37) % 50
        v = None if i % 11 == 0 else float((i * 13) % 29 - 10)
        rows.append((g, t, i, v, "abc"[i % 3] * (i % 4)))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


ORDERS = [["t", "id"], ["t desc", "id"], ["word desc", "t", "id desc"], ["v", "id desc"], ["id desc"]]
LIMITS = [{}, {"hot_rows": 20, "block_rows": 30}]


def window(order, keys=("g",)):
    return Window.partitionBy(*keys).orderBy(*order_columns(sort_keys(order, "test")))


@pytest.mark.parametrize("order", ORDERS, ids=str)
def test_running_equals_window_when_cut(data, listed, order):
    fns = {"sum": F.sum, "count": F.count, "average": F.avg, "maximum": F.max, "minimum": F.min}
    w = window(order).rowsBetween(Window.unboundedPreceding, 0)
    specs = [(op, "v", op) for op in fns]
    got = ordered.running_values(data, specs, order, "g", hot_rows=20, block_rows=30)
    want = data.withColumns({op: fn("v").over(w) for op, fn in fns.items()})
    near = {op: F.round(op, 6) for op in fns}
    assert listed(got.withColumns(near)) == listed(want.withColumns(near))


@pytest.mark.parametrize("order", ORDERS, ids=str)
def test_report_wide_running_and_sequence(data, listed, order):
    w = Window.orderBy(*order_columns(sort_keys(order, "test")))
    got = ordered.running(data, "sum", "v", "s", order, block_rows=30)
    assert listed(got) == listed(data.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    numbered = ordered.sequence(data, "n", order, start=10, step=5, block_rows=30)
    want = data.withColumn("n", (F.lit(10) + (F.row_number().over(w) - 1) * 5).cast("long"))
    assert listed(numbered) == listed(want)


@pytest.mark.parametrize("order,n", list(itertools.product(ORDERS[:3], [1, 4])), ids=str)
def test_previous_rows_across_blocks(data, listed, order, n):
    got = ordered.previous_rows(data, ["v", "word"], n, order, "g", hot_rows=20, block_rows=10)
    lags = {f"{c}_prev{i}": F.lag(c, i).over(window(order)) for c in ("v", "word") for i in range(1, n + 1)}
    assert listed(got) == listed(data.withColumns(lags))


@pytest.mark.parametrize("limits", LIMITS, ids=str)
def test_running_distinct(data, limits):
    got = ordered.running_distinct(data, "word", "n", ["t", "id"], "g", **limits)
    seen = {}
    for r in sorted(got.collect(), key=lambda r: (r.g is not None, r.g or "", r.t is not None, r.t or 0, r.id)):
        words = seen.setdefault(r.g, set())
        words.add(r.word)
        assert r.n == len(words)


@pytest.mark.parametrize("limits", LIMITS, ids=str)
def test_hide_repeats(data, listed, limits):
    got = ordered.hide_repeats(data, "word", ["t", "id"], "g", out="shown", **limits)
    w = window(["t", "id"])
    same = F.coalesce(F.lag("word").over(w) == F.col("word"), F.lit(False))
    assert listed(got) == listed(data.withColumn("shown", F.when(~same, F.col("word"))))


def test_same_result_for_any_shuffle_width(spark, data, listed):
    results = []
    for width in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        results.append(listed(ordered.running(data, "sum", "v", "s", ["t", "id"], "g", hot_rows=20, block_rows=30)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_longest_run(spark, listed):
    df = spark.createDataFrame([("a", p) for p in (1, 2, 3, 7, 8, 9, 9)] + [("b", 5), (None, 1), (None, 2)], "k string, p int")
    assert listed(ordered.longest_run(df, "k", "p")) == sorted(
        [("a", 1, 3, 3), ("b", 5, 5, 1), (None, 1, 2, 2)], key=repr
    )


@pytest.mark.parametrize("ties,fn", [("rank", F.rank), ("dense", F.dense_rank)])
@pytest.mark.parametrize("top", [True, False])
def test_rank_n_with_ties(data, listed, ties, fn, top):
    w = Window.partitionBy("g").orderBy(F.col("v").desc() if top else F.col("v").asc())
    got = ordered.rank_n(data, "g", "v", 3, "r", top, ties)
    want = data.filter("v is not null").withColumn("r", fn().over(w)).filter("r <= 3")
    assert listed(got) == listed(want)


def test_rank_n_beyond_the_group_limit(data, listed, monkeypatch):
    near = ordered.rank_n(data, "g", "v", 5, "r"), ordered.rank_n(data, "g", "v", 5, "r", ties="row", order="id")
    want = [listed(df) for df in near]
    monkeypatch.setattr(ordered, "GROUP_LIMIT", 1)
    monkeypatch.setattr(ordered, "HOT_ROWS", 20)
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 10)
    far = ordered.rank_n(data, "g", "v", 5, "r"), ordered.rank_n(data, "g", "v", 5, "r", ties="row", order="id")
    assert [listed(df) for df in far] == want


def test_median(data):
    from tallyloom.operators.aggregate import median_values

    want = {r.g: r.m for r in data.groupBy("g").agg(F.median("v").alias("m")).collect()}
    got = {r.g: r.median for r in median_values(data, "g", "v", hot_rows=5, block_rows=4).collect()}
    assert got == want


def test_rank_by_aggregate(data, listed):
    got = ordered.rank_by_aggregate(data, "word", F.count("v"), "n", block_rows=2)
    w = Window.orderBy(F.col("n").desc())
    want = data.groupBy("word").agg(F.count("v").alias("n")).withColumn("rank_index", F.rank().over(w).cast("long"))
    assert listed(got) == listed(want)


def test_numbers(data):
    top = ordered.continue_sequence(data.select(F.col("id").alias("sk")), data.select("id"), "sk", "id")
    assert [r.sk for r in top.orderBy("id").limit(2).collect()] == [600, 601]
    groups = ordered.group_number(data, "g", "n").select("g", "n").distinct().orderBy("n").collect()
    assert [r.n for r in groups] == list(range(1, len(groups) + 1)) and groups[0].g is None
    lines = ordered.sample_lines(data, "1,3..4,600,700", "id").orderBy("id")
    assert [r.id for r in lines.collect()] == [0, 2, 3, 599]


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ordered.running(empty, "sum", "v", "s", "id").count() == 0
    assert ordered.previous_rows(empty, "v", 2, "id", "g").count() == 0
    one = spark.createDataFrame([("a", 1, 1, 5.0, "x")], SCHEMA)
    assert ordered.running(one, "average", "v", "s", "id").first().s == 5.0


def test_order_is_required(data):
    with pytest.raises(OrderRequired):
        ordered.running(data, "sum", "v", "s", [])


def test_report_wide_plan_has_no_single_partition_of_rows(data):
    plan = ordered.running(data, "sum", "v", "s", "id", block_rows=30)._jdf.queryExecution().executedPlan().toString()
    # the only single partition holds one row per block: it sits above an aggregate by block
    rows_side = plan.split("BroadcastExchange")[0]
    assert "SinglePartition" not in rows_side


@pytest.fixture
def by_ranges(monkeypatch):
    """All that is cut is cut by range partitions."""
    monkeypatch.setattr(ordered, "MAX_BLOCKS", 1)
    calls, plain = [], ordered._range_blocks

    def spy(*args):
        calls.append(args[3])
        return plain(*args)

    monkeypatch.setattr(ordered, "_range_blocks", spy)
    yield calls
    assert calls


@pytest.mark.parametrize("order", [["t", "id"], ["t desc", "id"]])
def test_range_blocks_equal_windows(data, listed, by_ranges, order):
    specs = [(op, "v", f"o_{op}") for op in ordered.RUNNING_OPS]
    for by in ("g", None):
        got = ordered.running_values(data, specs, order, by, hot_rows=20, block_rows=30)
        assert listed(got) == listed(ordered.running_values(data, specs, order, by))
        prev = ordered.previous_rows(data, ["v", "word"], 2, order, by, hot_rows=20, block_rows=10)
        assert listed(prev) == listed(ordered.previous_rows(data, ["v", "word"], 2, order, by))
        numbered = ordered.sequence(data, "n", order, by=by, hot_rows=20, block_rows=30)
        assert listed(numbered) == listed(ordered.sequence(data, "n", order, by=by))


def test_small_blocks_do_not_make_many_range_partitions(data, listed, by_ranges, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_PARTS", 4, raising=False)
    cut = ordered.cut_hot_groups(data, [], [("t", False), ("id", False)], block_rows=3)
    assert cut.df.select(cut.block).distinct().count() <= 4
    got = ordered.sequence(data, "n", ["t", "id"], block_rows=3)
    assert listed(got) == listed(data.withColumn("n", F.row_number().over(window(["t", "id"], ())).cast("long")))


def test_many_hot_groups_are_not_listed(spark, listed, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_LIST", 3)
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 40).alias("g"), (F.col("id") % 7).alias("v"))
    got = ordered.running(rows, "sum", "v", "s", "id", "g", hot_rows=10, block_rows=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert listed(got) == listed(ordered.running(rows, "sum", "v", "s", "id", "g")) and "ranges-" in plan
