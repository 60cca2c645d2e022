"""Row operators on small frames with NULLs, duplicates, ties and rejects."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import dates, numbers, text
from tallyloom.operators import aggregate as agg
from tallyloom.operators import compare, joins, load, reshape, select, sets
from tallyloom.operators.aggregate import Agg, Measure, Summary
from tallyloom.operators.select import Clause, Condition, Parameter
from tallyloom.operators.topn import OTHERS_LAST, TopN, top_n_others


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "Ann", "A", 10.0), (2, "bob", "B", None), (3, None, "A", -5.0), (4, "Ann", None, 0.0), (None, "Eve", "B", 7.5)],
        "id int, name string, grp string, amount double",
    )


def test_filters_keep_every_row_once(people, listed):
    good, bad = select.split_filter(people, F.col("amount") > 1)
    assert listed(good.unionByName(bad)) == listed(people)
    flows = select.route(people, {"a": F.col("grp") == "A", "b": F.col("amount") > 0})
    assert {r.id for r in flows["default"].collect()} == {2, 4}
    assert [r.id for r in flows["a"].collect()] == [1, 3] and [r.id for r in flows["b"].collect()] == [1, None]
    exclusive = select.switch(people, "grp", {"A": "first", None: "none"})
    assert sum(f.count() for f in exclusive.values()) == 5 and exclusive["none"].count() == 1


def test_conditions(people):
    ids = lambda *c, how="and": [r.id for r in select.filter_rows(people, c, how).collect()]
    assert ids(Condition("name", "==", "")) == [3]
    assert ids(Condition("name", "!=", None), Condition("amount", ">=", 0)) == [1, 4, None]
    assert ids(Condition("name", "==", "bob", "lower"), Condition("amount", "<", 0), how="or") == [2, 3]
    assert ids(Condition("name", "==", "A.n", "matches")) == [1, 4]
    assert ids(Condition("name", "==", "A", "matches")) == []
    with pytest.raises(ValueError):
        ids(Condition("name", "<", None))


def test_record_selection(people):
    multi, optional = Parameter("g", multi_value=True), Parameter("low", optional=True)
    out = select.record_selection(people, [Clause("grp", "=", param="g"), Clause("amount", ">", param="low")], [multi, optional], {"g": ["A", "B"]})
    assert out.count() == 4
    with pytest.raises(ValueError):
        select.record_selection(people, [Clause("grp", "<>", param="g")], [multi], {"g": ["A"]})
    with pytest.raises(ValueError):
        select.record_selection(people, [Clause("grp", "=", param="x")])


def test_bind_params():
    sql, args = select.bind_params("select ${a}, ${b}, ${c}, ${d}", {"a": "353", "b": "", "c": "O'Hare", "d": "-1.5"})
    assert sql == "select :a, :b, :c, :d" and args == {"a": 353, "b": None, "c": "O'Hare", "d": -1.5}


def test_convert_types(spark, listed):
    df = spark.createDataFrame([("1", "2024-01-31"), ("x", "2024-02-30"), (None, None)], "n string, d string")
    good, reject = select.convert_types(df, {"n": "int", "d": "date"})
    assert good.count() == 2 and [r.reject_columns for r in reject.collect()] == ["n,d"]
    kept, none = select.convert_types(df, {"n": "int"}, on_error="null")
    assert kept.count() == 3 and none.count() == 0


def test_assert_rows(people):
    assert select.assert_rows(people, F.col("amount") >= 0, "drop").count() == 3
    counted, seen = select.assert_rows(people, F.col("amount") >= 0, "count")
    counted.collect()
    assert seen.get["bad_rows"] == 2
    with pytest.raises(Exception, match="negative"):
        select.assert_rows(people, F.col("amount") >= 0, "fail", "negative").collect()


def test_lookup_policies(spark, people, listed):
    ref = spark.createDataFrame([("A", 1, "x"), ("A", 2, "y"), ("B", 1, "z"), (None, 9, "n")], "g string, o int, label string")
    look = lambda **k: {r.id: r.label for r in joins.lookup(people, ref, [("grp", "g")], ["label"], **k).collect()}
    assert look(on_multiple="first", order="o") == {1: "x", 2: "z", 3: "x", 4: None, None: "z"}
    assert look(on_multiple="last", order="o", default={"label": "?"}) == {1: "y", 2: "z", 3: "y", 4: "?", None: "z"}
    assert set(look(on_multiple="any", inner=True)) == {1, 2, 3, None}
    with pytest.raises(Exception, match="several reference rows"):
        look(on_multiple="error")
    main, reject = joins.simple_join(people, ref, [("grp", "g")])
    assert listed(main.unionByName(reject)) == listed(people)


def test_interval_match_bounds(spark, listed):
    ref = spark.createDataFrame([(0.0, 10.0, "a"), (10.0, 20.0, "b"), (5.0, 5.0, "p"), (None, 3.0, "n"), (-1e6, 1e6, "all")], "lo double, hi double, tag string")
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (20.0,), (2e6,), (None,)], "v double")
    def hits(lo, hi):
        out = {}
        for r in joins.interval_match(df, "v", ref, "lo", "hi", {"tag": "tag"}, lo, hi).collect():
            out.setdefault(r.v, set()).add(r.tag)
        return out
    assert hits(False, False) == {0.0: {"a", "all"}, 5.0: {"a", "p", "all"}, 10.0: {"a", "b", "all"}, 20.0: {"b", "all"}, 2e6: {None}, None: {None}}
    assert hits(True, False)[10.0] == {"a", "all"} and hits(True, False)[5.0] == {"a", "all"}
    assert hits(False, True)[10.0] == {"b", "all"}


def test_interval_match_equals_brute_force(spark):
    import random

    rng = random.Random(7)
    spans = [(a := rng.uniform(-50, 50), a + rng.choice([0, 0.5, 3, 40]), i) for i in range(60)]
    points = [(rng.choice([rng.uniform(-60, 100), spans[i % 60][0]]),) for i in range(80)]
    out = joins.interval_match(
        spark.createDataFrame(points, "v double"), "v", spark.createDataFrame(spans, "lo double, hi double, i int"), "lo", "hi", {"i": "i"}, how="inner"
    )
    want = sorted((v, i) for (v,) in points for lo, hi, i in spans if lo <= v <= hi)
    assert sorted((r.v, r.i) for r in out.select("v", "i").collect()) == want


def test_fuzzy_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    pairs = joins.fuzzy_pairs(df, df, "w", "w", 2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b, distance(a, b)) for a in words for b in words if distance(a, b) <= 2}
    assert {tuple(r) for r in pairs.collect()} == want


def test_pairs_must_be_wanted(people):
    with pytest.raises(ValueError):
        joins.cross(people, people)
    with pytest.raises(ValueError):
        joins.link_tables({"a": people, "b": people.select(F.col("id").alias("x"))}, [])


def test_aggregates(people, listed):
    out = agg.aggregate(people, "grp", [Agg("n", "count", "amount"), Agg("s", "sum", "amount"), Agg("f", "first", "name", order="id"), Agg("d", "distinct", "name")])
    assert listed(out) == sorted([("A", 2, 5.0, "Ann", 1), ("B", 1, 7.5, "Eve", 2), (None, 1, 0.0, "Ann", 1)], key=repr)
    with pytest.raises(ValueError):
        agg.aggregate(people, "grp", [Agg("l", "list", "name")])
    with pytest.raises(ValueError):
        agg.crosstab(people, ["grp"], ["name"], [Measure("amount", "median")])
    spread = {r.id: r.sd for r in agg.spread_columns(people, "amount", "grp", {"sd": "StdDev"}).collect()}
    assert spread[4] is None and round(spread[1], 6) == round((112.5) ** 0.5, 6)


def test_percent_of_zero_whole(spark, listed):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 2.0), ("b", "y", -2.0)], "o string, i string, v double")
    assert listed(agg.percent_of_sum(df, "v", "i", "o")) == [("a", "x", 25.0), ("a", "y", 75.0), ("b", "x", 0.0), ("b", "y", 0.0)]


def test_list_values_in_parts(spark):
    df = spark.createDataFrame([("a", w) for w in "zyxwvx"] + [("b", None), ("b", "q")], "g string, w string")
    got = {(r.g, r.part): r.l for r in agg.list_values(df, "g", "w", "l", part_items=4).collect()}
    assert got == {("a", 1): "v,w,x,x", ("a", 2): "y,z", ("b", 1): "q"}
    distinct = {(r.g, r.part): r.l for r in agg.list_values(df, "g", "w", "l", "|", True, part_items=3).collect()}
    assert distinct == {("a", 1): "v|w|x", ("a", 2): "y|z", ("b", 1): "q"}


def test_subtotals_match_rollup(people, listed):
    out = agg.subtotals(people.fillna({"grp": "-", "name": "-"}), ["grp", "name"], [Summary("s", "Sum", "amount"), Summary("m", "Average", "amount")])
    by_level = {}
    for r in out.collect():
        by_level.setdefault(r.level, []).append(r.s)
    assert by_level[0] == [12.5] and sorted(by_level[1]) == [0.0, 5.0, 7.5] and len(by_level[2]) == 5


def test_effort_and_score(spark):
    df = spark.createDataFrame([(10, 8, 1, 1, 2, 3, 5)], "steps int, auto int, review int, manual int, untranslated int, reviewed_exprs int, total_exprs int")
    r = agg.effort_rollup(df).first()
    assert (r.assisted_hours, r.manual_hours, r.saved_hours, r.saved_pct) == (3.0, 9.0, 6.0, 67)
    assert [r.h for r in spark.range(3).select(agg.discounted_hours(F.col("id"), 2.0).alias("h")).collect()] == [0.0, 2.0, 3.2]


def test_top_n_others_nested(spark):
    data = [("DE", "n", 5), ("DE", "s", 7), ("DE", "w", 1), ("FR", "n", 9), ("FR", "s", 2), ("IT", "n", 1), ("ES", "n", 2), ("ES", "s", 9)]
    df = spark.createDataFrame(data, "c string, r string, v int")
    out, ranks = top_n_others(df, ["c", "r"], [TopN("c", "v", n=2), TopN("r", "v", n=1)])
    got = {(r.c, r.r, r.v) for r in out.collect()}
    # DE 13, ES and FR 11 tie at rank 2; the rank inside Others runs over its members together
    assert got == {("DE", "s", 7), ("DE", "Others", 5), ("DE", "Others", 1), ("FR", "n", 9), ("FR", "Others", 2), ("ES", "s", 9), ("ES", "Others", 2), ("Others", "n", 1)}
    assert out.filter("c = 'Others'").first()[ranks[0]] == OTHERS_LAST


def test_unique_rows(people, listed):
    unique, more = sets.unique_rows(people, "name", ["id"], case_sensitive=False)
    assert listed(unique.unionByName(more)) == listed(people) and [r.id for r in more.collect()] == [4]
    with pytest.raises(sets.LayoutMismatch):
        sets.unite([people, people.drop("name")])


def test_normalize_and_replace(spark):
    df = spark.createDataFrame([("a| b|a||", ), (None,)], "c string")
    assert [r.c for r in reshape.normalize(df, "c", "|", True, True, True).collect()] == ["a", "b"]
    texts = spark.createDataFrame([("The cat concat CAT $1",)], "c string")
    R = reshape.Replacement
    out = reshape.replace_values(texts, [R("c", "cat", "dog", whole_word=True), R("c", "CAT", "$2", case_sensitive=True), R("c", "c?nc*t", "#", glob=True)])
    assert out.first().c == "The dog # $2 $1"


def test_decompose_keeps_real_keys(spark, listed):
    df = spark.createDataFrame([(None, "Ann", 1), (None, "Ann", 2), (None, "Bob", 3), (77, "Cy", 4), (None, None, 5)], "cid long, name string, oid int")
    parts = reshape.decompose(df, {"c": ["cid", "name"], "o": ["cid", "oid"]}, [(("c", "cid"), ("o", "cid"))])
    assert listed(parts["c"]) == sorted([(1, "Ann"), (2, "Bob"), (77, "Cy")], key=repr)
    assert listed(parts["o"]) == sorted([(1, 1), (1, 2), (2, 3), (77, 4), (None, 5)], key=repr)


def test_load(spark, listed):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, n string, v double")
    source = spark.createDataFrame([(2, "B", 20.0), (3, "c", 3.0)], "k int, n string, v double")
    once = load.upsert(target, source, "k", ["v"])
    assert listed(once) == [(1, "a", 1.0), (2, "b", 20.0), (3, "c", 3.0)]
    assert listed(load.upsert(once, source, "k", ["v"])) == listed(once)
    with pytest.raises(ValueError):
        load.upsert(target, source, [])
    with pytest.raises(Exception, match="several"):
        load.upsert(target, source.union(source), "k").collect()
    feed = spark.createDataFrame([(1, "x", 9.0, 1, "update"), (1, "x", 9.0, 2, "delete"), (4, "d", 4.0, 1, "insert")], "k int, n string, v double, s int, op string")
    assert listed(load.apply_changes(target, feed, "k", "s", "op")) == [(2, "b", 2.0), (4, "d", 4.0)]


def test_diff(spark, people, listed):
    same = compare.diff_keyed(people.filter("id is not null"), people.filter("id is not null"), "id").report.first()
    assert same.verdict == "PASS" and same.parity == 1.0
    e = spark.createDataFrame([("north", "100.50"), ("south", "7"), ("east", "x")], "r string, t string")
    a = spark.createDataFrame([("north", " 100.5 ", 1), ("west", "9", 1), ("east", "z", 1), ("east", "y", 2)], "r string, t string, o int")
    d = compare.diff_keyed(e, a, "r", order="o")
    r = d.report.first()
    assert (r.matching_rows, r.mismatched_rows, r.missing_rows, r.extra_rows, r.actual_rows, r.verdict) == (1, 1, 1, 1, 4, "FAIL")
    assert listed(d.samples) == [("east", "t", "x", "y")] and listed(d.columns) == [("t", 1)]
    with pytest.raises(ValueError):
        compare.diff_keyed(e, people, "r")


def test_number_texts(spark):
    texts = ["$ 1,234.50", "(42.00)", "007", "ACC-100501", "-3.10", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(numbers.canonical_number(F.col("t"))).collect()] == ["1234.5", "-42", "7", None, "-3.1", None, None]
    ref = spark.createDataFrame([("Total 10 of 12 on 2002/04/3",)], "t string")
    ren = spark.createDataFrame([("Total 10.00 of 13",)], "t string")
    r = compare.number_parity(ref, ren, "t", strip_dates=True).first()
    assert (r.matched, r.reference_total, r.missing, r.extra, r.verdict) == (1, 2, 1, 1, "FAIL")


def test_has_upstream_with_cycle(spark):
    nodes = spark.createDataFrame([(n, k) for n, k in zip("abcdef", ["goal", "x", "stop", "x", "x", "x"])], "name string, kind string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("e", "f"), ("f", "e"), ("b", "e")], "from_step string, to_step string")
    out = compare.has_upstream(nodes, edges, F.col("kind") == "goal", F.col("kind") == "stop")
    assert {r.name for r in out.collect() if r.reached} == {"a", "b", "e", "f"}


def test_text_and_dates(spark):
    swapped = "Côte d’Azur".encode("utf-16-le").decode("utf-16-be")
    df = spark.createDataFrame([(swapped,), ("漢字かな",), ("plain",), ("",)], "t string")
    assert [r[0] for r in df.select(text.repair_byteswapped(F.col("t"))).collect()] == ["Côte d’Azur", "漢字かな", "plain", ""]
    lines = spark.createDataFrame([("  Due  March 3,  2024: $ 1,200.50",), ("Marking up",), ("ab",)], "t string")
    assert [r[0] for r in lines.select(text.normal_line(F.col("t"))).collect()] == ["Due Mar # #: $#", "Marking up", ""]
    assert dates.java_pattern("MM/DD/YYYY HH24:MI:SS") == "MM/dd/yyyy HH:mm:ss"
    one = spark.range(1).select(
        dates.make(F.lit(2024), F.lit(13), F.lit(0)).alias("a"), dates.diff("m", F.lit("2024-01-31").cast("date"), F.lit("2024-02-01").cast("date")).alias("b"),
        dates.elapsed("m", F.lit("2024-01-31").cast("date"), F.lit("2024-02-01").cast("date")).alias("c"), text.chr_(F.lit(0x20AC)).alias("d"),
    ).first()
    assert (str(one.a), one.b, one.c, one.d) == ("2024-12-31", 1, 0, "€")
