"""Aggregation, cross-tabs, nested totals, chart series and portfolio roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import aggregate as agg
from tallyloom.operators.aggregate import Agg, Factor, Measure, Summary
from tallyloom.plans.catalog import query, table


@query("""
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(avg(l_extendedprice), 4) as avg_price,
  count(l_discount) as n, min(l_shipdate) as first_ship, max(l_extendedprice) as max_price
from lineitem group by 1, 2
""")
def aggregate(spark, sf):
    out = agg.aggregate(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
        [
            Agg("sum_qty", "sum", "l_quantity"), Agg("avg_price", "avg", "l_extendedprice"), Agg("n", "count", "l_discount"),
            Agg("first_ship", "min", "l_shipdate"), Agg("max_price", "max", "l_extendedprice"),
        ],
    )
    return out.withColumns({"sum_qty": F.round("sum_qty", 2), "avg_price": F.round("avg_price", 4)})


@query("""
select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_order, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as last_price
from orders group by 1
""")
def aggregate_first_last(spark, sf):
    order = ["o_orderdate", "o_orderkey"]
    return agg.aggregate(
        table(spark, sf, "orders"), "o_custkey",
        [Agg("first_order", "first", "o_orderkey", order=order), Agg("last_price", "last", "o_totalprice", order=order)],
    )


@query("select l_returnflag, count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts from lineitem group by 1")
def aggregate_distinct(spark, sf):
    return agg.aggregate(
        table(spark, sf, "lineitem"), "l_returnflag",
        [Agg("suppliers", "distinct", "l_suppkey"), Agg("parts", "count_distinct", "l_partkey")],
    )


@query("""
select n_regionkey, 1 as part, string_agg(n_name, ',' order by n_name) as names from nation group by 1
""")
def list_values(spark, sf):
    return agg.list_values(table(spark, sf, "nation"), "n_regionkey", "n_name", "names")


@query("""
with s as (select *, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) - 1 as rn from orders)
select o_custkey, (rn // 4 + 1)::int as part, string_agg(o_orderpriority, ';' order by rn) as priorities from s group by o_custkey, rn // 4
""")
def list_values_parts(spark, sf):
    return agg.list_values(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "priorities", ";", part_items=4)


@query("""
select c_mktsegment, round(stddev_samp(c_acctbal), 4) as sd, round(var_pop(c_acctbal), 2) as vp from customer group by 1
""")
def aggregate_spread(spark, sf):
    out = agg.aggregate(
        table(spark, sf, "customer"), "c_mktsegment",
        [Agg("sd", "std_dev", "c_acctbal"), Agg("vp", "variance_pop", "c_acctbal")],
    )
    return out.withColumns({"sd": F.round("sd", 4), "vp": F.round("vp", 2)})


@query("select l_returnflag, median(l_extendedprice) as median from lineitem group by 1")
def median_values(spark, sf):
    return agg.median_values(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")


@query("""
select l_suppkey, round(sum(l_quantity * l_extendedprice), 2) as volume, round(sum(case when l_returnflag = 'R' then l_extendedprice end), 2) as returned,
  count(*) filter (l_discount > 0.05) as discounted
from lineitem group by 1
""")
def aggregate_expressions(spark, sf):
    out = agg.aggregate(
        table(spark, sf, "lineitem"), "l_suppkey",
        [
            Agg("volume", "sum", "l_quantity * l_extendedprice"),
            Agg("returned", "sum", "l_extendedprice", condition="l_returnflag = 'R'"),
            Agg("discounted", "count_rows", condition="l_discount > 0.05D"),
        ],
    )
    return out.withColumns({"volume": F.round("volume", 2), "returned": F.round("returned", 2)})


@query("select count(o_orderkey) as orders, round(sum(o_totalprice), 2) as total, min(o_orderdate) as first_day from orders")
def grand_total(spark, sf):
    out = agg.grand_total(
        table(spark, sf, "orders"),
        [Agg("orders", "count", "o_orderkey"), Agg("total", "sum", "o_totalprice"), Agg("first_day", "min", "o_orderdate")],
    )
    return out.withColumn("total", F.round("total", 2))


@query("""
select o_orderkey, round(sum(o_totalprice) over (partition by o_orderstatus), 2) as total_g1,
  round(sum(o_totalprice) over (partition by o_orderstatus, o_orderpriority), 2) as total_g2,
  count(o_totalprice) over (partition by o_orderstatus) as n_g1, count(o_totalprice) over (partition by o_orderstatus, o_orderpriority) as n_g2
from orders
""")
def group_totals(spark, sf):
    out = agg.group_totals(
        table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"],
        [Summary("total", "Sum", "o_totalprice"), Summary("n", "Count", "o_totalprice")],
    )
    return out.select(
        "o_orderkey", F.round("total_g1", 2).alias("total_g1"), F.round("total_g2", 2).alias("total_g2"), "n_g1", "n_g2"
    )


@query("""
select c_custkey, round(stddev_samp(c_acctbal) over w, 4) as sd, round(var_samp(c_acctbal) over w, 2) as va,
  round(stddev_pop(c_acctbal) over w, 4) as psd, round(var_pop(c_acctbal) over w, 2) as pva
from customer window w as (partition by c_nationkey)
""")
def spread_columns(spark, sf):
    out = agg.spread_columns(
        table(spark, sf, "customer"), "c_acctbal", "c_nationkey",
        {"sd": "StdDev", "va": "Variance", "psd": "PopStdDev", "pva": "PopVariance"},
    )
    return out.select("c_custkey", *[F.round(c, n).alias(c) for c, n in (("sd", 4), ("va", 2), ("psd", 4), ("pva", 2))])


@query("""
select o_orderpriority, o_orderstatus, round(sum(o_totalprice) * 100 / sum(sum(o_totalprice)) over (partition by o_orderpriority), 4) as percent
from orders group by 1, 2
""")
def percent_of_sum(spark, sf):
    out = agg.percent_of_sum(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    return out.withColumn("percent", F.round("percent", 4))


@query("""
select r_name, n_name, (2 - (grouping(r_name) + grouping(n_name)))::int as level, count(c_acctbal) as n,
  round(sum(c_acctbal), 2) as total, round(avg(c_acctbal), 4) as mean, max(c_acctbal) as top
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)
""")
def subtotals(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = (
        table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    out = agg.subtotals(
        rows, ["r_name", "n_name"],
        [Summary("n", "Count", "c_acctbal"), Summary("total", "Sum", "c_acctbal"), Summary("mean", "Average", "c_acctbal"),
         Summary("top", "Maximum", "c_acctbal")],
    )
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query("""
select c_custkey, round(sum(c_acctbal) over (partition by c_nationkey), 2) as total_g1, count(*) over (partition by c_nationkey) as n_g1,
  (select count(distinct i.c_mktsegment) from customer i where i.c_nationkey = o.c_nationkey) as kinds_g1,
  (select count(distinct i.c_nationkey) from customer i where i.c_nationkey = o.c_nationkey and i.c_mktsegment = o.c_mktsegment) as nations_g2
from customer o
""")
def group_totals_distinct(spark, sf):
    """Distinct counts on every row, beside summaries that add up."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    groups = ["c_nationkey", "c_mktsegment"]
    summaries = [Summary("total", "Sum", "c_acctbal"), Summary("n", "Count", "c_custkey"), Summary("kinds", "DistinctCount", "c_mktsegment")]
    out = agg.group_totals(rows, groups, summaries, [1])
    out = agg.group_totals(out, groups, [Summary("nations", "DistinctCount", "c_nationkey")], [2])
    return out.select("c_custkey", F.round("total_g1", 2).alias("total_g1"), "n_g1", "kinds_g1", "nations_g2")


@query("""
select o_orderstatus, o_orderpriority, count(o_custkey) as n, count(distinct o_custkey) as customers, round(stddev_samp(o_totalprice), 4) as spread,
  round(var_pop(o_custkey), 0) as even, (2 - grouping(o_orderstatus) - grouping(o_orderpriority))::int as level
from orders group by rollup (o_orderstatus, o_orderpriority)
""")
def subtotals_distinct(spark, sf):
    """Distinct counts and spreads at every level."""
    out = agg.subtotals(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], [
        Summary("n", "Count", "o_custkey"), Summary("customers", "DistinctCount", "o_custkey"),
        Summary("spread", "StdDev", "o_totalprice"), Summary("even", "PopVariance", "o_custkey"),
    ])
    return out.withColumns({"spread": F.round("spread", 4), "even": F.round("even", 0)})


@query("""
select o_orderpriority, """ + ", ".join(
    f"round(sum(o_totalprice) filter (o_orderstatus = '{s}'), 2) as {s.lower()}_total, count(o_totalprice) filter (o_orderstatus = '{s}') as {s.lower()}_n"
    for s in "FOP"
) + " from orders group by 1")
def crosstab(spark, sf):
    rows = table(spark, sf, "orders").withColumn("state", F.lower("o_orderstatus"))
    out = agg.crosstab(
        rows, ["o_orderpriority"], ["state"],
        [Measure("o_totalprice", "Sum", "total"), Measure("o_totalprice", "Count", "n")], values=["f", "o", "p"],
    )
    return out.withColumns({f"{s}_total": F.round(f"{s}_total", 2) for s in "fop"})


_MONTHS = [f"1995-{m:02d}-01" for m in range(1, 13)]


@query("select l_returnflag, " + ", ".join(
    f"round(sum(l_quantity) filter (make_date(year(l_shipdate), month(l_shipdate), 1) = date '{m}'), 2) as \"{m}\"" for m in _MONTHS
) + " from lineitem group by 1")
def crosstab_dimension(spark, sf):
    """Months, computed from their parts, as columns."""
    month = agg.date_dimension(F.year("l_shipdate"), F.month("l_shipdate"), 1)
    rows = table(spark, sf, "lineitem").withColumn("month", month)
    out = agg.crosstab(rows, ["l_returnflag"], ["month"], [Measure("l_quantity")], values=_MONTHS)
    return out.withColumns({m: F.round(F.col(f"`{m}`"), 2) for m in _MONTHS})


@query("""
select o_orderstatus, dense_rank() over (order by o_custkey) as column_no, o_custkey::varchar as column_label, round(sum(o_totalprice), 2) as total,
  count(*) as n from orders group by o_orderstatus, o_custkey
""")
def crosstab_long(spark, sf):
    """A column for each customer."""
    out = agg.crosstab_long(
        table(spark, sf, "orders"), ["o_orderstatus"], ["o_custkey"], [Measure("o_totalprice", "Sum", "total"), Measure("o_totalprice", "Count", "n")]
    )
    return out.withColumn("total", F.round("total", 2))


@query("""
with t as (select o_orderstatus, o_totalprice, case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then 'a|b' else 'a' end as x,
  case when o_orderkey % 2 = 0 then 'c' else 'b|c' end as y from orders)
select o_orderstatus, count(*) filter (x is null and y = 'c') as none_c, count(*) filter (x is null and y = 'b|c') as none_bc,
  count(*) filter (x = 'a|b' and y = 'c') as ab_c, count(*) filter (x = 'a' and y = 'b|c') as a_bc from t group by 1
""")
def crosstab_like_labels(spark, sf):
    """Cells whose values differ although joined labels with a bar would be equal."""
    third, even = F.col("o_orderkey") % 3, F.col("o_orderkey") % 2 == 0
    rows = table(spark, sf, "orders").withColumns({
        "x": F.when(third == 1, "a|b").when(third == 2, "a"), "y": F.when(even, "c").otherwise("b|c"), "one": F.lit(1),
    })
    cells = {(None, "c"): "none_c", (None, "b|c"): "none_bc", ("a|b", "c"): "ab_c", ("a", "b|c"): "a_bc"}
    out = agg.crosstab(rows, ["o_orderstatus"], ["x", "y"], [Measure("one", "Count")], list(cells), label_sep="/")
    named = out.withColumnsRenamed({"/".join(v or "" for v in k): n for k, n in cells.items()})
    return named.withColumns({n: F.coalesce(n, F.lit(0)) for n in cells.values()})


@query("select c_nationkey, 1 as part, string_agg(distinct c_mktsegment, '|' order by c_mktsegment) as segments from customer group by 1")
def denormalize_list(spark, sf):
    return agg.denormalize_list(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment", "|", True, "segments")


@query("""
select o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) filter (o_orderpriority = '1-URGENT') as urgent_price,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) filter (o_orderpriority = '5-LOW') as low_price
from orders group by 1
""")
def denormalize_keys(spark, sf):
    return agg.denormalize_keys(
        table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_totalprice",
        {"1-URGENT": "urgent_price", "5-LOW": "low_price"}, order=["o_orderdate", "o_orderkey"],
    )


@query("""
select flag as l_returnflag, series, value from (
  select l_returnflag as flag, 'quantity' as series, round(sum(l_quantity), 2) as value from lineitem group by 1
  union all select l_returnflag, 'price', round(sum(l_extendedprice), 2) from lineitem group by 1)
""")
def category_series(spark, sf):
    out = agg.category_series(table(spark, sf, "lineitem"), "l_returnflag", {"l_quantity": "quantity", "l_extendedprice": "price"})
    return out.withColumn("value", F.round("value", 2))


@query("""
select c_mktsegment, round(sum(c_acctbal), 2) as total, round(sum(c_acctbal) * 100 / sum(sum(c_acctbal)) over (), 4) as share from customer group by 1
""")
def pie_series(spark, sf):
    out = agg.pie_series(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
    return out.withColumns({"total": F.round("total", 2), "share": F.round("share", 4)})


@query("select p_brand as series, p_size as x, p_retailprice as y, p_partkey as z from part where p_size is not null and p_retailprice is not null")
def xy_series(spark, sf):
    return agg.xy_series(table(spark, sf, "part"), "p_brand", "p_size", "p_retailprice", "p_partkey")


@query("select event_type, date_trunc('day', ts)::timestamp as period, round(sum(value), 2) as value from events group by 1, 2")
def time_series(spark, sf):
    out = agg.time_series(table(spark, sf, "events"), "event_type", "ts", "value", "day")
    return out.select("event_type", F.col("period").cast("timestamp_ntz").alias("period"), F.round("value", 2).alias("value"))


@query("""
with n as (select c_custkey, count(o_orderkey) filter (o_orderpriority = '1-URGENT') as urgent from customer left join orders on o_custkey = c_custkey group by 1),
b as (select case when urgent = 0 then '0 (hand over)' when urgent = 1 then '1' when urgent = 2 then '2' when urgent <= 5 then '3-5' else '6+' end as bin, count(*) as rows from n group by 1)
select bin_no, a.bin, coalesce(rows, 0) as rows
from (values (0, '0 (hand over)'), (1, '1'), (2, '2'), (3, '3-5'), (4, '6+')) a(bin_no, bin) left join b on a.bin = b.bin
""")
def binned_counts(spark, sf):
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    customers = table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return agg.binned_counts(customers.withColumn("urgent", F.coalesce("urgent", F.lit(0))), "urgent", agg.LOAD_BINS)


@query("""
select p_type, count(*) as rows, min(case when p_type in ('ECONOMY', 'SMALL') then null else 'catalogued' end) as mapped,
  min(case when p_type in ('ECONOMY', 'SMALL') then 'manual' else 'auto' end) as status from part group by 1
""")
def coverage_report(spark, sf):
    known = ~F.col("p_type").isin("ECONOMY", "SMALL")
    rows = table(spark, sf, "part").withColumns(
        {"mapped": F.when(known, "catalogued"), "status": F.when(known, "auto").otherwise("manual")}
    )
    return agg.coverage_report(rows, "p_type", "status", "mapped")


@query("""
select count(*) as total, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o,
  count(*) filter (o_orderstatus = 'F') / count(*) as f_rate, count(*) filter (o_orderstatus = 'O') / count(*) as o_rate from orders
""")
def status_rates(spark, sf):
    out = agg.status_rates(table(spark, sf, "orders"), "o_orderstatus", ["F", "O"])
    return out.select("total", F.col("F").alias("f"), F.col("O").alias("o"), F.col("F_rate").alias("f_rate"), F.col("O_rate").alias("o_rate"))


@query("""
with f as (select o_custkey,
  round_even(avg(case o_orderstatus when 'F' then 0.9 when 'O' then 0.5 else 0.1 end::double) * 100, 0)::int as mapping,
  round_even(avg(case o_orderpriority when '1-URGENT' then 0.3 when '2-HIGH' then 0.45 when '3-MEDIUM' then 0.7 else 0.95 end::double) * 100, 0)::int as impact
  from orders group by 1),
s as (select *, round_even(round(0.0::double + mapping * 0.6::double + impact * 0.4::double, 9), 0)::int as score from f)
select *, case when score >= 85 then 'A' when score >= 70 then 'B' when score >= 55 then 'C' when score >= 40 then 'D' else 'E' end as grade from s
""")
def weighted_score(spark, sf):
    mapping = F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.5).otherwise(0.1)
    impact = (
        F.when(F.col("o_orderpriority") == "1-URGENT", 0.3).when(F.col("o_orderpriority") == "2-HIGH", 0.45)
        .when(F.col("o_orderpriority") == "3-MEDIUM", 0.7).otherwise(0.95)
    )
    return agg.weighted_score(
        table(spark, sf, "orders"), "o_custkey", [Factor("mapping", mapping, 0.6), Factor("impact", impact, 0.4, empty=1.0)], order="o_orderkey"
    )


_COUNTS = """
with c as (select o_custkey, count(*) as steps, count(*) filter (o_orderstatus = 'F') as auto, count(*) filter (o_orderstatus = 'O') as review,
  count(*) filter (o_orderstatus = 'P') as manual, count(*) filter (o_orderpriority = '1-URGENT') as untranslated,
  count(*) filter (o_orderpriority = '2-HIGH') as reviewed_exprs, count(*) filter (o_orderpriority in ('1-URGENT', '2-HIGH')) as total_exprs
  from orders group by 1),
v as (select *, case when auto > 0 then pow(auto, 0.8::double) else 0 end as va, case when review > 0 then pow(review, 0.8::double) else 0 end as vr,
  case when manual > 0 then pow(manual, 0.8::double) else 0 end as vm, case when untranslated > 0 then pow(untranslated, 0.8::double) else 0 end as vu,
  case when reviewed_exprs > 0 then pow(reviewed_exprs, 0.8::double) else 0 end as ve, case when steps > 0 then pow(steps, 0.8::double) else 0 end as vs,
  case when total_exprs > 0 then pow(total_exprs, 0.8::double) else 0 end as vt from c),
a as (select *, greatest(round_even((0.35::double + va * 0.03::double + vr * 0.3::double + vm * 1.5::double + vu * 0.1::double + ve * 0.03::double) * 1.15::double * 2, 0) / 2, 0.5::double) as assisted_hours,
  greatest(round_even((0.75::double + vs * 1.0::double + vt * 0.15::double) * 1.2::double * 2, 0) / 2, 0.5::double) as m from v),
r as (select *, greatest(m, assisted_hours) as manual_hours from a)
"""


def _effort(spark, sf):
    count = lambda c, *vs: F.count_if(F.col(c).isin(*vs))
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("steps"), count("o_orderstatus", "F").alias("auto"), count("o_orderstatus", "O").alias("review"),
        count("o_orderstatus", "P").alias("manual"), count("o_orderpriority", "1-URGENT").alias("untranslated"),
        count("o_orderpriority", "2-HIGH").alias("reviewed_exprs"), count("o_orderpriority", "1-URGENT", "2-HIGH").alias("total_exprs"),
    )
    return agg.effort_rollup(counts)


@query(_COUNTS + """
select o_custkey, assisted_hours, manual_hours, manual_hours - assisted_hours as saved_hours,
  case when manual_hours > 0 then round_even((manual_hours - assisted_hours) / manual_hours * 100, 0)::int else 0 end as saved_pct from r
""")
def effort_rollup(spark, sf):
    return _effort(spark, sf).select("o_custkey", "assisted_hours", "manual_hours", "saved_hours", "saved_pct")


@query(_COUNTS + """
select case when manual > 4 then 1 when manual > 0 then 2 else 3 end as priority, c_mktsegment as title,
  count(distinct o_custkey) as entities, sum(manual)::bigint as items, round(sum(manual_hours), 2) as hours
from r join customer on o_custkey = c_custkey group by 1, 2
""")
def rollup_by_kind(spark, sf):
    priority = F.when(F.col("manual") > 4, 1).when(F.col("manual") > 0, 2).otherwise(3)
    rows = _effort(spark, sf).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(priority.alias("priority"), F.col("c_mktsegment").alias("title"), "o_custkey", "manual", "manual_hours")
    return agg.rollup_by_kind(rows, ["priority", "title"], "o_custkey", "manual", "manual_hours")
