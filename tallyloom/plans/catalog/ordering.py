"""Order-dependent operators. Line order is ship date, then the identifying columns, which make it total."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import ordered, sets
from tallyloom.operators.topn import TopN, top_n_others as bucket_top_n
from tallyloom.plans.catalog import query, table

LINE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_W = "order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey rows unbounded preceding"


def _lines(spark, sf, *more):
    return table(spark, sf, "lineitem").select(*dict.fromkeys([*LINE, *more]))


@query(f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity) over (partition by l_suppkey {_W}) as running_qty,
  max(l_extendedprice) over (partition by l_suppkey {_W}) as running_max, count(l_discount) over (partition by l_suppkey {_W}) as running_n
from lineitem
""")
def running(spark, sf):
    rows = _lines(spark, sf, "l_quantity", "l_extendedprice", "l_discount")
    specs = [("Sum", "l_quantity", "running_qty"), ("Maximum", "l_extendedprice", "running_max"), ("Count", "l_discount", "running_n")]
    out = ordered.running_values(rows, specs, LINE, "l_suppkey")
    return out.select(*ID, "running_qty", "running_max", "running_n")


@query(f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity) over (partition by l_returnflag {_W}) as running_qty,
  round(avg(l_quantity) over (partition by l_returnflag {_W}), 6) as running_avg, min(l_quantity) over (partition by l_returnflag {_W}) as running_min
from lineitem
""")
def running_hot_groups(spark, sf):
    """Three groups hold all rows; limits are lowered so that they are cut into blocks at any scale."""
    rows = _lines(spark, sf, "l_returnflag", "l_quantity")
    specs = [("Sum", "l_quantity", "running_qty"), ("Average", "l_quantity", "running_avg"), ("Minimum", "l_quantity", "running_min")]
    out = ordered.running_values(rows, specs, LINE, "l_returnflag", hot_rows=1000)
    return out.select(*ID, "running_qty", F.round("running_avg", 6).alias("running_avg"), "running_min")


@query("""
with f as (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) = 1 as first from orders)
select o_orderkey, (sum(first::int) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding))::bigint as seen from f
""")
def running_distinct(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    out = ordered.running_distinct(rows, "o_orderpriority", "seen", ["o_orderdate", "o_orderkey"], "o_custkey")
    return out.select("o_orderkey", "seen")


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity) over ({_W}) as running_qty from lineitem")
def running_report_wide(spark, sf):
    out = ordered.running(_lines(spark, sf, "l_quantity"), "Sum", "l_quantity", "running_qty", LINE)
    return out.select(*ID, "running_qty")


@query(f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, (sum(l_quantity::decimal(10,2)) over (partition by l_returnflag {_W}))::double as running_qty,
  ((20000 * sum((l_quantity * 100)::bigint) over (partition by l_returnflag {_W}) + count(*) over (partition by l_returnflag {_W}))
  // (2 * count(*) over (partition by l_returnflag {_W})))::double / 1e6 as running_avg from lineitem
""")
def running_decimal(spark, sf):
    """Decimals in groups that are cut at any scale keep the plain window's types."""
    rows = _lines(spark, sf, "l_returnflag", "l_quantity").withColumn("l_quantity", F.col("l_quantity").cast("decimal(10,2)"))
    specs = [("Sum", "l_quantity", "running_qty"), ("Average", "l_quantity", "running_avg")]
    out = ordered.running_values(rows, specs, LINE, "l_returnflag", hot_rows=500, block_rows=200)
    return out.select(*ID, *[F.col(c).cast("double").alias(c) for c in ("running_qty", "running_avg")])


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (order by case when l_linenumber = 2 then 'nan'::double
  when l_linenumber = 5 then null else l_quantity end desc nulls last, l_orderkey, l_linenumber, l_partkey, l_suppkey) as nth from lineitem
""")
def running_nan_order(spark, sf):
    """Descending order with NaN first and NULL last, cut into blocks at any scale."""
    odd = F.when(F.col("l_linenumber") == 2, float("nan")).when(F.col("l_linenumber") == 5, None).otherwise(F.col("l_quantity"))
    rows = _lines(spark, sf, "l_quantity").withColumn("x", odd.cast("double"))
    return ordered.sequence(rows, "nth", ["x desc", *ID], hot_rows=500, block_rows=200).select(*ID, "nth")


@query("""
select l_linenumber, min(nth) as low, max(nth) as high, count(distinct nth) as numbers from
  (select l_linenumber, row_number() over (order by l_linenumber) as nth from lineitem) group by 1
""")
def running_low_cardinality(spark, sf):
    """Seven sort values for all rows: the row hash completes the order, and blocks stay small."""
    rows = ordered.sequence(_lines(spark, sf), "nth", ["l_linenumber"], hot_rows=500, block_rows=200)
    return rows.groupBy("l_linenumber").agg(F.min("nth").alias("low"), F.max("nth").alias("high"), F.count_distinct("nth").alias("numbers"))


@query("""
select event_id, lag(value, 1) over w as value_prev1, lag(value, 2) over w as value_prev2,
  lag(event_type, 1) over w as event_type_prev1, lag(event_type, 2) over w as event_type_prev2
from events window w as (partition by user_id order by ts, event_id)
""")
def previous_rows(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "value", "event_type")
    out = ordered.previous_rows(rows, ["value", "event_type"], 2, ["ts", "event_id"], "user_id")
    return out.drop("user_id", "ts", "value", "event_type")


@query("""
select l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, rank_index::int as rank_index from (
  select *, rank() over (partition by l_returnflag order by l_extendedprice desc) as rank_index from lineitem) where rank_index <= 10
""")
def rank_n(spark, sf):
    out = ordered.rank_n(_lines(spark, sf, "l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", 10)
    return out.select("l_returnflag", *ID, "rank_index")


@query("""
select c_custkey, rank_index::int as rank_index from (
  select c_custkey, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) as rank_index from customer where c_acctbal is not null)
where rank_index <= 3
""")
def rank_n_rows(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return ordered.rank_n(rows, "c_nationkey", "c_acctbal", 3, top=False, ties="row", order="c_custkey").select("c_custkey", "rank_index")


@query("""
select l_partkey, round(sum(l_quantity), 2) as qty, rank() over (order by round(sum(l_quantity), 2) desc) as rank_index from lineitem group by 1
""")
def rank_by_aggregate(spark, sf):
    return ordered.rank_by_aggregate(table(spark, sf, "lineitem"), "l_partkey", F.round(F.sum("l_quantity"), 2), "qty")


@query("select o_orderkey, (1000 + (row_number() over (order by o_orderdate desc, o_orderkey) - 1) * 10)::bigint as surrogate from orders")
def sequence(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ordered.sequence(rows, "surrogate", ["o_orderdate desc", "o_orderkey"], 1000, 10).select("o_orderkey", "surrogate")


@query("""
select p_partkey, (select max(o_orderkey) from orders) + row_number() over (order by p_name desc, p_partkey) as o_orderkey from part
""")
def continue_sequence(spark, sf):
    target, rows = table(spark, sf, "orders"), table(spark, sf, "part").select("p_partkey", "p_name")
    return ordered.continue_sequence(target, rows, "o_orderkey", ["p_name desc", "p_partkey"]).select("p_partkey", "o_orderkey")


@query("""
select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as record_no,
  dense_rank() over (order by o_custkey) as group_no from orders
""")
def record_and_group_number(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = ordered.record_number(rows, "record_no", ["o_orderdate", "o_orderkey"], "o_custkey")
    return ordered.group_number(out, "o_custkey", "group_no").select("o_orderkey", "record_no", "group_no")


@query("""
with base as (select r_name, n_name, c_custkey, c_acctbal from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
a as (select r_name, round(sum(c_acctbal), 6) as t from base group by 1),
ar as (select r_name, dense_rank() over (order by t desc) as rk from a),
o as (select case when rk <= 2 then base.r_name else 'Others' end as r_name, n_name, c_custkey, c_acctbal,
  case when rk <= 2 then rk else 2147483647 end as region_rank from base join ar on base.r_name = ar.r_name),
b as (select r_name, n_name, round(sum(c_acctbal), 6) as t from o group by 1, 2),
br as (select r_name, n_name, dense_rank() over (partition by r_name order by t desc) as rk from b)
select o.r_name, case when rk <= 3 then o.n_name else 'Others' end as n_name, c_custkey, region_rank::int as region_rank,
  (case when rk <= 3 then rk else 2147483647 end)::int as nation_rank
from o join br on o.r_name = br.r_name and o.n_name = br.n_name
""")
def top_n_others(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = (
        table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "c_custkey", "c_acctbal")
    )
    out, ranks = bucket_top_n(rows, ["r_name", "n_name"], [TopN("r_name", "c_acctbal", n=2), TopN("n_name", "c_acctbal", n=3)])
    return out.select("r_name", "n_name", "c_custkey", F.col(ranks[0]).alias("region_rank"), F.col(ranks[1]).alias("nation_rank"))


@query("""
with d as (select distinct user_id, date_diff('day', timestamp '2024-01-01', ts)::int as day from events),
i as (select *, day - row_number() over (partition by user_id order by day) as island from d),
r as (select user_id, min(day) as first_pos, max(day) as last_pos, count(*) as run_length from i group by user_id, island)
select user_id, first_pos, last_pos, run_length from (
  select *, row_number() over (partition by user_id order by run_length desc, first_pos) as rn from r) where rn = 1
""")
def longest_run(spark, sf):
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("day")
    return ordered.longest_run(table(spark, sf, "events").select("user_id", day), "user_id", "day")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def top_count(spark, sf):
    return ordered.top_count(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 100, "o_orderkey")


def _placed(sorted_rows):
    """Sorted rows with their place in the output, which nothing but the sort decides."""
    rows = sorted_rows.withColumn("__place", F.monotonically_increasing_id())
    return ordered.sequence(rows, "row_no", "__place").drop("__place")


@query("""
select row_number() over (order by lower(p_name), p_size desc, p_partkey) as row_no, p_partkey from part
""")
def sort_rows(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.initcap("p_name").alias("p_name"), "p_size")
    out = _placed(sets.sort_rows(rows, [("p_name", "asc", "alpha"), ("p_size", "desc", "num"), ("p_partkey", "asc")]))
    return out.select("row_no", "p_partkey")


@query("select row_number() over (order by o_orderstatus desc, o_orderdate, o_orderkey) as row_no, o_orderkey from orders")
def report_order(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderstatus", "o_orderdate", "o_orderkey")
    out = sets.report_order(rows, [("o_orderstatus", True)], [("o_orderdate", False), ("o_orderstatus", False), ("o_orderkey", False)])
    return _placed(out).select("row_no", "o_orderkey")


@query("""
select row_number() over (order by c_nationkey, c_mktsegment) as row_no, c_nationkey, c_mktsegment from (select distinct c_nationkey, c_mktsegment from customer)
""")
def sort_distinct(spark, sf):
    return _placed(sets.sort_distinct(table(spark, sf, "customer").select("c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"]))
