"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import numbers
from tallyloom.operators import joins
from tallyloom.operators.joins import Lookup, Output
from tallyloom.plans.catalog import query, table


@query("""
select o_orderkey, c_name, o_totalprice from orders right join customer on o_custkey = c_custkey
""")
def joiner(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return joins.joiner(orders, customer, [("o_custkey", "c_custkey")], "right").select("o_orderkey", "c_name", "o_totalprice")


@query("""
select coalesce(c_nationkey, s_nationkey) as nation, customers, suppliers
from (select c_nationkey, count(*) as customers from customer where c_nationkey < 20 group by 1)
full join (select s_nationkey, count(*) as suppliers from supplier where s_nationkey > 4 group by 1) on c_nationkey = s_nationkey
""")
def joiner_full(spark, sf):
    c = table(spark, sf, "customer").filter("c_nationkey < 20").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf, "supplier").filter("s_nationkey > 4").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    both = joins.joiner(c, s, [("c_nationkey", "s_nationkey")], "full")
    return both.select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "customers", "suppliers")


@query("""
select c_custkey, coalesce(k.o_orderkey, -1) as last_order, k.o_totalprice as last_price, k.o_orderkey is not null as has_order
from customer left join (
  select * from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) where rn = 1
) k on c_custkey = k.o_custkey
""")
def lookup(spark, sf):
    return joins.lookup(
        table(spark, sf, "customer"), table(spark, sf, "orders"), [("c_custkey", "o_custkey")],
        {"o_orderkey": "last_order", "o_totalprice": "last_price"}, default={"last_order": -1},
        on_multiple="last", order=["o_orderdate", "o_orderkey"], found="has_order",
    ).select("c_custkey", "last_order", "last_price", "has_order")


@query("""
select 'big' as flow, l_orderkey, l_linenumber, p_brand as brand, s_name as supplier from lineitem
  join part on l_partkey = p_partkey left join (select * from supplier where s_nationkey < 20) on l_suppkey = s_suppkey
  where l_extendedprice > 60000
union all
select 'rest', l_orderkey, l_linenumber, p_brand, null from lineitem
  join part on l_partkey = p_partkey where not (l_extendedprice > 60000)
""")
def multi_lookup(spark, sf):
    part = Lookup(table(spark, sf, "part"), [("l_partkey", "p_partkey")], {"p_brand": "brand"}, inner=True)
    supplier = Lookup(table(spark, sf, "supplier").filter("s_nationkey < 20"), [("l_suppkey", "s_suppkey")], {"s_name": "supplier"})
    flows = joins.multi_lookup(
        table(spark, sf, "lineitem"), [part, supplier],
        {
            "big": Output({"flow": F.lit("big"), "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "brand": "brand",
                           "supplier": "supplier"}, F.col("l_extendedprice") > 60000),
            "rest": Output({"flow": F.lit("rest"), "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "brand": "brand",
                            "supplier": F.lit(None).cast("string")}, catch_rejects=True),
        },
    )
    return flows["big"].unionByName(flows["rest"])


@query("""
select n_nationkey, n_name, c_custkey from nation left join customer on n_nationkey = c_nationkey and c_mktsegment = 'BUILDING'
""")
def all_matches(spark, sf):
    builders = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    return joins.all_matches(
        table(spark, sf, "nation"), builders, [("n_nationkey", "c_nationkey")], {"c_custkey": "c_custkey"}
    ).select("n_nationkey", "n_name", "c_custkey")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
def inner_reject(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 250000")
    return joins.inner_reject(table(spark, sf, "customer"), big, [("c_custkey", "o_custkey")]).select("c_custkey", "c_name")


@query("""
select o_orderkey from orders where not (coalesce(o_totalprice > 100000, false) or coalesce(o_orderstatus = 'F', false))
""")
def catch_output_reject(spark, sf):
    filters = [F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F"]
    return joins.catch_output_reject(table(spark, sf, "orders"), filters).select("o_orderkey")


@query("""
select 'main' as flow, s_suppkey, n_name as nation from supplier join nation on s_nationkey = n_nationkey where n_regionkey <> 2
union all
select 'reject', s_suppkey, null from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey <> 2)
""")
def simple_join(spark, sf):
    nation = table(spark, sf, "nation").filter("n_regionkey <> 2")
    main, reject = joins.simple_join(
        table(spark, sf, "supplier"), nation, [("s_nationkey", "n_nationkey")], True, {"n_name": "nation"}
    )
    a = main.select(F.lit("main").alias("flow"), "s_suppkey", "nation")
    return a.unionByName(reject.select(F.lit("reject").alias("flow"), "s_suppkey", F.lit(None).cast("string").alias("nation")))


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def semi_filter(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return joins.semi_filter(table(spark, sf, "customer"), urgent, [("c_custkey", "o_custkey")]).select("c_custkey", "c_name")


@query("""
with bands as (select min(p_retailprice) as lo, max(p_retailprice) as hi, p_brand || '/' || p_type as band from part group by p_brand, p_type),
q as (select distinct round(l_quantity * 30 + 850, 1) as v from lineitem)
select v, band from q left join bands on v > lo and v <= hi
""")
def interval_match(spark, sf):
    bands = table(spark, sf, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("band")).agg(
        F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")
    )
    probes = table(spark, sf, "lineitem").select(F.round(F.col("l_quantity") * 30 + 850, 1).alias("v")).distinct()
    out = joins.interval_match(probes, "v", bands, "lo", "hi", {"band": "band"}, lo_strict=True)
    return out.select("v", "band")


@query("""
select r_name, n_name, count(*) as customers, round(sum(o_totalprice), 2) as total
from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey
group by 1, 2
""")
def link_tables(spark, sf):
    tables = {n: table(spark, sf, n) for n in ("orders", "customer", "nation", "region")}
    links = [
        (("nation", "n_regionkey"), ("region", "r_regionkey")), (("customer", "c_nationkey"), ("nation", "n_nationkey")),
        (("orders", "o_custkey"), ("customer", "c_custkey")),
    ]
    return joins.link_tables(tables, links).groupBy("r_name", "n_name").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("""
with c as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as rn from orders)
select c_custkey, (coalesce(rn // 5, 0) + 1)::int as part, coalesce(string_agg(o_orderkey::varchar, ',' order by rn), '') as children
from customer left join c on c_custkey = o_custkey group by c_custkey, rn // 5
""")
def nest_children(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    nested = joins.nest_children(
        table(spark, sf, "customer").select("c_custkey"), orders, [("c_custkey", "o_custkey")], ["o_orderdate", "o_orderkey"],
        part_rows=5,
    )
    listed = F.array_join(F.transform("children", lambda r: r["o_orderkey"].cast("string")), ",")
    return nested.select("c_custkey", "part", listed.alias("children"))


@query("""
with p as (select n_nationkey as period, date '1995-02-01' + n_nationkey::int * 100 as low, date '1995-02-01' + n_nationkey::int * 100 + 100 as high from nation)
select o_orderkey, a.period as starts_in, b.period as ends_in from orders
  left join p a on o_orderdate::date >= a.low and o_orderdate::date < a.high left join p b on o_orderdate::timestamp > b.low and o_orderdate::timestamp <= b.high
""")
def interval_match_dates(spark, sf):
    """Effective periods by date, the last day left out, and by timestamp, the first moment left out."""
    nation = table(spark, sf, "nation")
    low = F.date_add(F.lit("1995-02-01").cast("date"), (F.col("n_nationkey") * 100).cast("int"))
    days = nation.select("n_nationkey", low.alias("low"), F.date_add(low, 100).alias("high"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    by_day = joins.interval_match(orders, "day", days, "low", "high", {"n_nationkey": "starts_in"}, hi_strict=True)
    times = days.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("low", "high")})
    both = joins.interval_match(by_day, "at", times, "low", "high", {"n_nationkey": "ends_in"}, lo_strict=True)
    return both.select("o_orderkey", "starts_in", "ends_in")


@query("""
with r as (select n_nationkey, n_nationkey * 700 as low, n_nationkey * 700 + 699 as high from nation)
select c_custkey, n_nationkey as block from customer left join r on c_custkey between low and high
""")
def interval_match_addresses(spark, sf):
    """Ranges of addresses in dotted text."""
    dotted = lambda n: F.concat_ws(".", *[F.pmod(F.floor(n / d), F.lit(256)).cast("string") for d in (1 << 24, 1 << 16, 1 << 8, 1)])
    nation = table(spark, sf, "nation").select("n_nationkey", dotted(F.col("n_nationkey") * 700).alias("low"), dotted(F.col("n_nationkey") * 700 + 699).alias("high"))
    ranges = nation.withColumns({c: numbers.address_number(F.col(c)) for c in ("low", "high")})
    customers = table(spark, sf, "customer").select("c_custkey", numbers.address_number(dotted(F.col("c_custkey"))).alias("address"))
    return joins.interval_match(customers, "address", ranges, "low", "high", {"n_nationkey": "block"}).select("c_custkey", "block")


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / coalesce(p_retailprice, 1) as price_ratio
from lineitem left join (select * from part where p_size > 10) on l_partkey = p_partkey
""")
def unconnected_lookup(spark, sf):
    part = table(spark, sf, "part").filter("p_size > 10")
    looked = joins.unconnected_lookup(
        table(spark, sf, "lineitem"), part, [("l_partkey", "p_partkey")], "p_retailprice", "list_price", 1.0
    )
    return looked.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("list_price")).alias("price_ratio")
    )


@query("""
with names as (select distinct p_name from part), refs as (select distinct replace(p_name, 'e', 'a') as ref from part),
pairs as (select p_name, ref, levenshtein(p_name, ref) as d from names, refs where levenshtein(p_name, ref) <= 2),
best as (select p_name, ref, d from (select *, row_number() over (partition by p_name order by d, ref) rn from pairs) where rn = 1)
select p_partkey, b.ref as match, b.d::int as distance from part left join best b using (p_name)
""")
def fuzzy_match(spark, sf):
    part = table(spark, sf, "part")
    refs = part.select(F.replace("p_name", F.lit("e"), F.lit("a")).alias("ref"))
    return joins.fuzzy_match(part, refs, "p_name", "ref").select("p_partkey", "match", "distance")


@query("""
with names as (select distinct p_name as value from part), refs as (select distinct replace(p_name, 'e', 'a') as match from part),
pairs as (select value, match, levenshtein(value, match) as distance, greatest(length(value), length(match)) as longer from names, refs),
near as (select *, row_number() over (partition by value order by distance / longer, match) as rank from pairs where distance * 100 <= longer * 30)
select value, rank::int as rank, match, distance::int as distance, round(1 - distance / longer, 4) as similarity from near where rank <= 4
""")
def fuzzy_top_k(spark, sf):
    part = table(spark, sf, "part")
    return joins.fuzzy_top_k(part, part.select(F.replace("p_name", F.lit("e"), F.lit("a")).alias("ref")), "p_name", "ref", 70, 4)


@query("""
with o as (select c_custkey, c_name, c_mktsegment from customer where c_custkey % 10 <> 3),
n as (select c_custkey, c_name, case when c_custkey % 7 = 0 then 'CHANGED' else c_mktsegment end as c_mktsegment from customer where c_custkey % 10 <> 4)
select coalesce(n.c_custkey, o.c_custkey) as c_custkey,
  case when n.c_custkey is null then o.c_name else n.c_name end as c_name,
  case when n.c_custkey is null then o.c_mktsegment else n.c_mktsegment end as c_mktsegment,
  case when o.c_custkey is null then 'new' when n.c_custkey is null then 'deleted'
    when o.c_name is distinct from n.c_name or o.c_mktsegment is distinct from n.c_mktsegment then 'changed' else 'identical' end as flag
from o full join n on o.c_custkey = n.c_custkey
""")
def diff_rows(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changed = F.when(F.col("c_custkey") % 7 == 0, "CHANGED").otherwise(F.col("c_mktsegment"))
    old = base.filter("c_custkey % 10 <> 3")
    new = base.filter("c_custkey % 10 <> 4").withColumn("c_mktsegment", changed)
    return joins.diff_rows(old, new, "c_custkey")


@query("""
select n_name, p.o_orderpriority, count(o_orderkey) as orders from nation cross join (select distinct o_orderpriority from orders) p
left join (select c_nationkey, o_orderpriority, o_orderkey from orders join customer on o_custkey = c_custkey where o_totalprice > 480000) o
  on o.c_nationkey = n_nationkey and o.o_orderpriority = p.o_orderpriority group by 1, 2
""")
def cross(spark, sf):
    """Zero-filled grid: every nation with every priority (25 x 5 at any scale), counted orders joined to it."""
    nation, orders = table(spark, sf, "nation").select("n_nationkey", "n_name"), table(spark, sf, "orders")
    grid = joins.cross(nation, orders.select("o_orderpriority").distinct(), allow_pairs=True)
    counts = (
        orders.filter("o_totalprice > 480000").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    )
    filled = grid.join(counts, ["n_nationkey", "o_orderpriority"], "left")
    return filled.select("n_name", "o_orderpriority", F.coalesce("orders", F.lit(0)).alias("orders"))
