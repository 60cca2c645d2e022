"""Projection, predicates and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import ordered, select
from tallyloom.operators.select import Case, Clause, Condition, Parameter
from tallyloom.plans.catalog import query, table


@query("select l_orderkey as order_key, l_extendedprice as price, l_linenumber as line from lineitem")
def select_columns(spark, sf):
    return select.select_columns(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_extendedprice", "l_linenumber"],
        {"l_orderkey": "order_key", "l_extendedprice": "price", "l_linenumber": "line"},
    )


def _raw_events(spark, sf):
    """Events with their value as text, unreadable for errors."""
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("#"), F.col("value").cast("string"))).otherwise(
        F.col("value").cast("string")
    )
    return table(spark, sf, "events").select("event_id", text.alias("value"), F.col("user_id").cast("string").alias("user_id"))


@query("select event_id, value, user_id::int as user_id from events where event_type <> 'error'")
def convert_types(spark, sf):
    return select.convert_types(_raw_events(spark, sf), {"value": "double", "user_id": "int"})[0]


@query("""
select event_id, user_id::varchar as user_id, 'value' as reject_columns from events where event_type = 'error'
""")
def convert_types_reject(spark, sf):
    reject = select.convert_types(_raw_events(spark, sf), {"value": "double", "user_id": "int"})[1]
    return reject.select("event_id", "user_id", "reject_columns")


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_extendedprice * (1 - l_discount) as net,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) as gross,
       case when l_extendedprice * (1 - l_discount) * (1 + l_tax) > 50000 then 'large' else 'small' end as size_class
from lineitem
""")
def derive(spark, sf):
    out = select.derive(
        table(spark, sf, "lineitem"),
        [
            ("net", "l_extendedprice * (1 - l_discount)"),
            ("gross", "net * (1 + l_tax)"),
            ("size_class", F.when(F.col("gross") > 50000, "large").otherwise("small")),
        ],
    )
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net", "gross", "size_class")


@query("""
select o_orderkey, o_orderstatus, o_totalprice from orders
where o_orderstatus is not null and o_totalprice >= 100000 and o_orderpriority <> '5-LOW'
""")
def filter_rows(spark, sf):
    return select.filter_rows(
        table(spark, sf, "orders"),
        [Condition("o_orderstatus", "!=", ""), Condition("o_totalprice", ">=", 100000), Condition("o_orderpriority", "!=", "5-LOW")],
    ).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""
select p_partkey, p_name from part
where length(p_name) > 12 or lower(p_type) = 'promo' or regexp_full_match(p_brand, 'Brand#1\\d')
""")
def filter_functions(spark, sf):
    return select.filter_rows(
        table(spark, sf, "part"),
        [
            Condition("p_name", ">", 12, "length"), Condition("p_type", "==", "promo", "lower"),
            Condition("p_brand", "==", r"Brand#1\d", "matches"),
        ],
        "or",
    ).select("p_partkey", "p_name")


@query("""
select 'pass' as flow, count(*) as rows, round(sum(c_acctbal), 2) as balance from customer where c_acctbal > 2500
union all select 'reject', count(*), round(sum(c_acctbal), 2) from customer where not coalesce(c_acctbal > 2500, false)
""")
def split_filter(spark, sf):
    good, bad = select.split_filter(table(spark, sf, "customer"), F.col("c_acctbal") > 2500)
    return select.flow_union({"pass": good, "reject": bad}).groupBy("flow").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query("""
select 'urgent' as flow, o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH')
union all select 'large', o_orderkey from orders where o_totalprice > 400000
union all select 'default', o_orderkey from orders
where not (o_orderpriority in ('1-URGENT', '2-HIGH') or o_totalprice > 400000)
""")
def route(spark, sf):
    flows = select.route(
        table(spark, sf, "orders"),
        {"urgent": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "large": F.col("o_totalprice") > 400000},
    )
    return select.flow_union(flows).select("flow", "o_orderkey")


@query("""
select case o_orderstatus when 'O' then 'open' when 'F' then 'done' else 'other' end as flow, o_orderkey from orders
""")
def switch(spark, sf):
    flows = select.switch(table(spark, sf, "orders"), "o_orderstatus", {"O": "open", "F": "done"}, "other")
    return select.flow_union(flows).select("flow", "o_orderkey")


@query("""
select o_orderkey, o_orderdate, o_totalprice from orders
where o_orderpriority in ('1-URGENT', '3-MEDIUM') and o_totalprice >= 250000 and o_orderstatus <> 'P'
""")
def record_selection(spark, sf):
    return select.record_selection(
        table(spark, sf, "orders"),
        [
            Clause("o_orderpriority", "=", param="prio"), Clause("o_totalprice", ">=", param="low"),
            Clause("o_orderstatus", "<>", "P"), Clause("o_custkey", "=", param="customer"),
        ],
        [Parameter("prio", multi_value=True), Parameter("low", 250000), Parameter("customer", optional=True)],
        {"prio": ["1-URGENT", "3-MEDIUM"]},
    ).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_acctbal > 1000")
def bind_params(spark, sf):
    sql, args = select.bind_params(
        f"select c_custkey, c_name from parquet.`{sf}/customer.parquet` where c_mktsegment = ${{segment}} and c_acctbal > ${{low}}",
        {"segment": "BUILDING", "low": 1000},
    )
    return spark.sql(sql, args=args)


@query("select distinct p_brand from part where p_brand is not null")
def pick_list(spark, sf):
    return select.pick_list(table(spark, sf, "part"), "p_brand")


@query("""
select p_partkey, case when p_size in (1, 2, 3) or p_size between 7 and 9 then 'tiny' when p_size between 10 and 25 then 'medium'
  when p_size > 45 then 'huge' end as size_class from part
""")
def select_case(spark, sf):
    size = select.select_case(
        "p_size", [([1, 2, 3, Case(low=7, high=9)], "tiny"), ([Case(low=10, high=25)], "medium"), ([Case(45, op=">")], "huge")]
    )
    return table(spark, sf, "part").select("p_partkey", size.alias("size_class"))


@query("select p_partkey, p_size between 10 and 20 as mid_size from part")
def in_range(spark, sf):
    return table(spark, sf, "part").select("p_partkey", select.in_range("p_size", 10, 20).alias("mid_size"))


@query("""
select o_orderkey, o_custkey from (select o_orderkey, o_custkey, row_number() over (order by o_orderdate, o_orderkey) rn from orders)
where rn in (1, 48) or rn between 23 and 25 or rn between 1000 and 1200
""")
def sample_lines(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ordered.sample_lines(rows, "1,23..25,48,1000..1200", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
select (select count(*) > 50 from orders where o_totalprice > 300000) as truncated,
       (select least(count(*), 50) from orders where o_totalprice > 300000) as shown
""")
def preview(spark, sf):
    rows, more = select.preview(table(spark, sf, "orders").filter("o_totalprice > 300000"))
    return rows.agg(F.lit(more).alias("truncated"), F.count(F.lit(1)).alias("shown"))


@query("""
select c_custkey, not coalesce(c_acctbal < 0, false) as visible,
       case when c_acctbal < 0 then '#ff0000' end as color,
       coalesce(c_acctbal > 9000, false) as bold, false as italic,
       case (c_custkey % 2) when 0 then '#ffffff' else '#eeeeee' end as shade,
       case when c_mktsegment = 'BUILDING' then 'green' else 'gray' end as tint
from customer
""")
def conditional_columns(spark, sf):
    style = F.when(F.col("c_acctbal") > 9000, "bold").otherwise("regular")
    return select.conditional_columns(
        table(spark, sf, "customer"),
        {
            "color": F.when(F.col("c_acctbal") < 0, F.lit("#ff0000")),
            "shade": select.row_shading(F.col("c_custkey") + 1, ["#ffffff", "#eeeeee"]),
            "tint": select.color_by(F.col("c_mktsegment") == "BUILDING", "green", "gray"),
        },
        suppress=F.col("c_acctbal") < 0,
        style=style,
    ).select("c_custkey", "visible", "color", "bold", "italic", "shade", "tint")


@query("select count(*) > 0 as show_body, case when count(*) = 0 then 'no rows' end as banner from orders where o_totalprice > 1e9")
def show_if_data(spark, sf):
    return select.show_if_data(table(spark, sf, "orders").filter("o_totalprice > 1e9"), "no rows")


@query("""
select conv_id, turn, case when lag(role) over w is null or lag(role) over w <> role then role end as role
from conversations window w as (partition by conv_id order by turn)
""")
def hide_repeats(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return ordered.hide_repeats(rows, "role", "turn", "conv_id")


@query("""
select 'ok' as flow, count(*) as pages from pages where regexp_full_match(url, 'https?://[a-z.]+/[a-z]{2}/[0-9]+')
union all select 'nok', count(*) from pages where not regexp_full_match(url, 'https?://[a-z.]+/[a-z]{2}/[0-9]+')
""")
def pattern_check(spark, sf):
    ok, nok = select.pattern_check(table(spark, sf, "pages"), "url", "https?://[a-z.]+/[a-z]{2}/[0-9]+")
    return select.flow_union({"ok": ok, "nok": nok}).groupBy("flow").agg(F.count(F.lit(1)).alias("pages"))


@query("""
select sha256('pepper' || c_custkey) as c_custkey,
       regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') as c_name,
       repeat('*', greatest(length(c_mktsegment) - 4, 0)::int) || right(c_mktsegment, 4) as c_mktsegment
from customer
""")
def mask(spark, sf):
    out = select.mask(
        table(spark, sf, "customer"), {"c_custkey": "hash", "c_name": "chars", "c_mktsegment": "last4"}, salt="pepper"
    )
    return out.select("c_custkey", "c_name", "c_mktsegment")


@query("select l_returnflag, count(*) as rows from lineitem where l_quantity between 1 and 30 group by 1")
def assert_rows(spark, sf):
    kept = select.assert_rows(table(spark, sf, "lineitem"), F.col("l_quantity") <= 30, "drop")
    checked = select.assert_rows(kept, F.col("l_quantity") >= 1, "fail", "quantity below 1")
    return checked.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"))


@query("""
select 'count' as consumer, count(*)::double as figure from lineitem
union all select 'quantity', round(sum(l_quantity), 2) from lineitem
""")
def replicate(spark, sf):
    first, second = select.replicate(table(spark, sf, "lineitem"), 2)
    a = first.agg(F.count(F.lit(1)).cast("double").alias("figure")).select(F.lit("count").alias("consumer"), "figure")
    b = second.agg(F.round(F.sum("l_quantity"), 2).alias("figure")).select(F.lit("quantity").alias("consumer"), "figure")
    return a.unionByName(b)
