"""Reshaping and field operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import reshape
from tallyloom.operators.reshape import Replacement
from tallyloom.plans.catalog import query, table


@query("""
select distinct p_partkey, trim(w) as word from (select p_partkey, unnest(string_split(p_name || ' , ' || p_type || ',' || p_type, ',')) as w from part)
""")
def normalize(spark, sf):
    cell = F.concat("p_name", F.lit(" , "), "p_type", F.lit(","), "p_type", F.lit(",,"))
    rows = table(spark, sf, "part").select("p_partkey", cell.alias("word"))
    return reshape.normalize(rows, "word", ",", dedupe=True, trim=True, discard_trailing_empty=True)


@query("""
with n as (select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as gk from lineitem)
select gk, l_orderkey, 1 as gcid, l_discount as rate from n union all select gk, l_orderkey, 2, l_tax from n
""")
def normalizer(spark, sf):
    return reshape.normalizer(
        table(spark, sf, "lineitem"), {"rate": ["l_discount", "l_tax"]}, ["l_orderkey"], generated_key="gk",
        order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"],
    )


@query("select c_custkey, c_name as name, c_nationkey as nation, case when c_custkey % 10 <> 0 then c_acctbal end as balance from customer")
def split_fields(spark, sf):
    balance = F.when(F.col("c_custkey") % 10 == 0, "?").otherwise(F.col("c_acctbal").cast("string"))
    rows = table(spark, sf, "customer").select("c_custkey", F.concat_ws("|", "c_name", "c_nationkey", balance).alias("cell"))
    return reshape.split_fields(rows, "cell", "|", [("name", "string"), ("nation", "int"), ("balance", "double")]).drop("cell")


@query("select p_partkey, p_brand as brand, p_size as size, p_type as type from part")
def split_positional(spark, sf):
    cell = F.concat(F.rpad("p_brand", 10, " "), F.lpad(F.col("p_size").cast("string"), 5, " "), F.rpad("p_type", 12, " "))
    rows = table(spark, sf, "part").select("p_partkey", cell.alias("cell"))
    return reshape.split_positional(rows, "cell", "10,5,12", [("brand", "string"), ("size", "int"), ("type", "string")]).drop("cell")


@query(r"""
select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\bthe\b', 'THE', 'g'), '(?i)tion', 'TION', 'g'), '\.', '!', 'g') as text
from documents where lang = 'en'
""")
def replace_values(spark, sf):
    rows = table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", "text")
    return reshape.replace_values(
        rows,
        [
            Replacement("text", "the", "THE", whole_word=True), Replacement("text", "tion", "TION", case_sensitive=False),
            Replacement("text", ".", "!"),
        ],
    )


@query(r"""
select c_custkey, md5(c_custkey || '|' || c_name || '|' || coalesce(nullif(c_mktsegment, 'BUILDING'), '\N')) as checksum from customer
""")
def add_checksum(spark, sf):
    rows = table(spark, sf, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return reshape.add_checksum(rows, ["c_custkey", "c_name", "c_mktsegment"], "md5").select("c_custkey", "checksum")


@query("select event_id, json_extract_string(props, '$.k')::bigint as k, json_extract_string(props, '$.none') as none from events")
def extract_json(spark, sf):
    return reshape.extract_json(table(spark, sf, "events").select("event_id", "props"), "props", {"k": ("$.k", "bigint"), "none": "$.none"}).drop("props")


@query("""
select event_id, unnest([json_extract_string(props, '$.k')::bigint, user_id]) as item from events
""")
def explode_json(spark, sf):
    array = F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(","), F.col("user_id").cast("string"), F.lit("]"))
    rows = table(spark, sf, "events").select("event_id", array.alias("doc"))
    return reshape.explode_json(rows, "doc", "array<bigint>").drop("doc")


@query("select c_custkey, c_name as name, c_nationkey as nation from customer")
def extract_xml(spark, sf):
    doc = F.concat(F.lit("<c><name>"), "c_name", F.lit('</name><home nation="'), F.col("c_nationkey").cast("string"), F.lit('"/></c>'))
    rows = table(spark, sf, "customer").select("c_custkey", doc.alias("doc"))
    return reshape.extract_xml(rows, "doc", {"name": "/c/name", "nation": ("/c/home/@nation", "int")}).drop("doc")


@query("""
with c as (select c_name, c_mktsegment, row_number() over (order by c_name, c_mktsegment) as id from (
  select distinct c_name, c_mktsegment from customer join orders on o_custkey = c_custkey))
select 'customer' as base_table, id as customer_id, c_name as name, null::bigint as orders from c
union all select 'orders', id, null, count(*) from customer join orders on o_custkey = c_custkey join c using (c_name, c_mktsegment) group by 1, 2
""")
def decompose(spark, sf):
    joined = (
        table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
        .select("c_name", "c_mktsegment", "o_orderkey", "o_totalprice")
    )
    tables = {"customer": ["customer_id", "c_name", "c_mktsegment"], "orders": ["customer_id", "o_orderkey", "o_totalprice"]}
    parts = reshape.decompose(joined, tables, [(("customer", "customer_id"), ("orders", "customer_id"))])
    customers = parts["customer"].select(
        F.lit("customer").alias("base_table"), "customer_id", F.col("c_name").alias("name"), F.lit(None).cast("bigint").alias("orders")
    )
    orders = parts["orders"].groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"))
    return customers.unionByName(
        orders.select(F.lit("orders").alias("base_table"), "customer_id", F.lit(None).cast("string").alias("name"), "orders")
    )


@query("""
select 'event_type' as column_name, 0::bigint as null_count, count(*) as value_count, max(length(event_type))::int as widest, 0::bigint as as_double, 'string' as effective_type from events
union all select 'user_text', 0, count(*), max(length(user_id::varchar))::int, count(*), 'bigint' from events
union all select 'value_text', count(*) filter (value < 1), count(*) filter (value >= 1), max(length(value::varchar)) filter (value >= 1)::int, count(*) filter (value >= 1), 'double' from events
""")
def profile_columns(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_type", F.col("user_id").cast("string").alias("user_text"),
        F.when(F.col("value") >= 1, F.col("value").cast("string")).alias("value_text"),
    )
    return reshape.profile_columns(rows).select("column_name", "null_count", "value_count", "widest", "as_double", "effective_type")


@query("""
select o_orderkey as "KEY", o_totalprice as "PRICE", case when o_orderkey % 20 = 0 then 'n/a' end as "PRICE_raw", o_orderdate::date as "DAY",
  o_orderstatus = 'F' as "DONE", o_orderpriority as "PRIO" from (select * replace (case when o_orderkey % 20 <> 0 then o_totalprice end as o_totalprice) from orders)
""")
def decode_raw(spark, sf):
    serial = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")) + 2_440_587
    swapped = F.decode(F.encode("o_orderpriority", "UTF-16LE"), "UTF-16BE")
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("ORDERS.KEY"),
        F.when(F.col("o_orderkey") % 20 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("ORDERS.PRICE"),
        serial.cast("string").alias("ORDERS.DAY"), (F.col("o_orderstatus") == "F").cast("string").alias("ORDERS.DONE"),
        swapped.alias("ORDERS.PRIO"), F.lit("second").alias("OTHER.KEY"),
    )
    out = reshape.decode_raw(
        raw,
        {"ORDERS.KEY": "Int32s", "ORDERS.PRICE": "Currency", "ORDERS.DAY": "Date", "ORDERS.DONE": "Boolean", "ORDERS.PRIO": "String",
         "OTHER.KEY": "String"},
    )
    return out.select("KEY", "PRICE", "PRICE_raw", "DAY", "DONE", "PRIO")


@query("""
select o_orderkey, 'Order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%Y-%m-%d') || ': $' || format('{:,.2f}', o_totalprice) || ' (' || o_orderpriority || ')' as message from orders
""")
def message_template(spark, sf):
    out = reshape.message_template(
        table(spark, sf, "orders"),
        "Order $(o_orderkey) of $(o_orderdate, date, yyyy-MM-dd): $(o_totalprice, number, $#,##0.00) ($(o_orderpriority))", "message",
    )
    return out.select("o_orderkey", "message")
