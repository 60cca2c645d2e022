"""Sources and sinks: tables are written in each format below the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.core import scratch_path
from tallyloom.plans.catalog import query, table
from tallyloom.sources import generate, readers, writers


@query("""
select o_orderkey, o_custkey, o_totalprice from orders where o_orderpriority = '1-URGENT' and o_totalprice > 300000.5
""")
def read_query(spark, sf):
    sql = f"""
        select o_orderkey, o_custkey, o_totalprice from parquet.`{sf}/orders.parquet`
        where o_orderpriority = ${{prio}} and o_totalprice > ${{low}} and (${{blank}} is null or o_orderstatus = ${{blank}})
    """
    return readers.read_query(spark, sql, {"prio": "1-URGENT", "low": "300000.5", "blank": ""})


@query("select p_partkey, p_brand, p_size from part")
def read_table(spark, sf):
    return readers.read_table(spark, f"{sf}/part.parquet", ["p_partkey", "p_brand", "p_size"], format="parquet")


@query("""
select distinct n_name, c_mktsegment from customer join nation on c_nationkey = n_nationkey where c_acctbal > 5000
""")
def source_qualifier(spark, sf):
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    return readers.source_qualifier(
        customer, (nation, customer.c_nationkey == nation.n_nationkey), F.col("c_acctbal") > 5000,
        distinct=True, fields=["n_name", "c_mktsegment"], sorted_ports=2,
    )


def _orders_file(spark, sf):
    """Orders as delimited text; the price of every 50th order is no number."""
    price = F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", price.alias("o_totalprice"))
    path = scratch_path(spark, "delimited")
    writers.write_delimited(rows, path)
    return readers.read_delimited(spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double")


@query("select o_orderkey, o_orderpriority, o_totalprice from orders where o_orderkey % 50 <> 0")
def read_delimited(spark, sf):
    return _orders_file(spark, sf)[0]


@query("select o_orderkey || ';' || o_orderpriority || ';n/a' as line from orders where o_orderkey % 50 = 0")
def read_delimited_reject(spark, sf):
    return _orders_file(spark, sf)[1]


@query("""
select length(line)::int as line_length, count(*) as lines
from (select unnest(string_split(text, chr(10))) as line from documents) group by 1
""")
def read_lines(spark, sf):
    path = scratch_path(spark, "lines")
    table(spark, sf, "documents").select("text").write.text(path)
    lines = readers.read_lines(spark, path)
    return lines.groupBy(F.length("line").alias("line_length")).agg(F.count(F.lit(1)).alias("lines"))


@query("select p_partkey, p_brand, p_size, p_type from part")
def read_positional(spark, sf):
    line = F.concat(
        F.lpad(F.col("p_partkey").cast("string"), 12, " "), F.rpad("p_brand", 10, " "),
        F.lpad(F.col("p_size").cast("string"), 4, "0"), F.col("p_type"),
    )
    path = scratch_path(spark, "positional")
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    schema = [("p_partkey", "bigint"), ("p_brand", "string"), ("p_size", "int"), ("p_type", "string")]
    return readers.read_positional(spark, path, "12,10,4,*", schema)


@query("select c_custkey, c_name, c_nationkey as nation, c_mktsegment as segment from customer")
def read_xml(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("home")
    )
    path = scratch_path(spark, "xml")
    writers.write_xml(rows, path, "customer")
    return readers.read_xml(
        spark, path, "customer", "c_custkey bigint, c_name string, home struct<nation: int, segment: string>",
        {"c_custkey": "c_custkey", "c_name": "c_name", "nation": "home.nation", "segment": "home.segment"},
    )


@query("select event_id, user_id, event_type, value from events")
def read_json(spark, sf):
    path = scratch_path(spark, "json")
    writers.write_json(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), path)
    return readers.read_json(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@query("select l_orderkey, l_quantity, l_shipdate from lineitem")
def parquet_in_out(spark, sf):
    path = scratch_path(spark, "parquet")
    writers.write_parquet(table(spark, sf, "lineitem"), path)
    return readers.read_parquet(spark, path, ["l_orderkey", "l_quantity", "l_shipdate"])


@query("select 'customer.' || c_custkey as key, c_name || '=' || c_mktsegment as value from customer")
def read_properties(spark, sf):
    line = F.concat(F.lit("customer."), F.col("c_custkey"), F.lit(" = "), F.col("c_name"), F.lit("="), F.col("c_mktsegment"))
    path = scratch_path(spark, "properties")
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return readers.read_properties(spark, path)


@query("""
select case o_orderstatus when 'O' then 'open' when 'F' then 'filled' when 'P' then 'partial' end as status_name,
       count(*) as orders
from orders group by 1
""")
def inline_rows(spark, sf):
    names = readers.inline_rows(spark, [("O", "open"), ("F", "filled"), ("P", "partial")], "code string, status_name string")
    counts = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))
    return counts.join(names, counts.o_orderstatus == names.code).select("status_name", "orders")


_SEED = 7
_SYNTHETIC = [
    generate.Field("amount", "decimal", 10, 2), generate.Field("moment", "date/time"), generate.Field("day", "date"),
    generate.Field("word", "string", 20), generate.Field("n", "integer"), generate.Field("ratio", "double"),
]


def _drawn(field: str) -> str:
    """A field's draw, in SQL."""
    p, (a, b) = generate.PRIME, generate.FACTORS
    first = f"((c_custkey % {p}) * {a} + {generate.salt(field, _SEED)}) % {p}"
    return f"((xor({first}, ({first}) >> 13) * {b} + 1) % {p})"


def _spanned(field: str, kind: str) -> str:
    _, low, high = generate.SPANS[kind]
    return f"({_drawn(field)} % {high - low + 1} + {low})"


@query(f"""
select c_custkey, (({_drawn('amount')} % 1000000000) / 100)::double as amount, epoch_ms({_spanned('moment', 'date/time')} * 1000) as moment,
  date '1970-01-01' + {_spanned('day', 'date')}::int as day,
  {generate.WORDS!r}[({_drawn('word')} % {len(generate.WORDS)} + 1)::int] || '-' || lower(to_hex(c_custkey)) as word, {_spanned('n', 'integer')}::int as n,
  round({generate.REALS[0]} + {_drawn('ratio')} / {float(generate.PRIME)} * {generate.REALS[1] - generate.REALS[0]}, 6) as ratio from customer
""")
def generate_rows(spark, sf):
    """A synthetic row for each customer."""
    rows = generate.synthetic_like(table(spark, sf, "customer"), "c_custkey", _SYNTHETIC, _SEED, keep=True)
    return rows.withColumns({"moment": F.col("moment").cast("timestamp_ntz"), "ratio": F.round("ratio", 6), "amount": F.col("amount").cast("double")})


@query("select o_orderstatus as state, sum(length(o_orderkey::varchar) + 1)::bigint as bytes from orders group by 1")
def list_files(spark, sf):
    """The files of a table written as text, a folder per state: folders by name, sizes as the lines add up."""
    path = scratch_path(spark, "listed")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("line"), "o_orderstatus")
    orders.write.partitionBy("o_orderstatus").text(path)
    files = readers.list_files(spark, path, "*.txt")
    state = F.regexp_extract("path", "o_orderstatus=([^/]+)", 1).alias("state")
    return files.filter(F.col("name").startswith("part-")).groupBy(state).agg(F.sum("size").alias("bytes"))


@query("select count(*) as rows, sum(length(s_name))::bigint as name_chars from supplier")
def read_whole_files(spark, sf):
    path = scratch_path(spark, "whole")
    table(spark, sf, "supplier").select("s_name").write.option("maxRecordsPerFile", 1000).text(path)
    lines = readers.read_whole_files(spark, path, "*.txt").select(F.explode(F.split("content", "\n")).alias("line"))
    return lines.filter("line <> ''").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("line")).alias("name_chars"))


@query("""
select s_suppkey, s_name, s_nationkey, count(*) as copies
from (select * from supplier union all select * from supplier where s_nationkey < 5) group by all
""")
def write_delimited(spark, sf):
    supplier, path = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), scratch_path(spark, "append")
    writers.write_delimited(supplier, path, sep="|")
    writers.write_delimited(supplier.filter("s_nationkey < 5"), path, sep="|", append=True)
    good, _ = readers.read_delimited(spark, path, "s_suppkey bigint, s_name string, s_nationkey int", sep="|")
    return good.groupBy("s_suppkey", "s_name", "s_nationkey").agg(F.count(F.lit(1)).alias("copies"))


@query("select c_custkey, c_name, c_acctbal from customer union all select c_custkey, c_name, c_acctbal from customer where c_acctbal < 0")
def write_table(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    name, path = f"t_{uuid.uuid4().hex}", scratch_path(spark, "table")
    writers.write_table(rows, name, path=path)
    writers.write_table(rows.filter("c_acctbal < 0").select("c_acctbal", "c_name", "c_custkey"), name)
    spark.sql(f"drop table {name}")
    return spark.read.parquet(path)


@query("""
select c_custkey, '{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' as document from customer
""")
def to_json_field(spark, sf):
    return writers.to_json_field(table(spark, sf, "customer"), ["c_name", "c_mktsegment"], "document").select("c_custkey", "document")


@query("""
select c_custkey, '<row><c_name>' || c_name || '</c_name><c_mktsegment>' || c_mktsegment || '</c_mktsegment></row>' as document
from customer
""")
def to_xml_field(spark, sf):
    out = writers.to_xml_field(table(spark, sf, "customer"), ["c_name", "c_mktsegment"], "document")
    return out.select("c_custkey", F.regexp_replace("document", r">\s+<", "><").alias("document"))


@query("select o_orderstatus, count(*) as orders, round(sum(o_totalprice), 2) as total from orders group by 1")
def write_partitioned(spark, sf):
    path = scratch_path(spark, "burst")
    writers.write_partitioned(table(spark, sf, "orders"), path, "o_orderstatus")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("""
select 'big' as flow, count(*) as orders from orders where o_totalprice >= 200000
union all select 'all', count(*) from orders
""")
def stage(spark, sf):
    staged = writers.stage(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), durable=True)
    count = F.count(F.lit(1)).alias("orders")
    big = staged.filter("o_totalprice >= 200000").agg(count).select(F.lit("big").alias("flow"), "orders")
    return big.unionByName(staged.agg(count).select(F.lit("all").alias("flow"), "orders"))
