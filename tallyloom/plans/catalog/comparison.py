"""Table comparison, number parity, key checks, classification, graph checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import compare
from tallyloom.plans.catalog import query, table

_PAIR = """
with e as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 100 <> 7),
a as (select o_orderkey, case when o_orderkey % 50 = 1 then 'X' else ' ' || o_orderstatus || ' ' end as o_orderstatus,
  case when o_orderkey % 40 = 2 then o_totalprice + 1 else o_totalprice end as o_totalprice from orders where o_orderkey % 100 <> 8),
p as (select e.o_orderkey as ek, a.o_orderkey as ak, trim(e.o_orderstatus) <> trim(a.o_orderstatus) as s_off,
  abs(e.o_totalprice - a.o_totalprice) > 1e-9 as p_off from e full join a on e.o_orderkey = a.o_orderkey)
"""


def _pair(spark, sf):
    """Orders against a copy with padded text, other prices here and there, and rows missing on either side."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    status = F.when(key % 50 == 1, "X").otherwise(F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")))
    price = F.when(key % 40 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    actual = orders.filter(key % 100 != 8).withColumns({"o_orderstatus": status, "o_totalprice": price})
    return orders.filter(key % 100 != 7), actual


@query(_PAIR + """
, c as (select (select count(*) from e) as expected_rows, (select count(*) from a) as actual_rows,
  count(*) filter (ek is not null and ak is not null and not s_off and not p_off) as matching_rows,
  count(*) filter (ek is not null and ak is not null and (s_off or p_off)) as mismatched_rows,
  count(*) filter (ak is null) as missing_rows, count(*) filter (ek is null) as extra_rows from p)
select expected_rows, actual_rows, expected_rows = actual_rows as row_count_match, matching_rows + mismatched_rows as compared_rows,
  matching_rows, mismatched_rows, missing_rows, extra_rows, round(matching_rows / greatest(expected_rows, actual_rows), 4) as parity,
  case when matching_rows / greatest(expected_rows, actual_rows) >= 0.999 and expected_rows = actual_rows then 'PASS'
    when matching_rows / greatest(expected_rows, actual_rows) >= 0.95 then 'NEAR' else 'FAIL' end as verdict from c
""")
def diff_keyed(spark, sf):
    expected, actual = _pair(spark, sf)
    return compare.diff_keyed(expected, actual, "o_orderkey").report


@query(_PAIR + """
select 'o_orderstatus' as column_name, count(*) filter (s_off) as mismatches from p where ek is not null and ak is not null
union all select 'o_totalprice', count(*) filter (p_off) from p where ek is not null and ak is not null
""")
def diff_keyed_columns(spark, sf):
    expected, actual = _pair(spark, sf)
    return compare.diff_keyed(expected, actual, "o_orderkey").columns


@query("""
select o_orderkey::varchar as row_id, 'o_totalprice' as column_name, round(o_totalprice, 2) as expected, round(o_totalprice + 1, 2) as actual
  from orders where o_orderkey % 4 = 0
union all select o_orderkey::varchar, 'o_custkey', o_custkey, o_custkey + 1 from orders where o_orderkey % 6 = 0
""")
def diff_keyed_mismatches(spark, sf):
    """Every differing cell of two tables, not a sample."""
    expected = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    off = lambda n: F.when(F.col("o_orderkey") % n == 0, 1).otherwise(0)
    actual = expected.withColumns({"o_totalprice": F.col("o_totalprice") + off(4), "o_custkey": F.col("o_custkey") + off(6)})
    cell = lambda c: F.round(F.col(c).cast("double"), 2).alias(c)
    return compare.diff_keyed(expected, actual, "o_orderkey").mismatches.select("row_id", "column_name", cell("expected"), cell("actual"))


@query("""
with e as (select *, row_number() over (order by c_custkey) as i from (select c_custkey, c_name, c_acctbal from customer)),
a as (select *, row_number() over (order by c_custkey) as i from (select c_custkey, c_name, c_acctbal from customer where c_custkey <> 1000)),
p as (select e.i, e.c_custkey is distinct from a.c_custkey or e.c_name is distinct from a.c_name or e.c_acctbal is distinct from a.c_acctbal as off
  from e join a using (i)),
c as (select (select count(*) from e) as expected_rows, (select count(*) from a) as actual_rows,
  count(*) filter (not off) as matching_rows, count(*) filter (off) as mismatched_rows from p)
select expected_rows, actual_rows, expected_rows = actual_rows as row_count_match, matching_rows + mismatched_rows as compared_rows, matching_rows,
  mismatched_rows, 0::bigint as missing_rows, 0::bigint as extra_rows, round(matching_rows / greatest(expected_rows, actual_rows), 4) as parity,
  case when matching_rows / greatest(expected_rows, actual_rows) >= 0.999 and expected_rows = actual_rows then 'PASS'
    when matching_rows / greatest(expected_rows, actual_rows) >= 0.95 then 'NEAR' else 'FAIL' end as verdict from c
""")
def diff_positional(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return compare.diff_positional(rows, rows.filter("c_custkey <> 1000"), "c_custkey").report


@query("""
select o_orderkey, o_orderkey % 3 <> 0 or o_totalprice = 0 as same, case when o_orderkey % 3 <> 0 then 'PASS' else 'FAIL' end as verdict from orders
""")
def values_equal(spark, sf):
    """Padded text with trailing zeros against the number; every third one is off by a cent."""
    price = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice"))
    same = compare.values_equal(F.col("o_totalprice"), F.concat(F.lit("  "), price.cast("decimal(18,4)").cast("string")))
    return table(spark, sf, "orders").select(
        "o_orderkey", same.alias("same"), compare.verdict(same.cast("int").cast("double"), F.lit(True)).alias("verdict")
    )


_NUMBERS = r"""
with t as (select lang, 'ref' as side, unnest(regexp_extract_all(text, '\(?-?[$€£]?\s?\d[\d,]*(?:\.\d+)?\)?')) as tok from documents
  union all select lang, 'ren', unnest(regexp_extract_all(replace(text, '7', '8'), '\(?-?[$€£]?\s?\d[\d,]*(?:\.\d+)?\)?')) from documents),
s as (select lang, side, trim(tok) as s from t),
b as (select lang, side, s like '(%' and s like '%)' as wrapped, regexp_replace(regexp_replace(s, '^[()]+|[()]+$', '', 'g'), '[,$€£ ]', '', 'g') as bare from s),
n as (select lang, side, wrapped or bare like '-%' as neg, regexp_replace(bare, '^-', '') as d from b),
v as (select lang, side, case when neg then -(d::double) else d::double end as v from n where regexp_full_match(d, '\d+(?:\.\d+)?')),
k as (select lang, side, regexp_replace(regexp_replace(printf('%.6f', v), '0+$', ''), '\.$', '') as num from v),
c as (select lang, num, count(*) filter (side = 'ref') as r, count(*) filter (side = 'ren') as c from k group by 1, 2)
select lang, sum(least(r, c))::bigint as matched, sum(r)::bigint as reference_total, sum(c)::bigint as rendered_total,
  (sum(r) - sum(least(r, c)))::bigint as missing, (sum(c) - sum(least(r, c)))::bigint as extra,
  case when sum(r) = 0 then 'FAIL' when sum(r) = sum(least(r, c)) then 'PASS' when sum(least(r, c)) / sum(r) >= 0.9 then 'NEAR' else 'FAIL' end as verdict
from c group by 1
"""


@query(_NUMBERS[: _NUMBERS.rindex("select lang, sum(least")] + """
select lang, num as number, case when r > c then 'missing' else 'extra' end as state, abs(r - c) as n from c where r <> c
""")
def number_differences(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "text")
    rendered = docs.withColumn("text", F.replace("text", F.lit("7"), F.lit("8")))
    return compare.number_differences(docs, rendered, "text", "lang")


@query(_NUMBERS)
def number_parity(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "text")
    rendered = docs.withColumn("text", F.replace("text", F.lit("7"), F.lit("8")))
    return compare.number_parity(docs, rendered, "text", "lang")


@query("select l_orderkey, l_linenumber, count(*) as occurrences from lineitem group by 1, 2 having count(*) > 1")
def check_keys(spark, sf):
    return compare.check_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size <= 48)")
def check_references(spark, sf):
    out = compare.check_references(table(spark, sf, "lineitem"), table(spark, sf, "part").filter("p_size <= 48"), [("l_partkey", "p_partkey")])
    return out.select("l_orderkey", "l_linenumber", "l_partkey")


@query(r"""
select doc_id, case when regexp_matches(text, '(?i)\blicense\b') then 'legal' when regexp_matches(text, '(?i)[a-z0-9._]+@[a-z0-9.]+') then 'contact'
  when regexp_matches(text, '(?i)\d{3}') then 'figures' else 'prose' end as kind from documents
""")
def classify_text(spark, sf):
    rules = [("legal", r"\blicense\b"), ("contact", r"[a-z0-9._]+@[a-z0-9.]+"), ("figures", r"\d{3}")]
    return compare.classify_text(table(spark, sf, "documents"), "text", rules, "prose").select("doc_id", "kind")


@query("""
select 'large' as tag, count(*) as rows from orders where o_totalprice > 400000
union all select 'open', count(*) from orders where o_orderstatus = 'O' union all select 'urgent', count(*) from orders where o_orderpriority = '1-URGENT'
""")
def tag_features(spark, sf):
    return compare.tag_counts(
        table(spark, sf, "orders"),
        {"large": F.col("o_totalprice") > 400000, "open": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority") == "1-URGENT"},
    )


@query("""
select 'unknown-node' as code, l_suppkey as item from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 500) group by 2
union all select 'unknown-node', l_partkey + 1000000 from lineitem where l_partkey not in (select p_partkey from part where p_size < 49) group by 2
union all select 'isolated', p_partkey + 1000000 from part where p_size < 49 and p_partkey not in (select l_partkey from lineitem)
union all select 'isolated', s_suppkey from supplier where s_acctbal > 500 and s_suppkey not in (select l_suppkey from lineitem)
""")
def edge_lint(spark, sf):
    """Suppliers and parts as nodes, deliveries as edges between them."""
    suppliers = table(spark, sf, "supplier").filter("s_acctbal > 500").select(F.col("s_suppkey").alias("name"))
    parts = table(spark, sf, "part").filter("p_size < 49").select((F.col("p_partkey") + 1_000_000).alias("name"))
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("from_step"), (F.col("l_partkey") + 1_000_000).alias("to_step"))
    return compare.edge_lint(suppliers.unionByName(parts), edges)


@query("""
with recursive n as (select o_orderkey, o_orderstatus = 'F' as goal, o_orderstatus = 'P' as stop,
    lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as nxt from orders),
r(k) as (select o_orderkey from n where goal union select m.o_orderkey from r join n on n.o_orderkey = r.k join n m on m.o_orderkey = n.nxt
  where not m.stop)
select o_orderkey, o_orderkey in (select k from r) as reached from n
""")
def has_upstream(spark, sf):
    """Each order points to the customer's next one; is there a filled order before a pending one looking back?"""
    from tallyloom.operators.ordered import previous_rows

    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    linked = previous_rows(orders, "o_orderkey", 1, ["o_orderdate", "o_orderkey"], "o_custkey")
    edges = linked.filter("o_orderkey_prev1 is not null").select(
        F.col("o_orderkey_prev1").alias("from_step"), F.col("o_orderkey").alias("to_step")
    )
    status = F.col("o_orderstatus")
    return compare.has_upstream(orders, edges, status == "F", status == "P", node="o_orderkey").select("o_orderkey", "reached")


@query("select 'orders' as flow, count(*) as rows, round(sum(o_totalprice), 2) as total from orders where o_orderstatus <> 'P'")
def flow_metrics(spark, sf):
    flow, seen = compare.flow_metrics(table(spark, sf, "orders").filter("o_orderstatus <> 'P'"), "orders", total="o_totalprice")
    flow.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([("orders", got["rows"], round(got["total"], 2))], "flow string, rows bigint, total double")
