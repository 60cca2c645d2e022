"""Set operations and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import sets
from tallyloom.plans.catalog import query, table


@query("""
select c_name as name, c_nationkey as nation from customer union all select s_name, s_nationkey from supplier
""")
def unite(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return sets.unite([c, s])


@query("select c_nationkey as nation from customer union select s_nationkey from supplier")
def union_distinct(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf, "supplier").select("s_nationkey")
    return sets.union_distinct(c, s)


@query("select c_nationkey as nation from customer union all select s_nationkey from supplier")
def union_all(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf, "supplier").select("s_nationkey")
    return sets.union_all(c, s)


_RANKED = """
select o_orderkey, o_custkey, o_orderpriority, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as rn from orders
"""


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")


@query(f"""
select case when rn = 1 then 'unique' else 'duplicate' end as flow, o_orderkey, o_custkey, o_orderpriority from ({_RANKED})
""")
def unique_rows(spark, sf):
    unique, more = sets.unique_rows(_orders(spark, sf), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])
    tagged = unique.withColumn("flow", F.lit("unique")).unionByName(more.withColumn("flow", F.lit("duplicate")))
    return tagged.select("flow", "o_orderkey", "o_custkey", "o_orderpriority")


@query(f"select o_orderkey, o_custkey, o_orderpriority from ({_RANKED}) where rn = 2")
def unique_rows_once(spark, sf):
    _, again = sets.unique_rows(
        _orders(spark, sf), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], case_sensitive=False, once_only=True
    )
    return again.select("o_orderkey", "o_custkey", "o_orderpriority")


@query("select c_nationkey as nation, c_mktsegment as segment from customer except all select s_nationkey, 'BUILDING' from supplier")
def multiset_minus(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return sets.multiset_minus(a, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("BUILDING").alias("segment")))


@query("""
select nation, least(n, m) as occurrences from (select c_nationkey as nation, count(*) as n from customer group by 1)
join (select s_nationkey as nation, count(*) as m from supplier group by 1) using (nation)
""")
def multiset_intersect(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    return sets.multiset_intersect(a, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")), counted=True)
