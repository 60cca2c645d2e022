"""Loading and change application."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.core import scratch_path
from tallyloom.operators import load
from tallyloom.plans.catalog import query, table
from tallyloom.sources.keyed_table import KeyedTable

_NEW = "select c_custkey + 500 as c_custkey, c_name || '!' as c_name, c_acctbal + 1 as c_acctbal from customer"


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")


def _changed(spark, sf):
    return _customers(spark, sf).select(
        (F.col("c_custkey") + 500).alias("c_custkey"), F.concat("c_name", F.lit("!")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal")
    )


@query(f"""
with n as ({_NEW})
select coalesce(c.c_custkey, n.c_custkey) as c_custkey, case when c.c_custkey is null then n.c_name else c.c_name end as c_name,
  case when n.c_custkey is null then c.c_acctbal else n.c_acctbal end as c_acctbal
from customer c full join n on c.c_custkey = n.c_custkey
""")
def upsert(spark, sf):
    """Known customers get a new balance only, unknown ones come in whole."""
    return load.upsert(_customers(spark, sf), _changed(spark, sf), "c_custkey", ["c_acctbal"])


_FLAGGED = f"select *, (c_custkey % 5)::int as flag from ({_NEW})"


@query(f"""
with s as ({_FLAGGED}), t as (select c_custkey, c_name, c_acctbal from customer)
select 'table' as flow, t.c_custkey, case when s.flag = 1 then s.c_name else t.c_name end as c_name from t left join s on t.c_custkey = s.c_custkey
  where not coalesce(s.flag = 2, false)
union all select 'table', c_custkey, c_name from s where flag = 0 and c_custkey not in (select c_custkey from t)
union all select 'reject', c_custkey, c_name from s where flag in (3, 4) or (flag = 0 and c_custkey in (select c_custkey from t))
""")
def apply_strategy(spark, sf):
    source = _changed(spark, sf).withColumn("flag", (F.col("c_custkey") % 5).cast("int"))
    result, rejects = load.apply_strategy(_customers(spark, sf), source, "flag", "c_custkey")
    a = result.select(F.lit("table").alias("flow"), "c_custkey", "c_name")
    return a.unionByName(rejects.select(F.lit("reject").alias("flow"), "c_custkey", "c_name"))


@query("""
with last as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1),
t as (select c_custkey as user_id, c_acctbal as value from customer)
select t.user_id, case when l.user_id is not null then l.value else t.value end as value from t left join last l on t.user_id = l.user_id
  where not coalesce(l.event_type = 'error', false)
union all select user_id, value from last where event_type <> 'error' and user_id not in (select user_id from t)
""")
def apply_changes(spark, sf):
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    changes = table(spark, sf, "events").select("user_id", "value", "ts", "event_id", "event_type")
    return load.apply_changes(target, changes, "user_id", ["ts", "event_id"], "event_type", ["error"])


@query("""
with e as (select *, case when ts < timestamp '2024-01-08' then 1 when ts < timestamp '2024-01-15' then 2 when ts < timestamp '2024-01-22' then 3 else 4 end as part
  from events),
ends as (select * from e qualify row_number() over (partition by user_id, part order by ts desc, event_id desc) = 1),
last as (select * from ends qualify row_number() over (partition by user_id order by part desc) = 1),
t as (select c_custkey as user_id, c_name as name, c_acctbal as value from customer)
select coalesce(t.user_id, l.user_id) as user_id, case when coalesce(t.user_id, l.user_id) not in (select user_id from ends where event_type = 'error') then t.name end as name,
  case when l.user_id is not null then l.value else t.value end as value
from t full join last l on t.user_id = l.user_id where not coalesce(l.event_type = 'error', false)
""")
def change_table(spark, sf):
    """Four deliveries of changes, without names, to a keyed table that is compacted on the way; who was taken out and comes
    again has no name."""
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))
    keyed = KeyedTable.create(target, scratch_path(spark, "keyed"), "user_id", 16)
    events = table(spark, sf, "events").select("user_id", "value", "ts", "event_id", "event_type")
    days = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-03-01"]
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    for low, high in zip(days, days[1:]):
        part = events.filter((F.col("ts") >= at(low)) & (F.col("ts") < at(high)))
        keyed = load.change_table(keyed, part, ["ts", "event_id"], "event_type", ["error"]).compact(2)
    keyed.vacuum()
    return KeyedTable.load(spark, keyed.path).read()


@query(f"""
with n as ({_NEW})
select coalesce(c.c_custkey, n.c_custkey) as c_custkey, case when c.c_custkey is null then n.c_name else c.c_name end as c_name,
  case when n.c_custkey is null then c.c_acctbal else n.c_acctbal end as c_acctbal
from customer c full join n on c.c_custkey = n.c_custkey
""")
def upsert_table(spark, sf):
    keyed = KeyedTable.create(_customers(spark, sf), scratch_path(spark, "keyed"), "c_custkey", 16)
    return load.upsert_table(keyed, _changed(spark, sf), ["c_acctbal"]).read()


@query("select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")
def delete_rows(spark, sf):
    gone = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return load.delete_rows(table(spark, sf, "part").select("p_partkey", "p_name"), gone, "p_partkey")


@query("select s_suppkey, s_name from supplier where s_acctbal > 0")
def truncate_load(spark, sf):
    path, supplier = scratch_path(spark, "truncate"), table(spark, sf, "supplier")
    load.truncate_load(supplier.select("s_suppkey", "s_name"), path)
    load.truncate_load(supplier.filter("s_acctbal > 0").select("s_suppkey", "s_name"), path)
    return spark.read.parquet(path)


@query("select c_custkey, c_name || '?' as c_name from customer")
def write_swapped(spark, sf):
    base, rows = scratch_path(spark, "versions"), table(spark, sf, "customer").select("c_custkey", "c_name")
    load.write_swapped(rows, base)
    load.write_swapped(load.read_swapped(spark, base).withColumn("c_name", F.concat("c_name", F.lit("?"))), base)
    return load.read_swapped(spark, base)
