"""The composite report and the user-code surface."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators import joins, usercode
from tallyloom.operators.aggregate import Summary
from tallyloom.operators.select import Clause, Parameter
from tallyloom.operators.topn import TopN
from tallyloom.plans import report
from tallyloom.plans.catalog import query, table


@query("""
with base as (select n_name, c_mktsegment, o_orderdate, o_orderkey, o_totalprice from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  where o_orderstatus in ('F', 'O') and o_totalprice > 50000),
x as (select *, round(stddev_samp(o_totalprice) over (partition by n_name), 2) as price_sd,
  row_number() over (partition by n_name, c_mktsegment order by o_orderdate, o_orderkey) as nth,
  round(sum(o_totalprice) over (partition by n_name), 2) as total_g1, round(sum(o_totalprice) over (partition by n_name, c_mktsegment), 2) as total_g2,
  round(sum(o_totalprice) over (partition by n_name, c_mktsegment) * 100 / sum(o_totalprice) over (partition by n_name), 4) as share from base),
r as (select n_name, dense_rank() over (order by round(sum(o_totalprice), 6) desc) as rk from base group by 1)
select case when rk <= 5 then x.n_name else 'Others' end as n_name, c_mktsegment, o_orderdate, o_orderkey, o_totalprice, price_sd, nth, total_g1, total_g2, share
from x join r on x.n_name = r.n_name
""")
def grouped_report(spark, sf):
    """Flagship: orders by nation and segment, selected by parameters, with totals, shares and the best five nations."""
    tables = {n: table(spark, sf, n) for n in ("orders", "customer", "nation")}
    links = [(("orders", "o_custkey"), ("customer", "c_custkey")), (("customer", "c_nationkey"), ("nation", "n_nationkey"))]
    rows = joins.link_tables(tables, links)
    definition = report.Report(
        select={c: c for c in ("n_name", "c_mktsegment", "o_orderdate", "o_orderkey", "o_totalprice")},
        where=[Clause("o_orderstatus", "=", param="status"), Clause("o_totalprice", ">", param="least")],
        parameters=[Parameter("status", multi_value=True), Parameter("least", 50000)],
        groups=[("n_name", False), ("c_mktsegment", False)],
        sorts=[("o_orderdate", False), ("o_orderkey", False)],
        summaries=[Summary("total", "Sum", "o_totalprice")],
        running=[report.Running("nth", "Count", "o_orderkey", "c_mktsegment")],
        spread=[report.Spread("o_totalprice", {"price_sd": "StdDev"}, "n_name")],
        percent=[report.Percent("share", "o_totalprice", "c_mktsegment", "n_name")],
        top_n=[TopN("n_name", "o_totalprice", n=5)],
    )
    out = report.grouped_report(rows, definition, {"status": ["F", "O"]})
    return out.withColumns(
        {"price_sd": F.round("price_sd", 2), "total_g1": F.round("total_g1", 2), "total_g2": F.round("total_g2", 2), "share": F.round("share", 4)}
    )


@query("select o_orderkey, upper(left(o_orderpriority, 1)) || '-' || o_orderstatus as code, o_totalprice / 100 as hundreds from orders")
def row_script(spark, sf):
    import pandas as pd

    def script(frame: pd.DataFrame) -> pd.DataFrame:
        code = frame["o_orderpriority"].str[:1].str.upper() + "-" + frame["o_orderstatus"]
        return pd.DataFrame({"code": code, "hundreds": frame["o_totalprice"] / 100})

    out = usercode.row_script(
        table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"), script,
        ["o_orderpriority", "o_orderstatus", "o_totalprice"], "code string, hundreds double",
    )
    return out.select("o_orderkey", "code", "hundreds")


@query("select count(*) as rows, round(sum(l_quantity), 2) as quantity from lineitem")
def flow_script(spark, sf):
    """Start, main and end script: every partition counts its rows and reports once at its end."""
    import pandas as pd

    def main(state, frame):
        state["rows"] += len(frame)
        state["quantity"] += float(frame["l_quantity"].sum())
        return pd.DataFrame({"rows": [], "quantity": []}).astype({"rows": "int64", "quantity": "float64"})

    parts = usercode.flow_script(
        table(spark, sf, "lineitem").select("l_quantity"), main, "rows bigint, quantity double", lambda: {"rows": 0, "quantity": 0.0},
        lambda state: pd.DataFrame({"rows": [state["rows"]], "quantity": [state["quantity"]]}),
    )
    return parts.agg(F.sum("rows").alias("rows"), F.round(F.sum("quantity"), 2).alias("quantity"))


@query("select user_id, max(value) - min(value) as spread from events group by 1")
def group_script(spark, sf):
    import pandas as pd

    def bounds(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [frame["user_id"].iloc[0]], "low": [frame["value"].min()], "high": [frame["value"].max()]})

    parts = usercode.group_script(
        table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", bounds, "user_id bigint, low double, high double",
        "event_id", part_rows=1000,
    )
    return parts.groupBy("user_id").agg((F.max("high") - F.min("low")).alias("spread"))


@query("""
select p_partkey, unnest(generate_series(1, p_size % 4)) as copy_no from part
""")
def row_generator(spark, sf):
    """As many copies of each part as its size says."""
    import numpy as np
    import pyarrow as pa

    class Copies:
        def eval(self, rows: pa.RecordBatch):
            n = rows.column("n").to_numpy()
            take, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
            yield pa.table({"p_partkey": rows.column("p_partkey").take(pa.array(take)), "copy_no": pa.array(np.arange(len(take)) - (ends - n)[take] + 1, pa.int64())})

    parts = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 4).alias("n"))
    return usercode.row_generator(parts, Copies, lambda s: T.StructType([s["p_partkey"], T.StructField("copy_no", T.LongType())]))


@query("""
select o_custkey, o_orderkey, unnest(generate_series(1, gap // 100)) as step from (
  select o_custkey, o_orderkey, date_diff('day', lag(o_orderdate) over w, o_orderdate) as gap from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
""")
def row_generator_ordered(spark, sf):
    """A row for each hundred days since the customer's order before: the generator remembers the last day it saw."""
    import numpy as np
    import pyarrow as pa

    class Waits:
        def __init__(self):
            self.last = None

        def eval(self, rows: pa.RecordBatch):
            days = rows.column("day").to_numpy()
            before = np.concatenate([days[:1] if self.last is None else [self.last], days[:-1]])
            self.last = days[-1] if len(days) else self.last
            n = (days - before) // 100
            take = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(take)) - (np.cumsum(n) - n)[take] + 1
            yield pa.table({"o_custkey": rows.column("o_custkey").take(pa.array(take)), "o_orderkey": rows.column("o_orderkey").take(pa.array(take)), "step": pa.array(step, pa.int64())})

    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))
    return usercode.row_generator(orders, Waits, "o_custkey bigint, o_orderkey bigint, step bigint", "o_custkey", ["day", "o_orderkey"])


@query("select l_returnflag, round(ln(sum(exp(l_tax))), 6) as log_sum from lineitem group by 1")
def custom_aggregate(spark, sf):
    """Log-sum-exp: the state is a maximum and a sum scaled by it."""
    import numpy as np

    def take(state, v):
        return join(state, (v.max(), np.exp(v - v.max()).sum())) if len(v) else state

    def join(a, b):
        top = max(a[0], b[0])
        return a if b[1] == 0 else b if a[1] == 0 else (top, a[1] * np.exp(a[0] - top) + b[1] * np.exp(b[0] - top))

    log_sum = usercode.Aggregate(lambda: (-np.inf, 0.0), take, join, lambda s: float(s[0] + np.log(s[1])) if s[1] else None)
    out = usercode.custom_aggregate(table(spark, sf, "lineitem"), "l_returnflag", "log_sum", log_sum, "l_tax")
    return out.withColumn("log_sum", F.round("log_sum", 6))


@query("""
select c_nationkey, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer where c_acctbal > 0 group by 1
""")
def sub_flow(spark, sf):
    def positive(df):
        return df.filter("c_acctbal > 0")

    def by_nation(df):
        return df.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))

    return usercode.sub_flow(table(spark, sf, "customer"), positive, by_nation)
