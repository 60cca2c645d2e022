"""Structured Streaming jobs run over everything that is available now."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.core import scratch_path, session_settings
from tallyloom.operators.aggregate import Agg
from tallyloom.plans.catalog import query, table
from tallyloom.streaming import flows

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(spark, sf):
    raw = flows.stream_files(spark, sf, EVENTS, glob="events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query("select event_id, user_id, event_type, value from events")
def stream_files(spark, sf):
    return flows.run_to_table(_events(spark, sf).select("event_id", "user_id", "event_type", "value"))


@query("""
select user_id::varchar as key, case when event_id % 50 <> 0 then event_id end as event_id, case when event_id % 50 <> 0 then value end as value,
  case when event_id % 50 = 0 then '{broken' end as reject from events
""")
def decode_messages(spark, sf):
    path = scratch_path(spark, "topic")
    messages = flows.encode_messages(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", ["event_id", "value"])
    broken = table(spark, sf, "events").filter("event_id % 50 = 0").select(
        F.col("user_id").cast("string").cast("binary").alias("key"), F.lit("{broken").cast("binary").alias("value")
    )
    good = messages.filter(F.get_json_object(F.col("value").cast("string"), "$.event_id").cast("bigint") % 50 != 0)
    good.unionByName(broken).write.parquet(path)
    stream = flows.stream_files(spark, path, "key binary, value binary")
    return flows.run_to_table(flows.decode_messages(stream, "event_id bigint, value double"))


@query("select event_id, event_type from events where value > 20 and event_type <> 'error'")
def stream_filter(spark, sf):
    kept = flows.stream_filter(_events(spark, sf), (F.col("value") > 20) & (F.col("event_type") != "error"))
    return flows.run_to_table(kept.select("event_id", "event_type"))


@query("""
select 'money' as flow, event_id from events where event_type = 'purchase' union all select 'high', event_id from events where value > 50
union all select 'default', event_id from events where not (event_type = 'purchase' or value > 50)
""")
def stream_route(spark, sf):
    branches = flows.stream_route(_events(spark, sf), {"money": F.col("event_type") == "purchase", "high": F.col("value") > 50})
    out = None
    for name, branch in branches.items():
        done = flows.run_to_table(branch.select(F.lit(name).alias("flow"), "event_id"))
        out = done if out is None else out.unionByName(done)
    return out


@query("select event_id, upper(event_type) as kind, json_extract_string(props, '$.k')::int as k from events")
def stream_map(spark, sf):
    mapped = flows.stream_map(
        _events(spark, sf), {"event_id": "event_id", "kind": "upper(event_type)", "k": "get_json_object(props, '$.k')"}, {"k": "int"}
    )
    return flows.run_to_table(mapped)


@query("select doc_id, line, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by 1, 2")
def stream_split(spark, sf):
    docs = flows.stream_files(spark, sf, "doc_id bigint, text string", glob="documents.parquet")
    lines = flows.run_to_table(flows.stream_split(docs, "text", "\n", "line").select("doc_id", "line"))
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, c_name as customer, c_mktsegment as segment from events left join customer on user_id = c_custkey")
def stream_enrich(spark, sf):
    enriched = flows.stream_enrich(
        _events(spark, sf), table(spark, sf, "customer"), [("user_id", "c_custkey")], {"c_name": "customer", "c_mktsegment": "segment"}
    )
    return flows.run_to_table(enriched.select("event_id", "customer", "segment"))


@query("select event_id, event_type from events")
def stream_dedupe(spark, sf):
    """Every event is sent twice."""
    twice = _events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return flows.run_to_table(flows.stream_dedupe(twice, "event_id", "ts", "1 hour").select("event_id", "event_type"))


@query("""
select event_type, time_bucket(interval 1 day, ts) as window_start, time_bucket(interval 1 day, ts) + interval 1 day as window_end,
  count(*) as n, round(sum(value), 2) as total from events group by 1, 2
""")
def stream_aggregate(spark, sf):
    cells = flows.stream_aggregate(
        _events(spark, sf), "event_type", [Agg("n", "count_rows"), Agg("total", "sum", "value")], "ts", "1 day", "2 days"
    )
    return _as_ntz(flows.run_to_table(cells, "complete"))


@query("""
select event_type, w as window_start, w + interval 12 hour as window_end, count(*) as n, round(sum(value), 2) as total from (
  select event_type, value, unnest([time_bucket(interval 6 hour, ts), time_bucket(interval 6 hour, ts) - interval 6 hour]) as w from events) group by 1, 2
""")
def stream_aggregate_sliding(spark, sf):
    cells = flows.stream_aggregate(
        _events(spark, sf), "event_type", [Agg("n", "count_rows"), Agg("total", "sum", "value")], "ts", "12 hours", "1 day", "6 hours"
    )
    return _as_ntz(flows.run_to_table(cells, "complete"))


@query("""
with g as (select user_id, ts, value, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 3 hour, true)::int as start from events),
s as (select *, sum(start) over (partition by user_id order by ts rows unbounded preceding) as session from g)
select user_id, min(ts) as window_start, max(ts) + interval 3 hour as window_end, count(*) as n, round(sum(value), 2) as total from s group by user_id, session
""")
def stream_aggregate_session(spark, sf):
    cells = flows.stream_aggregate(
        _events(spark, sf), "user_id", [Agg("n", "count_rows"), Agg("total", "sum", "value")], "ts", "3 hours", "1 day", session=True
    )
    return _as_ntz(flows.run_to_table(cells, "complete"))


@query("""
select event_type, time_bucket(interval 1 day, ts) as window_start, time_bucket(interval 1 day, ts) + interval 1 day as window_end,
  count(*) as n, round(sum(value), 2) as total from events
group by 1, 2 having time_bucket(interval 1 day, ts) + interval 1 day <= (select max(ts) - interval 2 day from events)
""")
def stream_aggregate_late(spark, sf):
    """Append mode in two arrivals: rows of the first days come again with the second, behind the watermark, and are dropped;
    windows that the watermark hasn't passed aren't out yet."""
    folder = scratch_path(spark, "late")
    events, middle = table(spark, sf, "events").select("event_type", "ts", "value"), F.lit("2024-01-15").cast("timestamp_ntz")
    again = events.filter(F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")).withColumn("value", F.lit(1000.0))
    for rows in (events.filter(F.col("ts") < middle), events.filter(F.col("ts") >= middle).unionByName(again)):
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = flows.stream_files(spark, f"{folder}/in", "event_type string, ts timestamp_ntz, value double")
        cells = flows.stream_aggregate(
            stream.withColumn("ts", F.col("ts").cast("timestamp")), "event_type",
            [Agg("n", "count_rows"), Agg("total", "sum", "value")], "ts", "1 day", "2 days",
        )
        cells.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(
            f"{folder}/out").awaitTermination()
    return _as_ntz(spark.read.schema(cells.schema).parquet(f"{folder}/out"))


def _as_ntz(cells):
    return cells.withColumns(
        {
            "window_start": F.col("window_start").cast("timestamp_ntz"), "window_end": F.col("window_end").cast("timestamp_ntz"),
            "total": F.round("total", 2),
        }
    )


_RUNNING = "event_id bigint, user_id bigint, ts timestamp_ntz, value double"
# fixed values: days of the month at which arrivals end
_ARRIVALS = ("2024-01-01", "2024-01-10", "2024-01-20", "2024-03-01")


def _arrivals(spark, sf):
    """The month's events in three parts."""
    events, at = table(spark, sf, "events").select("event_id", "user_id", "ts", "value"), lambda d: F.lit(d).cast("timestamp_ntz")
    for low, high in zip(_ARRIVALS, _ARRIVALS[1:]):
        yield events.filter((F.col("ts") >= at(low)) & (F.col("ts") < at(high)))


@query("""
select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as running_value from events
""")
def stream_running(spark, sf):
    """Three arrivals; a run without news in between leaves all as it is."""
    folder = scratch_path(spark, "running")
    for rows in _arrivals(spark, sf):
        rows.write.mode("append").parquet(f"{folder}/in")
        for _ in range(2):
            stream = flows.stream_files(spark, f"{folder}/in", _RUNNING)
            flows.stream_running(stream, "user_id", ["ts", "event_id"], "value", "sum", "running_value", f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out/rows").select("event_id", F.round("running_value", 4).alias("running_value"))


@query("""
select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as running_value, false as late
from events qualify ts <= (select max(ts) - interval 5 hour from events)
""")
def stream_running_ordered(spark, sf):
    """Three arrivals of rows in no order: what the watermark has passed is out, in event order; the rest waits."""
    folder = scratch_path(spark, "ordered")
    with session_settings(spark, flows.STATE_STORE):
        for rows in _arrivals(spark, sf):
            rows.repartition("event_id").write.mode("append").parquet(f"{folder}/in")
            stream = flows.stream_files(spark, f"{folder}/in", _RUNNING).withColumn("ts", F.col("ts").cast("timestamp"))
            ran = flows.stream_running_ordered(stream, "user_id", ["event_id"], "value", "sum", "running_value", "ts", "5 hours", "1 hour")
            ran.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(
                f"{folder}/out").awaitTermination()
    return spark.read.schema(ran.schema).parquet(f"{folder}/out").select("event_id", F.round("running_value", 4).alias("running_value"), "late")


_CHANGED = """
with last as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1),
t as (select c_custkey as user_id, c_acctbal as value from customer)
select t.user_id, case when l.user_id is not null then l.value else t.value end as value from t left join last l on t.user_id = l.user_id
  where not coalesce(l.event_type = 'error', false)
union all select user_id, value from last where event_type <> 'error' and user_id not in (select user_id from t)
"""


@query(_CHANGED)
def stream_apply_changes(spark, sf):
    base = scratch_path(spark, "cdc")
    accounts = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    flows.start_table(accounts, f"{base}/table", "user_id", 16)
    for _ in range(2):  # the second run finds nothing new and leaves the table as it is
        flows.stream_apply_changes(
            _events(spark, sf), f"{base}/table", "user_id", ["ts", "event_id"], "event_type", f"{base}/state", ["error"]
        )
    return flows.newest_version(spark, f"{base}/table")


@query("select count(*) as rows, round(sum(value), 2) as total from events where event_type = 'click'")
def stream_metrics(spark, sf):
    meter = flows.FlowMeter("clicks")
    spark.streams.addListener(meter)
    clicks = flows.stream_filter(_events(spark, sf), F.col("event_type") == "click")
    flows.run_to_table(flows.stream_metrics(clicks, "clicks", total="value"))
    rows = [(b["rows"], b["total"]) for b in meter.wait()]
    spark.streams.removeListener(meter)
    return spark.createDataFrame(rows, "rows bigint, total double").agg(
        F.sum("rows").alias("rows"), F.round(F.sum("total"), 2).alias("total")
    )
