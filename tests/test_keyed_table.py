"""Tables by key that change without being rewritten, and what streams and loads do with them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import load
from tallyloom.sources import manifests
from tallyloom.sources.keyed_table import KeyedTable
from tallyloom.streaming import flows


def frame(spark, data):
    return spark.createDataFrame(data, "k int, v string, w int")


def contents(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


def files(spark, table, bucket):
    return {s["path"] for s in table.manifest["segments"] if bucket in s["buckets"]}


def test_changes_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(2)
    now = {k: (k, f"v{k}", k) for k in [None, *range(40)]}
    table = KeyedTable.create(frame(spark, list(now.values())), str(tmp_path / "t"), "k", 8)
    assert contents(table) == sorted(now.values(), key=repr)
    for step in range(5):
        rows = [(k, f"s{step}", step, rng.random() < 0.3) for k in rng.sample([None, *range(60)], 7)]
        table = table.write_changes(spark.createDataFrame(rows, "k int, v string, w int, gone boolean"), F.col("gone"))
        for k, v, w, gone in rows:
            now.pop(k, None) if gone else now.__setitem__(k, (k, v, w))
        if step == 2:
            table = table.compact()
            assert not table.changed_buckets()
        assert contents(KeyedTable.load(spark, table.path)) == sorted(now.values(), key=repr)
    old = table.compact(1)
    old.vacuum(1)
    assert contents(old) == sorted(now.values(), key=repr) and manifests.numbers(spark, f"{table.path}/manifests") == [old.version]
    assert len(manifests.listing(spark, f"{table.path}/data")) == len({s["path"] for s in old.manifest["segments"]})


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = KeyedTable.create(frame(spark, [(k, "a", 0) for k in range(100)]), str(tmp_path / "t"), "k", 8)
    change = frame(spark, [(3, "b", 1)])
    touched = table.buckets_of(change)
    after = table.write_changes(change)
    assert len(touched) == 1
    for bucket in range(8):
        assert (files(spark, table, bucket) == files(spark, after, bucket)) == (bucket not in touched)
    assert contents(table) == sorted([(k, "a", 0) for k in range(100)], key=repr)  # the version before stays as it was
    plan = after.read(set(range(8)) - touched)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_writers_take_turns(spark, tmp_path):
    table = KeyedTable.create(frame(spark, [(1, "a", 0)]), str(tmp_path / "t"), "k", 2)
    table.write_changes(frame(spark, [(2, "b", 0)]))
    with pytest.raises(FileExistsError):
        table.write_changes(frame(spark, [(3, "c", 0)]))
    assert contents(KeyedTable.load(spark, table.path)) == [(1, "a", 0), (2, "b", 0)]


def test_batches_count_once(spark, tmp_path):
    table = KeyedTable.create(frame(spark, [(1, "a", 0)]), str(tmp_path / "t"), "k", 2)
    changes = spark.createDataFrame([(1, "b", 1, 1, "update"), (1, "c", 2, 2, "update"), (5, "e", 1, 1, None)], "k int, v string, w int, at int, op string")
    first = load.change_table(table, changes, "at", "op", source="s", batch=0)
    again = load.change_table(first, changes.withColumn("v", F.lit("x")), "at", "op", source="s", batch=0)
    assert again.version == first.version and contents(again) == [(1, "c", 2), (5, "e", 1)]
    assert contents(again.before_batch("s", 0)) == [(1, "a", 0)]


def test_missing_columns_keep_their_value(spark, tmp_path):
    table = KeyedTable.create(frame(spark, [(1, "a", 10), (2, "b", 20)]), str(tmp_path / "t"), "k", 4)
    changes = spark.createDataFrame([(1, "z", 1, "update"), (3, "n", 1, "insert"), (2, "q", 1, "delete")], "k int, v string, at int, op string")
    assert contents(load.change_table(table, changes, "at", "op")) == [(1, "z", 10), (3, "n", None)]
    table = KeyedTable.create(frame(spark, [(1, "a", 10), (2, "b", 20)]), str(tmp_path / "u"), "k", 4)
    assert contents(load.upsert_table(table, frame(spark, [(2, "u", 21), (4, "d", 40)]), ["w"])) == [(1, "a", 10), (2, "b", 21), (4, "d", 40)]


def test_one_join_in_the_plans(spark):
    target = spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    changes = spark.range(50).select(F.col("id").alias("k"), F.lit("b").alias("v"), F.lit(1).alias("at"), F.lit("update").alias("op"), (F.col("id") % 5).alias("flag"))
    result, rejects = load.apply_strategy(target, changes.select("k", "v", "flag"), "flag", "k")
    for df in (load.apply_changes(target, changes, "k", "at", "op"), result, rejects):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_strategy_of_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    source = spark.createDataFrame([(1, "u", 1), (None, "m", 1), (2, "i", 0), (3, "x", 1), (3, "y", 1), (4, "z", 0), (4, "z", 2), (1, "i", 0)], "k int, v string, flag int")
    result, rejects = load.apply_strategy(target, source, "flag", "k")
    assert sorted(map(tuple, result.collect()), key=repr) == sorted([(1, "u"), (None, "m"), (2, "i")], key=repr)
    assert [tuple(r) for r in rejects.collect()] == [(1, "i", 0)]
    twice, _ = load.apply_strategy(target, spark.createDataFrame([(1, "u", 1), (1, "w", 1)], "k int, v string, flag int"), "flag", "k")
    with pytest.raises(Exception, match="several source rows"):
        twice.collect()


def test_running_totals_write_only_what_arrived(spark, tmp_path):
    base, state, inbox = (str(tmp_path / n) for n in ("out", "state", "in"))
    def arrive(rows):
        spark.createDataFrame(rows, "k int, at int, x double").write.mode("append").parquet(inbox)
        stream = flows.stream_files(spark, inbox, "k int, at int, x double")
        flows.stream_running(stream, "k", "at", "x", "average", "mean", base, state, buckets=16)
        return KeyedTable.load(spark, f"{base}/totals")

    arrive([(k, 1, float(k)) for k in range(30)])
    before = arrive([(7, 2, 9.0)])
    after = arrive([(7, 3, None), (99, 3, 5.0)])
    assert len(after.manifest["segments"][-1]["buckets"]) <= 2
    quiet = set(range(16)) - after.buckets_of(spark.createDataFrame([(7,), (99,)], "k int"))
    assert all(files(spark, before, b) == files(spark, after, b) for b in quiet)
    found = {(r.k, r["at"]): r["mean"] for r in spark.read.parquet(f"{base}/rows").collect()}
    assert found[7, 1] == 7 and found[7, 2] == 8 and found[7, 3] == 8 and found[99, 3] == 5 and len(found) == 33


def test_ordered_running_values_call_the_state_by_buckets(spark, tmp_path):
    """500 keys, NULL and NaN among them, in 4 buckets: few calls, values as ever."""
    from tallyloom.core import session_settings

    state, inbox, out = (str(tmp_path / n) for n in ("state", "in", "out"))
    schema, total = "k double, minute int, x double", {}
    keys = [None, float("nan"), -0.0, *map(float, range(1, 498))]
    for first in (10, 100):  # the second arrival goes on from what the first has left
        spark.createDataFrame([(k, first + m, float(m)) for m in range(3) for k in keys], schema).write.mode("append").parquet(inbox)
        stream = flows.stream_files(spark, inbox, schema).withColumn("ts", F.timestamp_seconds(F.col("minute") * 60))
        ran = flows.stream_running_ordered(stream, "k", ["x"], "x", "sum", "total", "ts", "0 minutes", buckets=4)
        with session_settings(spark, flows.STATE_STORE):
            query = ran.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
            query.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), query.recentProgress) if p["stateOperators"]]
        assert 0 < max(kept) < 60
    found = spark.read.schema(ran.schema).parquet(out).collect()
    assert {r.minute for r in found} == {10, 11, 12, 100, 101, 102} and len(found) == 6 * len(keys) and not any(r.late for r in found)
    for r in sorted(found, key=lambda r: r.minute):
        key = repr(r.k or r.k and 0.0)
        total[key] = total.get(key, 0.0) + r.x
        assert r.total == total[key]


def test_ordered_running_values_and_late_rows(spark, tmp_path):
    from tallyloom.core import session_settings

    state, inbox, out = (str(tmp_path / n) for n in ("state", "in", "out"))
    schema = "k int, minute int, x double"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(inbox)
        stream = flows.stream_files(spark, inbox, schema).withColumn("ts", F.timestamp_seconds(F.col("minute") * 60))
        ran = flows.stream_running_ordered(stream, "k", ["x"], "x", "sum", "total", "ts", "10 minutes", "20 minutes")
        with session_settings(spark, flows.STATE_STORE):
            ran.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.k, r.minute, r.x, r.total, r.late) for r in spark.read.schema(ran.schema).parquet(out).collect())

    assert arrive((1, 100, 1.0), (1, 90, 2.0), (1, 89, 5.0), (2, 95, 4.0)) == [(1, 89, 5.0, 5.0, False), (1, 90, 2.0, 7.0, False)]
    # 95 is in time, 85 is late by less than the grace, 60 by more
    found = arrive((1, 95, 10.0), (1, 85, 100.0), (1, 60, 1000.0), (2, 130, 0.0))
    assert found[:2] == [(1, 85, 100.0, 107.0, True), (1, 89, 5.0, 5.0, False)]
    assert [r for r in found if r[1] >= 95] == [(1, 95, 10.0, 117.0, False), (1, 100, 1.0, 118.0, False), (2, 95, 4.0, 4.0, False)]
    assert not any(r[1] == 60 for r in found)
