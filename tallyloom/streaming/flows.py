"""The row operators on Structured Streaming."""

from __future__ import annotations

import pickle
import threading
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from tallyloom.core import fresh, join_back, match_on, names, scratch_path, sort_keys, written
from tallyloom.operators import load
from tallyloom.operators.aggregate import Agg, agg_column
from tallyloom.operators.joins import one_per_key
from tallyloom.operators.ordered import running_values
from tallyloom.operators.select import route
from tallyloom.sources import manifests
from tallyloom.sources.keyed_table import KeyedTable


def stream_files(spark: SparkSession, path: str, schema, format: str = "parquet", glob: str | None = None,
                 files_per_batch: int | None = None, **options) -> DataFrame:
    """File-polling source; ``glob`` names files of ``path``, or folders of it that are read with all their files."""
    reader = spark.readStream.schema(schema).format(format).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # in braces a plain name is a pattern too: only of patterns may a stream's path be a file
    return reader.load(f"{path.rstrip('/')}/{{{glob}}}" if glob else path)


def decode_messages(stream: DataFrame, schema: str | T.StructType, value: str = "value", key: str | None = "key",
                    reject: str = "reject") -> DataFrame:
    """Topic key/value bytes to typed columns; a record that is not valid JSON of the schema keeps its text in
    ``reject`` and has NULL fields."""
    text = F.col(value).cast("string")
    ddl = schema if isinstance(schema, str) else schema.simpleString()[len("struct<"):-1].replace(":", " ")
    parsed = F.from_json(text, f"{ddl}, __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})
    opened = stream.withColumn("__m", parsed)
    fields = [f.name for f in opened.schema["__m"].dataType.fields if f.name != "__bad"]
    keys = [F.col(key).cast("string").alias(key)] if key and key in stream.columns else []
    return opened.select(
        *keys, *[F.col(f"__m.{f}").alias(f) for f in fields],
        F.when(F.col("__m").isNull() | F.col("__m.__bad").isNotNull(), text).alias(reject),
    )


def encode_messages(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Rows as (key, value) bytes with a JSON value."""
    return df.select(
        F.col(key).cast("string").cast("binary").alias("key"), F.to_json(F.struct(*cols)).cast("binary").alias("value")
    )


def stream_filter(stream: DataFrame, condition: Column) -> DataFrame:
    return stream.filter(condition)


def stream_route(stream: DataFrame, groups: Mapping[str, Column], default: str = "default") -> dict[str, DataFrame]:
    """Recipient list: each branch is a stream of its own."""
    return route(stream, groups, default)


def stream_map(stream: DataFrame, exprs: Mapping[str, str | Column], types: Mapping[str, str] | None = None) -> DataFrame:
    """Payload mapping with body type conversion."""
    types = types or {}
    cells = {n: F.expr(e) if isinstance(e, str) else e for n, e in exprs.items()}
    return stream.select(*[(c.try_cast(types[n]) if n in types else c).alias(n) for n, c in cells.items()])


def stream_split(stream: DataFrame, column: str, sep: str, out: str | None = None) -> DataFrame:
    """One message to many rows."""
    import re

    return stream.withColumn(out or column, F.explode(F.split(column, re.escape(sep))))


def stream_enrich(
    stream: DataFrame, ref: DataFrame, keys: Sequence[tuple[str, str]], values: Mapping[str, str], match: str = "error", order=None
) -> DataFrame:
    """Content enricher: stream-static left join on a reference.

    A message never becomes several: where a key of ``ref`` has more rows, ``match`` decides as in ``one_per_key``.
    """
    side = one_per_key(ref, [b for _, b in keys], match, order).select(*[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(keys)],
                      *[F.col(c).alias(o) for c, o in values.items()])
    on = match_on(stream, side, [(a, f"__k{i}") for i, (a, _) in enumerate(keys)])
    return stream.join(side, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def stream_dedupe(stream: DataFrame, keys, time: str, watermark: str) -> DataFrame:
    """Idempotent consumer: the first message per key; state older than the watermark is dropped."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(names(keys))


def stream_aggregate(
    stream: DataFrame,
    keys,
    aggs: Sequence[Agg],
    time: str,
    window: str,
    watermark: str,
    slide: str | None = None,
    session: bool = False,
) -> DataFrame:
    """Aggregator over tumbling, sliding (``slide``) or session windows (``window`` is then the gap)."""
    span = F.session_window(time, window) if session else F.window(time, window, slide)
    grouped = stream.withWatermark(time, watermark).groupBy(*names(keys), span.alias("__w"))
    cells = grouped.agg(*[agg_column(stream, a) for a in aggs])
    out = [a.out for a in aggs]
    return cells.select(*names(keys), F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *out)


#: The default trigger: all that is there, then stop.
NOW = {"availableNow": True}


def _drain(query: StreamingQuery, wait: bool) -> StreamingQuery:
    if wait:
        query.awaitTermination()
    return query


# fixed values: what a running value keeps of what came before
_TOTALS = {"sum": "s", "count": "n", "average": "s", "maximum": "hi", "minimum": "lo"}


def stream_running(
    stream: DataFrame,
    keys,
    order,
    value: str,
    op: str,
    out: str,
    base: str,
    checkpoint: str,
    wait: bool = True,
    trigger: Mapping | None = None,
    buckets: int = 64,
) -> StreamingQuery:
    """Running value per key over an unbounded flow, at once and in order of arrival; rows go to ``base/rows``.

    ``trigger`` is what ``DataStreamWriter.trigger`` takes, by default everything available now.

    Each micro-batch runs the batch operator, which spreads hot keys over tasks, and adds what earlier batches left in the
    keyed table ``base/totals``. Only the totals of keys that arrived are read and written. Rows are written per batch id and
    the totals know their last batch, so a replayed batch rewrites the same files and counts once. Rows are ordered within a
    batch; batches follow each other. ``stream_running_ordered`` waits for late rows instead.
    """
    keys = names(keys)
    if op not in _TOTALS:
        raise ValueError(f"unsupported running operation {op!r}")
    totals = [F.sum(value).alias("s"), F.count(value).alias("n"), F.max(value).alias("hi"), F.min(value).alias("lo")]

    def feed(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch = written(batch, "arrived")
        ran = running_values(
            batch, [("count" if op == "count" else "sum" if op == "average" else op, value, "__l"), ("count", value, "__n")],
            order, keys,
        )
        new, now = batch.groupBy(*keys).agg(*totals), F.col("__l")
        table = None
        if manifests.numbers(session, f"{base}/totals/manifests"):
            table = KeyedTable.load(session, f"{base}/totals").before_batch(checkpoint, batch_id)
            before = table.read(table.buckets_of(new))
        else:
            before = new.limit(0)
        before = before.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("s", "n", "hi", "lo")])
        ran = join_back(ran, before.withColumnRenamed("__n", "__had"), keys)
        had, n = F.col("__had" if op == "count" else f"__{_TOTALS[op]}"), F.coalesce(F.col("__had"), F.lit(0)) + F.col("__n")
        joint = F.when(had.isNull(), now).when(now.isNull(), had).otherwise(had + now)
        shown = {"maximum": F.greatest(now, had), "minimum": F.least(now, had), "average": F.try_divide(joint, n)}.get(op, joint)
        ran.select(*batch.columns, shown.alias(out)).write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")
        both = join_back(new, before, keys)
        added = lambda c: F.when(F.col(f"__{c}").isNull(), F.col(c)).when(F.col(c).isNull(), F.col(f"__{c}")).otherwise(F.col(c) + F.col(f"__{c}"))
        after = both.select(
            *keys, added("s").cast(new.schema["s"].dataType).alias("s"), added("n").alias("n"),
            F.greatest("hi", "__hi").alias("hi"), F.least("lo", "__lo").alias("lo"),
        )
        if table is None:
            KeyedTable.create(after, f"{base}/totals", keys, buckets).write_changes(after.limit(0), None, checkpoint, batch_id)
        else:
            table = KeyedTable.load(session, f"{base}/totals").write_changes(after, None, checkpoint, batch_id)
            table.compact(8).vacuum()

    return _drain(
        stream.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint).trigger(**(trigger or NOW)).start(), wait
    )


#: Tuples of one value in the state of ``_OrderedValues``.
_PACK = 4096


def _same(x):
    """A key's value as Spark groups it: NaN equals NaN, lists and bytes are compared by what they hold."""
    if isinstance(x, (list, tuple)):
        return tuple(map(_same, x))
    return bytes(x) if isinstance(x, bytearray) else "NaN" if isinstance(x, float) and x != x else x


class _OrderedValues(StatefulProcessor):
    """Keeps the rows of a bucket of keys until the watermark has passed them, then gives them out in order with the running
    values of their keys. Each call reads and writes its state as a whole, however many keys it holds."""

    def __init__(self, rows: T.StructType, keys: Sequence[str], time: str, order: Sequence[tuple[str, bool]], value: str, op: str, out: str, grace: int) -> None:
        at = rows.names.index
        self.schema, self.keys, self.time, self.value = rows, [at(k) for k in keys], at(time), at(value)
        self.order, self.op, self.out, self.grace = [(at(c), descending) for c, descending in order], op, out, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, Row(*self.schema.names, self.out, "late")
        self.rows, self.totals = (handle.getListState(name, "many binary") for name in ("rows", "totals"))

    @staticmethod
    def _packed(values: list[tuple]) -> list[tuple]:
        """As few values of the state, each of up to ``_PACK`` tuples: the state turns every value into bytes by itself, slowly."""
        return [(pickle.dumps(values[at : at + _PACK], pickle.HIGHEST_PROTOCOL),) for at in range(0, len(values), _PACK)]

    @staticmethod
    def _unpacked(state):
        for (many,) in state.get():
            yield from pickle.loads(many)

    def _key(self, row: tuple) -> tuple:
        return tuple([row[k] for k in self.keys])

    def _millis(self, row: tuple) -> int:
        return int(row[self.time].timestamp() * 1000)

    def _wait(self, waiting: list[tuple]) -> None:
        self.handle.registerTimer(max(min(map(self._millis, waiting)) - self.grace, 1))

    def _shown(self, rows: list[tuple], late: bool):
        """Rows in order with the running values of their keys, which are kept afterwards."""
        for at, descending in reversed(self.order):
            rows.sort(key=lambda r: (r[at] is not None, r[at]) if r[at] is not None else (False,), reverse=descending)
        n_keys, totals = len(self.keys), {}
        for kept in self._unpacked(self.totals):
            totals[_same(kept[:n_keys])] = kept[:n_keys], list(kept[n_keys:])
        for row in rows:
            key = self._key(row)
            _, now = totals.setdefault(_same(key), (key, [None, 0, None, None]))
            x = row[self.value]
            if x is not None:
                x = float(x)
                s, n, hi, lo = now
                now[:] = (s or 0.0) + x, n + 1, x if hi is None else max(hi, x), x if lo is None else min(lo, x)
            s, n, hi, lo = now
            shown = {"sum": s, "count": float(n), "maximum": hi, "minimum": lo, "average": s / n if n else None}[self.op]
            yield self.row(*row, shown, late)
        self.totals.put(self._packed([(*key, *now) for key, now in totals.values()]))

    def handleInputRows(self, key, rows, timerValues):
        out_from, width = timerValues.getCurrentWatermarkInMs() + self.grace, len(self.schema)
        waiting, late = [], []
        for row in rows:
            row = tuple(row)[:width]  # behind it is the bucket
            (late if self._millis(row) <= out_from else waiting).append(row)
        if waiting:
            self.rows.appendList(self._packed(waiting))
            self._wait(waiting)
        if late:
            yield from self._shown(late, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out_to = timerValues.getCurrentWatermarkInMs() + self.grace
        ready, waiting = [], []
        for row in self._unpacked(self.rows):
            (ready if self._millis(row) <= out_to else waiting).append(row)
        if not ready:
            return
        if waiting:
            self.rows.put(self._packed(waiting))
            self._wait(waiting)
        else:
            self.rows.clear()
        yield from self._shown(ready, False)

    def close(self) -> None:
        pass


#: The state store that ``stream_running_ordered`` needs, a setting of the session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stream_running_ordered(
    stream: DataFrame, keys, order, value: str, op: str, out: str, time: str, wait: str, grace: str = "0 seconds", buckets: int = 256
) -> DataFrame:
    """Running value per key in event order, whatever the order of arrival: a stream of the rows with ``out`` and ``late``.

    The rows and totals of a bucket of keys are the engine's keyed state: a micro-batch touches the buckets that arrived and
    those whose timer the watermark has passed, and a restart goes on from the checkpoint, with the same ``buckets``. A call to
    the state costs more than many rows, and calls are per bucket, not per key. Rows are held for ``wait`` behind the newest
    time seen, then come out in order. Policy for late rows: one that is behind that, but by no more than ``grace``, comes
    out at once, marked ``late``, with the value that it brings the total to; a later one is dropped, and counted by the
    query's progress. A bucket's totals and rows of one such span are in one task's memory; more buckets make that less.
    Ordering columns come after ``time``.

    Set ``STATE_STORE`` in the session before the query starts.
    """
    keys = names(keys)
    if op not in _TOTALS:
        raise ValueError(f"unsupported running operation {op!r}")
    sort = [(time, False), *sort_keys(order, "stream_running_ordered")]
    millis = _millis_of(stream.sparkSession, grace)
    rows = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    shown = T.StructType([*rows, T.StructField(out, T.DoubleType()), T.StructField("late", T.BooleanType())])
    delay = f"{(_millis_of(stream.sparkSession, wait) + millis)} milliseconds"
    bucket = fresh(stream, "bucket")
    dealt = stream.withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    kept = dealt.withWatermark(time, delay).groupBy(bucket)
    return kept.transformWithState(_OrderedValues(rows, keys, time, sort, value, op, out, millis), shown, "Append", "EventTime")


def _millis_of(spark: SparkSession, span: str) -> int:
    """A span like "2 days" in milliseconds."""
    at = spark.sql(f"select timestamp_millis(0) + interval {span} as t").select(F.unix_millis("t").alias("ms"))
    return int(at.first().ms)


def stream_apply_changes(
    changes: DataFrame,
    base: str,
    keys,
    seq,
    op: str,
    checkpoint: str,
    deletes: Sequence[str] = ("delete",),
    wait: bool = True,
    trigger: Mapping | None = None,
    compact_at: int = 8,
) -> StreamingQuery:
    """Change subscriber feeding a keyed table below ``base``, which ``start_table`` puts there.

    Each micro-batch writes the keys it names into the buckets they belong to; other buckets keep their files. The table knows
    the last batch of this checkpoint, so a replayed batch counts once. A bucket with more than ``compact_at`` change
    segments is written anew; versions behind the last few are dropped.
    """
    keys = names(keys)

    def feed(batch: DataFrame, batch_id: int) -> None:
        table = KeyedTable.load(batch.sparkSession, base)
        if table.keys != keys:
            raise ValueError(f"the table's key is {table.keys}, not {keys}")
        after = load.change_table(table, batch, seq, op, deletes, checkpoint, batch_id)
        after.compact(compact_at).vacuum()

    return _drain(
        changes.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint).trigger(**(trigger or NOW)).start(), wait
    )


def start_table(table: DataFrame, base: str, keys, buckets: int = 64) -> KeyedTable:
    return KeyedTable.create(table, base, keys, buckets)


def newest_version(spark: SparkSession, base: str) -> DataFrame:
    """Table as of the last batch that was written, whether or not later runs found new data."""
    return KeyedTable.load(spark, base).read()


class FlowMeter(StreamingQueryListener):
    """Collects observed metrics and row counts per micro-batch: ``batches`` is a list of dicts."""

    def __init__(self, name: str):
        self.name, self.batches, self._ended = name, [], threading.Event()

    def wait(self, seconds: float = 60) -> list[dict]:
        """The metrics of all batches, once the query has ended and the listener has heard of it."""
        self._ended.wait(seconds)
        return self.batches

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches.append({"batch": event.progress.batchId, **row.asDict()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.set()  # events come in order: all progress has been heard


def stream_metrics(stream: DataFrame, name: str, **sums: str) -> DataFrame:
    """Flow meter: row count (and sums) of every micro-batch under ``name``; read them with FlowMeter."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(o) for o, c in sums.items()])


def run_to_table(stream: DataFrame, mode: str = "append", prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over everything available now and read its result back from the shared folder."""
    spark = stream.sparkSession
    folder = scratch_path(spark, "stream")
    if mode == "append":
        query = (
            stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).start(f"{folder}/data")
        )
    else:
        def replace(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/data")

        query = (
            stream.writeStream.outputMode(mode).foreachBatch(replace)
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    schema = stream.schema
    return spark.read.schema(schema).parquet(f"{folder}/data")
