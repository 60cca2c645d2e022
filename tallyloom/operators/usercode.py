"""User code at four places: per row, per flow, per group, and as a row source or an aggregate.

Everything that can be said with native expressions should be (``select.derive``); these run Python workers on Arrow
batches and keep Spark's partitioning.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from tallyloom.core import names, order_columns, shuffle_width, sort_keys
from tallyloom.operators.ordered import sequence


def row_script(df: DataFrame, fn: Callable, columns, outputs: str | StructType) -> DataFrame:
    """Vectorised per-row script: ``fn(pandas frame of columns) -> pandas frame of outputs``."""
    import pandas as pd

    def script(frame):
        return fn(frame)

    script.__annotations__ = {"frame": pd.DataFrame, "return": pd.DataFrame}
    cols, run = names(columns), F.pandas_udf(script, outputs)
    out = df.withColumn("__script", run(F.struct(*cols)))
    return out.select(*df.columns, "__script.*")


def flow_script(df: DataFrame, main: Callable, schema, start: Callable | None = None, end: Callable | None = None) -> DataFrame:
    """Start / main / end script per partition: ``start() -> state``, ``main(state, frame) -> frame``,
    ``end(state) -> frame or None``. State lives within one partition, as a flow copy's state does."""

    def run(batches: Iterator):
        state = start() if start else None
        for frame in batches:
            yield main(state, frame)
        if end:
            last = end(state)
            if last is not None:
                yield last

    return df.mapInPandas(run, schema)


def group_script(df: DataFrame, keys, fn: Callable, schema, order, part_rows: int = 100_000, **limits) -> DataFrame:
    """Ordered script per group: ``fn(frame) -> frame``, called for parts of at most ``part_rows`` consecutive rows.

    Frames come sorted along ``order`` and carry their number in ``part``. Ordinary groups are one part; a group of
    any size is spread over tasks, and the script's results per part are merged by an ordinary aggregate.
    """
    import pandas as pd

    keys = names(keys)
    numbered = sequence(df, "__nth", order, by=keys, **limits)
    parts = numbered.withColumn("part", F.floor((F.col("__nth") - 1) / part_rows).cast("int") + 1)

    def run(frame):
        return fn(frame.sort_values("__nth").drop(columns="__nth").reset_index(drop=True))

    run.__annotations__ = {"frame": pd.DataFrame, "return": pd.DataFrame}
    return parts.groupBy(*keys, "part").applyInPandas(run, schema)


def row_generator(
    df: DataFrame, handler: type, schema: str | StructType | Callable[[StructType], StructType], keys=(), order=()
) -> DataFrame:
    """Custom row generator: a Python table function over the rows as Arrow batches.

    ``handler`` is a class whose ``eval`` takes a record batch and yields tables; an instance sees the rows of one group of
    ``keys``, along ``order``, batch after batch, so it may keep state, and its ``terminate``, if there, yields last rows.
    Without keys an instance sees some rows in no order. ``schema`` says what comes out; a function works it out from the
    rows' own schema, so one handler serves tables of any layout.
    """
    table = df.asTable()
    if names(keys):
        table = table.partitionBy(*names(keys))
        if order:
            table = table.orderBy(*order_columns(sort_keys(order, "row_generator")))
    elif order:
        raise ValueError("rows are in order within groups: pass keys=[...] with order=[...]")
    return F.arrow_udtf(handler, returnType=schema(df.schema) if callable(schema) else schema)(table)


@dataclass(frozen=True)
class Aggregate:
    """An aggregate written in Python over numpy arrays of values.

    ``init`` makes an empty state (anything that can be pickled), ``update`` takes in an array of values, ``merge`` joins two
    states, ``finish`` makes the result. ``update`` and ``merge`` return the new state.
    """

    init: Callable[[], Any]
    update: Callable[[Any, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


#: Keys whose states a task keeps before it passes them on, and rows that one call of ``update`` gets at most.
STATES, UPDATE_ROWS = 10_000, 65_536


def custom_aggregate(df: DataFrame, keys, out: str, aggregate: Aggregate, column: str | Column, kind: str = "double") -> DataFrame:
    """One row per group with an aggregate written in Python; NULL values are left out.

    Rows stay where they are: each task folds its own into one state per key and passes states on. They are merged in two
    steps, first dealt by key and task, then by key, one after the other as they come, so a task holds the states of
    ``STATES`` keys at most, or two states of one key; a group of any size, of equal rows as well, is spread over all tasks.
    """
    keys = names(keys)
    value = F.col(column) if isinstance(column, str) else column
    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    state_ddl = ", ".join(filter(None, [key_ddl, "__state binary, __task int"]))
    key_of = lambda batch: list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows

    def rows(schema: pa.Schema, states: dict, task: int) -> pa.RecordBatch:
        columns = list(zip(*states)) if keys else []
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, schema.field(k).type) for k, c in zip(keys, columns)), pa.array([pickle.dumps(s) for s in states.values()], pa.binary()),
             pa.array([task] * len(states), pa.int32())], names=[*keys, "__state", "__task"])

    def fold(batches):
        states, schema, task = {}, None, TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, UPDATE_ROWS):
                batch, places = whole.slice(at, UPDATE_ROWS), defaultdict(list)
                schema = batch.schema
                for place, key in enumerate(key_of(batch)):
                    places[key].append(place)
                values, valid = batch.column("__v").to_numpy(zero_copy_only=False), batch.column("__v").is_valid().to_numpy(zero_copy_only=False)
                for key, found in places.items():
                    found = np.array(found)
                    states[key] = aggregate.update(states[key] if key in states else aggregate.init(), values[found[valid[found]]])
                if len(states) > STATES:
                    yield rows(schema, states, task)
                    states = {}
        if states:
            yield rows(schema, states, task)

    def merge(finish: bool):
        def run(batches):
            """States come sorted by key: one is open at a time."""
            now, state, schema, done = None, None, None, {}
            for batch in batches:
                schema = batch.schema
                for key, packed in zip(key_of(batch), batch.column("__state").to_pylist()):
                    if key != now:
                        if now is not None:
                            done[now] = aggregate.finish(state) if finish else state
                        now, state = key, pickle.loads(packed)
                    else:
                        state = aggregate.merge(state, pickle.loads(packed))
                if len(done) > STATES:
                    yield made(schema, done)
                    done = {}
            if now is not None:
                done[now] = aggregate.finish(state) if finish else state
                yield made(schema, done)

        def made(schema, done):
            if not finish:
                return rows(schema, done, 0)
            columns = list(zip(*done)) if keys else []
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, schema.field(k).type) for k, c in zip(keys, columns)), pa.array(list(done.values()), result)], names=[*keys, out])

        return run

    result = to_arrow_type(DataType.fromDDL(kind))
    width = shuffle_width(df.sparkSession)
    partial = df.select(*keys, value.alias("__v")).mapInArrow(fold, state_ddl)
    near = partial.repartition(width, *keys, F.col("__task") % F.lit(max(1, int(width**0.5)))).sortWithinPartitions(*keys, "__task")
    joined = near.mapInArrow(merge(False), state_ddl)
    last = (joined.repartition(width, *keys) if keys else joined.coalesce(1)).sortWithinPartitions(*keys, "__task")
    return last.mapInArrow(merge(True), ", ".join(filter(None, [key_ddl, f"`{out}` {kind}"])))


def sub_flow(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Reusable sub-flows applied in turn."""
    for step in steps:
        df = df.transform(step)
    return df
