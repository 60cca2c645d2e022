"""Loading and change application.

Operators on DataFrames return the table as it is afterwards. On plain files it is written to a new place and swapped in by
the caller (``write_swapped``); nothing overwrites its own input. Operators on a ``KeyedTable`` write only what changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import join_back, match_on, names, sort_keys
from tallyloom.operators.joins import one_per_key
from tallyloom.operators.ordered import _order_struct
from tallyloom.sources import manifests
from tallyloom.sources.keyed_table import KeyedTable, fill_missing


def _keys(keys) -> list[str]:
    keys = names(keys)
    if not keys:
        raise ValueError("the target has no key: refusing to match rows")
    return keys


def upsert(target: DataFrame, source: DataFrame, keys, update_cols: Sequence[str] | None = None, order=None) -> DataFrame:
    """Update rows whose key is known, insert the others; only ``update_cols`` change on known keys.

    Several source rows for one key need ``order`` (the last wins), otherwise they are an error. One full join does
    it all; repeating it changes nothing.
    """
    keys = _keys(keys)
    update = [c for c in (update_cols if update_cols is not None else source.columns) if c not in keys]
    unique = one_per_key(source, keys, "last" if order else "error", order)
    side = unique.select(*[F.col(c).alias(f"__s_{c}") for c in unique.columns], F.lit(True).alias("__src"))
    both = target.withColumn("__tgt", F.lit(True)).join(
        side, match_on(target, side, [(k, f"__s_{k}") for k in keys], null_safe=True), "full"
    )
    known, came = F.col("__tgt").isNotNull(), F.col("__src").isNotNull()
    columns = []
    for c in target.columns:
        new = F.col(f"__s_{c}") if c in unique.columns else F.lit(None).cast(target.schema[c].dataType)
        changes = came & (~known | F.lit(c in update))
        columns.append(F.when(changes, new).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c))
    return both.select(*columns)


# fixed values: row strategies
DD_INSERT, DD_UPDATE, DD_DELETE, DD_REJECT = 0, 1, 2, 3


def apply_strategy(target: DataFrame, source: DataFrame, flag_col: str, keys) -> tuple[DataFrame, DataFrame]:
    """(result, rejects): each source row is inserted, updated, deleted or rejected by its flag; NULL keys are equal.

    An insert of a known key and an unknown flag are rejected; an update or delete of an unknown key does nothing. The
    source comes down to one row per key first (two rows that insert or update one key are an error), then one full join
    with the target decides; the rejects need one join with the target's keys.
    """
    keys = _keys(keys)
    flag, known, came = F.col(flag_col), F.col("__tgt").isNotNull(), F.col("__src").isNotNull()

    def only(code: int) -> list[Column]:
        """The row of a flag as __r<code> and how many there are."""
        return [F.max(F.when(flag == code, F.struct(*source.columns))).alias(f"__r{code}"), F.count_if(flag == code).alias(f"__n{code}")]

    wanted = source.filter(flag.isin(DD_INSERT, DD_UPDATE, DD_DELETE))
    counted = wanted.groupBy(*keys).agg(*only(DD_INSERT), *only(DD_UPDATE), F.count_if(flag == DD_DELETE).alias("__del"))
    side = counted.withColumnsRenamed({k: f"__s_{k}" for k in keys}).withColumn("__src", F.lit(True))
    both = target.withColumn("__tgt", F.lit(True)).join(side, match_on(target, side, [(k, f"__s_{k}") for k in keys], null_safe=True), "full")
    twice = F.when(known, F.col(f"__n{DD_UPDATE}")).otherwise(F.col(f"__n{DD_INSERT}")) > 1
    row = F.when(twice, F.raise_error(F.lit("several source rows insert or update one key"))).otherwise(
        F.when(known, F.col(f"__r{DD_UPDATE}")).otherwise(F.col(f"__r{DD_INSERT}")))
    both = both.withColumn("__row", F.when(came, row)).filter(~F.coalesce(F.col("__del") > 0, F.lit(False)) & (known | F.col("__row").isNotNull()))
    columns = []
    for c in target.columns:
        kind = target.schema[c].dataType
        new = F.col(f"__row.{c}") if c in source.columns and c != flag_col else F.lit(None).cast(kind)
        columns.append(F.when(F.col("__row").isNull(), F.col(c)).otherwise(new).cast(kind).alias(c))
    odd = flag.isNull() | ~flag.isin(DD_INSERT, DD_UPDATE, DD_DELETE)
    have = target.select(*[F.col(k).alias(f"__t_{k}") for k in keys]).distinct().withColumn("__tgt", F.lit(True))
    asked = source.join(have, match_on(source, have, [(k, f"__t_{k}") for k in keys], null_safe=True), "left")
    return both.select(*columns), asked.filter(odd | ((flag == DD_INSERT) & known)).select(*source.columns)


def last_changes(changes: DataFrame, keys, seq) -> DataFrame:
    """The last change per key; a map-side combined maximum, so long histories of one key stay cheap."""
    keys = names(keys)
    at = _order_struct(changes, sort_keys(seq, "apply_changes"))
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), at).alias("__c")).select("__c.*")


def apply_changes(
    target: DataFrame,
    changes: DataFrame,
    keys,
    seq,
    op: str,
    deletes: Sequence[str] = ("delete",),
) -> DataFrame:
    """Change feed with insert, update and delete events: the last event per key decides, in one full join.

    Columns that the changes don't have keep their value on known keys and are NULL on new ones. A NULL event type is no
    delete. ``change_table`` does the same on a table that isn't rewritten.
    """
    keys = _keys(keys)
    last = last_changes(changes, keys, seq)
    side = last.select(*[F.col(c).alias(f"__s_{c}") for c in last.columns], F.lit(True).alias("__src"))
    both = target.withColumn("__tgt", F.lit(True)).join(
        side, match_on(target, side, [(k, f"__s_{k}") for k in keys], null_safe=True), "full"
    )
    came = F.col("__src").isNotNull()
    both = both.filter(~(came & F.coalesce(F.col(f"__s_{op}").isin(*deletes), F.lit(False))))
    columns = []
    for c in target.columns:
        new = F.when(came, F.col(f"__s_{c}")).otherwise(F.col(c)) if c in last.columns else F.col(c)
        columns.append(new.cast(target.schema[c].dataType).alias(c))
    return both.select(*columns)


def change_table(
    table: KeyedTable, changes: DataFrame, seq, op: str, deletes: Sequence[str] = ("delete",), source: str | None = None, batch: int | None = None
) -> KeyedTable:
    """``apply_changes`` on a keyed table: only the keys that the changes name are written, in a segment of their own.

    Where the changes carry all columns, the table isn't read at all; otherwise the buckets of their keys are.
    """
    if source is not None and (done := table.last_batch(source)) is not None and done >= batch:
        return table
    last = last_changes(changes, table.keys, seq)
    kept = [f.name for f in table.schema if f.name in last.columns]
    if len(kept) < len(table.schema):
        last = fill_missing(table, last.select(*kept, F.col(op).alias("__op")), kept)
    else:
        last = last.select(*kept, F.col(op).alias("__op"))
    return table.write_changes(last, F.col("__op").isin(*deletes), source, batch)


def upsert_table(table: KeyedTable, source: DataFrame, update_cols: Sequence[str] | None = None, order=None) -> KeyedTable:
    """``upsert`` on a keyed table: the buckets of the source's keys are read where known rows keep columns, nothing else is
    and only the source's keys are written."""
    side = one_per_key(source, table.keys, "last" if order else "error", order)
    every = [f.name for f in table.schema]
    if set(every) <= set(side.columns) and (update_cols is None or set(every) <= {*update_cols, *table.keys}):
        return table.write_changes(side.select(*every))
    known = table.read(table.buckets_of(side))
    known = join_back(known, side.select(*table.keys), table.keys, "left_semi")
    return table.write_changes(upsert(known, side, table.keys, update_cols))


def delete_rows(target: DataFrame, keys_df: DataFrame, keys) -> DataFrame:
    """Rows whose key is not listed; NULL keys are equal, as in ``upsert``."""
    keys = _keys(keys)
    gone = keys_df.select(*[F.col(k).alias(f"__d_{k}") for k in keys])
    return target.join(gone, match_on(target, gone, [(k, f"__d_{k}") for k in keys], null_safe=True), "left_anti")


def truncate_load(df: DataFrame, path: str) -> None:
    """Replace the contents of a Parquet folder."""
    df.write.mode("overwrite").parquet(path)


def write_swapped(df: DataFrame, base: str, pointer: str = "CURRENT") -> str:
    """Write a new version below ``base`` and point to it by one rename; readers of the old version are not disturbed, and
    there is a version to read at every moment."""
    spark = df.sparkSession
    version = f"{base.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    numbers = manifests.numbers(spark, f"{base}/{pointer}")
    manifests.publish(spark, f"{base}/{pointer}", max(numbers, default=-1) + 1, version)
    return version


def read_swapped(spark, base: str, pointer: str = "CURRENT") -> DataFrame:
    return spark.read.parquet(manifests.newest(spark, f"{base}/{pointer}")[1])
