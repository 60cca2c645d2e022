"""Small helpers shared by every operator."""

from __future__ import annotations

import contextlib
import itertools
import tempfile
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.manifests import remove

_serial = itertools.count()


class OrderRequired(ValueError):
    """An order-dependent operator was called without a sort order."""


def names(columns: str | Iterable[str] | None) -> list[str]:
    """``"a"``, ``["a", "b"]`` or ``None`` as a list of column names."""
    if columns is None:
        return []
    return [columns] if isinstance(columns, str) else list(columns)


def sort_keys(order, who: str) -> list[tuple[str, bool]]:
    """Sort spec as ``[(column, descending)]``.

    Accepts ``"c"``, ``"c desc"`` and ``(c, descending)`` items. Rows of a DataFrame carry no arrival
    order, so operators that depend on one refuse to run without it.
    """
    out = []
    for item in [order] if isinstance(order, (str, tuple)) else list(order or []):
        if isinstance(item, tuple):
            out.append((item[0], bool(item[1])))
        else:
            column, _, way = item.partition(" ")
            out.append((column, way.strip().lower() == "desc"))
    if not out:
        raise OrderRequired(f"{who} depends on row order: pass order=[...] with a total order")
    return out


def order_columns(order: Sequence[tuple[str, bool]], reverse: bool = False) -> list[Column]:
    """Sort Columns; nulls first when ascending, last when descending (Spark's own default)."""
    return [
        F.col(c).desc_nulls_last() if desc != reverse else F.col(c).asc_nulls_first()
        for c, desc in order
    ]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` uses."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name = f"__{stem}{next(_serial)}"
    return name


def match_on(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], null_safe: bool = False) -> Column:
    """Equi-join condition over column pairs; ``null_safe`` treats two NULLs as equal."""
    tests = [
        left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in pairs
    ]
    return reduce(lambda x, y: x & y, tests)


def join_back(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``side`` on equally named keys, NULL keys matching each other; key columns kept once."""
    renamed = {k: fresh(df, f"key_{k}") for k in keys}
    other = side.withColumnsRenamed(renamed)
    joined = df.join(other, match_on(df, other, list(renamed.items()), null_safe=True), how)
    return joined.drop(*[other[c] for c in renamed.values()]) if how not in ("left_semi", "left_anti") else joined


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_true(condition: Column) -> Column:
    """Condition with NULL counted as false, as in the filter steps of ETL tools."""
    return F.coalesce(condition, F.lit(False))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


@contextlib.contextmanager
def session_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Settings of the session for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own; a cluster must name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A new path below the shared folder for a written intermediate."""
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so iterative plans stay short and survive lost executors."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame, stem: str = "step") -> DataFrame:
    """An intermediate that several later steps read, as a Parquet table in the shared folder.

    It is computed once, survives lost executors, and each reader scans only the columns it needs.
    """
    path = scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def written_for_now(df: DataFrame, stem: str = "step") -> Iterator[DataFrame]:
    """Like ``written``, but the files go at the end of the block: what is read later has to be written within."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)
