"""Sinks. Output is a folder of part files; a single file is written only on request."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tallyloom.core import cut_lineage, names


def write_delimited(df: DataFrame, path: str, sep: str = ";", header: bool = True, append: bool = False,
                    quote: str = '"', single_file: bool = False, **options: Any) -> None:
    out = df.coalesce(1) if single_file else df
    out.write.mode("append" if append else "overwrite").options(
        sep=sep, header=header, quote=quote, escape=quote, **options
    ).csv(path)


def write_table(df: DataFrame, name: str, mode: str = "append", batch: int = 1000, format: str = "parquet",
                **options: Any) -> None:
    """Catalog table, or a JDBC table when ``url`` is given; truncate is off, ``batch`` rows per round trip."""
    if "url" in options:
        df.write.format("jdbc").mode(mode).options(dbtable=name, batchsize=batch, truncate=False, **options).save()
    elif mode == "append" and df.sparkSession.catalog.tableExists(name):
        df.select(*df.sparkSession.table(name).columns).write.insertInto(name)
    else:
        df.write.format(format).mode(mode).options(**options).saveAsTable(name)


def write_bucketed(df: DataFrame, name: str, keys, buckets: int, mode: str = "overwrite") -> None:
    """Table bucketed and sorted on its join keys, so that later joins and aggregates on them need no shuffle."""
    keys = names(keys)
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def to_json_field(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Columns as one JSON document column; NULL fields are left out."""
    return df.withColumn(out, F.to_json(F.struct(*cols)))


def write_xml(df: DataFrame, path: str, row_tag: str, root_tag: str = "rows", mode: str = "overwrite") -> None:
    df.write.format("xml").mode(mode).option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def to_xml_field(df: DataFrame, cols: Sequence[str], out: str, row_tag: str = "row") -> DataFrame:
    """Columns as one XML document column."""
    return df.withColumn(out, F.to_xml(F.struct(*cols), {"rowTag": row_tag, "indentation": ""}))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by=None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*names(by)) if by else writer).parquet(path)


def write_partitioned(df: DataFrame, path: str, by, format: str = "parquet", mode: str = "overwrite",
                      rows_per_file: int = 1_000_000) -> None:
    """Burst: one folder per group value. A large group is written by several tasks, in files of bounded size."""
    df.write.mode(mode).format(format).option("maxRecordsPerFile", rows_per_file).partitionBy(*names(by)).save(path)


def stage(df: DataFrame, name: str | None = None, durable: bool = False) -> DataFrame:
    """Intermediate used by several flows: kept in memory and on disk, or written to the shared folder when
    ``durable``; ``name`` makes it a temporary view as well."""
    staged = cut_lineage(df) if durable else df.persist(StorageLevel.MEMORY_AND_DISK)
    if name:
        staged.createOrReplaceTempView(name)
    return staged
