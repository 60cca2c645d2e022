"""Typed sources. Every reader takes a declared schema: nothing is inferred by a pass over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import order_columns, sort_keys
from tallyloom.operators.reshape import positional_columns
from tallyloom.operators.select import bind_params


def read_query(spark: SparkSession, sql: str, params: Mapping[str, Any] | None = None) -> DataFrame:
    """Table source that runs the SQL it is given; ``${name}`` placeholders become bound parameters."""
    text, args = bind_params(sql, params or {})
    return spark.sql(text, args=args)


def read_table(spark: SparkSession, table: str, fields: Sequence[str] | None = None, format: str | None = None,
               **options: Any) -> DataFrame:
    """Declared fields of a catalog table, or of a path with ``format`` (``jdbc`` takes its usual options)."""
    df = spark.read.format(format).options(**options).load(table) if format else spark.table(table)
    return df.select(*fields) if fields else df


def source_qualifier(
    df: DataFrame,
    join: tuple[DataFrame, Any] | None = None,
    where=None,
    distinct: bool = False,
    fields: Sequence[str] | None = None,
    sorted_ports: int = 0,
) -> DataFrame:
    """Source with a user-defined join, a filter, Select Distinct, and sorting by the first N ports."""
    if join is not None:
        other, condition = join
        df = df.join(other, condition)
    if where is not None:
        df = df.filter(where)
    if fields:
        df = df.select(*fields)
    if distinct:
        df = df.distinct()
    if sorted_ports:
        df = df.orderBy(*order_columns(sort_keys(df.columns[:sorted_ports], "source_qualifier")))
    return df


REJECT = "_reject_line"


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    sep: str = ";",
    quote: str = '"',
    header: bool = True,
    encoding: str = "UTF-8",
    multiline: bool = False,
    null_value: str = "",
    **options: Any,
) -> tuple[DataFrame, DataFrame]:
    """(good, reject): typed delimited file; lines that do not fit the schema go to reject as they stand."""
    declared = spark.createDataFrame([], schema).schema
    full = T.StructType([*declared.fields, T.StructField(REJECT, T.StringType())])
    raw = (
        spark.read.schema(full)
        .options(
            sep=sep, quote=quote, escape=quote, header=header, encoding=encoding, multiLine=multiline,
            # every column is parsed whatever is selected, so a line fits or does not fit regardless of the query
            columnPruning=False, nullValue=null_value, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECT, enforceSchema=True, **options,
        )
        .csv(path)
    )
    good = raw.filter(F.col(REJECT).isNull()).select(*declared.names)
    # the reader refuses queries on the reject column alone, so the data columns are asked for as well
    touched = F.length(F.concat_ws("", *[F.col(c).cast("string") for c in declared.names])) >= 0
    return good, raw.filter(F.col(REJECT).isNotNull() & touched).select(F.col(REJECT).alias("line"))


def read_lines(spark: SparkSession, path: str, column: str = "line", with_file: bool = False) -> DataFrame:
    """One row per line."""
    df = spark.read.text(path)
    extra = [F.col("_metadata.file_name").alias("file_name")] if with_file else []
    return df.select(F.col("value").alias(column), *extra)


def read_positional(spark: SparkSession, path: str, widths, schema: Sequence[tuple[str, str]], trim: bool = True) -> DataFrame:
    """Fixed-width file."""
    cells = positional_columns(F.col("value"), widths, schema, trim)
    return spark.read.text(path).select(*[c.alias(n) for n, c in cells.items()])


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType,
             fields: Mapping[str, str] | None = None) -> DataFrame:
    """Loop element of XML files to rows; ``fields`` maps output names to (nested) paths such as ``owner.name``."""
    df = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return df.select(*[F.col(p).alias(n) for n, p in fields.items()]) if fields else df


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, multiline: bool = False) -> DataFrame:
    """JSON documents, one per line or one per file."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_parquet(spark: SparkSession, path: str, fields: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*fields) if fields else df


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """``key=value`` lines to (key, value); comments and blank lines are left out, the rest after ``=`` is the value."""
    line = F.trim("value")
    kept = spark.read.text(path).filter(line.contains("=") & ~line.startswith("#") & ~line.startswith("!"))
    parts = F.split(line, r"\s*=\s*", 2)
    return kept.select(parts[0].alias("key"), parts[1].alias("value"))


def load_context(spark: SparkSession, path: str, most: int = 10_000) -> dict[str, str]:
    """Properties as run context for the driver; a file with more than ``most`` entries is no context."""
    rows = read_properties(spark, path).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{path} has more than {most} entries")
    return {r["key"]: r["value"] for r in rows}


def inline_rows(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: str | T.StructType) -> DataFrame:
    """Constant rows."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """File inventory (path, name, size, modified); file contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    )
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_whole_files(spark: SparkSession, path: str, glob: str = "*", binary: bool = False) -> DataFrame:
    """One row per file: (name, content)."""
    if binary:
        df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
        return df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    df = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path)
    return df.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
