"""Reshaping rows and fields."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import join_back, names
from tallyloom.functions import dates, numbers, text
from tallyloom.operators.ordered import sequence


def normalize(
    df: DataFrame,
    col: str,
    sep: str = ",",
    dedupe: bool = False,
    trim: bool = False,
    discard_trailing_empty: bool = False,
    out: str | None = None,
) -> DataFrame:
    """Delimited cell to one row per item; a NULL cell gives no row."""
    items = F.split(F.col(col), re.escape(sep))
    if discard_trailing_empty:
        stripped = F.regexp_replace(F.col(col), f"(?:{re.escape(sep)})+$", "")
        items = F.split(stripped, re.escape(sep))
    if trim:
        items = F.transform(items, lambda item: F.trim(item))
    if dedupe:
        items = F.array_distinct(items)
    return df.withColumn(out or col, F.explode(items))


def normalizer(
    df: DataFrame,
    groups: Mapping[str, Sequence[str]],
    keep: Sequence[str],
    occurrence: str = "gcid",
    generated_key: str | None = None,
    order=None,
    keep_null: bool = True,
    **limits,
) -> DataFrame:
    """Repeating columns to rows: ``{output: [column 1, column 2, ..]}``.

    ``occurrence`` numbers the repeats from 1; ``generated_key`` numbers the source rows along ``order``.
    """
    src = df if generated_key is None else sequence(df, generated_key, order, **limits)
    times = len(next(iter(groups.values())))
    structs = [
        F.struct(F.lit(i + 1).alias(occurrence), *[F.col(cols[i]).alias(out) for out, cols in groups.items()])
        for i in range(times)
    ]
    key = [generated_key] if generated_key else []
    rows = src.select(*key, *keep, F.inline(F.array(*structs)))
    if not keep_null:
        rows = rows.filter(F.coalesce(*[F.col(o).cast("string") for o in groups]).isNotNull())
    return rows


def split_fields(df: DataFrame, col: str, sep: str, schema: Sequence[tuple[str, str]]) -> DataFrame:
    """Delimited column to typed columns; missing or unconvertible fields are NULL."""
    items = F.split(F.col(col), re.escape(sep), -1)
    return df.withColumns(
        {name: F.get(items, F.lit(i)).try_cast(kind) for i, (name, kind) in enumerate(schema)}
    )


def positions(widths: str | Sequence[int]) -> list[tuple[int, int | None]]:
    """``"8,6,*"`` as (1-based start, width) pairs; ``*`` takes the rest."""
    parts = widths.split(",") if isinstance(widths, str) else [str(w) for w in widths]
    out, start = [], 1
    for part in parts:
        width = None if part.strip() == "*" else int(part)
        out.append((start, width))
        start += width or 0
    return out


def positional_columns(column: Column, widths, schema: Sequence[tuple[str, str]], trim: bool = True) -> dict[str, Column]:
    cells = {}
    for (start, width), (name, kind) in zip(positions(widths), schema, strict=True):
        piece = F.substring(column, start, width if width is not None else 2_147_483_647)
        cells[name] = (F.trim(piece) if trim else piece).try_cast(kind)
    return cells


def split_positional(df: DataFrame, col: str, widths, schema: Sequence[tuple[str, str]], trim: bool = True) -> DataFrame:
    """Fixed-width column to typed columns."""
    return df.withColumns(positional_columns(F.col(col), widths, schema, trim))


@dataclass(frozen=True)
class Replacement:
    """One substitution; ``glob`` lets ``*`` and ``?`` stand for any text and any character."""

    column: str
    search: str
    replacement: str
    whole_word: bool = False
    case_sensitive: bool = True
    glob: bool = False


def replace_values(df: DataFrame, replacements: Sequence[Replacement]) -> DataFrame:
    """Ordered substitutions; a later one sees the result of an earlier one."""
    for r in replacements:
        pattern = re.escape(r.search)
        if r.glob:
            pattern = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in r.search)
        if r.whole_word:
            pattern = rf"\b(?:{pattern})\b"
        if not r.case_sensitive:
            pattern = f"(?i){pattern}"
        safe = r.replacement.replace("\\", "\\\\").replace("$", "\\$")
        df = df.withColumn(r.column, F.regexp_replace(r.column, pattern, safe))
    return df


def add_checksum(df: DataFrame, cols: Sequence[str], algo: str = "crc32", out: str = "checksum",
                 null_mark: str = "\\N", sep: str = "|") -> DataFrame:
    """Row digest over columns; NULL and empty text differ."""
    joined = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(null_mark)) for c in cols])
    digests = {
        "crc32": F.crc32(joined.cast("binary")),
        "md5": F.md5(joined.cast("binary")),
        "sha256": F.sha2(joined.cast("binary"), 256),
        "xxhash64": F.xxhash64(joined),
    }
    if algo not in digests:
        raise ValueError(f"algo must be one of {sorted(digests)}")
    return df.withColumn(out, digests[algo])


def extract_json(df: DataFrame, col: str, paths: Mapping[str, str | tuple[str, str]]) -> DataFrame:
    """JSONPath fields: ``{output: path}`` or ``{output: (path, type)}``; unparsable text gives NULL."""
    cells = {}
    for out, path in paths.items():
        where, kind = path if isinstance(path, tuple) else (path, "string")
        cells[out] = F.get_json_object(F.col(col), where).try_cast(kind)
    return df.withColumns(cells)


def explode_json(df: DataFrame, col: str, schema: str, out: str = "item") -> DataFrame:
    """JSON array column to one row per element; ``schema`` is the DDL type of the whole document."""
    return df.withColumn(out, F.explode(F.from_json(col, schema)))


def extract_xml(df: DataFrame, col: str, paths: Mapping[str, str | tuple[str, str]]) -> DataFrame:
    """XPath fields: ``{output: xpath}`` or ``{output: (xpath, type)}``."""
    cells = {}
    for out, path in paths.items():
        where, kind = path if isinstance(path, tuple) else (path, "string")
        cells[out] = F.xpath_string(F.col(col), F.lit(where)).try_cast(kind)
    return df.withColumns(cells)


def decompose(
    df: DataFrame,
    tables: Mapping[str, Sequence[str]],
    links: Sequence[tuple[tuple[str, str], tuple[str, str]]] = (),
    **limits,
) -> dict[str, DataFrame]:
    """Split a joined result set into its base tables, one row per distinct tuple.

    ``links`` are ((parent table, key), (child table, foreign key)) pairs. A pair whose values are both missing on a
    row gets a surrogate: distinct parent tuples are numbered, and the child rows that arrived with a parent get its
    number. A value that did arrive is never overwritten. Rows with nothing but NULLs for a table are left out.
    """
    src = df
    used = {c for cols in tables.values() for c in cols}
    for (parent, key), (child, foreign) in links:
        if key not in tables[parent] or foreign not in tables[child]:
            continue
        identity = [c for c in tables[parent] if c != key and c in df.columns]
        have_key, have_foreign = key in df.columns, foreign in df.columns
        lacking = F.lit(True)
        if have_key:
            lacking = lacking & F.col(key).isNull()
        if have_foreign:
            lacking = lacking & F.col(foreign).isNull()
        there = F.coalesce(*[F.col(c).cast("string") for c in identity]).isNotNull()
        numbered = sequence(
            src.filter(lacking & there).select(*identity).distinct(), "__sur", [(c, False) for c in identity], **limits
        )
        src = join_back(src, numbered, identity)
        kind = src.schema[key].dataType if have_key else T.LongType()
        issued = F.when(lacking, F.col("__sur").cast(kind))
        values = {key: F.coalesce(F.col(key), issued) if have_key else issued}
        if foreign != key:
            fkind = src.schema[foreign].dataType if have_foreign else T.LongType()
            fissued = F.when(lacking, F.col("__sur").cast(fkind))
            values[foreign] = F.coalesce(F.col(foreign), fissued) if have_foreign else fissued
        src = src.withColumns(values).drop("__sur")
    out = {}
    for table, cols in tables.items():
        present = [c for c in cols if c in src.columns and c in used]
        filled = F.coalesce(*[F.col(c).cast("string") for c in present]).isNotNull()
        out[table] = src.filter(filled).select(*present).distinct()
    return out


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: declared type, nulls, minimum, maximum, widest text, how many values convert to each type,
    and the effective type the values support. One pass over the data."""
    kinds = {"bigint": "bigint", "double": "double", "timestamp": "timestamp", "boolean": "boolean"}
    aggs, fields = [], [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    for i, f in enumerate(fields):
        c, s = F.col(f.name), F.col(f.name).cast("string")
        aggs += [
            F.count_if(c.isNull()).alias(f"n{i}"),
            F.min(c).cast("string").alias(f"lo{i}"),
            F.max(c).cast("string").alias(f"hi{i}"),
            F.max(F.length(s)).alias(f"w{i}"),
            F.count(c).alias(f"c{i}"),
            *[F.count(s.try_cast(t)).alias(f"{k}{i}") for k, t in kinds.items()],
        ]
    one = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        n = F.col(f"c{i}")
        effective = F.when(n == 0, F.lit(f.dataType.simpleString()))
        for k in kinds:
            effective = effective.when(F.col(f"{k}{i}") == n, F.lit(k))
        rows.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("declared_type"),
                F.col(f"n{i}").alias("null_count"),
                n.alias("value_count"),
                F.col(f"lo{i}").alias("min_value"),
                F.col(f"hi{i}").alias("max_value"),
                F.col(f"w{i}").alias("widest"),
                *[F.col(f"{k}{i}").alias(f"as_{k}") for k in kinds],
                effective.otherwise(F.lit("string")).alias("effective_type"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def effective_types(df: DataFrame, declared: Mapping[str, str]) -> dict[str, str]:
    """Declared types, except that a column holding any value the declared type cannot take becomes string."""
    found = df.agg(
        *[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in declared.items()]
    ).first()
    return {c: "string" if found[c] else t for c, t in declared.items()}


def decode_raw(df: DataFrame, types: Mapping[str, str], raw_suffix: str = "_raw") -> DataFrame:
    """Raw text cells of a saved row set to typed columns.

    ``types`` maps (possibly qualified) names to Number, Currency, Int8s..Int32u, Date, DateTime, Time, Boolean or
    String. The short name after the last dot names the column; of two equal short names the first wins. A cell
    that does not convert stays visible in ``<name>_raw``.
    """
    cells: dict[str, Column] = {}
    for full, kind in types.items():
        short = full.rsplit(".", 1)[-1]
        if short in cells:
            continue
        raw = text.repair_byteswapped(F.col(f"`{full}`").cast("string"))
        value = {
            "Number": lambda r: F.round(r.try_cast("double"), 10),
            "Currency": lambda r: F.round(r.try_cast("double"), 10),
            "Int8s": lambda r: r.try_cast("bigint"),
            "Int16s": lambda r: r.try_cast("bigint"),
            "Int32s": lambda r: r.try_cast("bigint"),
            "Int32u": lambda r: r.try_cast("bigint"),
            "Date": lambda r: dates.serial_to_date(r.try_cast("bigint")),
            "DateTime": lambda r: dates.packed_to_timestamp(r.try_cast("bigint")),
            "Time": lambda r: dates.seconds_to_time(r.try_cast("bigint")),
            "Boolean": lambda r: numbers.decode_boolean(r),
        }.get(kind, lambda r: r)(raw)
        cells[short] = value
        if kind not in ("String", "Boolean"):
            cells[f"{short}{raw_suffix}"] = F.when(raw.isNotNull() & value.isNull(), raw)
    return df.select(*[c.alias(n) for n, c in cells.items()])


_MESSAGE = re.compile(r"\$\((\w+)(?:\s*,\s*(number|date|string)\s*(?:,\s*([^()]*?))?)?\s*\)")


def message_template(df: DataFrame, template: str, out: str, null_as: str = "") -> DataFrame:
    """Text with ``$(field)``, ``$(field, number, $#,##0.00)`` and ``$(field, date, yyyy-MM-dd)`` inserts."""
    pieces, at = [], 0
    for m in _MESSAGE.finditer(template):
        if m.start() > at:
            pieces.append(F.lit(template[at : m.start()]))
        c, kind, fmt = F.col(m.group(1)), m.group(2), m.group(3)
        if kind == "number" and fmt:
            shown = numbers.format_pattern(c, fmt)
        elif kind == "date":
            shown = F.date_format(c, fmt or "yyyy-MM-dd")
        else:
            shown = c.cast("string")
        pieces.append(F.coalesce(shown, F.lit(null_as)))
        at = m.end()
    if at < len(template):
        pieces.append(F.lit(template[at:]))
    return df.withColumn(out, F.concat(*pieces))
