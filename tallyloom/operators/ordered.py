"""Order-dependent operators that never put one hot group into one task.

A window over a group runs in one task. That is right for ordinary groups and wrong for a group that holds a
third of all rows, or for a report-wide running value whose only group is the whole table. Here groups beyond
a size limit are cut into blocks that are contiguous in the sort order. Windows then run per (group, block), and
what has to flow from one block to the next travels in a small per-block table. Where that takes more borders than a plan
should hold, the blocks are range partitions instead, so no limit grows with the table.

Block borders come from a sample of rows drawn by a hash of the row, so the block of a row is a plain expression of its
own values: nothing has to be materialised, and a recomputed task finds the same block again. The same hash completes an
order that isn't total: rows with equal sort keys stand in the order of their hashes, cut or uncut, on every run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import fresh, join_back, names, order_columns, sort_keys, written

HOT_ROWS = 1_000_000
"""Groups up to this size always run as one ordinary window."""

BLOCK_ROWS = 50_000
"""Aimed rows per block; their number follows the rows up to MAX_BLOCKS."""

MAX_BLOCKS = 10_000
"""Borders that travel inside the plan at most; more blocks, or more hot groups than HOT_LIST, are cut by range partitions."""

HOT_LIST = 1_000
"""Hot groups whose keys are broadcast at most."""

RANGE_ROWS = 5_000_000
"""Aimed rows of a range partition, whatever the number of rows: tasks don't grow with the table."""

RANGE_PARTS = 200
"""Range partitions at most, as long as that leaves none with more than RANGE_ROWS rows: small blocks are no reason for many tasks."""

SAMPLE_PER_BLOCK = 20

TREE_NODES = 63
"""Borders compared in generated code; a larger method would not be compiled by the JVM."""


@dataclass
class Blocks:
    """``df`` with an integer block column and a row hash; ``split`` tells whether any group was cut at all."""

    df: DataFrame
    block: str
    split: bool
    order: list[tuple[str, bool]]  # the sort spec, completed by the row hash


def _comparable(df: DataFrame, column: str, desc: bool) -> list[Column]:
    """Columns whose ascending struct order equals the wanted order of ``column``."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        value = F.unix_date(c).cast("long")
    elif isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        value = c.cast("int").cast("long") if isinstance(kind, T.BooleanType) else c.cast("long")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        # NaN is the largest value and stays NaN when negated
        return [c.isNull(), ~F.isnan(c), -c.cast("double")] if desc else [c.cast("double")]
    elif isinstance(kind, T.DecimalType):
        return [c.isNull(), -c] if desc else [c]
    elif isinstance(kind, T.StringType):
        if not desc:
            return [c]
        # complement of the UTF-8 bytes plus a terminator above every digit reverses the byte order exactly
        flipped = F.translate(F.hex(F.encode(c, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210")
        return [c.isNull(), F.concat(flipped, F.lit("~"))]
    elif isinstance(kind, T.BinaryType):
        hexed = F.hex(c)
        if not desc:
            return [hexed]
        return [c.isNull(), F.concat(F.translate(hexed, "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))]
    else:
        raise TypeError(f"cannot order by {column}: {kind.simpleString()}")
    return [c.isNull(), F.bitwise_not(value)] if desc else [value]


def _order_struct(df: DataFrame, order: Sequence[tuple[str, bool]]) -> Column:
    parts = [part for column, desc in order for part in _comparable(df, column, desc)]
    return F.struct(*[p.alias(f"s{i}") for i, p in enumerate(parts)])


def _at_or_above(parts: Sequence[Column], border: Sequence) -> Column:
    """Is the sort key at or above the border? Columns are compared in turn; NULL sorts first."""
    test = None
    for part, value in reversed(list(zip(parts, border, strict=True))):
        above = part.isNotNull() if value is None else F.coalesce(part > F.lit(value), F.lit(False))
        equal = part.isNull() if value is None else F.coalesce(part == F.lit(value), F.lit(False))
        test = above | equal if test is None else above | (equal & test)
    return test


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed; maps are left out."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])


def _block_expression(df: DataFrame, order: Sequence[tuple[str, bool]], rows: int, blocks: int) -> Column:
    """Block number of a row: how many sampled borders are at or below its sort key, whose last part is the row hash.

    There are at most ``blocks - 1`` borders, cut to the leading sort columns that tell them apart. They are looked
    up by binary search, as generated code for the upper levels and in a literal array below, so the expression needs
    neither join nor shuffle.
    """
    key = _order_struct(df, order)
    sample = df.select(key.alias("s"))
    every = max(1, rows // (blocks * SAMPLE_PER_BLOCK))
    if every > 1:
        sample = df.filter(F.pmod(F.col(order[-1][0]), F.lit(every)) == 0).select(key.alias("s"))
    found = (
        sample.agg(F.sort_array(F.collect_list("s")).alias("a"))
        .select(
            F.expr(
                f"transform(sequence(1, {blocks - 1}), i -> get(a, cast(i * cast(size(a) as bigint) div {blocks} as int)))"
            ).alias("b")
        )
        .first()["b"]
    )
    borders = list(dict.fromkeys(tuple(row) for row in found if row is not None))
    if not borders:
        return F.lit(0)
    width = next(w for w in range(1, len(borders[0]) + 1) if len({b[:w] for b in borders}) == len(borders))
    borders = [b[:width] for b in borders]
    parts = [p for column, desc in order for p in _comparable(df, column, desc)][:width]

    def tree(spots: Sequence[int], low: int, high: int) -> Column:
        """Number of borders at or below the key, counted in steps of ``spots``."""
        if low == high:
            return F.lit(0 if low == 0 else spots[low - 1] + 1)
        mid = (low + high) // 2
        return F.when(_at_or_above(parts, borders[spots[mid]]), tree(spots, mid + 1, high)).otherwise(tree(spots, low, mid))

    stride = -(-len(borders) // TREE_NODES)
    spots = range(stride - 1, len(borders), stride)
    coarse = tree(spots, 0, len(spots))
    if stride == 1:
        return coarse
    kind = ", ".join(f"s{i}: {df.select(p.alias('s')).schema['s'].dataType.simpleString()}" for i, p in enumerate(parts))
    literal = F.array(*[F.struct(*[F.lit(v).alias(f"s{i}") for i, v in enumerate(b)]) for b in borders])
    table = F.lit(literal).cast(f"array<struct<{kind}>>")
    short = F.struct(*[p.alias(f"s{i}") for i, p in enumerate(parts)])
    steps = [1 << bit for bit in reversed(range((stride - 1).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        coarse,
        lambda low, step: F.when(
            (low + step <= len(borders)) & (F.get(table, low + step - 1) <= short), low + step
        ).otherwise(low),
    )


def _range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], rows: int, range_rows: int) -> Blocks:
    """Blocks for tables with very many hot rows or groups: range partitions along keys and order, of any number.

    Borders lie in the shuffle's partitioner, not in the plan. The partitioned rows are written with their partition's number,
    so that all readers, and tasks that are repeated, see the same blocks. A group lies in partitions one after the other, a
    partition holds many small groups or a part of a large one.
    """
    block = fresh(df, "block")
    by = [*order_columns([(k, False) for k in keys]), *order_columns(order)]
    parts = min(-(-rows // range_rows), max(RANGE_PARTS, -(-rows // RANGE_ROWS)))
    dealt = df.repartitionByRange(max(2, parts), *by)
    return Blocks(written(dealt.withColumn(block, F.spark_partition_id()), "ranges"), block, True, list(order))


def cut_hot_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[tuple[str, bool]],
    hot_rows: int | None = None,
    block_rows: int | None = None,
) -> Blocks:
    """Add a block column that is 0 for ordinary groups and runs along ``order`` inside hot ones.

    A group is hot beyond ``hot_rows`` rows. Up to HOT_LIST hot groups and MAX_BLOCKS blocks, the hot groups' keys are
    broadcast and the block of a row is an expression; beyond either, all rows are cut by range partitions.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    range_rows = RANGE_ROWS if block_rows is None else block_rows
    block_rows = BLOCK_ROWS if block_rows is None else block_rows
    block = fresh(df, "block")

    def count_blocks(rows: int) -> int:
        return -(-rows // block_rows)

    tie = fresh(df, "tie")
    df, order = df.withColumn(tie, row_hash(df)), [*order, (tie, False)]
    if not keys:
        rows = df.count()
        blocks = count_blocks(rows)
        if blocks < 2:
            return Blocks(df.withColumn(block, F.lit(0)), block, False, order)
        if blocks > MAX_BLOCKS:
            return _range_blocks(df, keys, order, rows, range_rows)
        return Blocks(df.withColumn(block, _block_expression(df, order, rows, blocks)), block, True, order)

    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    many = F.col("__rows") > hot_rows
    total = sizes.agg(F.sum("__rows").alias("all"), F.count_if(many).alias("groups"), F.sum(F.when(many, F.col("__rows"))).alias("hot")).first()
    if not total["groups"]:
        return Blocks(df.withColumn(block, F.lit(0)), block, False, order)
    if total["groups"] > HOT_LIST or count_blocks(total["hot"]) > MAX_BLOCKS:
        return _range_blocks(df, keys, order, total["all"], range_rows)
    listed = sizes.filter(many).collect()  # HOT_LIST rows at most
    hot_keys = df.sparkSession.createDataFrame(
        [tuple(r[k] for k in keys) for r in listed], T.StructType([df.schema[k] for k in keys])
    )
    flag = fresh(df, "hot")
    marked = join_back(df, F.broadcast(hot_keys.withColumn(flag, F.lit(True))), keys)
    rows = sum(r["__rows"] for r in listed)
    blocks = max(2, count_blocks(rows))
    number = _block_expression(marked.filter(F.col(flag)), order, rows, blocks)
    cut = marked.withColumn(block, F.when(F.col(flag), number).otherwise(F.lit(0))).drop(flag)
    return Blocks(cut, block, True, order)


def with_carry(cut: Blocks, keys: Sequence[str], partials: Sequence[Column], carries: dict[str, Column]) -> DataFrame:
    """Attach to every row what the earlier blocks of its group add up to.

    ``partials`` are map-side combined per (group, block); ``carries`` fold them over the earlier blocks. Each
    group has at most as many rows here as it has blocks.
    """
    per_block = cut.df.groupBy(*keys, cut.block).agg(*partials)
    before = Window.partitionBy(*keys).orderBy(cut.block).rowsBetween(Window.unboundedPreceding, -1)
    if not keys:
        # one row per block: a handful of rows
        before = Window.partitionBy(F.lit(0)).orderBy(cut.block).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *keys, cut.block, *[c.over(before).alias(name) for name, c in carries.items()]
    )
    if not keys:
        carried = F.broadcast(carried)
    return join_back(cut.df, carried, [*keys, cut.block])


RUNNING_OPS = ("sum", "count", "average", "maximum", "minimum")


def running(
    df: DataFrame,
    op: str,
    col: str | Column,
    out: str,
    order,
    reset_by=None,
    hot_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Row-by-row running Sum, Count, Average, Maximum or Minimum, reset per group; report-wide without ``reset_by``.

    NULL values do not change the running value.
    """
    return running_values(df, [(op, col, out)], order, reset_by, hot_rows, block_rows)


def running_values(
    df: DataFrame,
    specs: Sequence[tuple[str, str | Column, str]],
    order,
    reset_by=None,
    hot_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Several running values ``(op, column, output)`` over one order and reset group: one cut, one window, one carry."""
    keys, by, kept = names(reset_by), sort_keys(order, "running"), df.columns
    ops = []
    for op, _, _ in specs:
        op = {"avg": "average", "max": "maximum", "min": "minimum"}.get(op.lower(), op.lower())
        if op not in RUNNING_OPS:
            raise ValueError(f"running {op!r} is not supported; use one of {RUNNING_OPS}")
        ops.append(op)
    values = [fresh(df, f"value{i}_") for i in range(len(specs))]
    src = df.withColumns({v: F.col(c) if isinstance(c, str) else c for v, (_, c, _) in zip(values, specs, strict=True)})
    cut = cut_hot_groups(src, keys, by, hot_rows, block_rows)
    local = (
        Window.partitionBy(*keys, cut.block)
        .orderBy(*order_columns(cut.order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    outs = [out for _, _, out in specs]
    plain = {"sum": F.sum, "count": F.count, "average": F.avg, "maximum": F.max, "minimum": F.min}
    if not cut.split:
        cells = {o: plain[op](F.col(v)).over(local) for o, op, v in zip(outs, ops, values, strict=True)}
        return cut.df.withColumns(cells).select(*kept, *outs)

    # cut or uncut, a value has the type of the plain window; an average travels between blocks as a sum and a count
    kinds = src.select(*[plain[op](v).alias(o) for o, op, v in zip(outs, ops, values, strict=True)]).schema
    basic = {**plain, "average": F.sum}
    fold = {"sum": F.sum, "count": F.sum, "average": F.sum, "maximum": F.max, "minimum": F.min}
    partials, carries, here, cells = [], {}, {}, {}
    for i, (op, v, out) in enumerate(zip(ops, values, outs, strict=True)):
        partials.append(basic[op](v).alias(f"__p{i}"))
        carries[f"__c{i}"] = fold[op](f"__p{i}")
        here[f"__l{i}"] = basic[op](v).over(local)
        before, now = F.col(f"__c{i}"), F.col(f"__l{i}")
        joint = F.when(before.isNull(), now).when(now.isNull(), before).otherwise(before + now)
        if op == "average":
            partials.append(F.count(v).alias(f"__q{i}"))
            carries[f"__d{i}"] = F.sum(f"__q{i}")
            here[f"__n{i}"] = F.count(v).over(local)
            many = F.coalesce(F.col(f"__d{i}"), F.lit(0)) + F.col(f"__n{i}")
            exact = isinstance(kinds[out].dataType, T.DecimalType)
            value = F.try_divide(joint, many.cast("decimal(20,0)")) if exact else F.try_divide(joint.cast("double"), many)
        else:
            value = {"maximum": F.greatest(before, now), "minimum": F.least(before, now)}.get(op, joint)
        cells[out] = value.cast(kinds[out].dataType)
    carried = with_carry(cut, keys, partials, carries)
    return carried.withColumns(here).withColumns(cells).select(*kept, *outs)


def running_distinct(df: DataFrame, col: str, out: str, order, reset_by=None, **limits) -> DataFrame:
    """Distinct non-NULL values of ``col`` seen so far: a running sum over first-occurrence marks.

    ``order`` must be total within the group, otherwise the first occurrence is not one row.
    """
    keys, by = names(reset_by), sort_keys(order, "running_distinct")
    at, first, mark = fresh(df, "at"), fresh(df, "first"), fresh(df, "mark")
    src = df.withColumn(at, _order_struct(df, by))
    firsts = src.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.min(at).alias(first))
    marked = join_back(src, firsts, [*keys, col]).withColumn(
        mark, F.coalesce((F.col(at) == F.col(first)).cast("int"), F.lit(0)).cast("long")
    )
    return running(marked.drop(at, first), "sum", mark, out, by, keys, **limits).drop(mark)


def sequence(df: DataFrame, out: str, order, start: int = 1, step: int = 1, by=None, **limits) -> DataFrame:
    """Dense surrogate sequence along ``order``, per group when ``by`` is given; no gaps and no repeats.

    To continue a stored sequence pass ``start = stored maximum + step``.
    """
    numbered = running(df, "count", F.lit(1), out, order, by, **limits)
    return numbered.withColumn(out, F.lit(start).cast("long") + (F.col(out) - 1) * F.lit(step).cast("long"))


def continue_sequence(target: DataFrame, df: DataFrame, out: str, order, step: int = 1, **limits) -> DataFrame:
    """Sequence that carries on after the largest value stored in ``target.out``."""
    top = target.agg(F.max(out).alias("top")).first()["top"]
    return sequence(df, out, order, start=step if top is None else top + step, step=step, **limits)


def record_number(df: DataFrame, out: str, order, by=None, **limits) -> DataFrame:
    """Running row number, report-wide or inside a group."""
    return sequence(df, out, order, by=by, **limits)


def group_number(df: DataFrame, group, out: str, desc: bool = False, **limits) -> DataFrame:
    """Ordinal of each row's group, groups counted along their keys."""
    keys = names(group)
    numbered = sequence(df.select(*keys).distinct(), out, [(k, desc) for k in keys], **limits)
    return join_back(df, numbered, keys)


def previous_rows(df: DataFrame, columns, n: int, order, by=None, hot_rows=None, block_rows=None) -> DataFrame:
    """Values of the last ``n`` rows as ``<column>_prev1 .. _prevN``, NULL before the first row of the group."""
    wanted, keys, order_by = names(columns), names(by), sort_keys(order, "previous_rows")
    kept = df.columns
    cut = cut_hot_groups(df, keys, order_by, hot_rows, block_rows)
    local = Window.partitionBy(*keys, cut.block).orderBy(*order_columns(cut.order))

    def label(c: str, i: int) -> str:
        return f"{c}_prev{i}"

    lags = {label(c, i): F.lag(c, i) for c in wanted for i in range(1, n + 1)}
    looked = cut.df.withColumns({name: e.over(local) for name, e in lags.items()})
    if not cut.split:
        return looked.select(*kept, *lags)

    # Only the first n rows of a block look into earlier blocks. They and the last n rows of every block are a
    # small table that is contiguous wherever a look-back crosses a block border.
    pos = fresh(df, "pos")
    backwards = Window.partitionBy(*keys, cut.block).orderBy(*order_columns(cut.order, reverse=True))
    placed = looked.withColumn(pos, F.row_number().over(local))
    tail = fresh(df, "tail")
    edges = (
        cut.df.withColumns({pos: F.row_number().over(local), tail: F.row_number().over(backwards)})
        .filter((F.col(pos) <= n) | (F.col(tail) <= n))
    )
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(cut.block, *order_columns(cut.order))
    crossing = (
        edges.select(
            *keys, cut.block, pos, *[e.over(across).alias(f"__x_{name}") for name, e in lags.items()]
        ).filter(F.col(pos) <= n)
    )
    joined = join_back(placed, crossing, [*keys, cut.block, pos])
    pick = {
        label(c, i): F.when(F.col(pos) > i, F.col(label(c, i))).otherwise(F.col(f"__x_{label(c, i)}"))
        for c in wanted
        for i in range(1, n + 1)
    }
    return joined.withColumns(pick).select(*kept, *lags)


def hide_repeats(df: DataFrame, col: str, order, by=None, out: str | None = None, **limits) -> DataFrame:
    """Blank a value that equals the one in the previous row of its group; the first row always prints."""
    seq = fresh(df, "nth")
    before = previous_rows(df.withColumn(seq, F.lit(1)), [col, seq], 1, order, by, **limits)
    first_row = F.col(f"{seq}_prev1").isNull()
    shown = F.when(first_row | ~F.col(col).eqNullSafe(F.col(f"{col}_prev1")), F.col(col))
    return before.withColumn(out or col, shown).drop(seq, f"{seq}_prev1", f"{col}_prev1")


def longest_run(df: DataFrame, key, pos: str, **limits) -> DataFrame:
    """Longest stretch of consecutive integer positions per key: (key, first_pos, last_pos, run_length).

    Of equally long runs the first one counts.
    """
    keys = names(key)
    spots = df.select(*keys, pos).distinct()
    numbered = sequence(spots, "__nth", pos, by=keys, **limits)
    runs = (
        numbered.groupBy(*keys, (F.col(pos).cast("long") - F.col("__nth")).alias("__island"))
        .agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count(F.lit(1)).alias("run_length"))
    )
    best = F.max_by(
        F.struct("first_pos", "last_pos", "run_length"),
        F.struct(F.col("run_length"), -F.col("first_pos").cast("long")),
    )
    return runs.groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.first_pos", "__b.last_pos", "__b.run_length")


def sample_lines(df: DataFrame, spec: str, order, **limits) -> DataFrame:
    """Rows at 1-based positions such as ``"1,5,10..20"`` along ``order``."""
    wanted = []
    for piece in spec.replace(" ", "").split(","):
        low, dots, high = piece.partition("..")
        wanted.append((int(low), int(high if dots else low)))
    seq = fresh(df, "line")
    top = max(high for _, high in wanted)
    by = sort_keys(order, "sample_lines")
    lines = sequence(df, seq, by, **limits).filter(F.col(seq) <= top)
    hits = F.lit(False)
    for low, high in wanted:
        hits = hits | F.col(seq).between(low, high)
    return lines.filter(hits).drop(seq)


GROUP_LIMIT = 1000
"""Up to this n Spark drops rows beyond the n-th of a group before they are shuffled."""


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], n: int, out: str) -> DataFrame:
    """First ``n`` rows per group numbered along a total order; no group is brought together in one task."""
    if n <= GROUP_LIMIT:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order_columns(order))
        return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)
    return sequence(df, out, order, by=keys).filter(F.col(out) <= n).withColumn(out, F.col(out).cast("int"))


def rank_n(df: DataFrame, group, by: str, n: int, out: str = "rank_index", top: bool = True, ties: str = "rank",
           order=None) -> DataFrame:
    """Top or bottom ``n`` per group with its rank; ``ties`` is ``rank``, ``dense`` or ``row`` (needs ``order``).

    ``rank`` and ``dense`` are decided on the distinct values of a group, so rows that tie never meet in a
    window: their ranks are joined back. NULL measures are not ranked.
    """
    keys, measured = names(group), df.filter(F.col(by).isNotNull())
    if ties == "row":
        return first_n(measured, keys, [(by, top), *sort_keys(order, "rank_n with ties='row'")], n, out)
    if ties not in ("rank", "dense"):
        raise ValueError("ties must be 'rank', 'dense' or 'row'")
    values = measured.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("__rows"))
    kept = first_n(values, keys, [(by, top)], n, "__nth")
    if ties == "rank":
        # at most n distinct values per group are left
        earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__nth").rowsBetween(Window.unboundedPreceding, -1)
        kept = kept.withColumn("__nth", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) + 1)
        kept = kept.filter(F.col("__nth") <= n)
    ranks = kept.select(*keys, by, F.col("__nth").cast("int").alias(out))
    return join_back(df, ranks, [*keys, by], "inner")


def rank_by_aggregate(df: DataFrame, keys, fn: Column, total: str, out: str = "rank_index", **limits) -> DataFrame:
    """Aggregate per key, then RANK() of every key by that total, largest first.

    Ranks come from a running count over the distinct totals, so no window holds all keys.
    """
    per_key = df.groupBy(*names(keys)).agg(fn.alias(total))
    steps = per_key.groupBy(total).agg(F.count(F.lit(1)).alias("__rows"))
    ahead = running(steps, "sum", "__rows", "__upto", [(total, True)], **limits)
    ranks = ahead.select(total, (F.col("__upto") - F.col("__rows") + 1).alias(out))
    return join_back(per_key, ranks, [total])


def top_count(df: DataFrame, by: str, n: int, order=()) -> DataFrame:
    """Global top ``n``; each task keeps its own n rows before they meet."""
    return df.orderBy(F.col(by).desc_nulls_last(), *order_columns(sort_keys(order, "top_count") if order else [])).limit(n)
