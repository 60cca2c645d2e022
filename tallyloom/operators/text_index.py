"""Finding many strings in many texts by the bytes they are made of.

A string is looked for by one gram, eight of its bytes (or all, where it has fewer) as a number; the grams of a text that no
string has are left out in the task that reads it, by a bit filter of fixed size, and the rest meet the strings in an
equi-join. UTF-8 lets bytes stand for characters: a match of bytes is a match of characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.core import written

#: Bytes of a gram, and binary logarithm of the bits of a filter, whose words (65,536 at most) are collected.
GRAM, FILTER_BITS = 8, 22
#: Of GRAM + WINDOW - 1 neighbouring bytes at least one gram is a fingerprint.
WINDOW = 9
_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows of a string or binary column, and where each row begins, with the end of the last."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.empty(0, np.uint8) if data is None or not data.size else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def gram_codes(data: np.ndarray, k: int) -> np.ndarray:
    """The k bytes from each place on as a number; one less than k places are left out at the end."""
    n = max(0, len(data) - k + 1)
    codes = np.zeros(n, _U)
    for j in range(k):
        codes |= data[j : j + n].astype(_U) << _U(8 * j)
    return codes


def grams_inside(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place within the row and code of all grams of k bytes that lie within a row."""
    codes = gram_codes(data, k)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(codes)]
    place = np.arange(len(codes))
    inside = place + k <= offsets[row + 1]
    return row[inside], (place - offsets[row])[inside], codes[inside]


def _slots(codes: np.ndarray) -> np.ndarray:
    return ((codes * _FACTOR) >> _U(64 - FILTER_BITS)).astype(np.int64)


def code_filter(df: DataFrame, code: str) -> np.ndarray:
    """Which slots the codes (long) of a table fall in, as booleans."""
    def slots(batches):
        for batch in batches:
            found = np.unique(_slots(batch.column(0).to_numpy(zero_copy_only=False).view(_U)))
            yield pa.RecordBatch.from_arrays([pa.array(found >> 6), pa.array(np.left_shift(1, found & 63))], names=["word", "bits"])

    words = df.select(code).distinct().mapInArrow(slots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words:
        out[r.word] = r.bits
    return np.unpackbits(out.astype("<i8").view(np.uint8), bitorder="little").astype(bool)


def may_be_in(wanted: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return wanted[_slots(codes)]


#: Binary logarithm of the bits of a filter that holds for one owner only.
OWN_BITS = 15


def own_filters(df: DataFrame, owner: str, code: str) -> DataFrame:
    """(owner, words): a bit filter for the codes of each owner, as at most 2 ** (OWN_BITS - 6) words that are not 0.

    Unlike the one filter of ``code_filter`` it does not fill up when owners become many.
    """
    def slots(batches):
        for batch in batches:
            at = _slots(batch.column(1).to_numpy(zero_copy_only=False).view(_U)) >> (FILTER_BITS - OWN_BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at >> 6), pa.array(np.left_shift(1, at & 63))], names=[owner, "word", "bits"])

    kind = df.schema[owner].dataType.simpleString()
    words = df.select(owner, code).mapInArrow(slots, f"`{owner}` {kind}, word long, bits long").groupBy(owner, "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy(owner).agg(F.collect_list(F.struct("word", "bits")).alias("words"))


def own_tests(words: pa.ListArray):
    """For each row of a column of ``own_filters`` a function from codes to whether they may be the owner's."""
    offsets, word, bits = words.offsets.to_numpy(), *(words.values.field(k).to_numpy(zero_copy_only=False) for k in ("word", "bits"))
    for low, high in zip(offsets, offsets[1:]):
        table = np.zeros(1 << (OWN_BITS - 6), _U)
        table[word[low:high]] = bits[low:high].view(_U)

        def may_be(codes: np.ndarray, table=table) -> np.ndarray:
            at = _slots(codes) >> (FILTER_BITS - OWN_BITS)
            return (table[at >> 6] >> (at & 63).astype(_U) & _U(1)).astype(bool)

        yield may_be


# ------------------------------------------------------------ values in lines


def value_grams(values: DataFrame) -> DataFrame:
    """Each value of a table (value, rank) with the gram it is looked for by: value, rank, k, code.

    Of a long value that is the gram which the fewest values have, so values that begin alike don't all meet every line that
    begins so.
    """
    def grams(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("value"))
            sizes = np.diff(offsets)
            for k in range(1, GRAM + 1):
                which = np.flatnonzero(sizes == k if k < GRAM else sizes >= k)
                if not len(which):
                    continue
                row, place, codes = grams_inside(data, offsets, k)
                mine = np.isin(row, which)
                take = pa.array(row[mine])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("value").take(take), batch.column("rank").take(take), pa.array(np.full(mine.sum(), k), pa.int32()),
                     pa.array(codes[mine].view(np.int64)), pa.array(place[mine], pa.int32())],
                    names=["value", "rank", "k", "code", "at"])

    found = written(values.filter("value <> ''").mapInArrow(grams, "value string, rank long, k int, code long, at int"), "grams")
    counts = found.groupBy("k", "code").agg(F.count_distinct("value").alias("n"))
    rated = found.join(counts, ["k", "code"])
    best = rated.groupBy("value").agg(F.max("rank").alias("rank"), F.min_by(F.struct("k", "code"), F.struct("n", "at")).alias("g"))
    return best.select("value", "rank", "g.k", "g.code")


def find_values(lines: DataFrame, place: list[str], line: str, index: DataFrame) -> DataFrame:
    """(place columns, value, rank): the values of a gram table that a line of the place contains."""
    index = written(index, "index")
    kinds = sorted(r.k for r in index.select("k").distinct().collect())  # GRAM numbers at most
    wanted = {k: code_filter(index.filter(F.col("k") == k), "code") for k in kinds}
    fields = [lines.schema[c] for c in place]

    def hits(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("__line"))
            for k in kinds:
                row, _, codes = grams_inside(data, offsets, k)
                some = may_be_in(wanted[k], codes)
                pairs = np.unique(np.stack([row[some].astype(np.int64), codes[some].view(np.int64)]), axis=1)
                take, n = pa.array(pairs[0]), pairs.shape[1]
                text = batch.column("__line").take(take) if k == GRAM else pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in place), pa.array(np.full(n, k), pa.int32()), pa.array(pairs[1]), text],
                    names=[*place, "k", "code", "__line"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", k int, code long, __line string"
    found = lines.select(*place, F.col(line).alias("__line")).mapInArrow(hits, schema)
    both = found.join(index, ["k", "code"]).filter((F.col("k") < GRAM) | F.contains("__line", "value"))
    return both.select(*place, "value", "rank").distinct()


# ------------------------------------------------------------ fingerprints


def mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes ^ (codes >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (x ^ (x >> _U(29))) * _FACTOR


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """Minimum or maximum of ``width`` values from each place on."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = of(out[: len(out) - step], out[step:])
        have += step
    return out


def fingerprints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: places of the grams that are smallest among some WINDOW neighbouring ones, and their mixed codes."""
    codes = mixed(gram_codes(data, GRAM))
    if len(codes) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, _U)
    least = _sliding(codes, WINDOW, np.minimum)
    padded = np.concatenate([np.zeros(WINDOW - 1, _U), least, np.zeros(WINDOW - 1, _U)])
    chosen = np.flatnonzero(_sliding(padded, WINDOW, np.maximum) == codes)
    return chosen, codes[chosen]


def window_fingerprints(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows of GRAM + WINDOW - 1 bytes that begin at ``starts``: the place of the chosen gram within and its code."""
    codes = mixed(gram_codes(data, GRAM))[starts[:, None] + np.arange(WINDOW)]
    at = codes.argmin(axis=1)
    return at, codes[np.arange(len(starts)), at]
