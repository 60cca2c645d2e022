"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's UTF-8 bytes; a chunk ends where the hash's top bits are zero and the next byte starts a code
point, not before the least and not after the most length. The hash sees the last 32 bytes only and no chunk is shorter than
that, so an insertion moves the borders next to it and no others. Chunks are counted by a 128-bit digest. A chunk repeats if
an earlier chunk of its document or a document of smaller id has it too; neighbouring chunks that repeat are a run, and runs
of at least ``min_run`` bytes are removed. So each passage stays in the document of the smallest id that has it.

Counting is an aggregate by digest, combined on the map side; documents look their digests up by a join on the repeated ones
only, so a chunk of very many documents is no hot group. Lists are per document.

Results: a null text stays null and counts as empty. A null id counts as the smallest. Rows of equal id count as one
document: they don't remove each other's chunks; equal rows share one list of spans, however many they are. An empty table gives an empty table. Other columns are kept as they are.
Ids must be whole numbers.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import fresh
from tallyloom.llm.arrow import documents, parts, record, utf8

#: Least and most bytes of a chunk; a border is found every 2**BORDER_BITS bytes on average once the least is reached.
LEAST, MOST, BORDER_BITS = 32, 256, 4
#: Bytes that neighbouring repeated chunks must have together to be removed.
MIN_RUN = 72
_LOWEST = -(1 << 63)


def _gear() -> np.ndarray:
    """One 32-bit number per byte value, from a multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: each step doubles the number of bytes that the sums cover, up to 32."""
    sums = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        wider = sums.copy()
        wider[width:] += sums[:-width] << np.uint32(width)
        sums = wider
    return sums


def borders(data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts of all chunks of the rows, with the end of the last, and the number of chunks before each row."""
    starts_point = np.concatenate([(data & 0xC0) != 0x80, [True]])
    ends = (rolled(data) >> np.uint32(32 - BORDER_BITS)) == 0
    possible = (np.flatnonzero(ends & starts_point[1:]) + 1).tolist()
    possible.append(1 << 62)
    at, first, k = [], [0], 0
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        while low < high:
            at.append(low)
            k = bisect_left(possible, low + LEAST, k)
            low = possible[k] if possible[k] <= low + MOST else low + MOST
            if low >= high:
                low = high
            else:
                while not starts_point[low]:
                    low -= 1
        first.append(len(at))
    return [*at, int(offsets[-1])], first


def chunk_table(column: pa.Array) -> dict[str, np.ndarray]:
    """All chunks of the rows: row, start and length within it, digest (two halves), whether the row had it before."""
    data, offsets = utf8(column)
    at, first = borders(data, offsets)
    starts, row = np.array(at, np.int64), np.repeat(np.arange(len(column)), np.diff(first))
    whole, digest = data.tobytes(), xxhash.xxh3_128_digest
    halves = np.frombuffer(b"".join([digest(whole[a:b]) for a, b in zip(at, at[1:])]), "<i8").reshape(-1, 2)
    own = np.empty(len(row), [("row", "<i8"), ("a", "<i8"), ("b", "<i8")])
    own["row"], own["a"], own["b"] = row, halves[:, 0], halves[:, 1]
    order = np.lexsort((halves[:, 0], row))
    again = np.zeros(len(row), bool)
    again[order[1:]] = own[order[1:]] == own[order[:-1]]
    return {"row": row, "start": starts[:-1] - offsets[row], "length": np.diff(starts), "a": halves[:, 0], "b": halves[:, 1], "again": again}


def _chunks(docs: DataFrame) -> DataFrame:
    """Chunks of a table (id, key, text): id, key, start, length, a, b, again."""
    def cut(batches):
        for batch in parts(batches, "text"):
            x = chunk_table(batch.column("text"))
            row = pa.array(x["row"])
            yield record({
                "id": batch.column("id").take(row), "key": batch.column("key").take(row), "start": pa.array(x["start"], pa.int32()),
                "length": pa.array(x["length"], pa.int32()), "a": pa.array(x["a"]), "b": pa.array(x["b"]), "again": pa.array(x["again"]),
            })

    return docs.mapInArrow(cut, "id long, key long, start int, length int, a long, b long, again boolean")


def repeats(docs: DataFrame) -> DataFrame:
    """Repeated chunks of a table (id, key, text) without nulls in id: id, key, spans (array of start and length)."""
    chunks = _chunks(docs)
    counted = (
        chunks.filter("not again").groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .filter("first < last").select("a", "b", "first")
    )
    later = chunks.filter("not again").join(counted, ["a", "b"]).filter("id > first").select("id", "key", "start", "length")
    own = chunks.filter("again").select("id", "key", "start", "length")
    return later.unionAll(own).groupBy("id", "key").agg(F.collect_set(F.struct("start", "length")).alias("spans"))


def runs(starts: np.ndarray, lengths: np.ndarray, min_run: int) -> list[tuple[int, int]]:
    """Neighbouring spans joined, those of at least ``min_run`` bytes."""
    found: list[list[int]] = []
    for start, length in sorted(set(zip(starts.tolist(), lengths.tolist()))):
        if found and start <= found[-1][1]:
            found[-1][1] = max(found[-1][1], start + length)
        else:
            found.append([start, start + length])
    return [(a, b) for a, b in found if b - a >= min_run]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, prefix: str = "") -> DataFrame:
    """``docs`` with repeated passages removed from the text, and n_bytes, n_removed, n_spans (names after ``prefix``).

    A column of ``docs`` that has the name of one of these is replaced.
    """
    counts = [f"{prefix}{n}" for n in ("n_bytes", "n_removed", "n_spans")]
    names = [c for c in docs.columns if c not in counts]
    key, same_id, spans_col = (fresh(docs, n) for n in ("key", "id", "spans"))
    given = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST))
    keyed = docs.select(*names, F.xxhash64(text_col).alias(key), given.alias(same_id))
    found = repeats(keyed.select(F.col(same_id).alias("id"), F.col(key).alias("key"), F.col(text_col).alias("text")))
    found = found.select(F.col("id").alias(same_id), F.col("key").alias(key), F.col("spans").alias(spans_col))
    joined = keyed.join(found, [same_id, key], "left").select(*names, spans_col)
    out = T.StructType([*docs.select(names).schema, *(T.StructField(n, T.LongType()) for n in counts)])

    def cut(batches):
        for batch in parts(batches, text_col):
            column, spans = batch.column(text_col), batch.column(spans_col)
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy())])
            flat = spans.flatten()
            starts, lengths = flat.field("start").to_numpy(), flat.field("length").to_numpy()
            texts, kept, removed, n_spans = documents(column), [], [], []
            for k, text in enumerate(texts):
                low, high = offsets[k], offsets[k + 1]
                cuts = runs(starts[low:high], lengths[low:high], min_run) if high > low else []
                kept.append(without(text, cuts) if cuts else text)
                removed.append(len(text) - len(kept[-1]))
                n_spans.append(len(cuts))
            new = pa.array(kept, pa.binary()).cast(pa.string())
            new = pa.array([None if n else t for t, n in zip(new.to_pylist(), column.is_null().to_pylist())], pa.string()) if column.null_count else new
            own = {n: new if n == text_col else batch.column(n) for n in names}
            numbers = ([len(t) for t in texts], removed, n_spans)
            yield record(own | {n: pa.array(x, pa.int64()) for n, x in zip(counts, numbers)})

    return joined.mapInArrow(cut, out)
