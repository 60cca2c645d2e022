"""Removal of repeated byte strings by grouping suffixes on a hash and ordering each group in blind tries.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else as well, in the same document or in
another. Only some suffixes are sorted: each string of that length contains an anchor, the place where the hash of the next
``GRAM`` bytes is smallest, the leftmost among equals, so equal strings have their anchor at the same place. Suffixes that
start at anchors are brought into groups of equal first ``GRAM`` bytes by an aggregate, a join and a sort on that hash: this
takes the place of the shallow phase of deep-shallow sorting, a multikey quicksort, as only equal beginnings matter here and not
their order, and a hash deals them to tasks evenly. Grams that occur once take no further part. Within a group the suffixes have a long prefix in common; a blind
trie orders them by the rest. Its nodes tell how far to the right groups of suffixes agree, and their reversed left sides in
sorted order tell how far each agrees to the left with its best partner in the group: both together are the strings that occur
again, to the byte.

A group of more than ``LARGE_GROUP`` suffixes isn't given to one task: its strings are counted by a 128-bit digest instead,
combined on the map side. Each document sends a region once per anchor, so what is shuffled follows the repeated text.

Results: a null text is empty. Each row is a document, so repeated rows repeat each other and lose what is long enough. A null
id counts as the smallest. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import shuffle_width
from tallyloom.llm.arrow import documents, parts, record, utf8

#: Bytes of a string that must not occur again, and of the gram that anchors are chosen by.
LENGTH, GRAM = 200, 32
#: Suffixes of a group that one task may get.
LARGE_GROUP = 20_000
_U = np.uint64
_BASE = 0xD1342543DE82EF95
_LOWEST = -(1 << 63)


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    return (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every place on; each step doubles the bytes covered."""
    values, width = _byte_values()[data], 1
    while width < GRAM:
        factor = _U(pow(_BASE, width, 1 << 64))
        values = np.concatenate([values[:-width] * factor + values[width:], values[-width:]]) if len(values) > width else values
        width *= 2
    values = (values ^ (values >> _U(32))) * _U(_BASE)
    return values ^ (values >> _U(29))


@dataclass
class Anchors:
    """Runs of string starts with one anchor: row, anchor, first and last start, all within the concatenated rows; gram."""

    row: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> Anchors:
    none = np.empty(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - length + 1, 0))
    if not len(row):
        return Anchors(none, none, none, none, none)
    grams = gram_hashes(data)
    best = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(data), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if span > width:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][row]
    at = (best[start] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    ends = np.append(new[1:], len(row)) - 1
    return Anchors(row[new], at[new], start[new], start[ends], grams[at[new]].view(np.int64))


@dataclass
class _Node:
    depth: int
    children: dict[int, _Node | int] = field(default_factory=dict)


class BlindTrie:
    """Orders distinct strings; its nodes keep the depth at which strings part and one byte per branch, no more."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings, self.root = strings, None
        for k in range(len(strings)):
            self._insert(k)

    def _byte(self, k: int, depth: int) -> int:
        s = self.strings[k]
        return s[depth] if depth < len(s) else -1

    def _insert(self, k: int) -> None:
        if self.root is None:
            self.root = k
            return
        node = self.root
        while isinstance(node, _Node):  # blind descent: bytes between nodes are not looked at
            node = node.children.get(self._byte(k, node.depth), next(iter(node.children.values())))
        shared = common(self.strings[k], self.strings[node])
        above, branch, node = None, 0, self.root
        while isinstance(node, _Node) and node.depth < shared:
            above, branch = node, self._byte(k, node.depth)
            node = node.children[branch]
        if isinstance(node, _Node) and node.depth == shared:
            node.children[self._byte(k, shared)] = k
            return
        other = node
        while isinstance(other, _Node):
            other = next(iter(other.children.values()))
        new = _Node(shared, {self._byte(other, shared): node, self._byte(k, shared): k})
        if above is None:
            self.root = new
        else:
            above.children[branch] = new

    def groups(self) -> list[tuple[int, list[int]]]:
        """Depth and sorted members of every node, the deeper ones first."""
        out: list[tuple[int, list[int]]] = []

        def walk(node: _Node | int) -> list[int]:
            if not isinstance(node, _Node):
                return [node]
            members = [k for _, child in sorted(node.children.items()) for k in walk(child)]
            out.append((node.depth, members))
            return members

        if self.root is not None:
            walk(self.root)
        return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def repeated(regions: list[tuple[bytes, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """First and last starts, in each region (bytes, place of its anchor), of strings that occur again in another one."""
    number: dict[tuple[bytes, int], int] = {}
    of = [number.setdefault(r, len(number)) for r in regions]
    distinct, times = list(number), np.bincount(of)
    found: list[list[tuple[int, int]]] = [[(0, len(b) - length)] if times[k] > 1 else [] for k, (b, _) in enumerate(distinct)]
    if len(distinct) > 1:
        left = [b[:at][::-1] for b, at in distinct]
        place = {k: n for n, k in enumerate(sorted(range(len(left)), key=left.__getitem__))}
        longest = max(map(len, left))
        right: dict[bytes, list[int]] = {}
        for k, (b, at) in enumerate(distinct):
            right.setdefault(b[at:], []).append(k)
        suffixes, equal = list(right), list(right.values())
        nodes = [(len(s), [n]) for n, s in enumerate(suffixes) if len(equal[n]) > 1] + BlindTrie(suffixes).groups()
        for depth, among in nodes:
            if depth + longest < length:
                continue
            members = sorted((k for n in among for k in equal[n]), key=place.__getitem__)
            near = [common(left[a], left[b]) for a, b in zip(members, members[1:])]
            for k, before, after in zip(members, [0, *near], [*near, 0]):
                region, at = distinct[k]
                low, high = at - max(before, after), min(at + depth, len(region)) - length
                if times[k] == 1 and low <= high:
                    found[k].append((low, high))
    return [found[k] for k in of]


def repeated_spans(docs: DataFrame, length: int = LENGTH, large: int = LARGE_GROUP) -> DataFrame:
    """Starts of repeated strings of a table (id, key, text): id, key, spans (array of low and high, ends exclusive)."""
    def anchor_rows(batches):
        for batch in parts(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            x = anchors(data, offsets, length)
            row = pa.array(x.row)
            yield record({
                "gram": pa.array(x.gram), "id": batch.column("id").take(row), "key": batch.column("key").take(row),
                "at": pa.array(x.at - offsets[x.row], pa.int32()),
            })

    def regions(batches):
        for batch in parts(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            x, whole, rows = anchors(data, offsets, length), data.tobytes(), []
            wanted = [dict(zip(a, b)) for a, b in zip(batch.column("places").to_pylist(), batch.column("large").to_pylist())]
            for r, at, first, last, gram in zip(x.row.tolist(), x.at.tolist(), x.first.tolist(), x.last.tolist(), x.gram.tolist()):
                flag = wanted[r].get(at - int(offsets[r]))
                if flag is not None:
                    rows.append((r, gram, at - first, whole[first : last + length], first - int(offsets[r]), flag))
            r, gram, at, region, start, flag = zip(*rows) if rows else [()] * 6
            row = pa.array(r, pa.int64())
            yield record({
                "gram": pa.array(gram, pa.int64()), "id": batch.column("id").take(row), "key": batch.column("key").take(row),
                "at": pa.array(at, pa.int32()), "region": pa.array(region, pa.binary()), "start": pa.array(start, pa.int32()),
                "large": pa.array(flag, pa.bool_()),
            })

    def grouped(batches):
        """Groups of equal gram, which may go on in the next batch."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            edges = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)] if len(gram) else [0]
            for a, b in zip(edges, edges[1:]):
                if held and held[-1].column("gram")[0].as_py() != int(gram[a]):
                    yield held
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield held

    def sort_groups(batches):
        ids, keys, lows, highs = [], [], [], []
        for group in grouped(batches):
            got = [x for batch in group for x in zip(*(batch.column(n).to_pylist() for n in ("region", "at", "id", "key", "start")))]
            for (_, _, doc, key, start), spans in zip(got, repeated([x[:2] for x in got], length)):
                for low, high in spans:
                    ids.append(doc), keys.append(key), lows.append(start + low), highs.append(start + high + length)
            if len(ids) > 20_000:
                yield _span_rows(ids, keys, lows, highs)
                ids, keys, lows, highs = [], [], [], []
        yield _span_rows(ids, keys, lows, highs)

    def digests(batches):
        for batch in parts(batches, "region"):
            texts = documents(batch.column("region"))
            n = [len(t) - length + 1 for t in texts]
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t[k : k + length]) for t, m in zip(texts, n) for k in range(m)), "<i8").reshape(-1, 2)
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = batch.column("start").to_numpy()[row] + step
            take = pa.array(row)
            yield record({"id": batch.column("id").take(take), "key": batch.column("key").take(take), "low": pa.array(start, pa.int32()), "a": pa.array(halves[:, 0]), "b": pa.array(halves[:, 1])})

    found = docs.mapInArrow(anchor_rows, "gram long, id long, key long, at int")
    grams = found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    places = (
        found.join(grams, "gram").groupBy("id", "key")
        .agg(F.collect_list(F.struct("at", (F.col("n") > large).alias("large"))).alias("found"))
        .select("id", "key", F.col("found.at").alias("places"), F.col("found.large").alias("large"))
    )
    def regions_of(wanted: DataFrame) -> DataFrame:
        return docs.join(wanted, ["id", "key"]).select("id", "key", "text", "places", "large").mapInArrow(
            regions, "gram long, id long, key long, at int, region binary, start int, large boolean")

    shallow = regions_of(places).filter("not large").repartition(shuffle_width(docs.sparkSession), "gram").sortWithinPartitions("gram")
    spans = shallow.mapInArrow(sort_groups, "id long, key long, low int, high int")
    in_large = regions_of(places.filter(F.array_contains("large", True))).filter("large")
    strings = in_large.mapInArrow(digests, "id long, key long, low int, a long, b long")
    again = strings.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
    counted = strings.join(again, ["a", "b"]).select("id", "key", "low", (F.col("low") + length).cast("int").alias("high"))
    return spans.unionAll(counted).groupBy("id", "key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def _span_rows(ids, keys, lows, highs) -> pa.RecordBatch:
    return record({"id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "low": pa.array(lows, pa.int32()), "high": pa.array(highs, pa.int32())})


def joined_spans(lows: np.ndarray, highs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    if not len(lows):
        return []
    order = np.argsort(lows, kind="stable")
    lows, reach = lows[order], np.maximum.accumulate(highs[order])
    new = np.flatnonzero(np.concatenate([[True], lows[1:] > reach[:-1]]))
    return list(zip(lows[new].tolist(), reach[np.append(new[1:], len(lows)) - 1].tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, large: int = LARGE_GROUP) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (binary: what is left may cut code points)."""
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")
    )
    found = repeated_spans(keyed, length, large)
    out = T.StructType([
        *(T.StructField(n, T.LongType()) for n in ("id", "n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType()),
    ])

    def cut(batches):
        for batch in parts(batches, "text"):
            spans = batch.column("spans")
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy())])
            flat = spans.flatten()
            lows, highs = flat.field("low").to_numpy(), flat.field("high").to_numpy()
            texts, kept, n = documents(batch.column("text")), [], []
            for k, text in enumerate(texts):
                runs = joined_spans(lows[offsets[k] : offsets[k + 1]], highs[offsets[k] : offsets[k + 1]])
                edges = [0, *(x for run in runs for x in run), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                n.append(len(runs))
            removed = [len(a) - len(b) for a, b in zip(texts, kept)]
            yield record({
                "id": batch.column("id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n, pa.int64()), "kept": pa.array(kept, pa.binary()),
            })

    # both joins read the same three columns dealt by the same keys, so the texts are shuffled once
    joined = keyed.join(found, ["id", "key"], "left").select("id", "text", "spans").mapInArrow(cut, out)
    given = F.when(F.col("id") != _LOWEST, F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col)
    return joined.select(given, "n_bytes", "n_removed", "n_spans", "kept")
