"""Token-id files of directly addressable codes: any token is read without decoding what stands before it.

Each id is split into chunks of eight bits, the lowest first. A level holds one chunk of every id that reaches it, a bitmap
that tells whether the id goes on to the next level, and a rank directory, the number of set bits before each 64-bit word.
The place of a token's chunk on the next level is the rank of its bit, so access takes one step per level.

A file is a row of segments of whole documents, then a footer: an Arrow table of the documents (id, first token, tokens) and
one of the segments (first token, tokens, place), and the lengths of both. Files lie in ascending order of document ids
(nulls first); a file's first token counts from 0 and the manifest, a Parquet table with a row per file, gives the global
place. A task writes under a name of its own and only the manifest's committed rows name files, so a repeated task is
harmless and what it left is never read.

Results: a null text has only the end id. Documents of equal id stand next to each other in no given order, each with a
row of its own. An empty table gives no rows. Other columns are not read. Ids must be whole numbers.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import scratch_path, shuffle_width
from tallyloom.llm.arrow import documents, parts, record
from tallyloom.llm.words import coder

MAGIC = b"TLDAC001"
#: Tokens after which a segment is closed at the end of its document.
SEGMENT = 1 << 20
_COUNT, _LEVEL, _FOOTER = struct.Struct("<Q"), struct.Struct("<QQ"), struct.Struct("<QQ8s")


@dataclass
class Level:
    chunks: np.ndarray
    more: np.ndarray  # 64-bit words of the bitmap
    ranks: np.ndarray  # set bits before each word


def split_levels(ids: np.ndarray) -> list[Level]:
    """The levels of a run of unsigned ids."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        chunks, high = (rest & 255).astype(np.uint8), rest >> 8
        bits = np.packbits(high > 0, bitorder="little")
        words = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)]).view("<u8")
        before = np.cumsum(np.bitwise_count(words), dtype=np.uint64) - np.bitwise_count(words)
        levels.append(Level(chunks, words, before.astype("<u4")))
        rest = high[high > 0]
        if not len(rest):
            return levels


class Segment:
    """Random access to the ids of one segment."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def to_bytes(self) -> bytes:
        out = [_COUNT.pack(len(self.levels))]
        for level in self.levels:
            out += [_LEVEL.pack(len(level.chunks), len(level.more)), level.more.tobytes(), level.ranks.tobytes(), level.chunks.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Segment:
        (count,), at, levels = _COUNT.unpack_from(data), _COUNT.size, []
        for _ in range(count):
            n, words = _LEVEL.unpack_from(data, at)
            at += _LEVEL.size
            more = np.frombuffer(data, "<u8", words, at)
            ranks = np.frombuffer(data, "<u4", words, at + 8 * words)
            levels.append(Level(np.frombuffer(data, np.uint8, n, at + 12 * words), more, ranks))
            at += 12 * words + n
        return cls(levels)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in their order."""
        out = np.zeros(len(places), np.uint32)
        which, at = np.arange(len(places)), np.asarray(places, np.int64)
        for depth, level in enumerate(self.levels):
            out[which] |= level.chunks[at].astype(np.uint32) << np.uint32(8 * depth)
            word, bit = level.more[at >> 6], (at & 63).astype(np.uint64)
            goes_on = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            which, at = which[goes_on], (level.ranks[at >> 6] + below)[goes_on].astype(np.int64)
            if not len(which):
                break
        return out

    def _rank(self, depth: int, at: int) -> int:
        level = self.levels[depth]
        if at >> 6 >= len(level.more):
            return int(level.ranks[-1]) + int(np.bitwise_count(level.more[-1])) if len(level.more) else 0
        return int(level.ranks[at >> 6]) + int(level.more[at >> 6] & np.uint64((1 << (at & 63)) - 1)).bit_count()

    def run(self, low: int, high: int) -> np.ndarray:
        """The ids of [low, high)."""
        out, depth, targets = np.zeros(high - low, np.uint32), 0, None
        while high > low:
            level = self.levels[depth]
            chunks = level.chunks[low:high].astype(np.uint32) << np.uint32(8 * depth)
            if targets is None:
                out |= chunks
            else:
                out[targets] |= chunks
            bits = np.unpackbits(level.more[low >> 6 : (high + 63) >> 6].view(np.uint8), bitorder="little")
            on = np.flatnonzero(bits[low & 63 : (low & 63) + high - low])
            targets = on if targets is None else targets[on]
            low = self._rank(depth, low) if len(on) else 0
            high, depth = low + len(on), depth + 1
        return out


class DacFile:
    """One file: its documents, its segments, the ids at any place."""

    def __init__(self, uri: str) -> None:
        system, path = pafs.FileSystem.from_uri(uri)
        self._file = system.open_input_file(path)
        size = self._file.size()
        docs, segments, magic = _FOOTER.unpack(self._file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no id file")
        end = size - _FOOTER.size
        read = lambda n, at: pa.ipc.open_stream(self._file.read_at(n, at)).read_all()
        self.segments = read(segments, end - segments)
        self.documents = read(docs, end - segments - docs)
        self._firsts = self.segments.column("first").to_numpy()
        self._held: tuple[int, Segment | None] = (-1, None)

    def segment_of(self, token: int) -> tuple[int, Segment]:
        """First token and content of the segment that holds a token."""
        k = int(np.searchsorted(self._firsts, token, side="right")) - 1
        if self._held[0] != k:
            place, size = self.segments.column("place")[k].as_py(), self.segments.column("size")[k].as_py()
            self._held = (k, Segment.from_bytes(self._file.read_at(size, place)))
        return int(self._firsts[k]), self._held[1]

    def token(self, place: int) -> int:
        first, segment = self.segment_of(place)
        return int(segment.at(np.array([place - first]))[0])

    def close(self) -> None:
        self._file.close()


def _stream(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


class _Writer:
    def __init__(self, uri: str) -> None:
        system, path = pafs.FileSystem.from_uri(uri)
        self._file = system.open_output_stream(path)
        self.ids, self.counts, self.segments, self.place = [], [], [], 0
        self._open: list[bytes] = []
        self._tokens = self._first = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self._open.append(ids)
        self._tokens += len(ids) // 4
        if self._tokens >= SEGMENT:
            self._flush()

    def _flush(self) -> None:
        data = Segment(split_levels(np.frombuffer(b"".join(self._open), "<u4"))).to_bytes()
        self._file.write(data)
        self.segments.append((self._first, self._tokens, self.place, len(data)))
        self._first, self.place, self._tokens, self._open = self._first + self._tokens, self.place + len(data), 0, []

    def close(self) -> int:
        if self._open:
            self._flush()
        counts = np.array(self.counts, np.int64)
        docs = _stream(record({"id": pa.array(self.ids, pa.int64()), "first": np.cumsum(counts) - counts, "tokens": counts}))
        names = ("first", "tokens", "place", "size")
        segments = _stream(record({n: pa.array([s[k] for s in self.segments], pa.int64()) for k, n in enumerate(names)}))
        self._file.write(docs + segments + _FOOTER.pack(len(docs), len(segments), MAGIC))
        self._file.close()
        return int(counts.sum())


def write(docs: DataFrame, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode and write all documents; returns the manifest (shard, file, n_docs, n_tokens, start), a row per file.

    ``folder`` must be reachable by all executors; without it a new one below spark.checkpoint.dir is taken.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "ids")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = base.repartitionByRange(shuffle_width(spark), F.col("id"), F.xxhash64("text")).sortWithinPartitions("id")
    end = b"" if end_id is None else struct.pack("<I", end_id)
    system, path = pafs.FileSystem.from_uri(f"{folder}/files")
    system.create_dir(path, recursive=True)

    def store(batches):
        words, out, shard = coder(tokenizer), None, TaskContext.get().partitionId()
        name = f"{folder}/files/{shard:06d}-{uuid.uuid4().hex}.dac"
        for batch in parts(batches, "text"):
            out = out or _Writer(name)
            for doc_id, text in zip(batch.column("id").to_pylist(), documents(batch.column("text"))):
                out.add(doc_id, words.encode(text) + end)
        if out:
            n = out.close()
            yield record({"shard": pa.array([shard], pa.int32()), "file": pa.array([name]), "n_docs": [len(out.ids)], "n_tokens": [n]})

    ordered.mapInArrow(store, "shard int, file string, n_docs long, n_tokens long").write.parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.schema("shard int, file string, n_docs long, n_tokens long").parquet(f"{folder}/manifest")
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: id, start (global place of its first token), n_tokens, ids as little-endian 32-bit integers."""
    def load(batches):
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                dac = DacFile(file)
                docs = dac.documents
                for low in range(0, docs.num_rows, 512):
                    piece = docs.slice(low, 512)
                    found = []
                    for first, n in zip(piece.column("first").to_pylist(), piece.column("tokens").to_pylist()):
                        base, segment = dac.segment_of(first) if n else (first, None)
                        found.append(segment.run(first - base, first - base + n).astype("<u4").tobytes() if n else b"")
                    yield record({
                        "id": piece.column("id").combine_chunks(), "start": pa.array(piece.column("first").to_numpy() + start),
                        "n_tokens": piece.column("tokens").combine_chunks(), "ids": pa.array(found, pa.binary()),
                    })
                dac.close()

    files = manifest.repartition(shuffle_width(manifest.sparkSession), "shard")
    return files.mapInArrow(load, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
