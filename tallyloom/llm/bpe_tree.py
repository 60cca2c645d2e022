"""BPE encoding and decoding of whole documents; long texts are encoded in halves and joined again by tree concatenation.

A text of at most ``leaf`` code points is encoded at once. A longer one is halved until its parts are short enough, without
regard to words; the parts are rows of their own, so tasks encode them in parallel. Going up the tree, each join encodes a
window of text around the cut anew and widens it until, on either side, a token of the window equals a token of the part
(same id, same place, away from all cut ends). From there on the part's own tokens hold: its neighbours were merged in the
same context, and a sequence of BPE tokens is right if each two neighbours are.

Results: a null text is empty and has no ids. Rows of equal id and text get equal results, one for each row. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.arrow import documents, id_lists, parts, record
from tallyloom.llm.words import WordCoder, coder

#: Code points that are encoded at once.
LEAF = 32_768
#: Code points next to a cut whose tokens are not trusted: longer than any special token or contraction.
MARGIN = 16
#: First width of a window on each side.
WINDOW = 96
#: Code points at the ends of a part whose tokens are placed ahead of the joins; a join that needs more places all.
BORDER = 1024


@dataclass
class Tokens:
    """Neighbouring tokens: ids, first and last code points within the whole text."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


@dataclass
class Part:
    """The ids of text[low:high], and its first and last tokens with their places."""

    low: int
    high: int
    ids: np.ndarray
    head: Tokens
    tail: Tokens


def placed(words: WordCoder, text: str, low: int, high: int) -> Tokens:
    ids, starts, ends = words.encode_spans(text[low:high])
    return Tokens(ids, starts + low, ends + low)


def _equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def head_of(words: WordCoder, text: str, low: int, high: int, ids: np.ndarray) -> Tokens:
    end = min(high, low + BORDER)
    t = placed(words, text, low, end)
    n = _equal_run(t.ids, ids)
    if end < high:
        n = min(n, int(np.searchsorted(t.ends, end - MARGIN, side="right")))
    return Tokens(t.ids[:n], t.starts[:n], t.ends[:n])


def tail_of(words: WordCoder, text: str, low: int, high: int, ids: np.ndarray) -> Tokens:
    start = max(low, high - BORDER)
    t = placed(words, text, start, high)
    n = _equal_run(t.ids[::-1], ids[::-1])
    if start > low:
        n = min(n, len(t.ids) - int(np.searchsorted(t.starts, start + MARGIN)))
    at = len(t.ids) - n
    return Tokens(t.ids[at:], t.starts[at:], t.ends[at:])


def part_of(words: WordCoder, text: str, low: int, high: int, ids: np.ndarray) -> Part:
    return Part(low, high, ids, head_of(words, text, low, high, ids), tail_of(words, text, low, high, ids))


def _whole(t: Tokens) -> np.ndarray:
    """Tokens that cover code points of their own, so that their place names them."""
    own = t.ends > t.starts
    own[1:] &= t.starts[1:] >= t.ends[:-1]
    own[:-1] &= t.ends[:-1] <= t.starts[1:]
    return own


def _stands_alone(text: str, at: int) -> bool:
    """The normaliser treats text[at] alike with and without what stands before it."""
    if at == 0:
        return True
    a, b = text[at - 1], text[at]
    form = unicodedata.normalize
    return unicodedata.category(b)[0] != "M" and form("NFC", a + b) == form("NFC", a) + form("NFC", b)


def _common(part: Tokens, window: Tokens, low: int, high: int, last: bool) -> tuple[int, int] | None:
    """Positions in part and window of the first or last token that both have within [low, high)."""
    def inside(t: Tokens) -> dict[tuple[int, int, int], int]:
        at = np.flatnonzero(_whole(t) & (t.starts >= low) & (t.ends <= high))
        return {k: int(i) for i, k in zip(at, zip(t.starts[at].tolist(), t.ends[at].tolist(), t.ids[at].tolist()))}

    here, there = inside(part), inside(window)
    shared = here.keys() & there.keys()
    if not shared:
        return None
    key = (max if last else min)(shared)
    return here[key], there[key]


def join_parts(words: WordCoder, text: str, left: Part, right: Part) -> Part:
    """The ids of two neighbouring parts as if their text had been encoded at once."""
    cut, width, tail, head = left.high, WINDOW, left.tail, right.head
    while True:
        if len(tail.ids) < len(left.ids) and (not len(tail.ids) or cut - width < tail.starts[0]):
            tail = placed(words, text, left.low, left.high)
        if len(head.ids) < len(right.ids) and (not len(head.ids) or cut + width > head.ends[-1]):
            head = placed(words, text, right.low, right.high)
        low, first = left.low, 0
        if cut - width > left.low:
            own, first = _whole(tail), min(int(np.searchsorted(tail.starts, cut - width)), len(tail.ids) - 1)
            while first > 0 and not (own[first] and tail.starts[first] <= cut - MARGIN and _stands_alone(text, int(tail.starts[first]))):
                first -= 1
            if first > 0:
                low = int(tail.starts[first])
            elif len(tail.ids) < len(left.ids):
                width *= 4
                continue
        high = min(right.high, cut + width)
        window = placed(words, text, low, high)
        from_left = (-len(tail.ids), 0) if low == left.low else _common(tail, window, low, cut - MARGIN, last=False)
        to_right = (
            (len(right.ids), len(window.ids)) if high == right.high
            else _common(head, window, cut + MARGIN, high - MARGIN, last=True)
        )
        if from_left and to_right and from_left[1] <= to_right[1]:
            u = 0 if low == left.low else len(left.ids) - len(tail.ids) + from_left[0]
            ids = np.concatenate([left.ids[:u], window.ids[from_left[1] : to_right[1]], right.ids[to_right[0] :]])
            return Part(
                left.low, right.high, ids,
                left.head if len(left.head.ids) <= u else head_of(words, text, left.low, right.high, ids),
                right.tail if len(right.tail.ids) <= len(right.ids) - to_right[0] else tail_of(words, text, left.low, right.high, ids),
            )
        width *= 4


def join_tree(words: WordCoder, text: str, leaves: list[Part]) -> np.ndarray:
    while len(leaves) > 1:
        pairs = [join_parts(words, text, a, b) for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = pairs + leaves[len(pairs) * 2 :]
    return leaves[0].ids


def halves(n: int, leaf: int) -> list[tuple[int, int]]:
    """Borders of the leaves when [0, n) is halved until each has at most ``leaf``."""
    count = 1
    while -(-n // count) > leaf:
        count *= 2
    at = [n * k // count for k in range(count + 1)]
    return list(zip(at, at[1:]))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, decoded: str | None = None) -> DataFrame:
    """One row (id, ids array<int>) per row of ``docs``; ``tokenizer`` is the path of a vocabulary of the tokenizers library.

    With ``decoded`` the ids' text is a column of that name: ids are decoded where they are made, in the same worker.
    """
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text") > leaf, F.lit(False))
    texts = [T.StructField("decoded", T.StringType())] if decoded else []
    out = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), *texts])

    def at_once(batches):
        words = coder(tokenizer)
        for batch in parts(batches, "text"):
            found = [np.frombuffer(words.encode(text), "<u4") for text in documents(batch.column("text"))]
            offsets = np.cumsum([0, *map(len, found)])
            text = {"decoded": pa.array([words.decode(x.tolist()) for x in found], pa.string())} if decoded else {}
            yield record({"id": batch.column("id"), "ids": id_lists(np.concatenate([*found, np.empty(0, "<u4")]), offsets)} | text)

    def cut(batches):
        for batch in parts(batches, "text"):
            for row, text in enumerate(batch.column("text").to_pylist()):
                key, at = hashlib.md5(text.encode()).digest(), halves(len(text), leaf)
                yield record({
                    "id": batch.column("id").take(pa.array([row] * len(at))), "key": pa.array([key] * len(at)),
                    "leaf": pa.array(range(len(at)), pa.int32()), "part": pa.array([text[a:b] for a, b in at]),
                })

    def leaves(batches):
        words = coder(tokenizer)
        for batch in parts(batches, "part"):
            found = [words.encode(x) for x in documents(batch.column("part"))]
            yield record({n: batch.column(n) for n in ("id", "key", "leaf", "part", "copies")} | {"ids": pa.array(found, pa.binary())})

    def together(table: pa.Table) -> pa.Table:
        rows = sorted(table.drop_columns(["id"]).to_pylist(), key=lambda r: r["leaf"])
        words, text, low, made = coder(tokenizer), "".join(r["part"] for r in rows), 0, []
        for r in rows:
            high = low + len(r["part"])
            made.append(part_of(words, text, low, high, np.frombuffer(r["ids"], "<u4").astype(np.int64)))
            low = high
        ids = join_tree(words, text, made)
        whole = {"id": table.column("id").combine_chunks().slice(0, 1), "ids": id_lists(ids, np.array([0, len(ids)]))}
        whole |= {"decoded": pa.array([words.decode(ids.tolist())], pa.string())} if decoded else {}
        return pa.table(whole | {"copies": pa.array([rows[0]["copies"]], pa.int64())})

    kinds = {f.name: f.dataType for f in out}
    row = lambda *fields: T.StructType([T.StructField(n, t) for n, t in fields])
    leaf_row = [("id", kinds["id"]), ("key", T.BinaryType()), ("leaf", T.IntegerType()), ("part", T.StringType())]
    whole = base.filter(~long).mapInArrow(at_once, out)
    pieces = (
        base.filter(long).mapInArrow(cut, row(*leaf_row)).groupBy("id", "key", "leaf")
        .agg(F.any_value("part").alias("part"), F.count("*").alias("copies"))
        .mapInArrow(leaves, row(*leaf_row, ("copies", T.LongType()), ("ids", T.BinaryType())))
    )
    joined = pieces.groupBy("id", "key").applyInArrow(together, T.StructType([*out, T.StructField("copies", T.LongType())]))
    each = joined.select(*out.names, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
    return whole.unionByName(each).withColumnsRenamed({"id": id_col, "decoded": decoded or "decoded"})


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids, special tokens shown; null ids give an empty text."""
    out = T.StructType([*(f for f in encoded.schema if f.name != to), T.StructField(to, T.StringType())])

    def texts(batches):
        words = coder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = [words.decode(ids or []) for ids in piece.column(ids_col).to_pylist()]
                kept = {n: piece.column(n) for n in piece.schema.names if n != to}
                yield record(kept | {to: pa.array(found, pa.string())})

    return encoded.mapInArrow(texts, out)
