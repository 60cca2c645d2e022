"""Runs of periodic words in texts, found by internal pattern matching.

A run is a stretch of words with smallest period q (words q apart are equal) that is at least ``least`` and ``exponent`` * q
words long and that no neighbouring word extends. A run of period q holds, whole and with its copy q further on, a block of
2**k words that starts at a multiple of 2**k, where 2**k is the largest power of two up to q (or, for small q, the largest
whose block surely fits in ``least`` words). So each such dyadic block asks where it occurs in the window of twice its length
behind it:

* the occurrences of a block are a range of the suffix array, which prefix doubling gives for every power of two;
* the next occurrence in the text is the range's successor of a position, which a wavelet tree over the suffix array answers;
* occurrences less than half a block apart are one arithmetic progression, which ends where its stretch ends and is stepped
  over at once; so a window has a handful of progressions whatever its text.

Distances to occurrences, differences of progressions and the shifts that lay one progression's stretch on another's are the
candidate periods. Each is extended to both sides by comparing words, so what is returned is exact, and of the candidates
with the same stretch the smallest period counts. Texts none of whose smallest blocks occurs twice have no run and skip this.

Results: a null text counts as empty; texts without words have no runs and keep nothing. A null id stays null, repeated rows
have equal results. A word is dropped if a run has it behind its first period. An empty table gives an empty table. Other
columns are not read. A text is worked on in one task, with some 100 bytes per word at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow import documents, parts, record

#: Least words of a run, and least length in periods (3 or more, so that a block and its copy fit).
LEAST, EXPONENT = 24, 3
_U = np.uint64
Run = tuple[int, int, int]


class WaveletTree:
    """Numbers of a sequence by their bits: which of a range of places is the smallest number from a given one on."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.zeros, self.ones_from = bits, [], []
        for b in reversed(range(bits)):
            one = (values >> b) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            self.ones_from.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[~one], values[one]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each query the smallest number >= least among places [low, high), or -1."""
        beyond = least >> self.bits > 0
        smaller, a, b = np.zeros(len(low), np.int64), low, high
        for level, (zeros, ones_from) in enumerate(zip(self.zeros, self.ones_from)):
            one = (least >> (self.bits - 1 - level)) & 1 == 1
            za, zb = zeros[a], zeros[b]
            smaller += np.where(one, zb - za, 0)
            a, b = np.where(one, ones_from + a - za, za), np.where(one, ones_from + b - zb, zb)
        none = beyond | (smaller >= high - low)
        a, b, found = np.where(none, 0, low), np.where(none, 0, high), np.zeros(len(low), np.int64)
        for zeros, ones_from in zip(self.zeros, self.ones_from):
            za, zb = zeros[a], zeros[b]
            one = smaller >= zb - za
            smaller = np.where(one, smaller - (zb - za), smaller)
            found = found * 2 + one
            a, b = np.where(one, ones_from + a - za, za), np.where(one, ones_from + b - zb, zb)
        return np.where(none, -1, found)


def _equal_after(words: np.ndarray, a: int, b: int, limit: int) -> int:
    """How many words from a and b on are equal, up to the limit; a < b."""
    n, step = 0, 32
    while n < limit:
        k = min(step, limit - n)
        differ = words[a + n : a + n + k] != words[b + n : b + n + k]
        at = int(differ.argmax())
        if differ[at]:
            return n + at
        n, step = n + k, min(step * 4, 1 << 16)
    return limit


def _equal_before(words: np.ndarray, a: int, b: int, limit: int) -> int:
    """How many words before a and b are equal, up to the limit."""
    n, step = 0, 32
    while n < limit:
        k = min(step, limit - n)
        differ = words[a - n - k : a - n][::-1] != words[b - n - k : b - n][::-1]
        at = int(differ.argmax())
        if differ[at]:
            return n + at
        n, step = n + k, min(step * 4, 1 << 16)
    return limit


class Stretches:
    """Maximal stretches of a period, each found once as long as it is asked for in order."""

    def __init__(self, words: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        self.words, self.first, self.end, self.last = words, first, end, {}

    def around(self, at: int, period: int) -> tuple[int, int]:
        """The stretch [low, high) in which words ``period`` apart are equal, around ``at`` and ``at + period``."""
        low, high = self.last.get(period, (0, 0))
        if not (low <= at and at + period < high):
            end = int(self.end[at])
            high = at + period + (_equal_after(self.words, at, at + period, end - at - period) if at + period < end else 0)
            low = at - _equal_before(self.words, at, at + period, at - int(self.first[at])) if high > at + period else at
            self.last[period] = low, high
        return low, high


def smallest_block(least: int) -> int:
    """The largest power of two whose aligned block and copy fit in every run of ``least`` words with a smaller period."""
    size = 1
    while 3 * (2 * size) - 2 <= least:
        size *= 2
    return size


def _ranked(words: np.ndarray, doc: np.ndarray, first: np.ndarray, end: np.ndarray, block: int, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Suffix array by prefix doubling, suffixes ending with their document, and for each block length its aligned blocks
    that occur again: start, first place in the suffix array, number of places."""
    n, levels = len(words), []
    _, kind, counts = np.unique(doc * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    rank, size = (np.cumsum(counts) - counts)[kind], counts[kind]
    length = 1
    while True:
        if length >= block:
            at = np.flatnonzero((size > 1) & ((np.arange(n) - first) % length == 0) & (np.arange(n) + length <= end))
            levels.append((length, at, rank[at], size[at]))
        active = np.flatnonzero(size > 1)
        if not len(active) or 2 * length * EXPONENT > longest and 2 * length > block:
            break
        behind = active + length
        inside = behind < end[active]
        second = np.where(inside, rank[np.where(inside, behind, 0)] + 1, 0)
        key = rank[active] * (n + 1) + second
        order = np.argsort(key)
        key, active = key[order], active[order]
        old = rank[active]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(key)]]))
        groups = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        group_start = np.repeat(groups, np.diff(np.concatenate([groups, [len(old)]])))
        rank[active] = old + np.repeat(starts, counts) - group_start
        size[active] = np.repeat(counts, counts)
        length *= 2
    return np.argsort(rank, kind="stable"), levels


def _candidates(words: np.ndarray, doc: np.ndarray, first: np.ndarray, end: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """(place, period) such that every run is around one of them."""
    suffixes, levels = _ranked(words, doc, first, end, block, int((end - first).max()))
    repeated = np.zeros(len(words) + 1, bool)  # places of the suffix array that some block may ask for
    for _, _, low, size in levels:
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, low, 1)
        np.add.at(change, low + size, -1)
        repeated |= np.cumsum(change) > 0
    before = np.concatenate([[0], np.cumsum(repeated[:-1])])
    tree = WaveletTree(suffixes[repeated[:-1]], max(1, int(len(words) - 1).bit_length()))
    stretches = Stretches(words, first, end)
    for length, at, low, size in levels:
        low, high = before[low], before[low + size]
        last = at.copy()  # the occurrence behind which is sought
        while len(at):
            found = tree.successor(low, high, last + 1)
            hit = (found >= 0) & (found < at + 2 * length)
            at, low, high, last, found = at[hit], low[hit], high[hit], last[hit], found[hit]
            near = found - last <= length // 2
            for i, occurrence in zip(at[~near].tolist(), found[~near].tolist()):
                yield i, occurrence - i
            for k in np.flatnonzero(near).tolist():
                i, start, step = int(at[k]), int(last[k]), int(found[k] - last[k])
                here = stretches.around(start, step)
                found[k] = start + step * ((here[1] - length - start) // step)
                if start == i:
                    yield i, step
                else:
                    own = stretches.around(i, step)
                    yield i, here[0] - own[0]
                    yield i, here[1] - own[1]
            last = found


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[list[Run]]:
    """All runs (start, length, period) of each document, by start, then period; words are numbers, bounds the borders."""
    out: list[list[Run]] = [[] for _ in bounds[1:]]
    sizes = np.diff(bounds)
    if not len(words):
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first, end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    stretches, found = Stretches(words, first, end), {}
    pairs = {(q, i) for i, q in _candidates(words, doc, first, end, smallest_block(least)) if q > 0 and i + q < end[i]}
    for q, i in sorted(pairs):
        low, high = stretches.around(i, q)
        if high - low >= max(least, exponent * q):
            found[low, high] = min(q, found.get((low, high), q))
    for (low, high), q in found.items():
        d = int(doc[low])
        out[d].append((low - int(bounds[d]), high - low, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def _with_repeats(hashes: np.ndarray, bounds: np.ndarray, block: int) -> np.ndarray:
    """Documents in which some block of words occurs twice (and, by chance, others)."""
    sizes = np.diff(bounds)
    if len(hashes) < block:
        return np.empty(0, np.int64)
    count = len(hashes) - block + 1
    doc = np.repeat(np.arange(len(sizes)), sizes)
    grams = hashes[:count].copy()
    for k in range(1, block):
        grams = grams * _U(0x9E3779B97F4A7C15) + hashes[k : k + count]
    grams ^= (doc[:count].astype(np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93)
    whole = doc[:count] == doc[block - 1 : block - 1 + count]
    grams, doc = grams[whole], doc[:count][whole]
    order = np.sort(grams)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
    return np.unique(doc[twice[at] == grams])


def text_runs(texts: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[list[Run]]:
    """All runs of texts given as lists of words."""
    out: list[list[Run]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    hashes = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(bounds[-1])).view(np.uint64)
    asked = _with_repeats(hashes, bounds, smallest_block(least)).tolist()
    if asked:
        chosen = [texts[k] for k in asked]
        number: dict[bytes, int] = {w: k for k, w in enumerate({w for t in chosen for w in t})}
        words = np.fromiter((number[w] for t in chosen for w in t), np.int64, sum(map(len, chosen)))
        for k, runs in zip(asked, runs_of(words, np.concatenate([[0], np.cumsum(sizes[asked])]), least, exponent)):
            out[k] = runs
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run has behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def best_run(runs: list[Run]) -> Run | None:
    """The run of the greatest length in periods; of equals the first, then the one of the smallest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs and best (start, length, period), kept (the words left, a space apart)."""
    if exponent < EXPONENT:
        raise ValueError(f"runs need at least {EXPONENT} periods")
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def found(batches):
        for batch in parts(batches, "text"):
            texts = [t.split() for t in documents(batch.column("text"))]
            runs = text_runs(texts, least, exponent)
            named = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))
            yield record({
                "id": batch.column("id"), "n_words": pa.array(map(len, texts), pa.int64()),
                "runs": pa.array([[named(r) for r in rs] for rs in runs], pa.list_(run)),
                "best": pa.array([named(best_run(rs)) for rs in runs], run),
                "kept": pa.array([b" ".join(collapsed(t, rs)) for t, rs in zip(texts, runs)], pa.binary()).cast(pa.string()),
            })

    one = "struct<start:bigint,length:bigint,period:bigint>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(found, f"id {kind}, n_words long, runs array<{one}>, best {one}, kept string").withColumnRenamed("id", id_col)
