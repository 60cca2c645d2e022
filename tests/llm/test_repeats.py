"""Chunk and suffix deduplication against brute force."""

from collections import Counter

import corpus
import numpy as np
import pytest

from tallyloom.llm import chunks, suffix


def chunked(text: bytes) -> list[tuple[int, int]]:
    """Content-defined chunks, byte by byte."""
    out, low, starts = [], 0, lambda i: i >= len(text) or text[i] & 0xC0 != 0x80
    while low < len(text):
        cut = low + chunks.LEAST
        while cut < len(text) and cut <= low + chunks.MOST:
            h = 0
            for b in text[cut - 32 : cut]:
                h = ((h << 1) + int(chunks.GEAR[b])) % (1 << 32)
            if h >> (32 - chunks.BORDER_BITS) == 0 and starts(cut):
                break
            cut += 1
        if cut > low + chunks.MOST and cut <= len(text):
            cut = low + chunks.MOST
            while not starts(cut):
                cut -= 1
        cut = min(cut, len(text))
        out.append((low, cut))
        low = cut
    return out


def without_chunks(rows, min_run=chunks.MIN_RUN):
    lowest, first, out = -(1 << 63), {}, []
    parts = [[(a, b, (r[1] or "").encode()[a:b]) for a, b in chunked((r[1] or "").encode())] for r in rows]
    for r, cut in zip(rows, parts):
        for _, _, c in cut:
            key = lowest if r[0] is None else r[0]
            first[c] = min(first.get(c, key), key)
    for r, cut in zip(rows, parts):
        seen, runs = set(), []
        for a, b, c in cut:
            if c in seen or first[c] < (lowest if r[0] is None else r[0]):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            seen.add(c)
        text = (r[1] or "").encode()
        out.append(chunks.without(text, [tuple(x) for x in runs if x[1] - x[0] >= min_run]).decode() if r[1] is not None else None)
    return out


def test_chunks_equal_brute_force(docs, empty):
    rows = corpus.rows()
    out = chunks.dedup(docs)
    assert set(out.columns) == set(docs.columns) | {"n_removed", "n_spans"}
    found = sorted(((r.doc_id, r.text, r.key, r.n_bytes, r.n_removed) for r in out.collect()), key=repr)
    sizes = [len((r[1] or "").encode()) for r in rows]
    wanted = [(r[0], t, "x", n, n - len((t or "").encode())) for r, t, n in zip(rows, without_chunks(rows), sizes)]
    assert found == sorted(wanted, key=repr)
    assert sum(r[4] for r in found) > 0
    assert chunks.dedup(empty).collect() == []


def test_chunks_resist_insertions():
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))

    def cut(t):
        at = chunks.borders(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        return {t[a:b] for a, b in zip(at, at[1:])}

    before, after = cut(text), cut(text[:9000] + b"inserted" + text[9000:])
    assert len(before - after) <= 6


def brute_repeats(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((r[0], len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("large", [suffix.LARGE_GROUP, 3])
def test_suffixes_equal_brute_force(docs, large):
    rows = corpus.rows()
    out = suffix.remove_repeats(docs, large=large)
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()), key=repr)
    assert found == brute_repeats(rows, suffix.LENGTH)


def test_no_documents_to_sort(empty):
    assert suffix.remove_repeats(empty).collect() == []


def test_blind_trie_sorts():
    rng = np.random.default_rng(5)
    strings = list({bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(300)})
    groups = suffix.BlindTrie(strings).groups()
    assert [strings[k] for k in groups[-1][1]] == sorted(strings)
    for depth, members in groups:
        assert len({strings[k][:depth] for k in members}) == 1 and len({strings[k][: depth + 1] for k in members}) > 1


def test_repeated_equals_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(200):
        regions = []
        for _ in range(rng.integers(1, 9)):
            at = int(rng.integers(0, 6))  # strings of six bytes contain the anchor
            left, right = (bytes(rng.integers(97, 99, k).astype(np.uint8)) for k in (at, rng.integers(max(0, 4 - at), 5)))
            regions.append((left + b"zz" + right, at))
        found = suffix.repeated(regions, 6)
        strings = Counter((b[i : i + 6], i - at) for b, at in regions for i in range(len(b) - 5))
        for (b, at), spans in zip(regions, found):
            covered = {i for low, high in spans for i in range(low, high + 1)}
            assert covered == {i for i in range(len(b) - 5) if strings[(b[i : i + 6], i - at)] > 1}
