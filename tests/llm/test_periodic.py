"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import corpus
import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import periodic, queries


def brute_runs(words, least=periodic.LEAST, exponent=periodic.EXPONENT):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        k = 0
        while k < n - q:
            if words[k] != words[k + q]:
                k += 1
                continue
            low = k
            while k < n - q and words[k] == words[k + q]:
                k += 1
            if k + q - low >= max(least, exponent * q):
                found[low, k + q] = min(q, found.get((low, k + q), q))
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    k, n = rng.choice([1, 2, 3, 50]), rng.randint(0, 300)
    part = lambda most: [rng.randrange(k) for _ in range(rng.randint(1, most))]
    kind = rng.randrange(4)
    if kind == 0:
        words = part(300)
    elif kind == 1:
        words = (part(60) * n)[:n]
    elif kind == 2:  # periods within periods
        words = (((part(5) * 20)[: rng.randint(1, 60)] + [99]) * n)[:n]
    else:
        words = sum(((part(20) * 30)[: rng.randint(1, 100)] for _ in range(5)), [])
    for _ in range(rng.choice([0, 0, 1, 3])):
        if words:
            words[rng.randrange(len(words))] = 77
    return [str(w).encode() for w in words]


def test_runs_equal_brute_force():
    rng, total = random.Random(4), 0
    for _ in range(300):
        texts = [made(rng) for _ in range(rng.randint(1, 4))]
        for least in (24, rng.choice([1, 3, 10, 50])):
            found = periodic.text_runs(texts, least)
            assert found == [brute_runs(t, least) for t in texts]
            total += sum(map(len, found))
    assert total > 1000


def test_fibonacci_words_and_one_word():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 3000:
        a, b = b, b + a
    assert periodic.text_runs([b, [b"x"] * 50_000]) == [brute_runs(b), [(0, 50_000, 1)]]


def test_successor_equals_brute_force():
    rng = np.random.default_rng(5)
    values = rng.permutation(200)
    tree = periodic.WaveletTree(values, 8)
    low = rng.integers(0, 200, 500)
    high = np.minimum(low + rng.integers(0, 60, 500), 200)
    least = rng.integers(0, 260, 500)
    wanted = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(low, high, least)]
    assert tree.successor(low, high, least).tolist() == wanted


def by_contract(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, digest(lines), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = corpus.rows() + [(k, " ".join(w.decode() for w in made(rng)), *corpus.rows()[0][2:]) for k in range(1000, 1120)]
    rows = [r for r in rows if len((r[1] or "").split()) < 2000]
    corpus.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["op12_internal_patterns"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = out.collect()
    assert sorted(map(tuple, found), key=repr) == sorted((by_contract(r[0], r[1]) for r in rows), key=repr)
    assert sum(r.n_runs > 0 for r in found) > 20 and max(r.n_runs for r in found) > 1


def test_edges(docs, empty):
    assert periodic.find_runs(empty).collect() == []
    out = periodic.find_runs(docs.filter(F.col("text").isNull() | (F.trim("text") == ""))).collect()
    assert out and all(r.n_words == 0 and r.runs == [] and r.best is None and r.kept == "" for r in out)
