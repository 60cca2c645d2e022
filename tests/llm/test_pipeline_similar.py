"""The pipeline's second stage against brute force, with pairs between its limit and that of op5_prefix_tree."""

import random
from itertools import combinations

import corpus

import corpus_pipeline
from test_similar import roots


def shingles(text, width):
    words = text.split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def similarity(a, b, width):
    a, b = shingles(a, width), shingles(b, width)
    return len(a & b) / len(a | b)


def changed(words, places):
    return " ".join(f"new{k}" if k in places else w for k, w in enumerate(words))


def test_similar_stage_equals_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for group in range(12):
        words = [f"g{group}w{rng.randrange(1 << 30)}" for _ in range(300)]
        texts.append(" ".join(words))
        texts += [changed(words, set(range(10, 10 + 40 * n, 40))) for n in (group % 3 + 5, 7)]  # isolated words
        cut = rng.randrange(30, 90)
        texts.append(" ".join(words[cut:]))  # one holds the other, sizes in other bands
    assert 0.8 <= similarity(texts[0], changed(texts[0].split(), set(range(10, 250, 40))), 5) < 0.83
    rows = [(k, t, "en", "s", len(t), *"xxxxxxxxx") for k, t in enumerate(texts)]
    pairs = list(combinations(range(len(texts)), 2))
    links = [(a, b) for a, b in pairs if similarity(texts[a], texts[b], 5) >= 0.8]
    assert sum(similarity(texts[a], texts[b], 5) < 0.9 and similarity(texts[a], texts[b], 3) < 0.9 for a, b in links) > 8
    wanted = roots(range(len(texts)), links)
    out = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, corpus.frame(spark, rows), "unused")
    assert sorted(r.doc_id for r in out.collect()) == sorted(k for k in wanted if wanted[k] == k)
