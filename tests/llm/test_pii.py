"""Base patterns against plain regular expressions, the field against enumeration of segmentations, and what it adds."""

import hashlib
import itertools
import random
import re

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import pii, queries


def by_contract(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(d[::-2]) % 10 == -sum(x * 2 // 10 + x * 2 % 10 for x in d[-2::-2]) % 10:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(("phone", *m.span()))
    return found


def card(rng, n=16):
    digits = [rng.randrange(10) for _ in range(n - 1)]
    check = -sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10
    return "".join(map(str, [*digits, check]))


def number(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def personal(rng):
    return rng.choice([
        lambda: f"ab.{number(rng, 2)}@mail{number(rng, 1)}.example.com", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)),
        lambda: card(rng), lambda: number(rng, 16), lambda: f"+1 ({number(rng, 3)}) 555-{number(rng, 4)}", lambda: f'token = "{number(rng, 20)}ab{number(rng, 10)}cd"',
    ])()


@pytest.fixture(scope="module")
def people(spark):
    rng, like = random.Random(8), corpus.rows()[0][2:]
    rows = corpus.rows() + [(k, " ".join(rng.choice(["word", "the", "Of", "élan", personal(rng)]) for _ in range(60)), *like) for k in range(500, 700)]
    return rows, corpus.frame(spark, rows).cache()


def test_base_patterns_equal_regular_expressions():
    rng = random.Random(9)
    for _ in range(4000):
        text = "".join(rng.choice(["1", "25", "4111", "@", ".", "-", " ", "+", "(", ")", "a", "B.c", "é", "%", "\n", "0", card(rng), "1.2.3.4"]) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text)[0] == by_contract(text), text


def test_long_texts_take_linear_time():
    for text in ("x" * 2_000_000, "1" * 2_000_000, "+" * 500_000, "a@" * 300_000, "1." * 500_000, "+1 " + "(" * 500_000):
        pii.base_spans(text)
        assert sum(b - a for a, b in pii.islands(text)) <= len(text)
    digits = "1" * 5000 + ".1.1.1"
    assert pii.base_spans(digits)[0] == []


def segmentations(n, spans):
    """All lists of spans and kinds without overlap."""
    def go(i):
        if i == n:
            yield []
            return
        for rest in go(i + 1):
            yield rest
        for k, (a, b) in enumerate(spans):
            if a == i:
                for y in range(len(pii.KINDS)):
                    for rest in go(b):
                        yield [(k, y), *rest]
    yield from go(0)


def test_expectations_and_decoding_equal_enumeration():
    rng = np.random.default_rng(3)
    n, spans = 4, [(0, 1), (0, 2), (1, 2), (1, 4), (2, 3), (3, 4)]
    scores, touch = rng.standard_normal((len(spans), 5)), rng.standard_normal((5, 5))
    weights, chance, touching = [], np.zeros_like(scores), np.zeros_like(touch)
    every = list(segmentations(n, spans))

    def score(segments):
        pairs = [(a[1], b[1]) for a, b in itertools.pairwise(segments) if spans[a[0]][1] == spans[b[0]][0]]
        return sum(scores[k, y] for k, y in segments) + sum(touch[p] for p in pairs), pairs

    for segments in every:
        total, pairs = score(segments)
        weights.append(np.exp(total))
        for k, y in segments:
            chance[k, y] += weights[-1]
        for p in pairs:
            touching[p] += weights[-1]
    total, found, found_touching = pii.expectations(n, spans, scores, touch)
    assert total == pytest.approx(np.log(sum(weights)))
    assert np.allclose(found, chance / sum(weights)) and np.allclose(found_touching, touching / sum(weights))

    class Fixed(pii.Field):
        def score(self, key):
            return scores[spans.index(key)] if key in spans else None

    x = pii.Island("abcd", [0, 1, 2, 3], [1, 2, 3, 4], ["a"] * 4)
    old, pii.span_key = pii.span_key, lambda x, i, j: (i, j)
    try:
        best = Fixed({}, touch).decode(x)
    finally:
        pii.span_key = old
    wanted = max(every, key=lambda s: score(s)[0])
    assert best == [(pii.KINDS[y], spans[k][0], spans[k][1]) for k, y in wanted]


def test_field_adds_what_the_patterns_miss(people):
    model = pii.train(people[1])
    found = lambda t: {(k, t[a:b]) for k, a, b in pii.all_spans(t, model)[1]}
    number = card(random.Random(1))
    assert found(f"of +1 (499) 555-6503 {number} the") == {("phone", "+1 (499) 555-6503"), ("card", number)}
    assert found("word 743-555-3824 the") == {("phone", "743-555-3824")}
    assert ("secret", "12345678901234567890ab1234567890cd") in found('the token = "12345678901234567890ab1234567890cd" of')
    for text in ("in 2020-01-02 there", "Version 2.0 of 1999", "pages 100-200", "words alone", "", "x" * 5000):
        assert found(text) == set()


def test_query_equals_brute_force(spark, people, tmp_path):
    rows, frame = people
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["op11_semi_markov"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    found, wanted = [], []
    for r in out.collect():
        found.append((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
    for r in rows:
        spans = by_contract(r[1] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        wanted.append((r[0], *(sum(s[0] == k for s in spans) for k in pii.BASE_KINDS), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted(found, key=repr) == sorted(wanted, key=repr) and sum(r.spans.count(":") for r in out.collect()) > 2 * sum(sum(w[1:5]) for w in wanted)


def test_edges(docs, empty):
    nothing = pii.train(empty)
    assert nothing.weights == {} and pii.find(empty, nothing).collect() == []
    out = pii.find(docs.filter(F.col("text").isNull() | (F.trim("text") == "")), nothing).collect()
    assert out and all(r.base == [] and r.spans == [] for r in out)
    assert pii.all_spans("a.b@c.de 1.2.3.4", nothing) == ([("email", 0, 8), ("ip", 9, 16)],) * 2
