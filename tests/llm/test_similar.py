"""Prefix-tree join and pivot index against brute force."""

import re
from itertools import combinations

import corpus
import numpy as np
import pytest

from tallyloom import core
from tallyloom.llm import jaccard, pivots
from tallyloom.llm.components import components
from tallyloom.sources import manifests


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width=3):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + k, 101 + k) for k in range(40)]
    frame = spark.createDataFrame([*links, *links[:3]], "a long, b long")
    found = {r.node: r.component for r in components(frame).collect()}
    wanted = roots({x for link in links for x in link}, links)
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert found == {n: c for n, c in wanted.items() if n not in alone}


@pytest.mark.parametrize("block,percent", [(jaccard.BLOCK, 90), (2, 90), (2, 70)])
def test_join_equals_brute_force(docs, block, percent):
    rows = corpus.rows()
    sets = [(r[0], shingles(r[1])) for r in rows]
    named = [(n, s) for n, s in sets if n is not None and s]
    links = [(a, b) for (a, s), (b, t) in combinations(named, 2) if 100 * len(s & t) >= percent * len(s | t)]
    wanted = roots({n for n, _ in sets if n is not None}, links)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(docs, block=block, percent=percent).collect()), key=repr)
    assert found == sorted(((n, len(s), wanted.get(n)) for n, s in sets), key=repr)
    assert len(set(wanted.values())) < len(wanted) - 8


def first_rows(rows, width=3, percent=90):
    """One row of each group of similar documents: equal rows once, documents without id behind all others."""
    sets = [shingles(r[1], width) for r in rows]
    nodes = [(r[0] is None, r[0] if r[0] is not None else r[1] or "") for r in rows]
    links = [(nodes[a], nodes[b]) for a, b in combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    wanted = roots(set(nodes), links)
    return sorted({repr((r[0], r[1])): r for r, n in zip(rows, nodes) if wanted[n] == n}.values(), key=repr)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_first_of_each(docs, empty, width, percent):
    kept = jaccard.first_of_each(docs, width=width, percent=percent)
    assert kept.columns == docs.columns
    rows = corpus.rows()
    wanted = first_rows(rows, width, percent)
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == wanted and len(wanted) < len({repr(r) for r in rows}) - 8
    assert jaccard.first_of_each(empty).collect() == [] and jaccard.similar_components(empty).collect() == []


def test_copies_leave_one_row(spark):
    texts = [" ".join(f"w{k}" for k in range(30)), " ".join(f"v{k}" for k in range(30))]
    rows = [(3, texts[0])] * 2000 + [(None, texts[0])] * 50 + [(None, texts[1])] * 50 + [(9, "")] * 3 + [(None, None)] * 4
    out = jaccard.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(3, texts[0]), (None, texts[1]), (9, ""), (None, None)], key=repr)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for size in [1, 2, 5, 9, 10, 15, 16, 17, 18, 25, 26, 60, 300, 2000]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            take = int(rng.integers(0, len(a) // 9 + 1))
            more = int(rng.integers(0, take + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[take - more :], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
            if 10 * len(np.intersect1d(a, b)) >= 9 * len(np.union1d(a, b)):
                assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size


@pytest.mark.parametrize("percent", [90, 80, 70, 50])
def test_sets_right_at_the_limit_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    fresh = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    for size in [1, 3, 5, 12, 15, 16, 25, 40, 60, 98, 100, 101, 300]:
        for _ in range(60):
            a = fresh(size)
            # all that the union may have more than the intersection: n-grams of one side only, or of both sides
            for common in (size, int(rng.integers(-(-percent * size // 100), size + 1))):
                more = max(0, 100 * common // percent - size)
                b = np.unique(np.concatenate([rng.permutation(a)[:common], fresh(more)]))
                both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                assert 100 * both >= percent * either > 0
                assert np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)).size


@pytest.mark.parametrize("limits", [{"block": 10}, {"block_grams": 750}])
def test_large_clusters_are_dealt_to_bounded_tasks(spark, monkeypatch, limits):
    rng = np.random.default_rng(6)
    prose = lambda n: [f"w{k}" for k in rng.integers(0, 1 << 40, n)]
    head, tail = prose(40), prose(30)
    pages = [[*head, *prose(6), *tail] for _ in range(100)]
    pages += [[*p[:-1], "other"] for p in pages[::5]]
    texts = [(k, " ".join(p)) for k, p in enumerate(pages)]
    sets = [(k, shingles(t)) for k, t in texts]
    links = [(a, b) for (a, s), (b, t) in combinations(sets, 2) if 100 * len(s & t) >= 90 * len(s | t)]
    grouped, frame = [], type(spark.range(0))
    group = frame.groupBy

    def spy(self, *by):
        if "text" in self.columns:
            grouped.append((self, by))
        return group(self, *by)

    monkeypatch.setattr(frame, "groupBy", spy)
    found = {r.doc_id: r.component_id for r in jaccard.similar_components(spark.createDataFrame(texts, "doc_id long, text string"), **limits).collect()}
    assert found == roots([k for k, _ in texts], links) and len(set(found.values())) == 100
    most = [max(r["count"] for r in group(rows, *by).count().collect()) for rows, by in grouped]
    assert len(most) == 2 and max(most) < 60  # two blocks of about 10 sets, not all 120


@pytest.mark.parametrize("percent", [90, 80, 70, 50])
def test_similar_sets_share_as_many_signatures_as_they_say(percent):
    """In one kind at least what they share is no less than either says, also where parts are empty."""
    rng = np.random.default_rng(percent + 1)
    fresh = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    said = 0
    for size in [1, 3, 5, 12, 15, 16, 25, 40, 60, 89, 98, 100, 226, 300, 362, 363, 580]:
        for _ in range(60):
            a = fresh(size)
            common = int(rng.integers(-(-percent * size // 100), size + 1))
            more = int(rng.integers(0, max(0, 100 * common // percent - size) + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[:common], fresh(more)]))
            assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
            (x, kinds, sure), (y, others, least) = jaccard.signed(a, percent), jaccard.signed(b, percent)
            shared = [int(v) & (jaccard._KINDS - 1) for v in np.intersect1d(x, y)]
            mine, theirs = dict(zip(kinds.tolist(), sure.tolist())), dict(zip(others.tolist(), least.tolist()))
            good = [k for k in mine.keys() & theirs.keys() if shared.count(k) >= max(mine[k], theirs[k])]
            assert good
            said += max(max(mine[k], theirs[k]) for k in good) > 1
    assert said > 100


def test_near_copies_stand_in_few_clusters_and_little_is_left(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in rng.integers(0, 1 << 40, 400)]
    texts = []
    for k in range(80):
        words = list(base)
        for at in rng.integers(0, 400, 3):
            words[at] = f"x{rng.integers(0, 1 << 40)}"
        texts.append((k, " ".join(words)))
    sets = [(k, shingles(t, 5)) for k, t in texts]
    links = [(a, b) for (a, s), (b, t) in combinations(sets, 2) if 100 * len(s & t) >= 80 * len(s | t)]
    seen, write = {}, jaccard.written

    def spy(df, stem="step"):
        seen[stem] = write(df, stem)
        return seen[stem]

    monkeypatch.setattr(jaccard, "written", spy)
    stems = []
    path = core.scratch_path
    monkeypatch.setattr(core, "scratch_path", lambda session, stem: stems.append((stem, path(session, stem))) or stems[-1][1])
    found = {r.doc_id: r.component_id for r in jaccard.similar_components(spark.createDataFrame(texts, "doc_id long, text string"), width=5, percent=80).collect()}
    assert found == roots([k for k, _ in texts], links)
    assert len(texts) <= seen["clusters"].count() <= 4 * len(texts)
    left = {stem for stem, at in stems if manifests.listing(spark, at)}
    assert "clusters" in left and "signed" in {stem for stem, _ in stems} and "signed" not in left


def test_only_decided_texts_are_shipped(spark):
    prose = lambda n: " ".join(f"w{n}v{k}" for k in range(40))
    rows = [(k, prose(k)) for k in range(200)] + [(1000, prose(3)), (1001, prose(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard.first_of_each(docs)
    assert sorted(map(tuple, kept.collect())) == rows[:200]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    joined = [block for block in re.split(r"Join ", plan)[1:]]
    assert joined and all("some(" in block for block in joined)  # each side with texts has been cut down before


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, 16))
    data = [centres[k % 60] + rng.normal(size=16) * (0.05 if k % 2 else 1.0) for k in range(600)]
    data += [data[0]] * 30 + [centres[0] + rng.normal(size=16) * 0.02 for _ in range(60)]
    rows = [(k, [float(np.float32(x)) for x in v], k % 3) for k, v in enumerate(data)]
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e200] * 16]
    return rows + [(1000 + k, v, None) for k, v in enumerate(odd)] + [(None, rows[0][1], 0), (5, rows[5][1], 1)]


@pytest.mark.parametrize("block", [pivots.BLOCK, 20])
def test_pivots_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rows = vectors()
    good = [r[0] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = np.zeros(len(rows), int)
    pairs = []
    for a, b in combinations([k for k in range(len(rows)) if good[k]], 2):
        x, y = np.array(rows[a][1]), np.array(rows[b][1])
        if len(x) == len(y):
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y >= 0.95 * np.sqrt((x @ x) * (y @ y)) - 1e-12:
                links[[a, b]] += 1
                pairs.append((rows[a][0], rows[b][0]))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = pivots.near_duplicates(table).collect()
    assert len(out) == len(rows)
    assert sum(r.n_links for r in out) >= 0.9 * links.sum() > 0
    most = {}
    for r, n in zip(rows, links):
        most.setdefault(r[0], []).append(int(n))
    for r in out:
        assert r.n_links <= max(most[r.vec_id]) and r.kept == (r.component_id is None or r.vec_id == r.component_id)
    wanted = roots({r[0] for r in rows if r[0] is not None}, pairs)
    same = [wanted[r.vec_id] == r.component_id for r in out if r.vec_id is not None]
    assert np.mean(same) > 0.9
    assert pivots.near_duplicates(table.limit(0)).collect() == []


@pytest.mark.parametrize("percent", [90, 80, 70])
def test_similar_sets_share_all_that_is_sure(percent):
    rng = np.random.default_rng(percent + 1)
    fresh = lambda n: np.unique(rng.integers(0, 1 << 64, n, np.uint64))
    more_than_one = 0
    for size in [4, 9, 25, 60, 100, 101, 300, 700]:
        for _ in range(40):
            a = fresh(size)
            common = int(rng.integers(-(-percent * size // 100), size + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[:common], fresh(max(0, 100 * common // percent - size))]))
            assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) > 0
            (x, kinds, sure), (y, *_) = jaccard.signed(a, percent), jaccard.signed(b, percent)
            shared = np.bincount((np.intersect1d(x, y) & np.uint64(255)).astype(int), minlength=256)
            # in some kind each shares what it surely does with a similar set
            assert any(shared[k] >= n for k, n in zip(kinds, sure)), (size, common)
            more_than_one += max(sure) > 1
    assert more_than_one > 100
