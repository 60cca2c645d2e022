"""Quality rules, language, licences and mixing against brute force and held-out documents."""

import re
from collections import defaultdict

import corpus
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import langid, licenses, mixing, quality

FOLDER = "/root/testdata/sf0.01"


def base_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    repeated = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


def test_base_rules_equal_brute_force(docs, empty):
    refs = quality.references(docs)
    out = quality.score(docs, refs).collect()
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=repr)
    assert found == sorted(((r[0], *base_counts(r[1])) for r in corpus.rows()), key=repr)
    assert not any(r.kept and r.base_failed for r in out)
    kept = quality.keep(docs, refs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    assert quality.score(empty, quality.references(empty)).collect() == []
    alone = quality.score(docs, quality.references(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert all(r.kept == (not r.base_failed) and r.nearest is None for r in alone.collect())


def test_distances():
    p, q = np.array([[8, 0], [4, 4]]), np.array([[0.0, 1.0], [0.5, 0.5]])
    found = quality.distances(p, q)
    assert found[0, 0] == pytest.approx(1) and found[1, 1] == pytest.approx(0)
    m = np.array([0.75, 0.25])
    wanted = (1 * np.log2(1 / 0.75) + (0.5 * np.log2(0.5 / m)).sum()) / 2
    assert found[0, 1] == pytest.approx(wanted**0.5)


def test_references_count_everything(docs):
    counted = {(r.lang, r.kind, r.bin): r.n for r in quality.count_references(docs).collect()}
    words = defaultdict(int)
    for r in corpus.rows():
        if r[2] is not None:
            words[r[2]] += base_counts(r[1])[0]
    assert {lang: counted[(lang, 2, "")] for lang in words} == dict(words)


def test_clean_documents_stay(spark):
    table = lambda n: spark.read.parquet(f"{FOLDER}/{n}.parquet")
    scored = quality.score(table("documents"), quality.references(table("documents"))).join(table("labels"), "doc_id").filter("not base_failed")
    kept = {r.quality: r.kept for r in scored.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert kept[1] > 0.99 and kept[0] < 0.3


def test_languages_of_held_out_documents(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = langid.identify(table, langid.train(table)).join(table.select("doc_id", "lang"), "doc_id").filter(langid.held_out())
    rows = out.collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(docs, empty):
    filters = langid.train(docs)
    out = langid.identify(docs, filters).collect()
    assert len(out) == len(corpus.rows())
    languages, scores = langid.predict(pa.array([None, "", "12 !!", "é", "the and"], pa.string()), filters)
    assert languages[:3] == ["und"] * 3 and languages[4] == "en" and scores[0] == 0
    none = langid.train(empty)
    assert langid.identify(empty, none).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_trigrams_equal_brute_force():
    texts = ["Ab c", "ÉÉ-x", "", "a b\x00cde"]
    hashes, row = langid.trigrams(pa.array(texts))
    for k, text in enumerate(texts):
        letters = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
        grams = [letters[i - 1 : i + 2] for i in range(1, len(letters) - 1) if letters[i] != " "]
        assert len(grams) == (row == k).sum() and len(set(grams)) == len(set(hashes[row == k].tolist()))


def test_filters_have_no_false_negatives(docs):
    counts = langid.count_trigrams(docs.select("text", "lang").filter("lang is not null"))
    filters = langid.train(docs)
    assert set(filters.languages) == {"en", "fr"} and (filters.false_positives < 0.2).all()
    assert counts.groupBy("lang", "gram").count().filter("count > 1").count() == 0


def find_phrases(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_phrases_equal_brute_force(docs, empty):
    index = licenses.weigh(docs, licenses.template_index())
    out = licenses.find_licenses(docs, index).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=repr)
    assert found == sorted(((r[0], *find_phrases(r[1])) for r in corpus.rows()), key=repr)
    assert any(r.n_base > 1 for r in out)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out if r.labels or r.base_labels)
    assert licenses.find_licenses(empty, licenses.weigh(empty, licenses.template_index())).collect() == []


def test_notices():
    index = licenses.template_index().post()
    notice = "words before. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
    changed = "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the conditions are met"
    keyless = "redistribution use in source binary forms with or without modification permitted provided following conditions met"
    found = licenses.scan(pa.array([notice, changed, keyless, "software license file"]), index)
    assert [sorted(x) for x in found["more"]] == [["mit"], ["bsd"], [], []]
    assert found["score"][0] > 0.6 and found["score"][3] == 0


def test_targets():
    assert mixing.targets([100, 100, 100, 100]) == [400 * w / 13 for w in (5, 2, 1, 5)]
    assert mixing.targets([10, 1000]) == [30, 980]
    assert mixing.targets([0, 50]) == [0, 50]


def test_mix_comes_near_its_targets(docs, empty):
    plan = mixing.plan(docs).collect()
    rows = corpus.rows()
    size = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r[1] or ""))
    assert sorted(((r.doc_id, r.size) for r in plan), key=repr) == sorted(((r[0], size(r)) for r in rows), key=repr)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[n] for n in names])))
    by_source = defaultdict(int)
    for r in plan:
        assert 0 <= r.copies <= 3 and 0 <= r.rate <= 3
        by_source[(r.source_size, r.target)] += r.copies * r.size
    assert set(by_source) == {(sizes[n], goal[n]) for n in names}
    longest = max(size(r) for r in rows)
    for (whole, target), taken in by_source.items():
        assert abs(taken - target) <= max(0.05 * target, 60) or whole - longest < target < whole + longest
    again = sorted(((r.doc_id, r.key, r.copies) for r in mixing.plan(docs.repartition(3)).collect()), key=repr)
    assert again == sorted(((r.doc_id, r.key, r.copies) for r in plan), key=repr)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.plan(empty).collect() == [] and mixing.mix(empty).collect() == []


def test_multipliers_solve_the_dual(spark):
    sources = [mixing.Source(0, "a", 300, 30, 130.0), mixing.Source(1, "b", 300, 30, 700.0), mixing.Source(2, "c", 300, 30, 900.0)]
    histogram = spark.createDataFrame([(n, s, k) for n in range(3) for s, k in ((5, 20), (20, 10))], "number int, size long, n long")
    for source in sources:
        k = mixing._multipliers(histogram, sources)[source.number]
        words = sum(n * s * min(3.0, np.exp(min(k * s, 700))) for s, n in ((5, 20), (20, 10)))
        assert words == pytest.approx(source.target, rel=1e-5)
