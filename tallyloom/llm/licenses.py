"""Licence scan with a positional index of licence words.

Templates are the words of licence notices. The index maps each word to its postings (template, position). A word's weight
is its inverse document frequency, counted over all documents. In a file, the words that occur in the index are found; for
each template, its rarest words (highest weight) give candidate starts: place in the file less place in the template.
Starts on which enough of these words agree, a few places apart allowed, are candidates; each is scored by the weighted
share of the template's words found at their place, and confirmed only if a mandatory key phrase of the template stands
within it word for word. Short phrases are templates of their own whose every word is mandatory: all their places are found
from their rarest word.

Results: a null text has no words. Each row is scanned by itself, repeated rows alike. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.arrow import documents, parts, record

#: Phrases whose places are counted, and their labels. Fixed values of the contract.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Licence notices: label, notice, key phrases of which one must stand in it word for word.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
     "license you may obtain a copy of the license at", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify and or distribute this software"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation", ["terms of the gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
     "license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the "
     "free software foundation", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
     ["eclipse public license 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution 4 0 international"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
     ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     ["creative commons attribution noncommercial"]),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", ["dedicated the work to the public domain"]),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited",
     ["unauthorized copying of this file"]),
]

#: Rarest words of a template that vote for its starts, those that must agree, and how many places apart they may be.
RARE_WORDS, AGREEING, SLACK = 6, 3, 3
#: Weighted share of a template's words that a confirmed start must have.
LEAST_SCORE = 0.6

_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """ASCII letters in lower case, digits and all code points beyond ASCII; everything else parts words."""
    return text.translate(_KEPT).split()


@dataclass
class Template:
    label: str
    words: np.ndarray  # codes
    keys: list[np.ndarray]
    exact: bool  # a phrase: all words are mandatory


@dataclass
class Index:
    codes: dict[bytes, int]
    weights: np.ndarray  # of each code, by document frequency
    templates: list[Template]
    postings: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # rare word's code: templates and positions

    def post(self) -> Index:
        """Fill the postings with every template's rarest words."""
        self.postings = {}
        for t, template in enumerate(self.templates):
            order = sorted(range(len(template.words)), key=lambda p: (-self.weights[template.words[p]], p))
            for p in order[: 1 if template.exact else RARE_WORDS]:
                self.postings.setdefault(int(template.words[p]), []).append((t, p))
        return self


def template_index(phrases: dict[str, str] = BASE_PHRASES, notices=NOTICES) -> Index:
    """The index before any document was counted: all words weigh the same."""
    codes: dict[bytes, int] = {}
    coded = lambda text: np.array([codes.setdefault(w, len(codes) + 1) for w in words(text.encode())], np.int64)
    templates = [Template(label, coded(p), [], True) for p, label in phrases.items()]
    templates += [Template(label, coded(text), [coded(k) for k in keys], False) for label, text, keys in notices]
    return Index(codes, np.ones(len(codes) + 1), templates)


def coded_words(column: pa.Array, codes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words (0: none of the index's) of the rows, and the rows' offsets."""
    split = [words(t) for t in documents(column)]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    get = codes.get
    return np.fromiter((get(w, 0) for row in split for w in row), np.int64, int(offsets[-1])), offsets


def weigh(docs: DataFrame, index: Index, text_col: str = "text") -> Index:
    """The index with weights from the document frequencies of its words over all documents."""
    n = len(index.codes) + 1

    def counted(batches):
        total, rows = np.zeros(n, np.int64), 0
        for batch in parts(batches, "text"):
            found, offsets = coded_words(batch.column("text"), index.codes)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            total += np.bincount(np.unique(row * n + found) % n, minlength=n)
            rows += batch.num_rows
        total[0] = rows
        yield record({"code": pa.array(np.arange(n)), "n": pa.array(total)})

    base = docs.select(F.col(text_col).alias("text"))
    sums = base.mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(n)
    for r in sums:
        frequency[r.code] = r.n
    return Index(index.codes, np.log((frequency[0] + 1) / (frequency + 1)) + 1, index.templates).post()


def _stands(found: np.ndarray, at: np.ndarray, phrase: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` have the phrase word for word before the end of their row."""
    good = (at >= 0) & (at + len(phrase) <= ends)
    for k, code in enumerate(phrase):
        good[good] = found[at[good] + k] == code
    return good


def scan(column: pa.Array, index: Index) -> dict[str, list | np.ndarray]:
    """Per row: n_words, places of phrases (n_base, first_word, last_word), labels of phrases and of notices, best score."""
    found, offsets = coded_words(column, index.codes)
    rows = len(column)
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    n_base, first, last = np.zeros(rows, np.int64), np.full(rows, -1), np.full(rows, -1)
    base = [set() for _ in range(rows)]
    more = [set() for _ in range(rows)]
    score = np.zeros(rows)
    votes: dict[int, list[np.ndarray]] = {}
    places = {c: np.flatnonzero(found == c) for c in index.postings}
    for code, posted in index.postings.items():
        at = places[code]
        for t, p in posted:
            template = index.templates[t]
            if not template.exact:
                votes.setdefault(t, []).append(np.stack([at - p, row_of[at]]) if len(at) else np.empty((2, 0), np.int64))
                continue
            starts, row = at - p, row_of[at]
            good = (starts >= offsets[row]) & _stands(found, starts, template.words, offsets[row + 1])
            for s, r in zip(starts[good].tolist(), row[good].tolist()):
                place = s - int(offsets[r])
                n_base[r] += 1
                first[r] = place if first[r] < 0 else min(first[r], place)
                last[r] = max(last[r], place)
                base[r].add(template.label)
                score[r] = 1.0
    for t, cast in votes.items():
        template, all_votes = index.templates[t], np.concatenate(cast, axis=1)
        order = np.lexsort((all_votes[0], all_votes[1]))
        start, row = all_votes[0][order], all_votes[1][order]
        need = min(AGREEING, len(cast))
        if len(start) < need:
            continue
        near = (row[need - 1 :] == row[: len(row) - need + 1]) & (start[need - 1 :] - start[: len(start) - need + 1] <= SLACK)
        weights = index.weights[template.words]
        for s, r in {(int(start[i]), int(row[i])) for i in np.flatnonzero(near)}:
            low, high = int(offsets[r]), int(offsets[r + 1])
            region = found[max(low, s - SLACK) : min(high, s + len(template.words) + 2 * SLACK)]
            keyed = any((np.lib.stride_tricks.sliding_window_view(region, len(k)) == k).all(axis=1).any() for k in template.keys if len(region) >= len(k))
            if not keyed:
                continue
            hit = np.zeros(len(template.words), bool)
            for shift in range(2 * SLACK + 1):
                at = s + shift - 0 + np.arange(len(template.words))
                inside = (at >= low) & (at < high)
                hit[inside] |= found[at[inside]] == template.words[inside]
            share = float(weights[hit].sum() / weights.sum())
            if share >= LEAST_SCORE:
                more[r].add(template.label)
                score[r] = max(score[r], share)
    return {"n_words": np.diff(offsets), "n_base": n_base, "first_word": first, "last_word": last, "base": base, "more": more, "score": score}


def find_licenses(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and places of the base phrases, base labels, all labels (comma-joined), score."""
    kinds = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
             ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())]
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in kinds)])

    def found(batches):
        for batch in parts(batches, "text"):
            x = scan(batch.column("text"), index)
            none = x["n_base"] == 0
            yield record({
                "id": batch.column("id"), "n_words": pa.array(x["n_words"], pa.int64()), "n_base": pa.array(x["n_base"], pa.int64()),
                "first_word": pa.array(x["first_word"], pa.int64(), mask=none), "last_word": pa.array(x["last_word"], pa.int64(), mask=none),
                "base_labels": pa.array([",".join(sorted(b)) for b in x["base"]], pa.string()),
                "labels": pa.array([",".join(sorted(b | m)) for b, m in zip(x["base"], x["more"])], pa.string()),
                "score": pa.array(x["score"], pa.float64()),
            })

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(found, out).withColumnRenamed("id", id_col)
