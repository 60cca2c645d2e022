"""Quality rules: base counts and the divergence of a document's histograms from language references.

References are counted over all documents with a language: the shares of character classes, and the shares of each
language's most common short words, the rest in one bin. A document is compared with every reference by the Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1) of both histograms; the nearest reference by their sum decides.
It is rejected if a distance is beyond its limit. A histogram of few words says little, so a document with fewer words than
a guard isn't judged by that histogram.

Results: a null text has no words and fails the base rules. Without any language there is no reference and only the base
rules decide. Each row is judged by itself, repeated rows alike. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.arrow import documents, parts, record, utf8
from tallyloom.llm.codepoints import categories, code_points

#: Words fewer than this fail the base rules; so do texts of which more than this percentage lies in repeated windows.
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = 20, 30, 8
#: Common words of a reference, and the most code points one may have.
COMMON_WORDS, COMMON_LENGTH = 150, 6
#: Distances beyond these reject; histograms of fewer words than these aren't judged.
CLASS_LIMIT, CLASS_GUARD = 0.27, 40
WORD_LIMIT, WORD_GUARD = 0.53, 100
#: Counted words kept per task before they are passed on.
_HELD_WORDS = 200_000

#: Character classes: ASCII white space, symbols of the base rules, then general categories with letters by case.
_SPACE, _SIGN, _UPPER, _LOWER, _OTHER_LETTER, _NUMBER, _PUNCTUATION, _SYMBOL, _REST = range(9)
CLASSES = 9
_SIGNS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"


def _class_table() -> np.ndarray:
    if not hasattr(_class_table, "kept"):
        table = np.full(0x110000, _REST, np.uint8)
        for letter, kind in (("L", _OTHER_LETTER), ("N", _NUMBER), ("P", _PUNCTUATION), ("S", _SYMBOL)):
            table[categories() == ord(letter)] = kind
        for i in np.flatnonzero(categories() == ord("L")).tolist():
            c = chr(i)
            if c.isupper():
                table[i] = _UPPER
            elif c.islower():
                table[i] = _LOWER
        table[[ord(c) for c in _SIGNS]] = _SIGN
        table[[ord(c) for c in _SPACES]] = _SPACE
        _class_table.kept = table
    return _class_table.kept


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each class, a line per row."""
    points, at = code_points(data, offsets)
    rows = len(offsets) - 1
    keys = np.repeat(np.arange(rows) * CLASSES, np.diff(at)) + _class_table()[points]
    return np.bincount(keys, minlength=rows * CLASSES).reshape(rows, CLASSES)


def repeated_words(codes: np.ndarray, offsets: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Words per row that lie in a window of ``width`` words found at least twice in the row."""
    n, rows = len(codes), len(offsets) - 1
    if n < width:
        return np.zeros(rows, np.int64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    value = _mix(codes.astype(np.uint64))
    hashes = _mix(row[: n - width + 1].astype(np.uint64) + np.uint64(1 << 40))
    for k in range(width):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + value[k : n - width + 1 + k]
    inside = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
    order = inside[np.argsort(hashes[inside], kind="stable")]
    same = hashes[order[1:]] == hashes[order[:-1]]
    starts = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    change = np.zeros(n + 1, np.int32)
    change[starts] += 1
    change[starts + width] -= 1  # starts are distinct, so no place is written twice by one statement
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return np.diff(covered[offsets])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads neighbours."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


@dataclass
class References:
    languages: list[str]
    classes: np.ndarray  # shares, a line per language
    words: dict[bytes, int]  # spelling to bin; bin 0 is for all other words
    shares: np.ndarray  # shares of the bins, a line per language


def _short(word: bytes) -> str | None:
    """A word as the references count it; None if it is too long to be one of them."""
    text = word.decode("utf-8", "replace").lower().rstrip(".,")
    return text if 0 < len(text) <= COMMON_LENGTH else None


def _spellings(word: str) -> list[bytes]:
    return [(w + end).encode() for w in {word, word.capitalize()} for end in ("", ".", ",")]


def count_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts (lang, kind, bin, n) over all documents with a language: kind 0 classes, 1 words, 2 number of words."""
    base = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")

    def counted(batches):
        held: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        totals: Counter = Counter()

        def passed_on():
            rows = [(lang, 1, w, n) for lang, words in held.items() for w, n in words.items()]
            for lang, words in held.items():
                words.clear()
            return _rows(rows)

        def _rows(rows):
            lang, kind, name, n = zip(*rows)
            return record({"lang": pa.array(lang), "kind": pa.array(kind, pa.int32()), "bin": pa.array(name), "n": pa.array(n, pa.int64())})

        for batch in parts(batches, "text"):
            langs = batch.column("lang").to_pylist()
            counts = class_counts(*utf8(batch.column("text")))
            raw: dict[str, Counter] = {}
            for k, text in enumerate(documents(batch.column("text"))):
                lang, words = langs[k], text.split()
                classes[lang] = classes.get(lang, 0) + counts[k]
                totals[lang] += len(words)
                raw.setdefault(lang, Counter()).update([w for w in words if len(w) <= 4 * COMMON_LENGTH + 2])
            for lang, words in raw.items():
                into = held.setdefault(lang, Counter())
                for word, n in words.items():
                    if (short := _short(word)) is not None:
                        into[short] += n
            if sum(map(len, held.values())) > _HELD_WORDS:
                yield passed_on()
        if totals:
            yield _rows([(lang, 0, str(c), int(n)) for lang, x in classes.items() for c, n in enumerate(x)] + [(lang, 2, "", n) for lang, n in totals.items()])
            if any(held.values()):
                yield passed_on()

    return base.mapInArrow(counted, "lang string, kind int, bin string, n long").groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """References of all languages. What reaches the driver is COMMON_WORDS + 10 counts per language."""
    counts = count_references(docs, text_col, lang_col)
    ranked = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "bin")
    rows = counts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= COMMON_WORDS).drop("rank").collect()
    languages = sorted({r.lang for r in rows})
    common = {w: k for k, w in enumerate(sorted({r.bin for r in rows if r.kind == 1}), start=1)}
    classes, shares = np.zeros((len(languages), CLASSES)), np.zeros((len(languages), len(common) + 1))
    for r in rows:
        at = languages.index(r.lang)
        if r.kind == 0:
            classes[at, int(r.bin)] = r.n
        else:
            shares[at, 0 if r.kind == 2 else common[r.bin]] += r.n
    shares[:, 0] -= shares[:, 1:].sum(axis=1)
    total = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1)
    return References(languages, total(classes), {s: k for w, k in common.items() for s in _spellings(w)}, total(shares))


def distances(found: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of histograms (rows x bins, counts) to references (languages x bins, shares)."""
    p = found[:, None, :] / np.maximum(found.sum(axis=1), 1)[:, None, None]
    q = np.broadcast_to(reference[None], (len(found), *reference.shape))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(axis=2)
        return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


COLUMNS = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()), T.StructField("nearest", T.StringType()),
    T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("kept", T.BooleanType()),
])


def judge(column: pa.Array, refs: References) -> dict[str, pa.Array]:
    """The columns of ``COLUMNS`` for a text column."""
    data, offsets = utf8(column)
    classes, texts = class_counts(data, offsets), documents(column)
    split = [t.split() for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    at = np.concatenate([[0], np.cumsum(n_words)])
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for words in split for w in words), np.int64, int(at[-1]))
    repeated = repeated_words(codes, at)
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    bins = len(refs.words) and refs.shares.shape[1]
    rows = len(texts)
    class_distance, word_distance, nearest = np.full(rows, np.nan), np.full(rows, np.nan), np.full(rows, -1)
    judged = np.flatnonzero(n_words >= CLASS_GUARD) if refs.languages else np.empty(0, np.int64)
    if len(judged):
        by_class = distances(classes[judged], refs.classes)
        both, by_word = by_class, None
        if bins:
            of_word = np.fromiter(map(refs.words.get, seen, [0] * len(seen)), np.int64, len(seen))
            keys = np.repeat(np.arange(rows) * bins, n_words) + of_word[codes]
            by_word = distances(np.bincount(keys, minlength=rows * bins).reshape(rows, bins)[judged], refs.shares)
            both = by_class + by_word
        best = both.argmin(axis=1)
        nearest[judged] = best
        class_distance[judged] = by_class[np.arange(len(judged)), best]
        if by_word is not None:
            long = n_words[judged] >= WORD_GUARD
            word_distance[judged[long]] = by_word[np.arange(len(judged)), best][long]
    passes = ~(class_distance > CLASS_LIMIT) & ~(word_distance > WORD_LIMIT)
    number = lambda x: pa.array(x, pa.float64(), from_pandas=True)  # noqa: E731  a distance that isn't judged is null
    return {
        "n_words": pa.array(n_words), "word_chars": pa.array(classes.sum(axis=1) - classes[:, _SPACE], pa.int64()),
        "n_symbols": pa.array(classes[:, _SIGN], pa.int64()), "n_dup_lines": pa.array([repeated_lines(t) for t in texts], pa.int64()),
        "n_repeat_words": pa.array(repeated, pa.int64()), "base_failed": pa.array(failed),
        "nearest": pa.array([refs.languages[k] if k >= 0 else None for k in nearest], pa.string()),
        "class_distance": number(class_distance), "word_distance": number(word_distance), "kept": pa.array(~failed & passes),
    }


def score(docs: DataFrame, refs: References, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id and ``COLUMNS``) per document."""
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *COLUMNS])

    def scored(batches):
        for batch in parts(batches, "text"):
            yield record({"id": batch.column("id")} | judge(batch.column("text"), refs))

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(scored, out).withColumnRenamed("id", id_col)


def keep(docs: DataFrame, refs: References, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    def passing(batches):
        for batch in parts(batches, text_col):
            yield batch.filter(judge(batch.column(text_col), refs)["kept"])

    return docs.mapInArrow(passing, docs.schema)
