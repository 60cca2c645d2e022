"""Language identification by bit-sliced Bloom filters of letter n-grams.

Training counts the letter trigrams of a bounded share of each language's labelled documents. A language's filter takes
those it uses often enough, in itself and beside the language that uses them most. All filters share their hash positions,
and a slot holds one bit per language, so the AND of an n-gram's slots is the set of all languages whose filter has it. A
document's score for a language is the share of its n-grams found in that language's filter, corrected for the filter's
false positives: (found - n * fp) / (n * (1 - fp)), fp being the filled share of the language's bits to the power of the
number of positions. The language of the best score is predicted, the first by code point among equals.

Results: ``und`` with score 0 where the text is null or has no letter, or nothing could be learned. Repeated rows are
predicted alike. An empty table gives an empty table. Prediction reads the text only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.arrow import parts, record, utf8
from tallyloom.llm.codepoints import code_points, lower_letters

#: Labelled documents per language that training reads, as the expectation of a draw by a hash of the id.
TRAINING_DOCUMENTS = 3000
#: An n-gram enters a filter from this share of the language's n-grams, and from this part of its largest share anywhere.
LEAST_SHARE, LEAST_OF_LARGEST = 2e-6, 0.2
#: Slots per n-gram in the filters (a power of two is taken) and positions per n-gram.
SLOTS_PER_GRAM, POSITIONS = 16, 3
UNKNOWN = "und"


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # slots x words of languages' bits
    false_positives: np.ndarray  # per language


def held_out(id_col: str = "doc_id") -> Column:
    """Documents kept from training: crc32 of the id as text is a multiple of 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter trigrams of each row (words in lower case between spaces), and the row of each."""
    data, offsets = utf8(column)
    points, at = code_points(data, offsets)
    rows = len(column)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # every row stands between spaces of its own; a trigram with a space in the middle is none
    row = np.repeat(np.arange(rows), np.diff(at))
    letters = np.full(len(points) + 2 * rows, 32, np.uint32)
    letters[np.arange(len(points)) + 2 * row + 1] = lower_letters()[points]
    owner = np.repeat(np.arange(rows), np.diff(at) + 2)
    middle = np.flatnonzero(letters[1:-1] != 32) + 1
    wide = letters.astype(np.uint64)
    codes = wide[middle - 1] << np.uint64(42) | wide[middle] << np.uint64(21) | wide[middle + 1]
    codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return codes ^ (codes >> np.uint64(32)), owner[middle]


def positions(hashes: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of each hash: an arithmetic progression by two halves of the hash."""
    first, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return [((first + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(POSITIONS)]


def count_trigrams(docs: DataFrame) -> DataFrame:
    """Counts (lang, gram, n) of a table (text, lang)."""
    def counted(batches):
        for batch in parts(batches, "text"):
            langs = np.array(batch.column("lang").to_pylist(), object)
            hashes, row = trigrams(batch.column("text"))
            for lang in sorted(set(langs)):
                grams, n = np.unique(hashes[langs[row] == lang], return_counts=True)
                yield record({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams.view(np.int64)), "n": pa.array(n)})

    return docs.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = TRAINING_DOCUMENTS) -> Filters:
    """Filters from the labelled documents that aren't held out.

    The driver gets the n-grams that enter the filters: distinct letter trigrams of at most ``documents`` texts a language.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = base.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0))
    rate = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, documents / n))))
    drawn = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30)).select("text", "lang")
    counts = count_trigrams(drawn)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    largest = shares.groupBy("gram").agg(F.max("share").alias("largest"))
    kept = shares.join(largest, "gram").filter((F.col("share") >= LEAST_SHARE) & (F.col("share") >= F.col("largest") * LEAST_OF_LARGEST))
    found = kept.select("lang", "gram").toArrow()
    languages = sorted(sizes)
    owner = np.searchsorted(np.array(languages, object), np.array(found.column("lang").to_pylist(), object)).astype(np.int64)
    grams = found.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    most = int(np.bincount(owner, minlength=1).max()) if len(owner) else 1
    slots = 1 << max(10, int(SLOTS_PER_GRAM * most - 1).bit_length())
    table = np.zeros((slots, -(-len(languages) // 64)), np.uint64)
    for at in positions(grams, slots):
        np.bitwise_or.at(table, (at, owner // 64), np.uint64(1) << (owner % 64).astype(np.uint64))
    fill = np.array([((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    if len(languages) <= 8:
        table = table.astype(np.uint8)
    return Filters(languages, table, fill**POSITIONS)


def predict(column: pa.Array, filters: Filters) -> tuple[list[str], np.ndarray]:
    """Language and score of each row."""
    rows, languages = len(column), filters.languages
    hashes, row = trigrams(column)
    n = np.bincount(row, minlength=rows)
    if not languages:
        return [UNKNOWN] * rows, np.zeros(rows)
    first, *rest = positions(hashes, len(filters.slots))
    masks = filters.slots[first]
    for at in rest:
        masks &= filters.slots[at]
    kind, scores = masks.dtype.type, np.zeros((rows, len(languages)))
    for k, fp in enumerate(filters.false_positives):
        has = (masks[:, k // 64] >> kind(k % 64)) & kind(1)
        found = np.bincount(row[has != 0], minlength=rows)
        scores[:, k] = np.clip((found - n * fp) / np.maximum(n * (1 - fp), 1e-9), 0, 1)
    best = scores.argmax(axis=1)
    return [languages[k] if m else UNKNOWN for k, m in zip(best.tolist(), n.tolist())], np.where(n > 0, scores[np.arange(rows), best], 0)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, lang_pred, score) per document."""
    out = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    ])

    def identified(batches):
        for batch in parts(batches, "text"):
            lang, score = predict(batch.column("text"), filters)
            yield record({"id": batch.column("id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)})

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(identified, out).withColumnRenamed("id", id_col)
