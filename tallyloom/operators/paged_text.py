"""Comparison of paged text: tables of (document, page_no, line_no, line).

All steps are keyed by document and by line content. A document may be arbitrarily long: beyond a fixed size (CELL) it is never
put together in one cell or one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import join_back, written
from tallyloom.functions.text import normal_line
from tallyloom.operators import text_index
from tallyloom.operators.ordered import longest_run, running

# fixed values: furniture share and minimum, lines of a page that can carry furniture, lines of a sparse page,
# lines of an orphan page, page overlap
FURNITURE_SHARE, FURNITURE_MIN, POPULATED_LINES = 0.6, 2, 3
SPARSE_LINES, ORPHAN_LINES, MIN_OVERLAP = 3, 8, 0.4

# fixed values: what money and totals look like
_AMOUNT = r"[$£€]?\s?\d[\d,]*(?:\.\d{1,2})?"
STATED_TOTAL = r"(?i)total(?:l)?ing\D{0,4}(" + _AMOUNT + ")"
TOTAL_AMOUNT = r"(?i)\btotals?\b\D{0,4}(" + _AMOUNT + ")"
ANY_MONEY = r"([$£€]\s?\d[\d,]*(?:\.\d{1,2})?|\d[\d,]*\.\d{2}\b)"
TOTAL_MARKER = r"(?i)\btotals?\b"


def cut_pages(df: DataFrame, doc: str, text: str, lines_per_page: int) -> DataFrame:
    """Text documents as lines with page numbers from 0."""
    rows = df.select(F.col(doc), F.posexplode(F.split(F.col(text), "\n")).alias("__pos", "line"))
    return rows.select(
        doc, F.floor(F.col("__pos") / lines_per_page).cast("int").alias("page_no"),
        F.pmod(F.col("__pos"), F.lit(lines_per_page)).cast("int").alias("line_no"), "line",
    )


def normal_lines(lines: DataFrame) -> DataFrame:
    """Lines with their comparison form ``norm``, noise lines left out.

    The form is the expensive part. A filter over it would be pushed below and work it out again; unnesting it is not.
    """
    return lines.withColumn("norm", F.explode(F.filter(F.array(normal_line(F.col("line"))), lambda n: n != "")))


def _digest(norm: str) -> Column:
    """128 bits that stand for a line where its text is not needed."""
    return F.unhex(F.md5(F.col(norm)))


def _furniture(norm: DataFrame, doc: str) -> DataFrame:
    """Page furniture (doc, digest) from lines as digests: (doc, page_no, digest)."""
    distinct = norm.select(doc, "page_no", "digest").distinct()
    full = distinct.groupBy(doc, "page_no").agg(F.count(F.lit(1)).alias("__k")).filter(F.col("__k") >= POPULATED_LINES)
    populated = full.groupBy(doc).agg(F.count(F.lit(1)).alias("__pages"))
    on = distinct.join(full.select(doc, "page_no"), [doc, "page_no"], "left_semi")
    seen = on.groupBy(doc, "digest").agg(F.count(F.lit(1)).alias("__n")).join(populated, doc)
    least = F.greatest(F.lit(FURNITURE_MIN), F.floor(F.col("__pages") * FURNITURE_SHARE))
    return seen.filter(F.col("__n") >= least).select(doc, "digest")


def boilerplate(lines: DataFrame, doc: str) -> DataFrame:
    """Page furniture (doc, norm): lines on most of the pages that have at least three different lines."""
    # normalising is the expensive part and its result is read several times
    norm = written(normal_lines(lines).select(doc, "page_no", _digest("norm").alias("digest"), "norm"))
    named = norm.select(doc, "digest", "norm").join(_furniture(norm, doc), [doc, "digest"])
    return named.groupBy(doc, "digest").agg(F.any_value("norm").alias("norm")).select(doc, "norm")


def content_lines(lines: DataFrame, doc: str, *facts: Column | str) -> DataFrame:
    """Normalised lines that are not furniture, as digests: (doc, page_no, digest) and the facts asked for. Texts stay where they are read."""
    norm = written(normal_lines(lines).select(doc, "page_no", _digest("norm").alias("digest"), *facts))
    return norm.join(_furniture(norm, doc), [doc, "digest"], "left_anti")


def sparse_pages(lines: DataFrame, doc: str) -> DataFrame:
    """Pages (doc, page_no, content) with at most three content lines, repeats counted."""
    pages = lines.select(doc, "page_no").distinct()
    content = content_lines(lines, doc).groupBy(doc, "page_no").agg(F.count(F.lit(1)).alias("content"))
    both = pages.join(content, [doc, "page_no"], "left").withColumn("content", F.coalesce("content", F.lit(0)))
    return both.filter(F.col("content") <= SPARSE_LINES)


# ---------------------------------------------------------------- line parity

# bytes of a document's lines, original and converted, up to which its stream is put together in one cell
CELL = 262_144
# bytes of a piece of a longer document's stream, and of the pieces of a line that are compared with it
CHUNK, PIECE = 16_384, 4_096
# chunks that share a copy of their document's filter, and places that a task collects before it gives them out
CHUNK_GROUP, SPOTS = 64, 200_000
# bytes of the shortest line that has a fingerprint; shorter ones are looked for by all grams of SHORT bytes
WHOLE, SHORT = text_index.GRAM + text_index.WINDOW - 1, 4


def _page_texts(lines: DataFrame, doc: str, line: Column) -> DataFrame:
    """One row per page with its lines, in line order, as the array ``a``."""
    return lines.groupBy(doc, "page_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("w")))), lambda s: s["w"]).alias("a")
    )


def _squeeze(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def _squeezed_pages(lines: DataFrame, doc: str) -> DataFrame:
    """Normalised page texts without blanks: (doc, page_no, text)."""
    page = _page_texts(lines, doc, F.col("line"))
    return page.select(doc, "page_no", _squeeze(normal_line(F.array_join("a", " "))).alias("text"))


def _stream(lines: DataFrame, doc: str) -> DataFrame:
    """Normalised page texts without blanks, placed in the byte stream of their document: (doc, start, text)."""
    text = _squeezed_pages(lines, doc).select(doc, "page_no", F.encode("text", "UTF-8").alias("text"))
    text = written(text.filter(F.octet_length("text") > 0))
    # positions are worked out without carrying the texts along
    placed = running(text.select(doc, "page_no", F.octet_length("text").cast("long").alias("__len")), "sum", "__len", "__end", "page_no", doc)
    return text.join(placed.select(doc, "page_no", (F.col("__end") - F.col("__len")).alias("start")), [doc, "page_no"]).select(doc, "start", "text")


def _chunks(stream: DataFrame, doc: str) -> DataFrame:
    """The streams in chunks of CHUNK bytes, each with the PIECE bytes behind it: (doc, chunk, text)."""
    end = F.col("start") + F.octet_length("text")
    first, last = F.greatest(F.lit(0), F.floor((F.col("start") - PIECE) / CHUNK)), F.floor((end - 1) / CHUNK)
    pieces = stream.select(doc, "start", "text", F.explode(F.sequence(first, last)).alias("chunk"))
    low = F.greatest(F.col("start"), F.col("chunk") * CHUNK)
    high = F.least(end, (F.col("chunk") + 1) * CHUNK + PIECE)
    cut = F.substring("text", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    pieces = pieces.filter(low < high).select(doc, "chunk", F.struct(low.alias("low"), cut.alias("cut")).alias("p"))
    joined = F.aggregate(F.array_sort(F.collect_list("p")), F.lit(b""), lambda x, p: F.concat(x, p["cut"]))
    return pieces.groupBy(doc, "chunk").agg(joined.alias("text"))


def _seeds(wanted: DataFrame, doc: str) -> DataFrame:
    """(doc, line, code, off): fingerprints of the first, middle and last bytes of each wanted line, or grams if it is short."""
    def seeds(batches):
        for batch in batches:
            data, offsets = text_index.text_bytes(batch.column("text"))
            low, size = offsets[:-1], np.diff(offsets)
            rows, codes, off = [], [], []
            for wide, least in ((True, WHOLE), (False, SHORT)):
                row = np.flatnonzero((size >= WHOLE) if wide else (size >= SHORT) & (size < WHOLE))
                if not len(row):
                    continue
                for begin in (np.zeros(len(row), np.int64), (size[row] - least) // 2, size[row] - least):
                    if wide:
                        at, code = text_index.window_fingerprints(data, low[row] + begin)
                    else:
                        at, code = 0, text_index.gram_codes(data, SHORT)[low[row] + begin]
                    rows.append(row), codes.append(code), off.append(begin + at)
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(doc).take(take), batch.column("line").take(take), pa.array(np.concatenate(codes).view(np.int64)),
                     pa.array(np.concatenate(off), pa.int32())], names=[doc, "line", "code", "off"])

    kind = wanted.schema[doc].dataType.simpleString()
    return wanted.select(doc, "line", F.encode("text", "UTF-8").alias("text")).mapInArrow(seeds, f"`{doc}` {kind}, line long, code long, off int").distinct()


def _spots(chunks: DataFrame, seeds: DataFrame, doc: str) -> DataFrame:
    """(doc, code, at): places of the chunks with a fingerprint or short gram that one of the document's lines may have.

    Every document has a filter of its own, so what leaves a task does not grow with the number of documents.
    """
    filters = text_index.own_filters(seeds.select(doc, "code").distinct(), doc, "code")
    group = F.floor(F.col("chunk") / CHUNK_GROUP).alias("group")
    # a long document's filter goes to each group of its chunks: the document is in no task as a whole
    filters = filters.join(chunks.select(doc, group).distinct(), doc)
    both = chunks.withColumn("group", group).join(filters, [doc, "group"]).select(doc, "chunk", "text", "words")

    def spots(batches):
        def out(batch, rows, codes, at):
            take = pa.array(np.concatenate(rows))
            begin = batch.column("chunk").take(take).to_numpy(zero_copy_only=False) * CHUNK + np.concatenate(at)
            return pa.RecordBatch.from_arrays(
                [batch.column(doc).take(take), pa.array(np.concatenate(codes).view(np.int64)), pa.array(begin)], names=[doc, "code", "at"])

        for batch in batches:
            data, offsets = text_index.text_bytes(batch.column("text"))
            rows, codes, at, n = [], [], [], 0
            for k, (low, high, may_be) in enumerate(zip(offsets, offsets[1:], text_index.own_tests(batch.column("words")))):
                text = data[low:high]
                short = text_index.gram_codes(text, SHORT)
                for place, code in (text_index.fingerprints(text), (np.arange(len(short)), short)):
                    mine = may_be(code)
                    rows.append(np.full(mine.sum(), k)), codes.append(code[mine]), at.append(place[mine])
                    n += len(rows[-1])
                if n > SPOTS:
                    yield out(batch, rows, codes, at)
                    rows, codes, at, n = [], [], [], 0
            if rows:
                yield out(batch, rows, codes, at)

    kind = chunks.schema[doc].dataType.simpleString()
    return both.mapInArrow(spots, f"`{doc}` {kind}, code long, at long")


def _found_in_stream(wanted: DataFrame, lines: DataFrame, doc: str) -> DataFrame:
    """Those (doc, line) of ``wanted`` (doc, line, norm) whose norm occurs in the document's stream, blanks aside.

    Streams are winnowed: of every WHOLE neighbouring bytes at least one gram is a fingerprint, chosen by these bytes alone, so
    a line that occurs brings its fingerprints along. Each line proposes places by that one of three of its own which is
    rarest in the document; the bytes there are compared piece by piece. Fingerprints that no line has stay in the task that
    finds them. Lines too short for a fingerprint are sought by grams.
    """
    needles = written(wanted.select(doc, "line", _squeeze(F.col("norm")).alias("text")))
    seeds = written(_seeds(needles, doc))
    chunks = written(_chunks(_stream(lines.join(needles.select(doc).distinct(), doc, "left_semi"), doc), doc))
    found = _spots(chunks, seeds, doc)
    found = written(found.join(seeds.select(doc, "code").distinct(), [doc, "code"], "left_semi").distinct())
    frequency = found.groupBy(doc, "code").agg(F.count(F.lit(1)).alias("f"))
    rarest = seeds.join(frequency, [doc, "code"]).groupBy(doc, "line").agg(F.min_by(F.struct("code", "off"), F.struct("f", "off")).alias("s"))
    missing = seeds.select(doc, "line", "code").distinct().join(frequency, [doc, "code"], "left_anti").select(doc, "line").distinct()
    rarest = rarest.join(missing, [doc, "line"], "left_anti").select(doc, "line", "s.code", "s.off")
    starts = rarest.join(found, [doc, "code"]).select(doc, "line", (F.col("at") - F.col("off")).alias("begin")).filter("begin >= 0").distinct()
    size = F.octet_length("text")
    pieces = needles.select(doc, "line", size.alias("size"), F.encode("text", "UTF-8").alias("bytes")).withColumn("step", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / PIECE))))
    pieces = pieces.select(
        doc, "line", "step", (F.floor((F.col("size") - 1) / PIECE) + 1).alias("steps"),
        F.substring("bytes", (F.col("step") * PIECE + 1).cast("int"), F.lit(PIECE)).alias("piece"),
    )
    asked = starts.join(pieces, [doc, "line"]).withColumn("from", F.col("begin") + F.col("step") * PIECE)
    asked = asked.withColumn("chunk", F.floor(F.col("from") / CHUNK))
    here = F.substring("text", (F.col("from") - F.col("chunk") * CHUNK + 1).cast("int"), F.octet_length("piece"))
    equal = asked.join(chunks, [doc, "chunk"]).filter(here == F.col("piece"))
    whole = equal.groupBy(doc, "line", "begin").agg(F.count(F.lit(1)).alias("k"), F.max("steps").alias("steps")).filter("k = steps")
    return whole.select(doc, "line").distinct()


def _first_pages(original: DataFrame, converted: DataFrame, doc: str, *dealt_by: str) -> DataFrame:
    """Lines of the original with their first page here and there: (doc, digest, norm, page_no, new_page).

    Of the conversion only digests are shuffled. NULL documents have no conversion.
    """
    a = normal_lines(original).select(doc, _digest("norm").alias("digest"), "norm", "page_no")
    b = normal_lines(converted.filter(F.col(doc).isNotNull())).select(doc, _digest("norm").alias("digest"), F.col("page_no").alias("new_page"))
    rows = a.unionByName(b, allowMissingColumns=True)
    if dealt_by:
        rows = rows.repartition(*dealt_by)
    both = rows.groupBy(doc, "digest").agg(
        F.any_value("norm", F.lit(True)).alias("norm"), F.min("page_no").alias("page_no"), F.min("new_page").alias("new_page")
    )
    return both.filter(F.col("norm").isNotNull())


def _parity(lines: DataFrame, doc: str, inside: Column) -> DataFrame:
    state = (
        F.when(F.col("new_page") == F.col("page_no"), "same").when(F.col("new_page").isNotNull(), "moved")
        .when(inside, "wrapped").otherwise("missing")
    )
    return lines.select(doc, "norm", "page_no", state.alias("state"), "new_page")


def _short_parity(original: DataFrame, converted: DataFrame, doc: str) -> DataFrame:
    """Documents whose stream fits a cell: lines and streams are dealt by document, once, and meet there."""
    lines = converted.filter(F.col(doc).isNotNull()).select(doc, "page_no", "line_no", "line").repartition(doc)
    pages = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"])
    stream = _squeezed_pages(lines, doc).groupBy(doc).agg(F.array_join(pages, "").alias("stream"))
    both = _first_pages(original, converted, doc, doc).join(stream, doc, "left")
    return _parity(both, doc, F.contains("stream", _squeeze(F.col("norm"))))


def _long_parity(original: DataFrame, converted: DataFrame, doc: str) -> DataFrame:
    """Documents of any length: none of them is in one task."""
    both = written(_first_pages(original, converted, doc).withColumn("line", F.xxhash64("norm")))
    inside = _found_in_stream(both.filter(F.col("new_page").isNull()).select(doc, "line", "norm"), converted, doc)
    return _parity(both.join(inside.withColumn("__in", F.lit(True)), [doc, "line"], "left"), doc, F.col("__in"))


def line_parity(original: DataFrame, converted: DataFrame, doc: str) -> DataFrame:
    """Lines of the original and what became of them: (doc, norm, page_no, state, new_page).

    ``same`` and ``moved`` lines exist in the conversion (first pages compared), ``wrapped`` ones only inside its text
    stream, ``missing`` ones nowhere. The stream is compared without blanks: whatever matches with them also matches
    without. Documents of up to CELL bytes of lines have their stream in one cell, longer ones in pieces.
    """
    size = F.octet_length("line").cast("long") + 1
    sizes = original.select(doc, size.alias("n")).unionByName(converted.select(doc, size.alias("n")))
    long = written(sizes.groupBy(doc).agg(F.sum("n").alias("n")).filter(F.col("n") > CELL).select(doc), "long")
    if long.isEmpty():
        return _short_parity(original, converted, doc)
    pick = lambda lines, how: join_back(lines, long, [doc], how)
    short = _short_parity(pick(original, "left_anti"), pick(converted, "left_anti"), doc)
    return short.unionByName(_long_parity(pick(original, "left_semi"), pick(converted, "left_semi"), doc))


# ---------------------------------------------------------------- groups on pages


Values = Sequence[str] | DataFrame


def _values(lines: DataFrame, values: Values) -> DataFrame:
    """(value, rank): a list's order, or a table's column ``rank`` (without one, the order of the values)."""
    if not isinstance(values, DataFrame):
        return lines.sparkSession.createDataFrame([(v, n) for n, v in enumerate(values)], "value string, rank long")
    rank = F.col("rank").cast("long") if "rank" in values.columns else F.lit(0).cast("long")
    return values.select(F.col("value").cast("string").alias("value"), rank.alias("rank")).filter("value is not null")


def _value_hits(lines: DataFrame, doc: str, values: Values) -> DataFrame:
    """Pages (doc, page_no, value, rank) a value occupies: it is on the page and no longer value containing it is.

    Values may be any number, as a list or as a table with column ``value``; the empty value is nowhere. They are found by
    their rarest gram (``text_index``), in lines and, the same way, in each other.
    """
    index = written(text_index.value_grams(_values(lines, values)), "values")
    on = written(text_index.find_values(lines, [doc, "page_no"], "line", index))
    inside = text_index.find_values(index.select(F.col("value").alias("longer")), ["longer"], "longer", index).filter("longer <> value")
    # a longer value on the page takes the page from the values it contains
    taken = on.select(doc, "page_no", F.col("value").alias("longer")).join(inside.select("longer", "value"), "longer")
    return on.join(taken.select(doc, "page_no", "value").distinct(), [doc, "page_no", "value"], "left_anti")


def group_spans(lines: DataFrame, doc: str, values: Values) -> DataFrame:
    """Longest run of consecutive pages per value: (doc, value, first_pos, last_pos, run_length)."""
    return longest_run(_value_hits(lines, doc, values).drop("rank"), [doc, "value"], "page_no")


def _owned_pages(lines: DataFrame, doc: str, values: Values) -> DataFrame:
    """(doc, value, rank, page_no) for the pages of each value's run; a run has as many pages as it has rows here."""
    hits = written(_value_hits(lines, doc, values))
    spans = longest_run(hits.drop("rank"), [doc, "value"], "page_no")
    return (
        hits.join(spans, [doc, "value"]).filter(F.col("page_no").between(F.col("first_pos"), F.col("last_pos")))
        .select(doc, "value", "rank", "page_no", "last_pos")
    )


def group_breaks(lines: DataFrame, doc: str, values: Values) -> DataFrame:
    """Last content line before each page break inside a value's run: (doc, value, page_no, mark); '' without one."""
    on = _owned_pages(lines, doc, values).filter(F.col("page_no") < F.col("last_pos"))
    last = content_lines(lines, doc, "line_no").groupBy(doc, "page_no").agg(F.max("line_no").alias("line_no"))
    last = last.join(on.select(doc, "page_no"), [doc, "page_no"], "left_semi")
    marks = normal_lines(lines.join(last, [doc, "page_no", "line_no"])).groupBy(doc, "page_no").agg(F.max("norm").alias("mark"))
    return on.join(marks, [doc, "page_no"], "left").select(doc, "value", "page_no", F.coalesce("mark", F.lit("")).alias("mark"))


def _amounts(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    bare = F.transform(found, lambda m: F.regexp_replace(m, r"[^\d.]", ""))
    return F.array_distinct(F.filter(bare, lambda m: m != ""))


def orphan_totals(lines: DataFrame, doc: str, values: Values) -> DataFrame:
    """Totals stranded on the page after their group: (doc, owner, page_no).

    A page that states its total in prose ("totalling $43.50") must print it; if the next page does instead, that
    page is stranded. Otherwise a near-empty page with a total that belongs to no group itself is the previous page's,
    unless both print amounts and share none. Of several values on a page the one of the highest rank owns it.
    """
    text = _page_texts(lines, doc, F.col("line")).select(doc, "page_no", F.array_join("a", "\n").alias("text"))
    facts = text.select(
        doc, "page_no", _amounts(F.col("text"), STATED_TOTAL).alias("stated"),
        _amounts(F.col("text"), TOTAL_AMOUNT).alias("totals"), _amounts(F.col("text"), ANY_MONEY).alias("money"),
    )
    owners = _owned_pages(lines, doc, values).groupBy(doc, "page_no").agg(F.max_by("value", F.struct("rank", "value")).alias("owner"))
    content = content_lines(lines, doc, F.col("norm").rlike(TOTAL_MARKER).alias("marked")).groupBy(doc, "page_no").agg(
        F.count(F.lit(1)).alias("content"), F.max("marked").alias("marked")
    )
    # each page is read as itself and as the one before
    page = written(
        facts.join(owners, [doc, "page_no"], "left").join(content, [doc, "page_no"], "left")
        .withColumn("claims", F.when(F.size("stated") > 0, F.col("stated")).otherwise(F.col("money")))
    )
    before = page.select(
        doc, (F.col("page_no") + 1).alias("page_no"), F.col("stated").alias("p_stated"), F.col("totals").alias("p_totals"),
        F.col("claims").alias("p_claims"), F.col("owner").alias("p_owner"),
    )
    pair = page.join(before, [doc, "page_no"])
    declared = (
        (F.size("p_stated") > 0) & ~F.arrays_overlap("p_stated", "p_totals") & F.arrays_overlap("p_stated", "totals")
    )
    disagree = (F.size("totals") > 0) & (F.size("p_claims") > 0) & ~F.arrays_overlap("p_claims", "totals")
    stranded = (
        F.col("content").between(1, ORPHAN_LINES) & F.col("marked") & F.col("owner").isNull()
        & F.col("p_owner").isNotNull() & ~disagree
    )
    owner = F.when(declared, F.coalesce("p_owner", F.array_min("p_stated"))).otherwise(F.col("p_owner"))
    return pair.filter(F.coalesce(declared, F.lit(False)) | F.coalesce(stranded, F.lit(False))).select(
        doc, owner.alias("owner"), "page_no"
    )


def _page_sets(lines: DataFrame, doc: str, page: str) -> tuple[DataFrame, DataFrame]:
    """Pages of different content with their lines as sorted 64-bit codes (doc, sig, size, first, codes), and all pages
    (doc, sig, copy, page), those of the same content numbered in page order."""
    sets = normal_lines(lines).groupBy(doc, "page_no").agg(F.array_sort(F.collect_set(F.xxhash64("norm"))).alias("codes"))
    sets = written(sets.withColumn("sig", F.xxhash64("codes")))
    numbered = running(sets.select(doc, "page_no", "sig"), "count", F.lit(1), "copy", "page_no", [doc, "sig"])
    kept = sets.groupBy(doc, "sig").agg(F.min("page_no").alias("first"), F.any_value("codes").alias("codes"))
    return written(kept.withColumn("size", F.size("codes"))), written(numbered.select(doc, "sig", "copy", F.col("page_no").alias(page)))


def _similar_pages(a: DataFrame, b: DataFrame, doc: str, least: float) -> DataFrame:
    """Pairs of page contents with an overlap of ``least`` or more: (doc, sig_a, sig_b, size_a, size_b, first_a, first_b,
    shared, overlap).

    A page that shares ``least`` of its lines with another must share one of its rarest ``1 - least`` part, so only those
    lines look for partners and furniture does not join every page with every page.
    """
    line = lambda side: side.select(doc, "sig", "size", F.explode("codes").alias("code"))
    frequency = line(a).unionByName(line(b)).groupBy(doc, "code").agg(F.count(F.lit(1)).alias("f"))

    def rare(side: DataFrame) -> DataFrame:
        keep = (F.col("size") - F.ceil(F.col("size") * least) + 1).cast("int")
        rated = line(side).join(frequency, [doc, "code"]).groupBy(doc, "sig", "size").agg(F.array_sort(F.collect_list(F.struct("f", "code"))).alias("c"))
        return rated.select(doc, "sig", "size", F.explode(F.slice("c", F.lit(1), keep)).alias("c")).select(doc, "sig", "size", "c.code")

    def meet(asks: DataFrame, asked: DataFrame, one: str, two: str) -> DataFrame:
        asks = asks.select(doc, "code", F.col("sig").alias(f"sig_{one}"), F.col("size").alias("n"))
        asked = asked.select(doc, "code", F.col("sig").alias(f"sig_{two}"), F.col("size").alias("m"))
        return asks.join(asked, [doc, "code"]).filter("n <= m").select(doc, "sig_a", "sig_b")

    pairs = meet(rare(a), line(b), "a", "b").unionByName(meet(rare(b), line(a), "b", "a")).distinct()
    side = lambda df, n: df.select(doc, *[F.col(c).alias(f"{c}_{n}") for c in ("sig", "size", "first", "codes")])
    both = pairs.join(side(a, "a"), [doc, "sig_a"]).join(side(b, "b"), [doc, "sig_b"])
    both = both.withColumn("shared", F.size(F.array_intersect("codes_a", "codes_b")))
    return both.withColumn("overlap", F.col("shared") / F.least("size_a", "size_b")).filter(F.col("overlap") >= least).drop("codes_a", "codes_b")


def pair_pages(original: DataFrame, converted: DataFrame, doc: str, least: float = MIN_OVERLAP) -> DataFrame:
    """Pages that are the same page: (doc, page_a, page_b, overlap), mutual best matches.

    The overlap is shared lines over the smaller page's lines. Pages with the same lines are handled as one and paired in
    page order. ``pair_pages_forward`` keeps to the order of pages instead.
    """
    a, a_pages = _page_sets(original, doc, "page_a")
    b, b_pages = _page_sets(converted, doc, "page_b")
    shared = written(_similar_pages(a, b, doc, least))
    # best partner each way: highest overlap, most shared lines, nearest size, earliest page
    near = -F.abs(F.col("size_a") - F.col("size_b"))
    rank_a = F.struct("overlap", "shared", near.alias("near"), -F.col("first_b"))
    rank_b = F.struct("overlap", "shared", near.alias("near"), -F.col("first_a"))
    best_a = shared.groupBy(doc, "sig_a").agg(F.max_by(F.struct("sig_b", "overlap"), rank_a).alias("p")).select(doc, "sig_a", "p.sig_b", "p.overlap")
    best_b = shared.groupBy(doc, "sig_b").agg(F.max_by("sig_a", rank_b).alias("sig_a"))
    pairs = best_a.join(best_b, [doc, "sig_a", "sig_b"])
    left = pairs.join(a_pages.withColumnRenamed("sig", "sig_a"), [doc, "sig_a"])
    return left.join(b_pages.withColumnRenamed("sig", "sig_b"), [doc, "sig_b", "copy"]).select(
        doc, "page_a", "page_b", F.round("overlap", 4).alias("overlap")
    )


def pair_pages_forward(original: DataFrame, converted: DataFrame, doc: str, least: float = MIN_OVERLAP) -> DataFrame:
    """Pages that are the same page, in order: (doc, page_a, page_b, overlap).

    Converted pages in their order each take the original page of the highest overlap (the earliest of equals) that is not
    before the one taken last; a page without one of at least ``least`` takes none. So a line that is on every page cannot
    pair a late page with an early one.

    Candidates are those of ``pair_pages``, by page content. The walk needs a document's in order: page numbers, contents as
    numbers and their overlaps are in one task, no text.
    """
    a, a_pages = _page_sets(original, doc, "page_a")
    b, b_pages = _page_sets(converted, doc, "page_b")
    none = F.lit(None).cast("double").alias("overlap")
    similar = _similar_pages(a, b, doc, least).select(doc, F.lit(0).alias("kind"), F.col("sig_b").alias("x"), F.col("sig_a").alias("y"), "overlap")
    of = lambda pages, kind, page: pages.select(doc, F.lit(kind).alias("kind"), F.col("sig").alias("x"), F.col(page).cast("long").alias("y"), none)
    rows = similar.unionByName(of(a_pages, 1, "page_a")).unionByName(of(b_pages, 2, "page_b"))

    def walk(table: pa.Table) -> pa.Table:
        partners, places, pages = defaultdict(list), defaultdict(list), []
        for kind, x, y, overlap in zip(*(table.column(c).to_pylist() for c in ("kind", "x", "y", "overlap"))):
            if kind == 0:
                partners[x].append((-overlap, y))
            elif kind == 1:
                places[x].append(y)
            else:
                pages.append((y, x))
        for found in (*partners.values(), *places.values()):
            found.sort()
        from_, out = 0, []
        for page_b, content in sorted(pages):
            best = None
            for rank, other in partners[content]:
                if best is not None and rank > best[0]:
                    break
                at = bisect_left(places[other], from_)
                if at < len(places[other]):
                    best = min(best or (rank, places[other][at]), (rank, places[other][at]))
            if best is not None:
                from_ = best[1]
                out.append((from_, page_b, -best[0]))
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({
            doc: table.column(doc).combine_chunks().take(pa.array([0] * len(out), pa.int64())), "page_a": pa.array(columns[0], pa.int32()),
            "page_b": pa.array(columns[1], pa.int32()), "overlap": pa.array(columns[2], pa.float64()),
        })

    kind = original.schema[doc].dataType.simpleString()
    return rows.groupBy(doc).applyInArrow(walk, f"`{doc}` {kind}, page_a int, page_b int, overlap double").withColumn("overlap", F.round("overlap", 4))
