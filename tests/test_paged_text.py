"""Paged text: small documents written by hand, with the tables they must give."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import paged_text as pt

VALUES = ["Cycles Ltd", "Northern Cycles Ltd", "Acme"]
FOOTER = "Legal footer of the company"

BOOK = {
    1: [
        ["Northern Cycles Ltd", "invoices totalling $30.00 were sent", "frames and wheels", "chains and pedals", FOOTER],
        ["Northern Cycles Ltd", "brakes and cables", "saddles and posts", "bells and lights", "tyres and tubes", FOOTER],
        ["Total: $10.50", FOOTER],
    ],
    2: [["Acme", "invoices totalling $20.50 are due", "alpha beta gamma", "delta and epsilon"], ["Total: $20.50", "zeta and theta words"]],
}


def frame(spark, book):
    lines = [(d, p, n, line) for d, pages in book.items() for p, page in enumerate(pages) for n, line in enumerate(page)]
    return spark.createDataFrame(lines, "doc int, page_no int, line_no int, line string")


@pytest.fixture(scope="module")
def lines(spark):
    return frame(spark, BOOK)


def test_lines_of_most_pages(lines):
    assert {(r.doc, r.norm) for r in pt.boilerplate(lines, "doc").collect()} == {(1, "Northern Cycles Ltd"), (1, FOOTER)}


def test_pages_with_little_on_them(lines):
    assert {(r.doc, r.page_no) for r in pt.sparse_pages(lines, "doc").collect()} == {(1, 0), (1, 2), (2, 0), (2, 1)}


def test_spans_of_the_longest_name(lines):
    found = {(r.doc, r.value, r.first_pos, r.run_length) for r in pt.group_spans(lines, "doc", VALUES).collect()}
    assert found == {(1, "Northern Cycles Ltd", 0, 2), (2, "Acme", 0, 1)}


def test_breaks_inside_a_span(lines):
    found = {(r.doc, r.value, r.page_no, r.mark) for r in pt.group_breaks(lines, "doc", VALUES).collect()}
    assert found == {(1, "Northern Cycles Ltd", 0, "chains and pedals")}


def test_totals_after_their_group(lines):
    found = {(r.doc, r.page_no, r.owner) for r in pt.orphan_totals(lines, "doc", VALUES).collect()}
    assert found == {(1, 2, "Northern Cycles Ltd"), (2, 1, "Acme")}


def test_lines_of_a_conversion(spark):
    given = {3: [["first line stays here", "second line will move", "third line gets wrapped", "fourth line is lost"]]}
    converted = {3: [["first line stays here", "third line gets"], ["wrapped", "second line will move"]]}
    found = {r.norm: r.state for r in pt.line_parity(frame(spark, given), frame(spark, converted), "doc").collect()}
    assert found == {
        "first line stays here": "same", "second line will move": "moved", "third line gets wrapped": "wrapped", "fourth line is lost": "missing",
    }


def test_pages_of_a_copy(lines):
    found = {(r.doc, r.page_a, r.page_b, r.overlap) for r in pt.pair_pages(lines, lines, "doc").collect()}
    assert found == {(d, p, p, 1.0) for d, pages in BOOK.items() for p in range(len(pages))}


def test_forward_pages_keep_their_order(spark):
    words = lambda pages: {1: [[f"the line of {w}" for w in page] for page in pages]}

    def forward(a, b):
        out = pt.pair_pages_forward(frame(spark, words(a)), frame(spark, words(b)), "doc").collect()
        return sorted((r.page_a, r.page_b, r.overlap) for r in out)

    assert forward([["alpha"], ["filler"], ["beta"], ["fuller"], ["gamma"]], [["alpha"], ["beta"], ["gamma"]]) == [(0, 0, 1.0), (2, 1, 1.0), (4, 2, 1.0)]
    assert forward([["aa", "footer"], ["bb", "footer"], ["cc", "footer"]], [["cc", "footer"], ["bb", "footer"]]) == [(2, 0, 1.0), (2, 1, 0.5)]
    assert forward([["alpha"]], [["different"]]) == []
    assert forward([["same"]] * 4, [["same"]] * 3) == [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0)]


def test_values_of_any_kind_and_number(spark):
    rng = random.Random(3)
    alphabet = ["a", "b", "é", "漢", " "]
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    values = sorted({word(rng.randint(1, 14)) for _ in range(400)} | {f"Customer number {k:05}" for k in range(15_000)} | {""})
    text = [word(60) + rng.choice(["", f" Customer number {rng.randrange(20_000):05}"]) for _ in range(150)]
    df = frame(spark, {1: [[t] for t in text]})
    table = spark.createDataFrame([(v,) for v in values], "value string")
    found = {(r.page_no, r.value) for r in pt._value_hits(df, "doc", table).collect()}
    wanted = set()
    for page, t in enumerate(text):
        on = [v for v in values if v and v in t]
        wanted |= {(page, v) for v in on if not any(v != w and v in w for w in on)}
    assert found == wanted and len(wanted) > 500


def test_lines_in_streams_of_any_length(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    text = " ".join(word() for _ in range(12_000))  # several chunks, lines over page and chunk borders
    pages = [text[k : k + 700].split(" ") for k in range(0, len(text), 700)]
    converted = {1: [[" ".join(p[:40]), " ".join(p[40:])] for p in pages]}
    stream = "".join("".join(lines).replace(" ", "") for lines in converted[1])
    lines = []
    for size in (6, 9, 14, 16, 17, 30, 200, 5000, 9000):
        for _ in range(4):
            at = rng.randrange(len(text) - size)
            piece = text[at : at + size]
            lines += [piece, piece[: size // 2] + "zz" + piece[size // 2 :]]
    found = {r.norm: r.state for r in pt.line_parity(frame(spark, {1: [lines]}), frame(spark, converted), "doc").collect()}
    have = {" ".join(x.split()) for page in converted[1] for x in page}
    wanted = {n: "same" if n in have else "wrapped" if n.replace(" ", "") in stream else "missing" for n in found}
    assert {n: "same" if s == "moved" else s for n, s in found.items()} == wanted and set(wanted.values()) >= {"wrapped", "missing"}


def test_documents_do_not_fill_each_others_filter(spark):
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))
    texts = {d: [line() for _ in range(20)] for d in range(300)}
    chunks = spark.createDataFrame([(d, 0, "".join(t).encode()) for d, t in texts.items()], "doc int, chunk long, text binary")
    # each document asks for a line of its own and for one of the next document
    asked = [(d, n, n, texts[e][3]) for d in texts for n, e in enumerate((d, (d + 1) % 300))]
    seeds = pt._seeds(spark.createDataFrame(asked, "doc int, norm string, line long, text string"), "doc")
    found = pt._spots(chunks, seeds, "doc")
    own = {(r.doc, r.code) for r in seeds.filter("line = 0").collect()}
    assert own <= {(r.doc, r.code) for r in found.collect()} and found.count() < 1.5 * len(own) + 300


def test_lines_are_normalised_once(lines):
    plan = pt.normal_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == text.normal_line(F.col("line"))._jc.toString().count("regexp_replace") == 4


def test_short_documents_are_dealt_once(spark, monkeypatch):
    rng = random.Random(7)
    line = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(12))
    given = {d: [[line() for _ in range(6)] for _ in range(4)] for d in range(30)} | {30: [["only here as a line"]]}
    converted = {}
    for d, pages in given.items():
        kept = [x for page in pages for x in page if rng.random() < 0.8] + [line()]
        wrapped = [" ".join(kept[k : k + 2]) if k % 3 else "\n".join(kept[k : k + 2]) for k in range(0, len(kept), 2)]
        flat = "\n".join(wrapped).split("\n")
        converted[d] = [flat[k : k + 5] for k in range(0, len(flat), 5)]
    del converted[30]
    rows = [(d, p, n, x) for d, pages in given.items() for p, page in enumerate(pages) for n, x in enumerate(page)]
    rows.append((None, 0, 0, "a line of no document"))
    a, b = spark.createDataFrame(rows, "doc int, page_no int, line_no int, line string"), frame(spark, converted)
    want = set()
    for d, p, _, x in rows:
        pages = converted.get(d, [])
        new = next((n for n, page in enumerate(pages) if x in page), None)
        stream = "".join(y for page in pages for y in page).replace(" ", "")
        where = "same" if new == p else "moved" if new is not None else "wrapped" if x.replace(" ", "") in stream else "missing"
        want.add((d, x, p, where, new))
    assert {w[3] for w in want} == {"same", "moved", "wrapped", "missing"}

    def folder():
        return sum(f.stat().st_size for f in pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).rglob("*.parquet"))

    before = folder()
    found = pt.line_parity(a, b, "doc")
    assert {tuple(r) for r in found.collect()} == want
    assert folder() - before < sum(len(r[3]) for r in rows) / 5  # no text is written
    # one exchange has the lines of the original with digests of the conversion's, one has the conversion's lines
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
    for limit in (0, 3500):  # all documents in pieces, and some
        monkeypatch.setattr(pt, "CELL", limit)
        assert {tuple(r) for r in pt.line_parity(a, b, "doc").collect()} == want


def test_content_is_known_without_its_text(spark):
    rng = random.Random(8)
    line = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400))
    book = {d: [["Acme", "Furniture on every page"] + [line() for _ in range(4)] for _ in range(3)] + [["Total: $1.50", "Furniture on every page"]] for d in range(60)}
    lines = frame(spark, book)
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    text = sum(len(x) for pages in book.values() for page in pages for x in page)
    for op, want in (
        (lambda: pt.orphan_totals(lines, "doc", VALUES), {(d, "Acme", 3) for d in book}),
        (lambda: pt.sparse_pages(lines, "doc"), {(d, 3, 1) for d in book}),
        (lambda: pt.group_breaks(lines, "doc", VALUES), {(d, "Acme", p, " ".join(book[d][p][-1].split())) for d in book for p in (0, 1)}),
    ):
        before = size()
        assert {tuple(r) for r in op().collect()} == want
        assert size() - before < text / 2  # no text is written
    assert {(r.doc, r.norm) for r in pt.boilerplate(lines, "doc").collect()} == {(d, "Furniture on every page") for d in book}
