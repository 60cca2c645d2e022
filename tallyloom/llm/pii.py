"""Personal data in texts: base patterns, and a semi-Markov conditional random field that adds spans of its own.

The base patterns find e-mail addresses, IP addresses, card and phone numbers, leftmost and without overlap per kind; their
matches are always kept. The field reads islands: words with a digit, ``@`` or ``=`` that follow each other, with the word
before them. An island's tokens are runs of letters and digits, and single signs. A segmentation covers the tokens with
entities of at most ``MOST_TOKENS`` tokens and ``MOST_CHARS`` characters and single tokens outside of entities; its score
sums, for each entity, weights of features of the whole span (form, number of digits, check digit, parts, what stands next to
it) under its kind, and a weight for entities that touch. Tokens outside score nothing, so islands can be decoded one by one:
the best segmentation of the text is that of its islands. Dynamic programming over the bounded entities finds it, and so
chooses borders and kinds together.

The field is trained here. Islands of all documents are counted by form; the ``TRAINING_FORMS`` most frequent forms, with
what the base patterns and the rules for secrets say of one example each, are the training rows, together with variants of
them (a phone number without its country, two entities side by side). Islands in which a pattern matched but failed its
check are left out: what they hold is for the field to say. The likelihood is maximised on the driver.

Results: a null text counts as empty and has no spans; a null id stays null; repeated rows have equal results. Without
training rows, as for an empty table, the field adds nothing. Added spans never overlap base spans. Other columns are not
read. A text is read in one task; its work is linear in its length, whatever it holds.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow import parts, record

# Kinds in the order of results, those of the base patterns first, and words that announce one.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
CUES = frozenset("account address api auth call card cell credit email fax host ip key mail mobile number passwd password phone pwd secret server tel telephone token visa".split())

# Numbers that are nothing personal, as training rows without entities.
PLAIN_NUMBERS = (
    "on 2020-01-02", "on 01.02.2020", "on 1/2/2020", "in 1999-2005", "at 12:30", "at 12:30:45", "version 2.0.1", "version 10.4", "release 1.2.3-4",
    "the 1 2 3 4 5", "1 2 3 4 5 6 7 8 9 10 11 12", "of 10 11 12 13", "about 10,000", "some 1 000 000", "pages 100-200", "pages 1200-1300", "is 3.14159", "x = 5", "x=12",
    "number 12345", "number 123456", "isbn 978-3-16", "year 2020 2021", "a = 100 200", "2020-01-02 12:30", "1. 2. 3.", "(1) (2) (3)", "the (1999) 2.0",
)

#: Forms of islands that are learned from, and tokens of such an island at most.
TRAINING_FORMS, TRAINING_TOKENS = 1000, 48
#: Tokens and characters of an entity at most.
MOST_TOKENS, MOST_CHARS = 16, 80
#: Passes over the training rows, step size, and strength of the penalty on weights.
PASSES, STEP, PENALTY = 15, 0.5, 1e-3
#: Scores kept per worker before the cache starts anew.
CACHE = 100_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"\b(?:token|secret|password|passwd|pwd|api_key|apikey|key)\s?[=:]\s?\"?([A-Za-z0-9]{8,80})(?![A-Za-z0-9])|\b(AKIA[A-Z0-9]{12,20})\b", re.I)
_MARK = re.compile(r"[0-9@=]+")
_WORD = re.compile(r"\S{0,80}")
_CONTEXT = re.compile(r"\s?(\S{0,24})")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_NUMERIC = frozenset("0+().-/")
_WHOLE_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """The check digit of a card number is right."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the base patterns by kind and start, and matches that failed their checks."""
    found, failed, end = [], [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append(("email", start, end))
        else:
            end = at  # a later local part cannot reach over an @
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        (found if all(map(_small, m.group().split("."))) else failed).append(("ip", *m.span()))
    for kind, pattern in (("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
            (found if good else failed).append((kind, *m.span()))
    return found, failed


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches [start, end) that the field reads."""
    start = end = -1
    for m in _MARK.finditer(text):
        at = m.start()
        if at < end:
            continue
        from_ = max(end, 0, at - MOST_CHARS)
        low = at - _WORD.match(text[from_:at][::-1]).end()
        high = _WORD.match(text, m.end()).end()
        if start >= 0 and low - end <= 2:
            end = high
            continue
        if start >= 0:
            yield start, end
        before = _CONTEXT.match(text[max(end, 0, low - 26) : low][::-1]).end()
        start, end = low - before, high
    if start >= 0:
        yield start, end


def _token_form(token: str) -> str:
    if token.isascii():
        if token.isdigit():
            return f"0{min(len(token), 24)}"
        if token.isalpha():
            low = token.lower()
            return low if low in CUES else "A" if token.isupper() else "a"
        if token.isalnum():
            return f"{'M' if token.upper() == token else 'm'}{min(len(token), 64)}"
        return token
    return "x" if token.isalnum() else token


@dataclass
class Island:
    """Tokens of an island: where they start and end in the text, and their forms, with a space where one stands before."""

    text: str
    starts: list[int]
    ends: list[int]
    forms: list[str]


def island(text: str, start: int, end: int) -> Island:
    starts, ends, forms = [], [], []
    for m in _TOKEN.finditer(text, start, end):
        gap = " " if ends and m.start() > ends[-1] else ""
        starts.append(m.start())
        ends.append(m.end())
        forms.append(gap + _token_form(m.group()))
    return Island(text, starts, ends, forms)


def _check(span: str) -> str:
    """What checks of the whole span say."""
    if "@" in span:
        return "mail" if _WHOLE_MAIL.fullmatch(span) else "no mail"
    if span[-1].isdigit() and not span.strip("0123456789 -"):
        digits = span.replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19:
            return "luhn" if luhn(digits) else "no luhn"
    elif span.count(".") == 3 and not span.strip("0123456789."):
        return "ip" if all(p and _small(p) for p in span.split(".")) else "no ip"
    elif span.isalnum() and span.isascii():
        return "hex" if not span.strip("0123456789abcdef") else ""
    return ""


def span_key(x: Island, i: int, j: int) -> tuple | None:
    """All that features of tokens i to j - 1 as one entity are made of; None if no entity can stand there."""
    first, last = x.forms[i].lstrip(), x.forms[j - 1].lstrip()
    if not (last[0].isalnum() and (first[0].isalnum() or first in "+(")) or x.ends[j - 1] - x.starts[i] > MOST_CHARS:
        return None
    if any(f[0] == " " for f in x.forms[i + 1 : j]) and any(f.lstrip()[0] not in _NUMERIC for f in x.forms[i:j]):
        return None  # only numbers are written with spaces
    span = x.text[x.starts[i] : x.ends[j - 1]]
    if not any("0" <= c <= "9" for c in span) and "@" not in span and (i == 0 or x.forms[i - 1].strip() not in '=:"'):
        return None
    form = (first, *x.forms[i + 1 : j])
    left = tuple(f.strip() for f in x.forms[max(0, i - 3) : i])
    glued_left = i > 0 and not x.forms[i].startswith(" ")
    right = x.forms[j] if j < len(x.forms) else " "
    return form, _check(span), left, glued_left, right


def features(key: tuple) -> list[str]:
    form, check, left, glued, right = key
    short = "".join(f.rstrip("0123456789") or "0" if f.strip()[0] in "0mM" else f for f in form)
    digits = sum(int(f.strip()[1:]) for f in form if f.strip()[0] == "0" and len(f.strip()) > 1)
    cue = next((f for f in reversed(left) if f in CUES), "")
    out = [
        "any", f"form {''.join(form)}", f"short {short}", f"digits {digits}", f"digits {digits} {short}", f"check {check}", f"check {check} {short}",
        f"left {left[-1] if left and glued else ' '}", f"right {right[0]}", f"right {right[0]} {short}", f"tokens {len(form)}", f"words {1 + short.count(' ')}",
    ]
    if left and glued:
        out.append(f"left {left[-1][0]} {short}")
    if cue:
        out += [f"cue {cue}", f"cue {cue} {short}"]
    return out


@dataclass
class Field:
    """Weights by feature, one per kind, and of kinds that touch."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    touch: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS), len(KINDS))))

    def __post_init__(self) -> None:
        self._scores: dict[tuple, np.ndarray | None] = {}

    def __getstate__(self):
        return {"weights": self.weights, "touch": self.touch, "_scores": {}}

    def score(self, key: tuple) -> np.ndarray | None:
        """Scores of the span by kind; None if none of them is above the score of standing outside."""
        if key in self._scores:
            return self._scores[key]
        if len(self._scores) > CACHE:
            self._scores.clear()
        known = [self.weights[f] for f in features(key) if f in self.weights]
        total = sum(known) if known else None
        total = total if total is not None and total.max() + max(self.touch.max(), 0) * 2 > 0 else None
        self._scores[key] = total
        return total

    def decode(self, x: Island) -> list[Span]:
        """Entities of the best segmentation: for each end and kind of what ends there, the best start and kind before."""
        n, kinds = len(x.starts), len(KINDS)
        best = np.full((n + 1, kinds + 1), -np.inf)
        best[0, kinds] = 0.0  # the last column stands for outside
        start, came = np.zeros((n + 1, kinds + 1), np.int32), np.zeros((n + 1, kinds + 1), np.int8)
        touch = np.vstack([self.touch, np.zeros(kinds)])
        for j in range(1, n + 1):
            k = int(best[j - 1].argmax())
            best[j, kinds], start[j, kinds], came[j, kinds] = best[j - 1, k], j - 1, k
            for i in range(max(0, j - MOST_TOKENS), j):
                key = span_key(x, i, j)
                scores = None if key is None else self.score(key)
                if scores is None:
                    continue
                ways = best[i][:, None] + touch
                before = ways.argmax(axis=0)
                total = ways[before, range(kinds)] + scores
                for y in np.flatnonzero(total > best[j, :kinds]).tolist():
                    best[j, y], start[j, y], came[j, y] = total[y], i, before[y]
        found, j, k = [], n, int(best[n].argmax())
        while j > 0:
            i, before = int(start[j, k]), int(came[j, k])
            if k < kinds:
                found.append((KINDS[k], x.starts[i], x.ends[j - 1]))
            j, k = i, before
        return found[::-1]


@dataclass
class Example:
    """A training island: its spans with their features, which of them are entities, and its weight."""

    n: int
    spans: list[tuple[int, int, list[str]]]
    truth: dict[tuple[int, int], int]
    weight: float


def example(x: Island, entities: Iterable[Span], weight: float) -> Example | None:
    """None if an entity's borders aren't those of tokens."""
    begins, ends = {s: k for k, s in enumerate(x.starts)}, {e: k + 1 for k, e in enumerate(x.ends)}
    truth = {}
    for kind, low, high in entities:
        if low not in begins or high not in ends:
            return None
        truth[begins[low], ends[high]] = KINDS.index(kind)
    n, spans = len(x.starts), []
    for j in range(1, n + 1):
        for i in range(max(0, j - MOST_TOKENS), j):
            key = span_key(x, i, j)
            if key is not None:
                spans.append((i, j, features(key)))
    return Example(n, spans, truth, weight) if truth.keys() <= {(i, j) for i, j, _ in spans} else None


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(values - np.expand_dims(safe, axis)).sum(axis=axis))


def expectations(n: int, spans: list[tuple[int, int]], scores: np.ndarray, touch: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Logarithm of the sum over segmentations, probabilities of each span by kind, expected number of touching kinds."""
    kinds = len(touch)
    step = np.vstack([touch, np.zeros(kinds)])
    by_end, by_start = defaultdict(list), defaultdict(list)
    for k, (i, j) in enumerate(spans):
        by_end[j].append((i, k))
        by_start[i].append((j, k))
    ahead = np.full((n + 1, kinds + 1), -np.inf)
    ahead[0, kinds] = 0
    into = np.full((n + 1, kinds), -np.inf)  # the ways to a place before an entity of each kind
    for j in range(n + 1):
        if j:
            ahead[j, kinds] = _log_sum(ahead[j - 1], 0)
            if by_end[j]:
                ahead[j, :kinds] = _log_sum(np.array([into[i] + scores[k] for i, k in by_end[j]]), 0)
        into[j] = _log_sum(ahead[j][:, None] + step, 0)
    behind = np.full((n + 1, kinds + 1), -np.inf)
    behind[n] = 0
    starts = np.full((n + 1, kinds), -np.inf)
    for i in range(n - 1, -1, -1):
        ways = [np.full(kinds + 1, _log_sum(np.array([behind[i + 1, kinds]]), 0))]
        if by_start[i]:
            starts[i] = _log_sum(np.array([behind[j, :kinds] + scores[k] for j, k in by_start[i]]), 0)
            ways.append(_log_sum(starts[i][None, :] + step, 1))
        behind[i] = _log_sum(np.array(ways), 0)
    total = float(_log_sum(ahead[n], 0))
    chance = np.array([np.exp(into[i] + scores[k] + behind[j, :kinds] - total) for k, (i, j) in enumerate(spans)]).reshape(-1, kinds)
    touching = np.zeros_like(touch)
    for i in range(1, n):
        touching += np.exp(ahead[i, :kinds, None] + touch + starts[i][None, :] - total)
    return total, chance, touching


def learn(examples: list[Example], passes: int = PASSES) -> Field:
    """The field of greatest penalised likelihood, by steps scaled with the gradients seen so far."""
    names = {f: k for k, f in enumerate(sorted({f for e in examples for _, _, fs in e.spans for f in fs}))}
    kinds = len(KINDS)
    weights, seen = np.zeros((len(names), kinds)), np.full((len(names), kinds), 1e-6)
    touch, touch_seen = np.zeros((kinds, kinds)), np.full((kinds, kinds), 1e-6)
    rows = [([(i, j) for i, j, _ in e.spans], [np.array([names[f] for f in fs]) for _, _, fs in e.spans]) for e in examples]
    for _ in range(passes):
        for e, (spans, index) in zip(examples, rows):
            if not spans:
                continue
            scores = np.array([weights[k].sum(axis=0) for k in index])
            _, chance, touching = expectations(e.n, spans, scores, touch)
            wrong = -chance
            for k, span in enumerate(spans):
                if span in e.truth:
                    wrong[k, e.truth[span]] += 1
            for a, b in e.truth.items():
                for c, d in e.truth.items():
                    if a[1] == c[0]:
                        touching[b, d] -= 1
            flat = np.concatenate(index)
            place, where = np.unique(flat, return_inverse=True)
            gradient = np.zeros((len(place), kinds))
            np.add.at(gradient, where, np.repeat(wrong, [len(k) for k in index], axis=0))
            gradient = gradient * e.weight - PENALTY * weights[place]
            seen[place] += gradient**2
            weights[place] += STEP * gradient / np.sqrt(seen[place])
            touching = -touching * e.weight - PENALTY * touch
            touch_seen += touching**2
            touch += STEP * touching / np.sqrt(touch_seen)
    return Field({f: weights[k] for f, k in names.items() if np.abs(weights[k]).max() > 1e-4}, touch)


def labelled(text: str, start: int, end: int) -> list[Span] | None:
    """Entities of an island by the base patterns and the rules for secrets; None if what it holds isn't clear."""
    found, failed = base_spans(text[start:end])
    secrets = [("secret", m.start(m.lastindex) - start, m.end(m.lastindex) - start) for m in _SECRET.finditer(text, start, end)]
    unclear = [(a, b) for _, a, b in failed if not any(c <= a and b <= d for _, c, d in secrets)]
    if any(sum(c.isdigit() for c in text[start + a : start + b]) > 8 for a, b in unclear):
        return None
    found += secrets
    found.sort(key=lambda s: s[1])
    kept: list[Span] = []
    for kind, low, high in found:
        if kept and low < kept[-1][2]:
            return None
        kept.append((kind, low, high))
    return kept


def variants(text: str, entities: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """Training islands made from one: its phone numbers without country and with other signs, alone and behind a word."""
    for kind, low, high in entities:
        if kind == "phone" and (m := re.match(r"\+[0-9]{1,3}[ .-]?", text[low:high])):
            rest = text[low + m.end() : high]
            for sign in (None, "-", ".", " "):
                form = rest if sign is None else re.sub(r"[() .-]+", sign, rest.strip("("))
                for word in ("", "call ", "then "):
                    yield word + form, [("phone", len(word), len(word) + len(form))]


def pairs(samples: dict[str, str]) -> Iterator[tuple[str, list[Span]]]:
    """One example of each kind side by side, in both orders, with and without a word before."""
    for a, first in samples.items():
        for b, second in samples.items():
            both = f"{first} {second}"
            yield both, [(a, 0, len(first)), (b, len(first) + 1, len(both))]


def count_forms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Forms of all islands: form, n, and the smallest island that has it (island, labels)."""
    def found(batches):
        for batch in parts(batches, "text"):
            counts: dict[str, list] = {}
            for text in batch.column("text").to_pylist():
                for start, end in islands(text or ""):
                    x = island(text, start, end)
                    if not x.starts or len(x.starts) > TRAINING_TOKENS:
                        continue
                    entities = labelled(text, start, end)
                    if entities is None:
                        continue
                    labels, piece = " ".join(f"{k}:{a}:{b}" for k, a, b in entities), text[start:end]
                    kinds = " ".join(k for k, _, _ in entities)
                    entry = counts.setdefault(f"{''.join(x.forms)} {kinds}", [0, piece, labels])
                    entry[0] += 1
                    if piece < entry[1]:
                        entry[1:] = [piece, labels]
            yield record({
                "form": pa.array(list(counts), pa.string()), "n": pa.array([c[0] for c in counts.values()], pa.int64()),
                "island": pa.array([c[1] for c in counts.values()], pa.string()), "labels": pa.array([c[2] for c in counts.values()], pa.string()),
            })

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(found, "form string, n long, island string, labels string")
    least = F.min(F.struct("island", "labels")).alias("least")
    return rows.groupBy("form").agg(F.sum("n").alias("n"), least).select("form", "n", "least.island", "least.labels")


def train(docs: DataFrame, text_col: str = "text", forms: int = TRAINING_FORMS) -> Field:
    """The field for a table's texts, from the most frequent forms of islands in all of them."""
    rows = count_forms(docs, text_col).orderBy(F.desc("n"), "form").limit(forms).collect()
    texts: dict[tuple[str, tuple[Span, ...]], float] = {}
    samples: dict[str, str] = {}
    for r in rows:
        entities = [(k, int(a), int(b)) for k, a, b in (s.rsplit(":", 2) for s in r.labels.split())]
        texts[r.island, tuple(entities)] = 1 + float(np.log2(r.n))
        for kind, a, b in entities:
            samples.setdefault(kind, r.island[a:b])
        for text, spans in variants(r.island, entities):
            texts.setdefault((text, tuple(spans)), 1.0)
    for text, spans in pairs({k: v for k, v in samples.items() if k != "secret"}):
        texts.setdefault((text, tuple(spans)), 4.0)
    if samples:
        for text in PLAIN_NUMBERS:
            texts.setdefault((text, ()), 4.0)
    made = (example(island(t, 0, len(t)), spans, w) for (t, spans), w in sorted(texts.items()))
    return learn([e for e in made if e is not None])


def all_spans(text: str, model: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by kind and start."""
    base, _ = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added, k = [], 0
    for start, end in islands(text) if model.weights else ():
        for kind, low, high in model.decode(island(text, start, end)):
            while k < len(taken) and taken[k][1] <= low and taken[k][0] <= low:
                k += 1
            if not any(a < high and low < b for a, b in taken[max(0, k - len(BASE_KINDS)) : k + 2 * len(BASE_KINDS)]):
                added.append((kind, low, high))
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted(base + added, key=order)


def find(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base and spans (kind, start, end), in code points with end exclusive."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    named = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in spans]

    def found(batches):
        for batch in parts(batches, "text"):
            both = [all_spans(t or "", model) for t in batch.column("text").to_pylist()]
            yield record({"id": batch.column("id"), "base": pa.array([named(b) for b, _ in both], span), "spans": pa.array([named(s) for _, s in both], span)})

    one = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(found, f"id {kind}, base {one}, spans {one}").withColumnRenamed("id", id_col)
