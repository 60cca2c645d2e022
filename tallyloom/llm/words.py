"""Ids of texts under a word-level public BPE vocabulary, cached per run of letters or signs."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import sys
import unicodedata
from array import array

import numpy as np

#: Runs kept per worker; when there are more, the older half goes. Of odd words a quarter as many.
CACHE_RUNS = 300_000
#: UTF-8 bytes of code points below U+0240, which are handled without the library's normaliser, and what is kept out:
#: white space beyond ASCII, a letter whose lower-case form has two code points, the start of special tokens.
_PLAIN_BYTES = bytes(range(0xC9))
_PLAIN_END = 0x240
_KEPT_OUT = ("\x85".encode(), "\xa0".encode(), "İ".encode(), b"<|")


def _odd(text: bytes) -> bool:
    return bool(text.translate(None, _PLAIN_BYTES)) or any(x in text for x in _KEPT_OUT)


def _plain_classes() -> tuple[str, str]:
    """Letters and numbers of the plain range, each as the inside of a pattern's set."""
    kinds = {chr(i): unicodedata.category(chr(i))[0] for i in range(_PLAIN_END)}
    return tuple(re.escape("".join(c for c, k in kinds.items() if k == kind)) for kind in "LN")


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _forget(cache: dict, limit: int) -> None:
    """Drop the half that came first from a cache beyond its limit."""
    if len(cache) > limit:
        for key in list(itertools.islice(cache, len(cache) // 2)):
            del cache[key]


class WordCoder:
    """Encodes texts run by run: the vocabulary drops white space, and no token reaches across it or out of a run.

    Runs of Latin letters, digits and signs are found by the vocabulary's own pattern and go to its merge table once.
    Words that hold anything else (special tokens, other scripts) go through the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        split = (config.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if split.get("behavior") != "Removed" or any(t["lstrip"] or t["rstrip"] for t in config["added_tokens"]):
            raise ValueError("the word cache needs a vocabulary that drops white space between words")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.decoder = config.get("decoder")
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self._model = self.tokenizer.model
        self._symbols = _byte_symbols()
        letters, numbers = _plain_classes()
        signs = f"[^{letters}{numbers} \\t\\n\\v\\f\\r]+"
        self._pieces = re.compile(f"[{letters}]+|[{numbers}]|'s|'t|'re|'ve|'m|'ll|'d|{signs}").findall
        self._ascii = re.compile(r"[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^a-z0-9 \t\n\v\f\r]+").findall
        self._words: dict[str, bytes] = {}
        self._runs: dict[str, bytes] = {}

    def _library(self, word: str) -> bytes:
        found = self._words.get(word)
        if found is None:
            _forget(self._words, CACHE_RUNS // 4)
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            found = self._words[word] = np.array(ids, "<u4").tobytes()
        return found

    def _learn(self, runs: list[str]) -> None:
        known, tokenize, symbols = self._runs, self._model.tokenize, self._symbols
        _forget(known, CACHE_RUNS)
        for run in set(runs).difference(known):
            ids = array("I", [t.id for t in tokenize(run.encode().decode("latin-1").translate(symbols))])
            if sys.byteorder != "little":
                ids.byteswap()
            known[run] = ids.tobytes()

    def _plain(self, text: bytes) -> bytes:
        runs = self._ascii(text.lower().decode()) if text.isascii() else self._pieces(text.decode().lower())
        try:
            return b"".join(map(self._runs.__getitem__, runs))
        except KeyError:
            self._learn(runs)
            return b"".join(map(self._runs.__getitem__, runs))

    def encode(self, text: bytes) -> bytes:
        """Ids of one UTF-8 text as little-endian unsigned 32-bit integers."""
        if not _odd(text):
            return self._plain(text)
        return b"".join([self._library(w.decode("utf-8", "replace")) if _odd(w) else self._plain(w) for w in text.split()])

    def encode_spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text with each token's first and last code point."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(found.offsets, np.int64).reshape(-1, 2)
        return np.array(found.ids, np.int64), spans[:, 0], spans[:, 1]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode with special tokens shown; ids outside the vocabulary are left out."""
        if self.decoder is not None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        names = self.names
        try:
            return " ".join([names[i] for i in ids])
        except IndexError:
            return " ".join([names[i] for i in ids if i < len(names)])


@functools.lru_cache(maxsize=4)
def coder(path: str) -> WordCoder:
    """The worker's coder for a vocabulary; tasks of one worker share its cache."""
    return WordCoder(path)
