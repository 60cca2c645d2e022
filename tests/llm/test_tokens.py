"""Tree-concatenated BPE and directly addressable files against the tokenizers library."""

import random
import zlib

import corpus
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import bpe_tree, dac
from tallyloom.llm.words import coder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", [1, 2])
def test_words_equal_library(seed):
    rng = random.Random(seed)
    signs = "abcA'sStrellmd.,;!?  \n\t<|>éàßÜσΣİı中文́  ²½_-3|ªº😀가ͅ\x00\x7f\xad\x1c\x85"
    for k in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        if k % 5 == 0:
            text = text[:9] + rng.choice(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"]) + text[9:]
        found = np.frombuffer(coder(PATH).encode(text.encode()), "<u4").tolist()
        assert found == ids_of(text), text
        assert coder(PATH).decode(found) == LIBRARY.decode(found, skip_special_tokens=False)


@pytest.mark.parametrize("window,border", [(40, 64), (96, 256)])
def test_tree_equals_library(monkeypatch, window, border):
    monkeypatch.setattr(bpe_tree, "WINDOW", window)
    monkeypatch.setattr(bpe_tree, "BORDER", border)
    rng, words = random.Random(window), coder(PATH)
    some = ["the", "l'été", "can't", "WORLD", "<|endoftext|>", "!!!'s", "'re", "....", "中文字", "한국어", "á̂", "123", "\n", "''''", "<|end", "İ"]
    for k in range(250):
        n = rng.randint(1, 300)
        text = [
            "".join(rng.choice("abcdeéèst") for _ in range(n * 3)),  # no white space at all
            "".join(rng.choice(some) + rng.choice(["", "", " "]) for _ in range(n // 4 + 1)),
            "".join(rng.choice("abcA'sSt.,!?  \n<|>éß中́가ᅡ😀-3") for _ in range(n * 2)),
            "ab" * n + "!" * rng.randint(0, 300) + "'s" + "x" * n,
        ][k % 4]
        at = bpe_tree.halves(len(text), rng.choice([50, 100, 300]))
        encoded = [np.frombuffer(words.encode(text[a:b].encode()), "<u4").astype(np.int64) for a, b in at]
        leaves = [bpe_tree.part_of(words, text, a, b, ids) for (a, b), ids in zip(at, encoded)]
        assert bpe_tree.join_tree(words, text, leaves).tolist() == ids_of(text), text


def test_halves_cover():
    assert bpe_tree.halves(0, 10) == [(0, 0)]
    assert bpe_tree.halves(100, 30) == [(0, 25), (25, 50), (50, 75), (75, 100)]


def test_encode_and_decode(docs, empty):
    out = bpe_tree.decode(bpe_tree.encode(docs, PATH, leaf=500), PATH)
    found = sorted(((r.doc_id, list(r.ids), r.decoded) for r in out.collect()), key=repr)
    wanted = [(r[0], ids_of(r[1]), LIBRARY.decode(ids_of(r[1]), skip_special_tokens=False)) for r in corpus.rows()]
    assert found == sorted(wanted, key=repr)
    assert bpe_tree.encode(empty, PATH).collect() == []


@pytest.mark.parametrize("high", [1, 200, 70_000, 1 << 32])
def test_random_access(high):
    rng = np.random.default_rng(high)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, high, n).astype(np.uint32)
        segment = dac.Segment.from_bytes(dac.Segment(dac.split_levels(ids)).to_bytes())
        places = rng.permutation(n)
        assert (segment.at(places) == ids[places]).all()
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (segment.run(a, b) == ids[a:b]).all()


def test_files_read_back(docs, empty, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT", 500)  # reaches the tasks with the writer's code only in one process
    manifest = dac.write(docs, PATH, end_id=2)
    rows = sorted(((r.doc_id, r.start, r.n_tokens, r.ids) for r in dac.read(manifest).collect()), key=lambda r: r[1])
    wanted = [(r[0], np.array([*ids_of(r[1]), 2], "<u4").tobytes()) for r in corpus.rows()]
    assert sorted(((r[0], r[3]) for r in rows), key=repr) == sorted(wanted, key=repr)
    ids = [r[0] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))  # nulls first
    assert [r[1] for r in rows] == np.cumsum([0, *(r[2] for r in rows)])[:-1].tolist()
    file, whole = manifest.orderBy("shard").first().file, np.frombuffer(rows[0][3], "<u4")
    assert dac.DacFile(file).token(len(whole) - 1) == 2
    assert zlib.crc32(rows[0][3]) == zlib.crc32(whole.tobytes())
    assert dac.read(dac.write(empty, PATH, end_id=2)).collect() == []
