"""Small documents with every awkward case, for the tests of this folder."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns whose names the operators use themselves
    *(T.StructField(n, T.StringType()) for n in ("id", "key", "size", "n_bytes", "ids", "kept", "spans", "__id", "component")),
])


def rows(seed: int = 7, n: int = 90) -> list[tuple]:
    rng = random.Random(seed)
    syllables = {"en": ["the", "ing", "and", "tion", "er", "th", "ou"], "fr": ["é", "eau", "le", "qu", "oi", "ment", "ç"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))
    prose = lambda lang, k: " ".join(word(lang) for _ in range(k))
    passage = prose("en", 70)
    texts = []
    for k in range(n):
        lang = "fr" if k % 3 == 0 else "en"
        text = prose(lang, rng.randint(1, 160))
        if k % 6 == 1:
            text = f"{text[: len(text) // 2]} {passage} {text[len(text) // 2 :]}"
        if k % 9 == 2:
            text += "\nThis is under the MIT License, or the Apache License, version 2.0; cc-by-nc too.\nUnder THE mit\nlicense"
        texts.append((text, lang))
    near = prose("en", 150).split()
    for k in range(8):  # near copies, at and about the limits
        copy = list(near)
        for at in rng.sample(range(150), k // 2):
            copy[at] = "changed"
        texts.append((" ".join(copy), "en"))
    texts += [(texts[0][0], "fr")] * 4 + [(texts[1][0], "en")] * 3
    texts += [(None, "en"), ("", "fr"), (" \n\t ", None), ("one", "en"), ("two words", None), ("!!! ### |||", "en"), ("é" * 700, "fr")]
    texts += [("x" * 3000 + " " + "ab" * 900, "en"), (prose("en", 9000), "en"), ("line of words\n" * 40, "en"), ("😀 İ Σ <|endoftext|> it's 12345 中文", "en")]
    out = [(k, t, lang, None if k % 11 == 5 else f"s{k % 4}", None if t is None else len(t)) for k, (t, lang) in enumerate(texts)]
    out += [out[3], out[3], (None, texts[4][0], "en", "s1", 5), (out[5][0], "other text of the same id", "en", "s2", 4)]
    rng.shuffle(out)
    return [(*r, "x", "x", "x", "x", "x", "x", "x", "x", "x") for r in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
