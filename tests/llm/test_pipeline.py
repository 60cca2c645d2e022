"""The pipeline stage by stage against brute force on small documents."""

import hashlib

import corpus
import public_tokenizers
from pyspark.sql import functions as F
from test_repeats import without_chunks
from test_similar import first_rows
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import mixing, quality

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, docs, tmp_path):
    columns, current = docs.columns, docs
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "mixing", "BPE encoding"]

    def step(name):
        out = stage[name](spark, current, "unused")
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        return spark.read.parquet(str(tmp_path / name.replace(" ", "_")))

    kept = step("quality rules")
    good = {(r.doc_id, r.n_words) for r in quality.score(docs, quality.references(docs)).filter("kept").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {d for d, _ in good}
    current = kept
    single = step("n-gram Jaccard join")
    assert rows_of(single) == first_rows([tuple(r) for r in kept.collect()], 5, 80) and single.count() < kept.count() - 3
    current = single
    cut = step("substring dedup")
    before = [tuple(r) for r in single.collect()]
    wanted = [(r[0], t, *r[2:4], None if t is None else len(t), *r[5:]) for r, t in zip(before, without_chunks(before))]
    assert rows_of(cut) == sorted(wanted, key=repr) and wanted != before
    current = cut
    mixed = step("mixing")
    assert mixed.columns == columns
    assert mixed.count() == mixing.plan(cut).agg(F.sum("copies")).first()[0]
    current = mixed
    encoded = step("BPE encoding")
    ids = [LIBRARY.encode(r.text or "", add_special_tokens=False).ids for r in mixed.collect()]
    found = sorted((r.n_tokens, list(r.ids), r.ids_sha256, r.decoded_sha256) for r in encoded.collect())
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found == sorted((len(i), i, digest(" ".join(map(str, i))), digest(LIBRARY.decode(i, skip_special_tokens=False))) for i in ids)


def test_empty_documents(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "unused")
        assert out.collect() == []


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and out.filter("n_tokens <> size(ids)").count() == 0
    assert corpus.SCHEMA.fieldNames()[:5] == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").columns
