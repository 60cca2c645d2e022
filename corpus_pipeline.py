"""A training-data pipeline: documents in, token ids out.

Each stage takes (session, documents, folder of the tables) and returns a DataFrame that is written and read again as the
next one's documents. All stages but the last return the columns of documents:

1. quality rules: documents that fail the base rules or diverge from all language references go;
2. n-gram Jaccard join: of each group of similar documents (5-word shingles, 80 %) the one of the smallest id stays;
3. substring dedup: passages that a document of smaller id has go from the text, and n_chars follows;
4. mixing: documents are repeated or left out so that sources come to their target weights;
5. BPE encoding: one row per document of the mix with its ids, their number and digests of ids and decoded text.

Results: a null or empty text fails the base rules and goes in the first stage. Documents of null id take part in all stages
and come behind the others where one of a group stays; of equal rows one stays; rows of equal id and other texts count as one
document when similar ones are sought. Copies that the mix makes are rows of their own. A null source is a source like others.
Texts are whole at every length. An empty table gives an empty result of each stage. Columns beyond those of documents stay up
to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.core import written
from tallyloom.llm import bpe_tree, chunks, jaccard, mixing, quality
from tallyloom.llm.ship import ship_package

#: The public vocabulary of the last stage.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Words of a shingle and least similarity in per cent of the second stage; op5_prefix_tree has limits of its own.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: SQL can express neither the rules nor the vocabulary; the tests compare with brute force.
ORACLE_SQL = None


def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.keep(docs, quality.references(docs))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard.first_of_each(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    cut = chunks.dedup(docs, prefix="__")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    encoded = bpe_tree.encode(docs, TOKENIZER, decoded="decoded")
    return encoded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", keep_by_quality), ("n-gram Jaccard join", keep_one_of_similar), ("substring dedup", remove_passages),
    ("mixing", mix_sources), ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
