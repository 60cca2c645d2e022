"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from tallyloom.llm import bpe_tree, chunks, dac, jaccard, langid, licenses, mixing, periodic, pii, pivots, quality, suffix, whitening
from tallyloom.llm.ship import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The public vocabulary of the queries on token ids.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its equivalent SQL if there is one."""

    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op3_bpe_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    encoded = bpe_tree.encode(table(spark, folder, "documents"), TOKENIZER, decoded="decoded")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op4_directly_addressable(spark: SparkSession, folder: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the files."""
    stored = dac.write(table(spark, folder, "documents"), TOKENIZER, end_id=2)
    return dac.read(stored).select(
        "doc_id", "start", F.col("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    )


@query()
def op2_divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of every document, judged by references of the same documents."""
    docs = table(spark, folder, "documents")
    scored = quality.score(docs, quality.references(docs))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return scored.select(*first, "nearest", "class_distance", "word_distance")


@query()
def op8_language_bitmasks(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from those that aren't held out."""
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query()
def op10_positional_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Places of licence phrases and licence labels of every document."""
    docs = table(spark, folder, "documents")
    found = licenses.find_licenses(docs, licenses.weigh(docs, licenses.template_index()))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query()
def op9_entropy_balancing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes from every document."""
    found = mixing.plan(table(spark, folder, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return found.select("doc_id", "size", "source_size", "target", taken, "rate", "copies")


@query()
def op1_gear_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """What content-defined chunking removes from every document."""
    found = chunks.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op7_pivot_permutations(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors."""
    return pivots.near_duplicates(table(spark, folder, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query()
def op5_prefix_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of similar shingle sets."""
    return jaccard.similar_components(table(spark, folder, "documents"))


@query()
def op6_deep_shallow(spark: SparkSession, folder: str) -> DataFrame:
    """What the removal of strings that occur again leaves of every document."""
    found = suffix.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op11_semi_markov(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: matches of the base patterns, and those with the field's spans."""
    docs = table(spark, folder, "documents")
    found = pii.find(docs, pii.train(docs))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE_KINDS]
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", *(s[n].cast("string") for n in ("kind", "start", "end")))), ",")
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text); every tenth by the checksum of its id repeats its words from a place on, as the query asks."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", checksum.alias("h")).withColumn("g", F.expr("h div 10"))
    words = words.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    words = words.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    words = words.withColumn("p", F.when(F.col("n") > 0, F.expr("cast(1 + (n - a) div (3 + g % 8) as int)")))
    again = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[a + (i - a) % p])), ' ')")
    return words.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


@query()
def op12_internal_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, and digests of them and of the words left."""
    found = periodic.find_runs(planted_runs(table(spark, folder, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[n].cast("string") for n in ("start", "length", "period"))))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


@query()
def op13_jacobi_davidson(spark: SparkSession, folder: str) -> DataFrame:
    """Leading whitened components of every vector."""
    rows = table(spark, folder, "embeddings")
    return whitening.whiten(rows, whitening.fit(rows))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline on the documents."""
    return corpus_pipeline.run(spark, folder)
