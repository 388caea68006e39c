"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard join, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame, which is
written as Parquet and read again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationfill.llm import language_id
from stationfill.llm.common import Scratch, small_batches, table
from stationfill.llm.exact_dedup import dedup, digest_of
from stationfill.llm.jaccard_join import similarity_components
from stationfill.llm.packing import pack
from stationfill.llm.suffix_dedup import without_repeated_passages

#: No SQL: a trained model, components of a similarity join and a tokenizer decide. The tests hold run() and every stage against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the model tells from the others, go."""
    small_batches(spark)
    model = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    return language_id.with_language(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one row stays: of the smallest doc_id, of any of its rows where they repeat."""
    rows = dedup(docs).filter("kept").groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).count()
    rows = Scratch(spark, "kept").save(rows, "rows")
    docs = docs.withColumn("_text_digest", digest_of(F.col("text")))
    same = (F.col("_text_digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    once = docs.hint("merge").join(rows.filter("count = 1"), same, "left_semi")
    more = rows.filter("count > 1")
    if not more.isEmpty():
        once = once.unionByName(docs.join(more, same, "left_semi").dropDuplicates(["_text_digest"]))
    return once.drop("_text_digest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that chains of five-word-shingle similarity 0.8 connect, the smallest doc_id stays.

    Rows of one doc_id are one document. A row without doc_id takes no part and stays.
    """
    small_batches(spark)
    found = similarity_components(docs.filter("doc_id is not null"), width=5, num=80, den=100)
    gone = found.filter("doc_id <> component_id").select("doc_id")
    return docs.hint("merge").join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words, of any length in bytes, that also occur elsewhere are cut out of the texts; every document stays."""
    small_batches(spark)
    cut = without_repeated_passages(docs, n_words=50)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids."""
    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, last_id=2)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
