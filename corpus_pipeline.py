"""Training-data pipeline over ``documents``: five stages, each one operator of the ``llm`` subpackage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept; the first four return the columns of
``documents``. Stage 1 drops documents without an identified language, stage 2 leaves one document of each group of near
duplicates (five-word shingles, similarity 0.8), stage 3 cuts words under repeated 35-word windows out of the texts, stage
4 drops documents with a ten-word window of the benchmark, stage 5 encodes the texts and decodes them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, decontaminate, language_id, minhash_dedup, substring_dedup
from pagewright.llm._shared import read, small_batches, write_table
from pagewright.llm.queries import vocabulary

#: Least share of the best language. Only texts that look like no or like several languages alike stay below.
LEAST_SCORE = 0.3
#: An executor runs all stages one after another and keeps what the largest of them took, so fewer rows go to Python at a time here.
BATCH_ROWS = "500"


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH_ROWS)
    return language_id.keep_identified(docs, language_id.learn(docs), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH_ROWS)
    return minhash_dedup.keep_first(docs, width=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH_ROWS)
    return substring_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH_ROWS)
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH_ROWS)
    out = bpe.round_trip(docs, vocabulary(), carry=["lang", "source"])
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("language_id", identify),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("bpe", tokens),
]

#: Models and byte-pair codes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH_ROWS)
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_table(docs, name)
    return docs
