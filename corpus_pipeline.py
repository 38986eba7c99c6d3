"""Documents to training tokens: the stages of a corpus pipeline, each an operator of ``featurelens.llm``.

A stage takes the session, the documents that its predecessor kept and the folder of the tables, and
returns documents with the columns of the table; the last returns tokens.  ``run`` writes each stage's
result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelens.llm import bpe, exact_dedup, mixing, ngram_join, quality
from featurelens.llm.common import stored, table
from featurelens.llm.queries import KEEP, vocabulary


#: Near duplicates: shingles of five words, similarity of 0.8 or more (op4's query has its own 4 and 85).
NEAR = {"k": 5, "percent": 80}


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones outside the test fold, accepts."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.where(F.col("score") >= KEEP).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of largest id."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id."""
    return ngram_join.keep_one(docs, **NEAR)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source's words come near its target."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_tokens`` and ``ids`` of each document of the mix."""
    path, pattern = vocabulary()
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies),
          ("mixing", mixed_sources), ("tokens", tokens)]

#: The classifier and the tokenizer are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
