"""The corpus pipeline: five stages over ``documents``, each by one operator of ``verlog.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared
folder and reads it back as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verlog.llm import bpe, decontaminate, ngram_join, pii, toxicity
from verlog.llm.common import cut, drop_cut, table
from verlog.llm.queries import HELD_OUT, PATTERN, RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the lexicon and the model are learned from the labelled documents of ``docs``."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), train=~F.expr(HELD_OUT))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one of the smallest doc_id stays."""
    return ngram_join.keep_one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly such passages goes."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.encode_documents(docs, RANKS, PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("pii", redact_personal_data),
    ("byte_bpe", encode),
]

#: The stages hold learned models, an automaton and a tokenizer, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote goes when the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = cut(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_cut(spark, before)
        before = docs
    return docs
