"""From raw documents to a store of token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.decontamination import drop_contaminated
from loomline.llm.language import keep_identified, train_language_model
from loomline.llm.mixing import mixed_documents
from loomline.llm.neardup import near_duplicates
from loomline.llm.scratch import durable, may_match, new_path
from loomline.llm.store import read_digests, write_store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the model, learned from the labelled ones, tells with a score of a half or more."""
    return keep_identified(docs, train_language_model(docs))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles at a similarity of 0.8 or more.

    A row goes by its id and its text together, so another text under a repeated id stays; rows with a null id stay, and equal rows stay or go together.
    """
    found = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_text")).distinct()
    gone = durable(found, "pipeline-gone")
    marked, text = may_match(docs, F.col("doc_id"), gone, "gone"), F.xxhash64(F.col("text").cast("string"))
    asked = marked.where("may_match").join(gone.hint("merge"), (F.col("doc_id") == F.col("gone")) & (text == F.col("gone_text")), "left_anti")
    return marked.where("not may_match").unionByName(asked).select(*docs.columns)  # only texts under an id that may go are shuffled


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample the documents so that the sources' words meet their targets."""
    return mixed_documents(docs)


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token ids of the mix as a content-addressed store and return each document's digest, read back."""
    path = new_path(spark, "pipeline-store")
    write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, path).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_store", token_store),
]

#: Models, sketches and tokenizers are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and reread before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
