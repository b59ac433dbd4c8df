"""The corpus pipeline: toxicity, exact copies, near copies, mixing, byte-level BPE.

Each stage works on all rows that the one before kept and its decisions take effect: rejected and
duplicate documents are gone, the mix repeats and cuts documents, and the last stage gives the
token ids' digests of every mixed row. All stages but the last return the columns of documents.

Stages handle empty tables, nulls and repeated rows as their operators' modules say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stepwright.llm.bpe import round_trip
from stepwright.llm.common import release, settle
from stepwright.llm.exact_dedup import drop_exact_duplicates
from stepwright.llm.mixing import mix_documents
from stepwright.llm.near_copies import drop_near_copies
from stepwright.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labels of sf_dir; documents it calls toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies (5-word shingles, Jaccard 0.8 at least) stays;
    SimHash with pivots finds the first of them, see near_copies.py."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the mix takes them; every source ends at its target."""
    return mix_documents(docs, exact=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: A trained classifier and a tokenizer are not SQL; tests/llm hold the stages to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written as Parquet and read again.

    What a stage leaves in the shared folder, and its input, goes once its result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        made = settle(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        docs = before = made
    return STAGES[-1][1](spark, docs, sf_dir)
