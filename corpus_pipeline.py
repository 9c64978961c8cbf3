"""Corpus preparation: STAGES are applied in order, each to all rows its predecessor kept.

Documents of no accepted language go, then exact copies, then near copies (one document of each
group stays); the sources are mixed to their weights, documents being repeated or left out; the
last stage encodes what is left.  Each stage is an operator of ``sluicegate.llm`` over whole
texts; ``run`` writes the rows of a stage to the shared folder and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluicegate.llm import chunk_bpe, exact_dedup, lang_id, mixing, superminhash
from sluicegate.llm.base import table, written


def accepted_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.drop_rejected(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; such a pair shares no band with a chance of 2e-9."""
    return superminhash.drop_near_copies(docs, k=5, percent=80, bands=50, rows=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document as often as the mix holds it."""
    return chunk_bpe.encoded(docs).drop("decoded")


STAGES = [
    ("language ID", accepted_language),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i + 1}")
    return docs


#: Language models, near copies and the tokenizer are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None
