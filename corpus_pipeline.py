"""The corpus pipeline: quality rules, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. run() writes every stage's rows and reads them back for the next.

Cases: a null or empty text fails the quality rules; documents with null ids
are told apart by their texts; repeated rows are one document to near-dedup, and
come as often as the mix takes that one; of equal texts under several ids the
smallest id stays; very long texts are judged, mixed and packed whole; an empty
table gives no rows; other columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aspectra.llm.common import stored
from aspectra.llm.mixing import mixed_documents
from aspectra.llm.near_dedup import drop_near_duplicates
from aspectra.llm.packing import pack_documents, packed_digest
from aspectra.llm.quality import keep_quality, train_quality
from aspectra.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the limits and the classifier learnt from labelled rows among them."""
    return keep_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


#: Pieces of text whose ids a worker keeps: fewer than where packing is all a worker does.
CACHED_PIECES = 400_000


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packed_digest(pack_documents(docs, cached=CACHED_PIECES))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: The classifier, signatures and tokenizer have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
