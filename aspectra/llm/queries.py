"""One thin query per corpus operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.llm.chat_format import formatted_digest
from aspectra.llm.embedding_dedup import dedup_vectors
from aspectra.llm.filter_audit import audit_filters
from aspectra.llm.language_id import identify_languages, train_languages
from aspectra.llm.licenses import scan_licenses
from aspectra.llm.lm_score import score_documents
from aspectra.llm.mixing import mix_sources
from aspectra.llm.near_dedup import near_duplicate_classes
from aspectra.llm.packing import pack_documents, packed_digest
from aspectra.llm.quality import judge_quality, train_quality
from aspectra.llm.sharding import assign_shards, shuffle_records
from aspectra.llm.spelling import spelling_variants
from aspectra.llm.token_files import read_token_files, write_token_files
from aspectra.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string"
    )
    return formatted_digest(rows.unionByName(more))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_files(spark, write_token_files(docs))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written = shuffle_records(docs)
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    text = F.coalesce(text, F.lit(""))
    digest = written.select(doc_id.alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "_bucket", "_pos")
    return assign_shards(digest).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_vectors(table(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_every=97)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    models = train_languages(docs.select("doc_id", "text", "lang"), ~held_out)
    return identify_languages(docs.select("doc_id", "text"), models).withColumn("held_out", held_out)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit_filters(docs, table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_chat_format": op2_chat_format,
        "op3_mixing": op3_mixing,
        "op4_lm_score": op4_lm_score,
        "op5_quality_rules": op5_quality_rules,
        "op6_token_files": op6_token_files,
        "op7_sharding": op7_sharding,
        "op8_packing": op8_packing,
        "op9_licenses": op9_licenses,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_language_id": op12_language_id,
        "op13_filter_audit": op13_filter_audit,
    }
