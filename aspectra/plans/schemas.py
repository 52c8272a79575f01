"""Schemas of the star model and of the files around it."""

from __future__ import annotations

from pyspark.sql import types as T

from aspectra.plans.constants import ASPECTS


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TEXT, INT, NTZ = T.StringType(), T.IntegerType(), T.TimestampNTZType()

FACT_PRODUCT = _struct(product_id=INT, product_name=TEXT, os_version=TEXT, language_support=TEXT, price=INT, picture_url=TEXT, created_at=NTZ)
VIDEO = _struct(video_id=INT, product_id=INT, youtube_url=TEXT, s3_audio_path=TEXT, s3_transcript_path=TEXT, s3_comments_path=TEXT, raw_transcript=TEXT, created_at=NTZ)
COMMENT = _struct(comment_id=INT, video_id=INT, comment_text=TEXT, user_name=TEXT, aspects=T.MapType(TEXT, INT), created_at=NTZ)
COMMENT_EMBEDDING = _struct(
    chunk_id=INT, dim_id=INT, dim_table=TEXT, list_index=INT, chunk_index=INT, chunk_text=TEXT, embedding=T.ArrayType(T.FloatType()), created_at=NTZ
)
PRODUCT_LINK = _struct(product_name=TEXT, url=TEXT, price_vnd=INT, price_str=TEXT, image=TEXT, slug=TEXT)
USER_REVIEW = _struct(total=T.LongType(), comments=T.ArrayType(TEXT))


def dim_schema(aspect: str) -> T.StructType:
    """The one-to-one table of an aspect."""
    if aspect not in ASPECTS:
        raise ValueError(f"unknown aspect {aspect!r}; known: {', '.join(ASPECTS)}")
    specs = {column: TEXT for column in ASPECTS[aspect][1]}
    return _struct(dim_id=INT, product_id=INT, **specs, youtuber_review=TEXT, user_review=TEXT, last_updated=NTZ)


def spec_record_schema() -> T.StructType:
    """One scraped record: the product and a struct for each aspect."""
    fact = _struct(product_name=TEXT, os_version=TEXT, language_support=TEXT)
    dims = {name: _struct(**{c: TEXT for c in columns}) for name, columns in ASPECTS.values()}
    return _struct(_source_url=TEXT, fact_product=fact, **dims, id=TEXT, reference_id=TEXT, search_query_name=TEXT)
