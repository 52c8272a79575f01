"""Tagging comments by aspect, rolling reviews up and taking them apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.functions.text import aspects_of, collapse_space
from aspectra.plans.constants import KEYWORDS, UNIT_PATTERNS


def unclassified(comments: DataFrame, text: str = "comment_text", aspects: str = "aspects") -> DataFrame:
    """Comments without tags of at least three characters; only spaces are trimmed."""
    return comments.where(F.col(aspects).isNull() & (F.length(F.trim(F.col(text))) >= 3))


def with_review(dims: DataFrame, review: str = "user_review") -> DataFrame:
    return dims.where(F.trim(F.col(review)) != "")


def tag(comments: DataFrame, text: str, keywords: dict[str, list[str]] = KEYWORDS, units: dict[str, list[str]] = UNIT_PATTERNS) -> DataFrame:
    return comments.withColumn("aspects", aspects_of(F.col(text), keywords, units))


def aspect_histogram(tagged: DataFrame) -> DataFrame:
    """(aspect, n): in how many comments each aspect occurs."""
    return tagged.select(F.explode(F.map_keys("aspects")).alias("aspect")).groupBy("aspect").agg(F.count("*").alias("n"))


def aspect_coverage(tagged: DataFrame) -> DataFrame:
    """(n_unmatched, n_unprocessed): comments without a hit, and not tagged at all."""
    return tagged.agg(F.count_if(F.size("aspects") == 0).alias("n_unmatched"), F.count_if(F.col("aspects").isNull()).alias("n_unprocessed"))


def with_product(comments: DataFrame, videos: DataFrame, video: str = "video_id", product: str = "product_id") -> DataFrame:
    """Comments with the product of their video; those of unknown videos, or of videos without a product, are left out."""
    return comments.join(videos.where(F.col(product).isNotNull()).select(video, product), video)


def roll_up(comments: DataFrame, product: str, comment: str, text: str) -> DataFrame:
    """(product, aspect, total, comments): texts in order of the comment id, null texts kept.

    A review is one row by nature: its texts meet in that row.
    """
    each = comments.where(F.col(product).isNotNull()).select(product, comment, text, F.explode(F.map_keys("aspects")).alias("aspect"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(comment), F.col(text))))
    grouped = each.groupBy(product, "aspect").agg(F.count("*").alias("total"), rows.alias("_rows"))
    return grouped.select(product, "aspect", "total", F.transform("_rows", lambda r: r[text]).alias("comments"))


def apply_reviews(dims: DataFrame, rolled: DataFrame, aspect: str, product: str = "product_id") -> DataFrame:
    """The aspect's table with new reviews as JSON; products without matches keep the old one."""
    new = rolled.where(F.col("aspect") == aspect).select(product, F.to_json(F.struct("total", "comments")).alias("_new"))
    return dims.join(new, product, "left").withColumn("user_review", F.coalesce("_new", "user_review")).drop("_new")


def comment_text(element: Column) -> Column:
    """Text of one element of a review's JSON list, given as variant; blank becomes null."""
    as_text = F.try_variant_get(element, "$", "string")
    inner = [F.nullif(F.try_variant_get(element, f"$.{k}", "string"), F.lit("")) for k in ("comment_text", "text", "comment")]
    is_object = F.schema_of_variant(element).startswith("OBJECT")
    return F.nullif(collapse_space(F.when(is_object, F.coalesce(*inner)).otherwise(as_text)), F.lit(""))


def explode_reviews(dims: DataFrame, keys: list[str], review: str = "user_review") -> DataFrame:
    """(keys, list_index, chunk_text) of all non-blank comments; blank ones use up their index.

    Reviews that are blank or not JSON objects are skipped.
    """
    payload = F.try_parse_json(review)
    listed = with_review(dims, review).select(*keys, F.try_variant_get(payload, "$.comments", "array<variant>").alias("_list"))
    each = listed.select(*keys, F.posexplode("_list").alias("list_index", "_one"))
    return each.select(*keys, "list_index", comment_text(F.col("_one")).alias("chunk_text")).where("chunk_text is not null")
