"""Planning and recording of media collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.functions.text import blank_to_null
from aspectra.operators.dedup import sequential_ids
from aspectra.plans.constants import MIN_VIDEOS


def comments_of_info(info: DataFrame, keys: list[str], comments: str = "comments") -> DataFrame:
    """(keys, comment_text, user_name): comments with text, trimmed; blank authors become null."""
    each = info.select(*keys, F.explode(comments).alias("_c")).where(F.coalesce(F.col("_c.text"), F.lit("")) != "")
    return each.select(*keys, F.regexp_replace("_c.text", r"(?U)^\s+|\s+$", "").alias("comment_text"), blank_to_null(F.col("_c.author")).alias("user_name"))


def unknown_urls(found: DataFrame, known: DataFrame, url: str) -> DataFrame:
    """Rows whose URL is not stored; rows without one are not known either."""
    return found.join(known.select(url), url, "left_anti")


def insert_if_absent(existing: DataFrame, found: DataFrame, url: str, order: str) -> DataFrame:
    """Videos to append: first of their URL in the batch, URL not stored."""
    first = found.groupBy(url).agg(F.min(order).alias(order))
    return found.join(first, [url, order], "left_semi").join(existing.select(url), url, "left_anti")


def with_videos(products: DataFrame, videos: DataFrame, product: str, name: str) -> DataFrame:
    """Distinct names of products that have a video."""
    return products.join(videos.select(product), product, "left_semi").select(name).distinct()


def top_up_plan(products: DataFrame, videos: DataFrame, completed: DataFrame, product: str, name: str, order: str, least: int = MIN_VIDEOS) -> DataFrame:
    """(name, phase, n_videos, place): completed products short of videos by name, then new ones in file order."""
    counts = videos.groupBy(product).agg(F.count("*").alias("n_videos"))
    done = completed.select(name, F.lit(True).alias("_done")).distinct()
    counted = products.join(counts, product, "left").join(done, name, "left").withColumn("n_videos", F.coalesce("n_videos", F.lit(0)))
    phase = F.when(F.col("_done").isNotNull(), F.lit("top-up")).otherwise(F.lit("fresh"))
    plan = counted.withColumn("phase", phase).where((F.col("phase") == "fresh") | (F.col("n_videos") < least))
    first = F.col("phase") == "top-up"
    keyed = plan.select(
        product, name, "phase", "n_videos", (~first).cast("int").alias("_late"), F.when(first, F.col(name)).alias("_by_name"), F.when(first, F.col(product)).alias("_by_id"), F.when(~first, F.col(order)).alias("_by_order")
    )
    placed = sequential_ids(keyed, ["_late", "_by_name", "_by_id", "_by_order"], "place")
    return placed.select(product, name, "phase", "n_videos", "place")
