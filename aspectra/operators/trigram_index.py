"""Fuzzy search of many queries in a large catalogue, by trigram postings.

A name is indexed under its rarest trigrams only. Two sets of similarity t or
more (shared over all) share a trigram among the first n - ceil(t n) + 1 of
each, in any order common to both; in order of rarity those are the ones with
the shortest postings. Candidates meet through them under the size filter, and
each is verified once by its whole sets: no name is compared with a query that
it shares no such trigram with, and of many names alike one is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions.text import trigrams
from aspectra.plans.constants import SEARCH_LIMIT, TRIGRAM_THRESHOLD


def _prefixes(sets: DataFrame, key: str, rarity: DataFrame, threshold: float) -> DataFrame:
    """(gram, key, size): the rarest trigrams of each set, as many as the threshold asks for."""
    size = F.size("grams")
    each = sets.select(key, size.alias("size"), F.explode("grams").alias("gram")).join(rarity, "gram", "left")
    ranked = each.groupBy(key, "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("by"))
    kept: Column = (F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    return ranked.select(key, "size", F.explode(F.slice("by", F.lit(1), F.greatest(F.lit(0), F.least(kept, F.col("size"))))).alias("b")).select("b.gram", key, "size")


def trigram_candidates(names: DataFrame, queries: DataFrame, key: str, name: str, query_key: str, query: str, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """(query_key, key) of the pairs that may be of similarity above the threshold; nothing is lost."""
    sets, asked = (df.select(k, trigrams(F.col(c)).alias("grams")).where(F.size("grams") > 0) for df, k, c in ((names, key, name), (queries, query_key, query)))
    return _candidates(sets, asked, key, query_key, threshold)


def _candidates(sets: DataFrame, asked: DataFrame, key: str, query_key: str, threshold: float) -> DataFrame:
    rarity = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    left = _prefixes(asked, query_key, rarity, threshold).withColumnRenamed("size", "asked")
    right = _prefixes(sets, key, rarity, threshold)
    like = (F.col("size") >= F.col("asked") * F.lit(threshold)) & (F.col("asked") >= F.col("size") * F.lit(threshold))
    return left.join(right, "gram").where(like).select(query_key, key).distinct()


def search_trigrams(names: DataFrame, queries: DataFrame, key: str, name: str, query_key: str, query: str, threshold: float = TRIGRAM_THRESHOLD, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(query_key, key, name, similarity, rank): for each query the most similar names above the threshold, as one search gives them.

    Names of the same trigrams are as similar to any query, so that they and the
    queries of the same trigrams meet once, as a class each. Of a class only the
    `limit` smallest keys can stand among a query's first; they alone are ranked.
    Keys must be unique on both sides, and must not be null; a query or a name
    without trigrams finds nothing.
    """
    members, askers = (
        df.select(*columns, F.array_sort(trigrams(F.col(text))).alias("_grams")).where(F.size("_grams") > 0).withColumn("_class", F.sha2(F.to_json("_grams"), 256))
        for df, columns, text in ((names, (key, name), name), (queries, (query_key,), query))
    )
    first = Window.partitionBy("_class").orderBy(key)
    held = members.select("_class", key, name).withColumn("_copy", F.row_number().over(first)).where(F.col("_copy") <= limit).drop("_copy")
    sets, asked = (df.groupBy("_class").agg(F.first("_grams").alias("grams")) for df in (members, askers))
    sets, asked = sets.withColumnRenamed("_class", "_n"), asked.withColumnRenamed("_class", "_q")
    found = _candidates(sets, asked, "_n", "_q", threshold)
    both = found.join(asked.withColumnRenamed("grams", "_a"), "_q").join(sets.withColumnRenamed("grams", "_b"), "_n")
    shared = F.size(F.array_intersect("_a", "_b"))
    scored = both.select("_q", "_n", (shared / (F.size("_a") + F.size("_b") - shared)).alias("similarity")).where(F.col("similarity") > threshold)
    best = Window.partitionBy("_q").orderBy(F.desc("similarity"), key)
    each = scored.join(held.withColumnRenamed("_class", "_n"), "_n").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return askers.select(query_key, F.col("_class").alias("_q")).join(each, "_q").select(query_key, key, name, "similarity", "rank")
