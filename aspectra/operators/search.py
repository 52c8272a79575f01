"""Product lists, fuzzy search and vector search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions.text import conditional_ilike, similarity
from aspectra.functions.vectors import cosine_distance, distance_to
from aspectra.operators.dedup import distinct_texts
from aspectra.plans.constants import ASPECTS, LIST_LIMIT, OVER_FETCH, SEARCH_LIMIT, TOP_K, TRIGRAM_THRESHOLD


def check_aspect(aspect: str) -> str:
    """The aspect's table, or ValueError."""
    if aspect not in ASPECTS:
        raise ValueError(f"unknown aspect {aspect!r}; known: {', '.join(ASPECTS)}")
    return ASPECTS[aspect][0]


def list_products(products: DataFrame, max_price: float | None = None, brand: str | None = None, name: str = "product_name", price: str = "price", tie: str = "product_id", limit: int = LIST_LIMIT, brand_column: str | None = None) -> DataFrame:
    """Dearest first, unknown prices before all; a brand of '' is ignored, a price of 0 finds nothing."""
    out = products
    if brand:
        out = out.where(conditional_ilike(F.col(brand_column or name), brand))
    if max_price is not None:
        out = out.where((F.col(price) <= F.lit(max_price)) & (F.col(price) > 0))
    return out.orderBy(F.col(price).desc_nulls_first(), F.col(tie)).limit(limit)


def search_trigram(products: DataFrame, query: str, name: str = "product_name", tie: str = "product_id", threshold: float = TRIGRAM_THRESHOLD, limit: int = SEARCH_LIMIT) -> DataFrame:
    scored = products.withColumn("similarity", similarity(F.col(name), F.lit(query)))
    return scored.where(F.col("similarity") > threshold).orderBy(F.desc("similarity"), tie).limit(limit)


def search_ilike(products: DataFrame, query: str, name: str = "product_name", tie: str = "product_id", limit: int = SEARCH_LIMIT) -> DataFrame:
    return products.where(conditional_ilike(F.col(name), query)).orderBy(name, tie).limit(limit)


def present_specs(row: DataFrame, columns: list[str]) -> DataFrame:
    """The row's columns as a map without its nulls, as `specs`; empty strings stay."""
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))
    return row.withColumn("specs", F.map_filter(pairs, lambda k, v: v.isNotNull()))


def specs_of(dims: DataFrame, product: int, aspect: str, columns: list[str] | None = None, key: str = "product_id", tie: str = "dim_id") -> DataFrame:
    """One aspect of one product; of several rows the one of smallest dim id."""
    check_aspect(aspect)
    row = dims.where(F.col(key) == product).orderBy(tie).limit(1)
    return present_specs(row, columns or ASPECTS[aspect][1]).select(key, F.lit(aspect).alias("aspect"), "specs")


def all_specs(dims: dict[str, DataFrame], columns: dict[str, list[str]], key: str = "product_id", tie: str = "dim_id") -> DataFrame:
    """(product, place, aspect, specs) for every product and aspect that has any specification."""
    parts = []
    for place, (aspect, rows) in enumerate(dims.items()):
        first = rows.groupBy(key).agg(F.min_by(F.struct(*columns[aspect]), tie).alias("_row")).select(key, "_row.*")
        parts.append(present_specs(first, columns[aspect]).select(key, F.lit(place).alias("place"), F.lit(aspect).alias("aspect"), "specs"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.size("specs") > 0)


def nearest_comments(embeddings: DataFrame, dims: DataFrame, product: int, aspect: str, query: Sequence[float], top: int = TOP_K, over_fetch: int = OVER_FETCH, key: str = "product_id") -> DataFrame:
    """Nearest comments of one product and aspect, exact, repeated texts dropped after over-fetching."""
    table = check_aspect(aspect)
    own = dims.where(F.col(key) == product).select("dim_id", key)
    held = embeddings.where((F.col("dim_table") == table) & F.col("embedding").isNotNull())
    scored = held.join(own, "dim_id").withColumn("distance", distance_to(F.col("embedding"), query))
    by = [F.col("distance").asc_nulls_last(), F.col("chunk_id")]
    fetched = scored.orderBy(*by).limit(top * over_fetch)
    return distinct_texts(fetched, [key], "chunk_text", "distance", "chunk_id", top, over_fetch)


def nearest_per_group(rows: DataFrame, queries: DataFrame, group: str, vector: str, query: str, tie: str, top: int) -> DataFrame:
    """The nearest rows to each group's own query vector; queries has a row per group."""
    scored = rows.where(F.col(vector).isNotNull()).join(queries, group).withColumn("distance", cosine_distance(F.col(vector), F.col(query)))
    window = Window.partitionBy(group).orderBy(F.col("distance").asc_nulls_last(), tie)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)


def mean_vector(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, mean): the element-wise mean divided by its norm, summed before the shuffle by element."""
    each = rows.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("_at", "_x"))
    means = each.groupBy(group, "_at").agg(F.avg("_x").alias("_x"))
    gathered = means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_all"))
    plain = gathered.select(group, F.transform("_all", lambda r: r["_x"]).alias("_mean"))
    norm = F.sqrt(F.aggregate("_mean", F.lit(0.0), lambda s, x: s + x * x)) + F.lit(1e-12)
    return plain.withColumn("_norm", norm).select(group, F.transform("_mean", lambda x: x / F.col("_norm")).alias("mean"))


def random_rows(rows: DataFrame, limit: int = TOP_K, seed: int | None = None) -> DataFrame:
    """The fallback without a usable query vector: any rows, repeated texts and null vectors too."""
    return rows.orderBy(F.rand(seed)).limit(limit)


def purchase_candidates(products: DataFrame, comments: DataFrame, max_price: float, candidates: int = 5, shown: int = 3, key: str = "product_id", price: str = "price", positive: str = "positive") -> DataFrame:
    """Dearest candidates within the price, reranked by their share of positive comments."""
    chosen = list_products(products, max_price=max_price, price=price, tie=key, limit=candidates)
    share = comments.join(chosen.select(key), key, "left_semi").groupBy(key).agg(F.avg(F.col(positive).cast("double")).alias("share"))
    return chosen.join(share, key, "left").orderBy(F.col("share").desc_nulls_last(), F.col(price).desc(), key).limit(shown)
