"""From scraped catalogue records to the star schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.functions.text import blank_to_null
from aspectra.operators.dedup import first_by, sequential_ids
from aspectra.plans.constants import ASPECTS, SPEC_LABELS
from aspectra.plans.schemas import dim_schema


def category_slugs(anchors: DataFrame, href: str, order: str, base_url: str, skip_prefix: str) -> DataFrame:
    """(slug, order) of category links that start with base_url: first seen of each, without those of skip_prefix."""
    quoted = "\\Q" + base_url + "\\E"
    slug = F.regexp_replace(F.regexp_extract(href, f"^{quoted}(.+)$", 1), "^/+|/+$", "")
    found = anchors.select(F.nullif(slug, F.lit("")).alias("slug"), F.col(order)).where(~F.col("slug").startswith(skip_prefix))
    return found.groupBy("slug").agg(F.min(order).alias(order))


def crawl_pages(pages: DataFrame, slug: str, page: str, url: str, max_pages: int = 60, cap: int | None = None) -> DataFrame:
    """New product rows of a page-wise crawl over stored page contents, one row per (slug, page, url).

    A slug's crawl ends before the first page that is missing, beyond the limit or
    brings no URL the slug's earlier pages had not; slugs do not see each other.
    """
    from pyspark.sql import Window

    known = pages.where((F.col(page) <= max_pages) & (F.coalesce(F.col(url), F.lit("")) != ""))
    first = known.groupBy(slug, url).agg(F.min(page).alias(page))
    bringing = first.groupBy(slug, page).agg(F.count("*").alias("_new"))
    run = Window.partitionBy(slug).orderBy(page)
    reached = bringing.withColumn("_at", F.row_number().over(run)).where(F.col("_at") == F.col(page)).select(slug, page)
    out = first.join(reached, [slug, page])
    return out.orderBy(slug, page, url).limit(cap) if cap is not None else out


def map_spec_fields(raw: Column) -> dict[str, Column]:
    """A column for each specification field from a map of page labels to values; blank becomes null."""
    return {field: F.coalesce(*[blank_to_null(raw[label]) for label in labels]) for field, labels in SPEC_LABELS.items()}


def spec_records(rows: DataFrame, raw: str, url: str, product_name: str, name: str) -> DataFrame:
    """Nested records: source URL, the product and a struct per aspect; rows without specifications are dropped."""
    fields = map_spec_fields(F.col(raw))
    title = F.coalesce(F.nullif(F.col(product_name), F.lit("")), F.nullif(F.col(name), F.lit("")), F.lit("Unknown Name"))
    fact = F.struct(title.alias("product_name"), fields["os_version"].alias("os_version"), fields["language_support"].alias("language_support"))
    dims = [F.struct(*[fields[c].alias(c) for c in columns]).alias(table) for table, columns in ASPECTS.values()]
    return rows.where(F.size(raw) > 0).select(F.col(url).alias("_source_url"), fact.alias("fact_product"), *dims)


def sanitize(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only columns that the target has; missing ones become null text."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def last_links(links: DataFrame, url: str, order: list[str], values: list[str]) -> DataFrame:
    """One row per URL: of repeated links the last in order wins."""
    row = F.struct(*[F.col(v) for v in values])
    return links.groupBy(url).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(url, "_row.*")


def enrich(records: DataFrame, links: DataFrame, on: str, order: list[str], values: list[str]) -> DataFrame:
    """Records with the last link's values; null where no link has the URL."""
    return records.join(last_links(links, on, order, values), on, "left")


def skip_existing(records: DataFrame, existing: DataFrame, name: str, order: str) -> DataFrame:
    """Records to load: first of their exact name in the batch, name not loaded yet; blank names are malformed."""
    usable = F.nullif(F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", ""), F.lit("")).isNotNull()
    firsts = first_by(records, F.when(usable, F.col(name)), [order])
    return firsts.join(existing.select(name), name, "left_anti")


def star_load(records: DataFrame, order: str) -> DataFrame:
    """Numbered products in order; after a truncating load every dim row has the same number."""
    return sequential_ids(records, order, "product_id")


def dim_tables(products: DataFrame) -> dict[str, DataFrame]:
    """The eight aspect tables of numbered products with a struct per aspect."""
    out = {}
    for aspect, (table, columns) in ASPECTS.items():
        kinds = dim_schema(aspect)
        extra = {"youtuber_review": "string", "user_review": "string", "last_updated": "timestamp_ntz"}
        out[table] = products.select(
            F.col("product_id").cast("int").alias("dim_id"),
            F.col("product_id").cast("int"),
            *[F.col(f"{table}.{c}").alias(c) for c in columns],
            *[F.lit(None).cast(k).alias(c) for c, k in extra.items()],
        )
        assert out[table].columns == kinds.names
    return out


def ids_by_name(products: DataFrame, names: list[str], name: str = "product_name", number: str = "product_id") -> DataFrame:
    """name to id for a given list, which meets the products in a join; of equal names the last id wins; an empty list gives no rows."""
    wanted = products.sparkSession.createDataFrame([(n,) for n in names], f"`{name}` string")
    return products.join(wanted, name, "left_semi").groupBy(name).agg(F.max(number).alias(number))


def names_by_id(rows: DataFrame, products: DataFrame, number: str = "product_id", name: str = "product_name") -> DataFrame:
    """Rows with the product's name, or a placeholder where the id is unknown."""
    missing = F.concat(F.lit("điện thoại (id="), F.col(number).cast("string"), F.lit(")"))
    return rows.join(products.select(number, name), number, "left").withColumn(name, F.coalesce(F.col(name), missing))
