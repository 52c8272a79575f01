"""First-wins dedup, master election, keys in input order, caps and idempotent inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions.text import device_id, hardware_hash

#: Rows sampled for each slice, and at most in all.
SAMPLED, MOST_SAMPLED = 100, 50_000


def first_by(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The row of each key that comes first in order; rows with a null key are dropped.

    A minimum by a struct, pre-aggregated before the shuffle: a key that holds a
    third of all rows sends one row per task.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    firsts = df.where(key.isNotNull()).groupBy(key.alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return firsts.select("_row.*")


def distinct_urls(df: DataFrame, url: str, order: str, cap: int | None = None) -> DataFrame:
    """First-seen rows by URL, blank URLs skipped; with a cap only the first so many by order."""
    out = first_by(df, F.nullif(F.col(url), F.lit("")), [order])
    return out.orderBy(order).limit(cap) if cap is not None else out


def elect_masters(df: DataFrame, attributes: list[str], name: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(masters with id, the others with reference_id) of records with equal hardware.

    The shortest name by characters is master, the earliest of those.
    """
    hashed = df.withColumn("_hash", hardware_hash(*[F.col(a).cast("string") for a in attributes]))
    best = hashed.groupBy("_hash").agg(F.min(F.struct(F.char_length(F.coalesce(F.col(name), F.lit(""))), F.col(order))).alias("_best"))
    judged = hashed.join(best.select("_hash", F.col(f"_best.{order}").alias("_master")), "_hash")
    mark = device_id(F.col("_hash"))
    masters = judged.where(F.col(order) == F.col("_master")).withColumn("id", mark).drop("_hash", "_master")
    others = judged.where(F.col(order) != F.col("_master")).withColumn("reference_id", mark).drop("_hash", "_master")
    return masters, others


def final_name_key(query_name: Column, product_name: Column) -> Column:
    """Lower-case stripped query name, else the lower-case product name as it is, else 'unknown'."""
    stripped = F.lower(F.regexp_replace(query_name, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.nullif(stripped, F.lit("")), F.nullif(F.lower(product_name), F.lit("")), F.lit("unknown"))


def sequential_ids(df: DataFrame, order: str | list[str], out: str, slices: int | None = None) -> DataFrame:
    """1, 2, 3, ... by order columns, nulls first, without one task for all rows; equal ones go by a hash of the row.

    A bounded sample, the rows of smallest hash, gives cuts; counts by slice give
    each slice its first number, and rows are numbered within slices, of which
    there are as many as shuffle partitions. Cuts go through rows of equal order
    by their hash, and through rows alike in all columns by their place in the
    input, so that a key of many rows has many slices. Any cuts give the same numbers.
    """
    order = [order] if isinstance(order, str) else order
    slices = slices or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.withColumns({"_mark": F.xxhash64(*[f"`{c}`" for c in df.columns]), "_place": F.xxhash64(F.monotonically_increasing_id())})
    by = [*order, "_mark", "_place"]
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)])
    sample = placed.select(key.alias("k")).orderBy(f"k.k{len(order) + 1}").limit(min(slices * SAMPLED, MOST_SAMPLED)).select("k.*").distinct()
    held = sample.orderBy(*sample.columns).collect()
    cuts = [held[i] for i in sorted({len(held) * k // slices for k in range(1, slices)}) if i < len(held)]
    kinds = [placed.schema[c].dataType for c in by]
    at_least = [key >= F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(c, kinds, strict=True))]) for c in cuts]

    def place(low: int, high: int) -> Column:
        """Number of cuts not above the row, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(at_least[middle], place(middle + 1, high)).otherwise(place(low, middle))

    cut = placed.withColumn("_slice", place(0, len(cuts)))
    counts = cut.groupBy("_slice").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy("_slice").orderBy(*by))
    return cut.join(F.broadcast(starts), "_slice").withColumn(out, (F.col("_start") + number).cast("long")).select(*[f"`{c}`" for c in df.columns if c != out], out)


def keep_first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of smallest order for each composite key."""
    return first_by(df, F.struct(*keys), [order])


def insert_new(existing: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of batch to append: first of their key in the batch, key not in existing."""
    return keep_first_per_key(batch, keys, order).join(existing.select(*keys), keys, "left_anti")


def cap_per_group(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group in order; zero or less: all.

    The rank filter is a window group limit, which cuts each task's rows before the shuffle.
    """
    if most <= 0:
        return df
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def distinct_texts(ranked: DataFrame, group: list[str], text: str, distance: str, tie: str, top: int, over_fetch: int) -> DataFrame:
    """Nearest top*over_fetch rows of each group, repeated texts dropped, nearest kept, then the first top.

    May give fewer than top: texts beyond the fetched rows are never looked at.
    """
    by = [F.col(distance).asc_nulls_last(), F.col(tie)]
    window = Window.partitionBy(*group).orderBy(*by)
    fetched = ranked.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= top * over_fetch)
    first = fetched.withColumn("_copy", F.row_number().over(Window.partitionBy(*group, text).orderBy(*by))).where("_copy = 1")
    return first.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= top).withColumnRenamed("_rank", "rank").drop("_copy")
