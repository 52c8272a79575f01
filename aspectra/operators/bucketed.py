"""Inserts that leave known keys alone, into a table kept in buckets of its keys: only the batch is shuffled.

The table is bucketed by a hash of its keys and sorted by them in each file. An
insert sends the batch to the buckets, meets each with its stored keys, and
appends what is new as one file per bucket. Of the stored keys only those
within the batch's range of the first key are read: files are sorted by it, so
that for keys that grow, ids or dates, the history is skipped by its statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.operators.dedup import keep_first_per_key

FORMAT = "parquet"


def create_bucketed(spark: SparkSession, name: str, path: str, schema: T.StructType, keys: list[str], buckets: int) -> None:
    """An empty table in buckets; one that exists stays."""
    spark.createDataFrame([], schema).write.format(FORMAT).mode("ignore").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def new_rows(spark: SparkSession, name: str, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the batch to append: first of their key, key not in the table; rows with a null key are left out, as a primary key has none.

    batch is read twice, for its range and for its rows.
    """
    whole = batch
    for k in keys:
        whole = whole.where(F.col(k).isNotNull())
    low, high = whole.agg(F.min(keys[0]), F.max(keys[0])).first()
    stored = spark.table(name).select(*keys).where(F.col(keys[0]).between(F.lit(low), F.lit(high)))
    # merged, so that each bucket is met where it is: a broadcast of the stored keys would read and send all of them
    return keep_first_per_key(whole, keys, order).join(stored.hint("merge"), keys, "left_anti")


def insert_new_bucketed(spark: SparkSession, name: str, batch: DataFrame, keys: list[str], order: str) -> int:
    """Append what is new and give its number of rows; a repeated call appends nothing."""
    columns = spark.table(name).columns
    found = _bucket_spec(spark, name)
    fresh = new_rows(spark, name, batch.select(*columns), keys, order).select(*columns).persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.format(FORMAT).mode("append").bucketBy(found, *keys).sortBy(*keys).saveAsTable(name)
        return n
    finally:
        fresh.unpersist()


def _bucket_spec(spark: SparkSession, name: str) -> int:
    """The table's number of buckets."""
    rows = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Num Buckets'").collect()
    if not rows:
        raise ValueError(f"table {name} has no buckets")
    return int(rows[0]["data_type"])
