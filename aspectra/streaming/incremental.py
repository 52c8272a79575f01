"""Resumable runs: streams that tag and append only what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_batches(
    source: DataFrame, target: str, keys: list[str], order: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], by: str | None = None
) -> None:
    """Run a stream over all that is there: each batch transformed, then appended without known keys.

    The batch's rows meet the stored keys in an anti-join, so that a batch that
    runs again, or a stream begun afresh, leaves the table as it was. `by` names
    one of the keys by whose values the table is partitioned, a date say: a batch
    then meets only the partitions that its own rows fall in, by a join that prunes
    them as it runs. A batch is transformed once and kept while it is written.
    """
    from aspectra.operators.dedup import keep_first_per_key

    def sink(batch: DataFrame, _: int) -> None:
        made = keep_first_per_key(transform(batch), keys, order).persist()
        try:
            stored = batch.sparkSession.read.schema(made.schema).parquet(target).select(*keys)
            if by:
                met = made.select(by).where(F.col(by).isNotNull()).distinct()
                stored = stored.join(met, by, "left_semi").select(*keys).unionByName(stored.where(F.col(by).isNull()))
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
            fresh = made.alias("n").join(stored.alias("s"), same, "left_anti")
            write = fresh.write.partitionBy(by) if by else fresh.write
            write.mode("append").parquet(target)
        finally:
            made.unpersist()

    query = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream over a table's files."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by time window and kind; rows later than the watermark are left out."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width), kind).agg(F.count("*").alias("n"))
