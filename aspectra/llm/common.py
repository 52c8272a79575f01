"""Shared pieces of the corpus operators: shared storage, prefix sums, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aspectra.session import with_conf

#: A summary of fixed-width columns is broadcast up to so many rows (a few megabytes).
SMALL_ROWS = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that setting is missing the context's own checkpoint folder serves. A
    temporary one is made only on a single machine; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="aspectra-shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Rows that go to Python at a time in steps that are written: texts are long, and batches are bounded by rows alone.
ARROW_ROWS = "1000"


def stored(df: DataFrame, label: str, path: str | None = None, **options: str) -> DataFrame:
    """Write a frame once to the shared folder, or to a path, and read it back.

    Lineage ends here: lost executors cost a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with with_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=ARROW_ROWS):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kind_of(df: DataFrame, name: str) -> str:
    """The type of a column, for schemas that keep it."""
    return df.schema[name].dataType.simpleString()


def partitions_for(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """A column by its exact name, cast; a typed null if the table lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def by_place(df: DataFrame) -> list[Column]:
    """All columns as c0, c1, ..., so that no name of theirs meets a working column's."""
    return [quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)]


def by_name(columns: list[str], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of by_place under their own names again, but for those that results replace."""
    replaced = {c.lower() for c in without}
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in replaced]


def exclusive_prefix(totals: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Running total before each row. Only for summaries with a row per partition or bucket."""
    window = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long"))


def join_summary(df: DataFrame, summary: DataFrame, on: str, rows: int) -> DataFrame:
    """Join numbers by key from a summary of a known number of rows; beyond SMALL_ROWS the planner shuffles both."""
    return df.join(F.broadcast(summary) if rows <= SMALL_ROWS else summary, on)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on an edge (a, b); component is the smallest node.

    Alternates large-star and small-star steps, each a pre-aggregated minimum and
    one join, until the edges are stars: each node on the left once, and none of
    them on the right. The number of rounds grows with the logarithm of the
    longest chain. Every round is written to the shared folder; only numbers
    come to the driver.
    """
    current = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    while not _stars(current):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(smallest, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        current = stored(small.where("a <> b").distinct(), "edges")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether each node on the left stands there once, and none on the right."""
    left = edges.groupBy("a").agg(F.count("*").alias("n"), F.lit(0).alias("m")).withColumnRenamed("a", "node")
    right = edges.groupBy("b").agg(F.lit(0).alias("n"), F.lit(1).alias("m")).withColumnRenamed("b", "node")
    seen = left.unionByName(right).groupBy("node").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return seen.where("n > 1 or n > 0 and m > 0").limit(1).count() == 0
