"""Files in and out: JSON lists, comment files, tables, idempotent overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.operators.dedup import sequential_ids
from aspectra.plans.constants import RECORDS_PER_PART
from aspectra.plans.pipeline import exists


def read_json_list(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of whole-file JSON arrays; a missing file raises, a file that is no list raises when read."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.regexp_extract("value", r"^[\s﻿]*(.)", 1).alias("c"))
    first = lines.where("c <> ''").groupBy("file").agg(F.min_by("c", "at").alias("c"))
    if bad := first.where(F.col("c") != "[").limit(1).count():
        raise ValueError(f"{path}: {bad} file holds no JSON list")
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_comments_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_name string, comment_text string").csv(path, header=True, multiLine=True, quote='"', escape='"')


def write_comments_csv(comments: DataFrame, path: str) -> None:
    comments.select("user_name", "comment_text").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def overwrite_parts(df: DataFrame, path: str, part: str) -> None:
    """Replace only the parts that df holds, so that a repeated run leaves the same files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def append_new(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append rows whose keys the table lacks; gives the rows appended."""
    fresh = df.join(spark.read.schema(df.schema).parquet(path).select(*keys), keys, "left_anti").checkpoint()
    fresh.write.mode("append").parquet(path)
    return fresh


def create_tables(spark: SparkSession, folder: str, schemas: dict[str, T.StructType], overwrite: bool = False) -> None:
    """Empty tables with their schemas; existing ones stay unless overwrite is asked for (a truncation)."""
    for name, schema in schemas.items():
        mode = "overwrite" if overwrite else "ignore"
        spark.createDataFrame([], schema).write.mode(mode).parquet(f"{folder}/{name}")


def write_parts_once(df: DataFrame, path: str, order: str, every: int = RECORDS_PER_PART) -> int:
    """Write records in runs of `every` by order, each run a part of its own; a repeated call goes on after the parts
    that are there. Gives the number of parts written. Records must keep their order from call to call."""
    spark = df.sparkSession
    numbered = sequential_ids(df, order, "_number").withColumn("part", F.expr(f"cast((_number - 1) div {every} as int)")).drop("_number")
    if exists(spark, path):
        held = spark.read.parquet(path).groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") == every)
        numbered = numbered.join(held.select("part"), "part", "left_anti")
    numbered = numbered.select(*df.columns, "part").checkpoint()
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return numbered.select("part").distinct().count()


def write_jdbc(df: DataFrame, url: str, name: str, overwrite: bool = False, batch: int = 1000, **properties: str) -> None:
    """Insert into a database table, each task in one transaction; overwrite truncates the table and keeps its definition."""
    options = {"batchsize": str(batch), "truncate": "true", **properties}
    df.write.jdbc(url, name, mode="overwrite" if overwrite else "append", properties=options)
