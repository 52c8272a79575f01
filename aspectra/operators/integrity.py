"""Checks of references between tables, and deletes that follow them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged_keys(dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(dim_table, dim_id) of all known rows: tables by name, each with its key column."""
    parts = [df.select(F.lit(name).alias("dim_table"), F.col(key).cast("long").alias("dim_id")) for name, (df, key) in dims.items()]
    return reduce(DataFrame.unionByName, parts)


def reference_violations(rows: DataFrame, dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose dim_table is unknown or whose dim_id is missing in it, with the reason."""
    known = tagged_keys(dims)
    bad = rows.join(known, ["dim_table", "dim_id"], "left_anti")
    return bad.withColumn("reason", F.when(F.col("dim_table").isin(*dims), F.lit("missing id")).otherwise(F.lit("unknown table")))


def checked(rows: DataFrame, dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The rows; reading them fails if any breaks a reference."""
    known = tagged_keys(dims).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, ["dim_table", "dim_id"], "left")
    told = F.concat(F.lit("no row for "), F.coalesce("dim_table", F.lit("null")), F.lit(" "), F.coalesce(F.col("dim_id").cast("string"), F.lit("null")))
    guard = F.when(F.col("_known").isNull(), F.raise_error(told).cast("boolean")).otherwise(F.lit(True))
    return joined.where(guard).drop("_known")


def cascade_delete(parents: DataFrame, children: DataFrame, doomed: DataFrame, owner: str, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) left when the parents of doomed owners go, and their children with them."""
    gone = parents.join(doomed.select(owner), owner, "left_semi").select(F.col(parent_key).alias(child_key))
    return parents.join(doomed.select(owner), owner, "left_anti"), children.join(gone, child_key, "left_anti")
