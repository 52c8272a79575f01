"""Tables of a database read by many tasks at once, in ranges of a numeric key that hold like numbers of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FETCH_ROWS = 5000
#: Accuracy of the key's quantiles: ranges are even to one part in so many.
ACCURACY = 100_000


def read_in_ranges(spark: SparkSession, url: str, name: str, key: str, partitions: int | None = None, columns: list[str] | None = None, where: str | None = None, fetch_rows: int = FETCH_ROWS, quote: str = '"', **properties: str) -> DataFrame:
    """The rows of a table or (query) with a partition for each range of its key, sorted by it within.

    One narrow scan, which keeps no rows, gives the key's quantiles, its range and
    its number of rows; ranges are cut there, so that gaps and crowds in the key
    do no harm. They end at the largest key of that scan: of a table that only
    grows every task sees the same rows, whenever it connects, and what comes
    later is left to the next read. For a table whose rows change under way name
    a query on a snapshot, or one through sessionInitStatement.

    `where` is a condition in the database's SQL and reaches every query, as
    columns do; names are put in the database's quotes. Rows with a null key are in the first range. A key that repeats
    on many rows stays in one range. Fails with ValueError where the key is no
    number.
    """
    name_of = lambda c: f"{quote}{c}{quote}"
    ranged, options = name_of(key), {"fetchsize": str(fetch_rows), **properties}
    condition = f" WHERE {where}" if where else ""
    keys = spark.read.jdbc(url, f"(SELECT {ranged} FROM {name}{condition}) keys_", properties=options)
    kind = keys.schema.fields[0].dataType
    if not isinstance(kind, T.IntegralType | T.DecimalType):
        raise ValueError(f"key {key} is {kind.simpleString()}, not a whole or decimal number")
    wanted = partitions or spark.sparkContext.defaultParallelism
    at = F.col(keys.columns[0])
    fractions = [k / wanted for k in range(1, wanted)] or [0.5]
    found = keys.agg(F.count("*").alias("rows"), F.max(at).alias("last"), F.percentile_approx(at, fractions, ACCURACY).alias("cuts")).first()
    shown = ", ".join(map(name_of, dict.fromkeys([*columns, key]))) if columns else "*"
    source = f"(SELECT {shown} FROM {name}{condition}) rows_" if where or columns else name
    if not found["rows"]:
        ranges = ["1 = 0"]
    elif found["last"] is None:
        ranges = [f"{ranged} IS NULL"]
    else:
        cuts = [c for c in sorted(set(found["cuts"])) if c < found["last"]] if wanted > 1 else []
        ends = [*cuts, found["last"]]
        ranges = [f"{ranged} IS NULL OR {ranged} <= {ends[0]}", *(f"{ranged} > {a} AND {ranged} <= {b}" for a, b in zip(ends, ends[1:], strict=False))]
    rows = spark.read.jdbc(url, source, predicates=ranges, properties=options)
    return rows.sortWithinPartitions(key).select(*(f"`{c}`" for c in columns or rows.columns))


def unclassified_comments(spark: SparkSession, url: str, name: str = "dim_video_comments", partitions: int | None = None, **properties: str) -> DataFrame:
    """(comment_id, comment_text) of comments that have no aspects yet and three characters at least, for a run that goes on where the last one ended."""
    condition = '"aspects" IS NULL AND LENGTH(TRIM("comment_text")) >= 3'
    return read_in_ranges(spark, url, name, "comment_id", partitions, ["comment_id", "comment_text"], condition, **properties)
