"""Sharding by a two-pass external shuffle.

Pass one scatters records into buckets small enough for memory by a seeded hash
that also takes in the row's place, so that repeated rows spread too; buckets are
dealt to tasks by their number, so that each gets as many. Pass two sorts each
bucket by that hash, Fisher-Yates shuffles it and writes it. Buckets follow each
other; equal runs of that global order are the shards, so that row
counts differ by one at most (the law `rows`).

Cases: a null text has 8 bytes of size and the checksum 0; repeated rows and
null ids are records like others; a very long text is one record of its bucket;
an empty table gives no rows; all columns are kept under any name, but for those
named shard or slot, which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.llm.common import by_name, by_place, exclusive_prefix, join_summary, partitions_for, quoted, stored
from aspectra.session import ship_code

BUCKET_BYTES = 4 << 20
MIN_BUCKETS = 64


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A permutation of range(n): from the last place down, swap with a place not above."""
    order = np.arange(n)
    swaps = rng.integers(0, np.arange(1, n + 1))
    for i in range(n - 1, 0, -1):
        j = swaps[i]
        order[i], order[j] = order[j], order[i]
    return order


def _bucket_shuffler(seed: int):
    """Rows sorted by bucket and mark to rows in shuffled order with their place in the bucket."""

    def shuffled(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        bucket = rows["_bucket"][0].as_py()
        rows = rows.take(pa.array(fisher_yates(rows.num_rows, np.random.default_rng([seed, bucket]))))
        rows = rows.drop_columns(["_mark"]).append_column("_pos", pa.array(np.arange(rows.num_rows), pa.int64()))
        yield from rows.to_batches(max_chunksize=2048)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            buckets = batch["_bucket"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if s == e:
                    continue
                if held and held[0]["_bucket"][0].as_py() != buckets[s]:
                    yield from shuffled(held)
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield from shuffled(held)

    return run


def shuffle_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Records in buckets, written (to the folder `path`, if given): all columns by place (c0, c1, ...), _bucket, and _pos, the place in the shuffled bucket."""
    spark = docs.sparkSession
    ship_code(spark)
    size = F.coalesce(F.octet_length(quoted(text_col)), F.lit(0)) + F.lit(8)
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-total // bucket_bytes))
    mark = F.xxhash64(F.lit(seed), quoted(id_col), F.monotonically_increasing_id())
    marked = docs.select(*by_place(docs), mark.alias("_mark"))
    marked = marked.withColumn("_bucket", F.pmod(F.xxhash64("_mark", F.lit(seed)), F.lit(buckets)).cast("long"))
    n = partitions_for(spark)
    dealt = marked.repartitionById(n, (F.col("_bucket") % n).cast("int")).sortWithinPartitions("_bucket", "_mark")
    fields = [f for f in marked.schema.fields if f.name != "_mark"] + [T.StructField("_pos", T.LongType())]
    return stored(dealt.mapInArrow(_bucket_shuffler(seed), T.StructType(fields)), "shards", path)


def assign_shards(written: DataFrame, shards: int = 24) -> DataFrame:
    """shard (int) and slot (long) for rows of shuffle_records, whichever columns were kept of them.

    Offsets have a row per bucket; beyond SMALL_ROWS buckets rows are shuffled to meet them,
    so narrow wide columns before.
    """
    counts = written.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    starts = exclusive_prefix(counts, "_bucket", "_rows", "_start")
    buckets, total = counts.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    placed = join_summary(written, starts.select("_bucket", "_start"), "_bucket", buckets).withColumn("_at", F.col("_start") + F.col("_pos"))
    shard = F.expr(f"((_at + 1) * {shards} - 1) div {max(total, 1)}")
    first = F.expr(f"(shard * {total}L) div {shards}")
    out = placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_at") - first).cast("long"))
    return out.drop("_bucket", "_pos", "_start", "_at")


def shard_records(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """All columns of docs, read back from the written buckets, and shard (int) and slot (long)."""
    placed = assign_shards(shuffle_records(docs, id_col, text_col, seed, bucket_bytes, path), shards)
    return placed.select(*by_name(docs.columns, ("shard", "slot")), "shard", "slot")
