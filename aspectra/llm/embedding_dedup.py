"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Per table a vector is rotated pseudo-randomly (three rounds of random signs and
a fast Walsh-Hadamard transform) and hashed to the nearest of the 2d signed
axes; two rotations together number a bucket. Each vector is stored in the bucket
of its nearest axes and probes the `probes` best pairs of near axes, so that
neighbours on either side of a border meet. Buckets are compared only within one
label; every candidate pair is verified by cosine in double precision. With the
defaults a pair at the limit of 0.93 in 64 dimensions is found with a chance
above 0.9995 (measured on random pairs), a closer one more surely.

Copies of one vector with one label are a single node with a count: they link
with each other and alike with everything else. Large buckets are cut into
blocks, and block meets block, so that no task holds a whole bucket. A pair that
meets in several buckets counts in the first of them only, which either side's
codes tell; so tasks add up numbers of links for each vector and give out a
forest of links, never the links themselves.

Cases: vectors that are null, empty, zero or hold null or non-finite components,
and rows with a null label, link with nothing; vectors of different lengths are
never compared; very large and very small components are scaled before squares
are taken; repeated rows are separate vectors that link; a repeated vec_id
counts for each row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import connected_components, kind_of, partitions_for, stored
from aspectra.session import ship_code

TABLES, PROBES, BLOCK, AT_LEAST = 10, 4, 512, 0.93
#: Pairs looked at together, and vectors a task keeps numbers for before it gives them out.
PAIRS, KEPT = 1 << 14, 1 << 17
#: What meets: block i's own vectors and block j's vectors of a bucket.
KEY = ("label", "bucket", "d", "i", "j")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        half *= 2
    return x


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    width = 1 << max(1, math.ceil(math.log2(x.shape[1])))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s) / math.sqrt(width)
    return x


def axes(x: np.ndarray, table: int, probes: int, seed: int) -> np.ndarray:
    """The nearest signed axes of each row after the table's rotation, nearest first."""
    turned = rotate(x, table, seed)
    probes = min(probes, turned.shape[1])
    order = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :probes]
    return 2 * order + (np.take_along_axis(turned, order, 1) < 0)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) << 20) | second.astype(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(batches: Iterator[pa.RecordBatch], tables: int, probes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Each row with its buckets, those of a table side by side, its own (the nearest) first; two rotations make one bucket number."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            raw = part["v"].to_pylist()
            lengths = np.array([len(v) for v in raw])
            for d in np.unique(lengths):
                pick = np.flatnonzero(lengths == d)
                x = unit(np.array([raw[i] for i in pick], np.float64))
                codes = []
                for t in range(tables):
                    one, two = axes(x, 2 * t, probes, seed), axes(x, 2 * t + 1, probes, seed)
                    places = sorted(((i, j) for i in range(one.shape[1]) for j in range(two.shape[1])), key=lambda c: (c[0] + 1) * (c[1] + 1))
                    codes += [pair_hash(one[:, i], two[:, j]) * tables + t for i, j in places[:probes]]
                codes = np.stack(codes, 1)
                ends = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
                rows = part.take(pa.array(pick))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.full(len(pick), d, np.int32)), pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))], names=[*rows.schema.names, "d", "codes"]
                )


def counts_here(bucket: int, node_a: np.ndarray, node_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether this bucket, a's own, is where the pair counts; a, b: codes by pair, table and probe.

    That is the smaller one of the own buckets through which the pair meets in the
    first table where it does. Where it is both own bucket, the smaller node is a.
    """
    ab, ba = (b == a[:, :, :1]).any(axis=2), (a == b[:, :, :1]).any(axis=2)
    first = (ab | ba).argmax(axis=1)
    k, far = np.arange(len(a)), np.iinfo(np.int64).max
    own_a, own_b = a[k, first, 0], b[k, first, 0]
    chosen = np.minimum(np.where(ab[k, first], own_a, far), np.where(ba[k, first], own_b, far))
    return (chosen == bucket) & (own_a == bucket) & ((own_b != bucket) | (node_a < node_b))


def _verify(batches: Iterator[pa.RecordBatch], at_least: float, tables: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task key: (node, links, null), the node's links found here, and (node, 0, other), a forest of them."""
    held: list[pa.RecordBatch] = []
    links: Counter[int] = Counter()
    parent: dict[int, int] = {}
    forest: list[tuple[int, int]] = []

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    def out() -> pa.RecordBatch:
        nodes, many = [*links, *(a for a, _ in forest)], [*links.values(), *([0] * len(forest))]
        others = [*([None] * len(links)), *(b for _, b in forest)]
        for kept in (links, parent, forest):
            kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, many, others)], names=["node", "links", "other"])

    def meet(rows: list[pa.RecordBatch]) -> None:
        one = pa.Table.from_batches(rows)
        home = one["home"].to_numpy()
        if home.all() or not home.any():
            return
        bucket = one["bucket"][0].as_py()
        node, copies = one["node"].to_numpy(), one["copies"].to_numpy()
        wide = lambda c: one[c].combine_chunks().flatten().to_numpy().reshape(len(home), -1)
        x, codes = unit(wide("v")), wide("codes").reshape(len(home), tables, -1)
        at_home, there = np.flatnonzero(home), np.flatnonzero(~home)
        i, j = np.nonzero(x[at_home] @ x[there].T >= at_least - 1e-9)
        i, j = at_home[i], there[j]
        for s in range(0, len(i), PAIRS):
            p, q = i[s : s + PAIRS], j[s : s + PAIRS]
            good = (node[p] != node[q]) & (np.einsum("ij,ij->i", x[p], x[q]) >= at_least)
            p, q = p[good], q[good]
            here = counts_here(bucket, node[p], node[q], codes[p], codes[q])
            p, q = p[here], q[here]
            for sums in (np.bincount(p, copies[q], len(node)), np.bincount(q, copies[p], len(node))):
                for k in np.flatnonzero(sums).tolist():
                    links[int(node[k])] += int(sums[k])
            for a, b in zip(node[p].tolist(), node[q].tolist(), strict=True):
                c, d = root(a), root(b)
                if c != d:
                    parent[c] = d
                    forest.append((a, b))

    current = None
    for batch in batches:
        keys, label = np.stack([batch[c].to_numpy() for c in KEY[1:]], 1), batch["label"]
        other = pc.not_equal(label.slice(1), label.slice(0, max(len(keys) - 1, 0))).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(keys, axis=0).any(1) | other) + 1).tolist(), len(keys)]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if s == e:
                continue
            key = (label[s].as_py(), *keys[s].tolist())
            if current is not None and key != current:
                meet(held)
                held = []
                if len(links) > KEPT:
                    yield out()
            current = key
            held.append(batch.slice(s, e - s))
    if held:
        meet(held)
    if links:
        yield out()


def link_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", at_least: float = AT_LEAST, tables: int = TABLES, probes: int = PROBES, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, nodes, links): id to key; node with key and copies; and by node parts of its number of links (vectors
    of other nodes; other is null), and links enough to join what is joined (other not null)."""
    spark = rows.sparkSession
    ship_code(spark)
    n = partitions_for(spark)
    doubles = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(doubles, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    nonzero = F.exists(doubles, lambda v: v != 0)
    usable = F.coalesce(finite & nonzero & (F.size(doubles) > 0), F.lit(False)) & F.col(f"`{label_col}`").isNotNull()
    all_rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.when(usable, F.transform(doubles, lambda v: v + F.lit(0.0))).alias("v"))
    whole = all_rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda v: v.cast("string"))), 256)))
    nodes = whole.where("key is not null").groupBy("key").agg(F.min("id").alias("smallest"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).select("node", "key", "smallest", "copies", "label", "v")
    kinds = f"node long, key string, smallest {kind_of(rows, id_col)}, copies long, label string, v array<double>, d int, codes array<long>"
    nodes = stored(nodes.mapInArrow(lambda b: _codes(b, tables, probes, seed), kinds), "vectors")
    each = nodes.select("node", "label", "d", (F.size("codes") / F.lit(tables)).cast("int").alias("of"), F.posexplode("codes").alias("place", "bucket"))
    coded = each.select("node", "label", "d", "bucket", (F.col("place") % F.col("of") == 0).alias("home"))
    sizes = coded.groupBy("label", "bucket", "d").agg(F.count("*").alias("n"), F.count_if("home").alias("stored")).where("n > 1 and stored > 0")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    met = coded.join(sizes.select("label", "bucket", "d", blocks.alias("blocks")), ["label", "bucket", "d"])
    # home rows of block i meet all rows of block j: a home row goes to (i, 0..), any row to (0.., j)
    block = F.pmod(F.xxhash64("node", "home"), F.col("blocks")).cast("int")
    spread = lambda part, i, j: part.select("node", "label", "bucket", "d", i.alias("i"), j.alias("j"), F.lit(part is as_home).alias("home"))
    placed = met.withColumn("block", block)
    as_home = placed.where("home").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    as_any = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = spread(as_home, F.col("block"), F.col("other")).unionByName(spread(as_any, F.col("other"), F.col("block")))
    full = tasks.select(*KEY, "node", "home").join(nodes.select("node", "copies", "v", "codes"), "node")
    ordered = full.repartition(n, *KEY).sortWithinPartitions(*KEY).select(*KEY, "node", "home", "copies", "v", "codes")
    links = stored(ordered.mapInArrow(lambda b: _verify(b, at_least, tables), "node long, links long, other long"), "links")
    return whole.select("id", "key"), nodes.select("node", "key", "smallest", "copies"), links


def dedup_vectors(rows: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    members, nodes, links = link_vectors(rows, id_col, **options)
    outside = links.groupBy("node").agg(F.sum("links").alias("outside"))
    parts = connected_components(links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = nodes.select("key", "node", "smallest", "copies").join(outside, "node", "left").join(parts, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_key = placed.join(least, "component").select("key", (F.col("copies") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), "component_id")
    joined = members.join(of_key, "key", "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
