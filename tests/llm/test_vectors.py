import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aspectra.llm import embedding_dedup as E
from tests.llm.brute import components


def test_hadamard_is_orthogonal():
    h = E.hadamard(np.eye(16))
    assert (h @ h.T == 16 * np.eye(16)).all()
    x = np.random.default_rng(0).normal(size=(5, 24))
    assert np.allclose(np.linalg.norm(E.rotate(x, 3, 1), axis=1), np.linalg.norm(x, axis=1))


def brute(rows):
    usable = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(usable)):
        for b in range(a):
            (i, x, p), (j, y, q) = usable[a], usable[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links.append((i, j))
    return links


def test_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for _ in range(25):
        base = rng.normal(size=16)
        for noise in (0, 0, 0.05, 0.2, 0.3, 0.4):
            rows.append((k, (base + noise * rng.normal(size=16) * np.linalg.norm(base) / 4).astype(np.float32).tolist(), k % 11 // 6))
            k += 1
    inf, nan = float("inf"), float("nan")
    for odd in (None, [], [0.0] * 16, [None] * 16, [nan] * 16, [inf] * 16):
        rows.append((k, odd, 0))
        k += 1
    rows += [(k, rows[0][1], None), (k + 1, rows[0][1][:8], 0), (k + 2, [1.0, -0.0], 0), (k + 3, [1.0, 0.0], 0), (k + 4, [1.0], 0), (k + 5, [2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    found = {r["vec_id"]: r for r in E.dedup_vectors(df).collect()}
    links = brute(rows)
    want = components([r[0] for r in rows], links)
    degree = {r[0]: 0 for r in rows}
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in found.items()} == {i: (degree[i], want[i], want[i] == i) for i in want}


def pairs_at(cosine, d, n, rng):
    x, y = rng.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    return x, cosine * x + math.sqrt(1 - cosine**2) * y


@pytest.mark.parametrize("d", [64, 768])
def test_recall_at_the_limit(d):
    """Pairs of a cosine just at the limit share a bucket that is one side's own."""
    x, y = pairs_at(0.931, d, 400, np.random.default_rng(d))

    def codes(v):
        batch = pa.RecordBatch.from_pydict({"v": pa.array(v.tolist(), pa.list_(pa.float64()))})
        rows = pa.Table.from_batches(list(E._codes([batch], E.TABLES, E.PROBES, 17)))
        return np.array(rows["codes"].to_pylist()).reshape(len(v), E.TABLES, E.PROBES)

    a, b = codes(x), codes(y)
    met = ((b == a[:, :, :1]).any(2) | (a == b[:, :, :1]).any(2)).any(1)
    assert met.mean() >= 0.99


def test_rows_grow_with_the_group_not_its_square(spark, monkeypatch):
    written, plain = [], E.stored

    def counted(df, label, **options):
        out = plain(df, label, **options)
        if label == "links":
            written.append(out.count())
        return out

    monkeypatch.setattr(E, "stored", counted)
    rng = np.random.default_rng(2)
    base = rng.normal(size=32)
    for n in (150, 300, 600):
        rows = [(i, (base + 0.1 * rng.normal(size=32)).tolist(), 1) for i in range(n)]
        found = E.dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        assert {r["n_links"] for r in found} == {n - 1} and {r["component_id"] for r in found} == {0}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(w <= 2 * n * tasks for w, n in zip(written, (150, 300, 600), strict=True))  # links: 11175, 44850, 179700


def test_extreme_lengths_and_ties(spark):
    v = [1.0, 2.0, -1.0, 0.5]
    rows = [(7, [x * 1e200 for x in v], 1), (3, [x * 1e-200 for x in v], 1), (5, v, 1), (5, v, 1), (4, [5e-324, 0.0, 0.0, 0.0], 1), (None, v, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("codes", "copies", "d", "key", "bucket")})
    found = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in E.dedup_vectors(df).collect())
    assert found == [(-1, 4, 3), (3, 4, 3), (4, 0, 4), (5, 4, 3), (5, 4, 3), (7, 4, 3)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.dedup_vectors(df).count() == 0
