"""Searches of many queries at once, against one at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.functions.text import similarity
from aspectra.operators import trigram_index
from aspectra.operators.trigram_index import search_trigrams, trigram_candidates
from aspectra.operators.vector_blocks import nearest_in_blocks


@pytest.mark.parametrize("threshold", [0.1, 0.5])
def test_trigram_search_equals_the_scan(spark, threshold):
    rng = random.Random(1)
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    names = [(i, " ".join(word() for _ in range(rng.randrange(1, 4)))) for i in range(300)] + [(300, None), (301, ""), (302, "--"), (303, "Đẹp ảnh")]
    asked = [(i, rng.choice(names)[1] if i % 2 else word()) for i in range(60)] + [(60, None), (61, "đẹp"), (62, "  ")]
    one = spark.createDataFrame(names, "k long, name string")
    two = spark.createDataFrame(asked, "q long, text string")
    pairs = two.join(one, on=F.lit(True)).withColumn("s", similarity(F.col("name"), F.col("text"))).where(F.col("s") > threshold).collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (r["q"], -r["s"], r["k"])):
        if len(want.setdefault(r["q"], [])) < 5:
            want[r["q"]].append((r["k"], round(r["s"], 9)))
    got = {}
    for r in search_trigrams(one, two, "k", "name", "q", "text", threshold).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["k"], round(r["similarity"], 9)))
    assert got == want and len(want) > 20
    compared = trigram_candidates(one, two, "k", "name", "q", "text", threshold).count()
    assert compared >= len(pairs) and compared < (0.6 if threshold < 0.3 else 0.2) * len(names) * len(asked)


def test_names_alike_meet_a_query_once(spark, monkeypatch):
    texts = ["red bolt", "Red  bolt!", "red bolts", "blue ring", "old blue ring"]
    names = spark.range(3000).select(F.col("id").alias("k"), F.array(*map(F.lit, texts))[(F.col("id") % 5).cast("int")].alias("name"))
    asked = spark.range(400).select(F.col("id").alias("q"), F.array(F.lit("RED BOLT"), F.lit("blue ring"))[(F.col("id") % 2).cast("int")].alias("text"))
    compared, plain = [], trigram_index._candidates
    monkeypatch.setattr(trigram_index, "_candidates", lambda *a: (compared.append(plain(*a)), compared[-1])[1])
    rows = search_trigrams(names, asked, "k", "name", "q", "text", 0.3, 5).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["q"], r["rank"])):
        got.setdefault(r["q"], []).append((r["k"], r["name"], r["similarity"], r["rank"]))
    red = [(k, texts[k % 5], 1.0, i + 1) for i, k in enumerate([0, 1, 5, 6, 10])]
    blue = [(k, "blue ring", 1.0, i + 1) for i, k in enumerate([3, 8, 13, 18, 23])]
    assert got == {q: [red, blue][q % 2] for q in range(400)}
    assert compared[0].count() <= 4 * 2


@pytest.mark.parametrize("query_bytes", [1 << 20, 200])
def test_nearest_in_blocks_against_brute_force(spark, query_bytes):
    rng = np.random.default_rng(2)
    rows = [(i, f"g{i % 3}", rng.integers(-2, 3, 4).tolist()) for i in range(500)] + [(900, "g0", None), (901, None, [1, 1, 1, 1]), (902, "g1", [1, 2]), (903, "g9", [0, 0, 0, 0])]
    queries = [(k, f"g{k % 3}", rng.integers(-2, 3, 4).tolist()) for k in range(12)] + [(50, "g9", [1, 0, 0, 0]), (51, "none", [1, 0, 0, 0]), (52, "g1", [2, 4]), (53, "g0", [0, 0, 0, 0])]
    df = spark.createDataFrame([(i, g, v and [float(x) for x in v]) for i, g, v in rows], "vec long, grp string, v array<float>").repartition(5)
    asked = spark.createDataFrame([(k, g, [float(x) for x in v]) for k, g, v in queries], "q int, grp string, query array<float>")
    got = {}
    for r in nearest_in_blocks(df, asked, "grp", "v", "q", "query", "vec", 7, query_bytes).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["vec"], None if r["distance"] is None else round(r["distance"], 9)))
    for k, g, q in queries:
        found = []
        for i, h, v in rows:
            if h == g and v and len(v) == len(q):
                norm = np.linalg.norm(v) * np.linalg.norm(q)
                found.append((i, None if norm == 0 else round(1 - float(np.dot(v, q)) / norm, 9)))
        want = sorted(found, key=lambda x: (x[1] is None, x[1] or 0, x[0]))[:7]
        have = got.get(k, [])
        assert len(have) == len(want) and all(a[1] == b[1] or abs(a[1] - b[1]) < 1e-8 for a, b in zip(have, want, strict=True))
        assert {i for i, d in have} <= {i for i, d in found}


@pytest.mark.parametrize("query_bytes", [1 << 20, 40])
def test_ranks_by_rounded_distance_count_all_rows(spark, query_bytes):
    rng = np.random.default_rng(4)
    rows = [(int(i), f"g{k % 2}", [1.0, float(a), 0.0]) for k, (i, a) in enumerate(zip(rng.permutation(400), rng.integers(0, 40, 400) * 1e-4, strict=True))]
    rows += [(1000 + k, "g0", [2.0, 1e-4 * (k % 3), 0.0]) for k in range(300)] + [(2000, "g1", [0.0, 0.0, 0.0])]
    queries = [(k, f"g{k % 2}", [1.0, 1e-4 * k, 1e-4]) for k in range(6)] + [(90, "g2", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([*rows, (3000, "g2", [1.0, 1.0, 0.0]), (3001, "g2", [0.0, 0.0, 0.0])], "vec long, grp string, v array<double>").repartition(5)
    asked = spark.createDataFrame(queries, "q long, grp string, query array<double>")
    found = nearest_in_blocks(df, asked, "grp", "v", "q", "query", "vec", 7, query_bytes, 6).collect()

    def distance(v, q):
        dot, one, two = sum(a * b for a, b in zip(v, q, strict=True)), sum(a * a for a in v), sum(b * b for b in q)
        return 1 - max(-1.0, min(1.0, dot / math.sqrt(one * two))) if one * two else math.inf

    want, beyond = {(90, 3000): (round(1 - 0.5**0.5, 6), 1), (90, 3001): (None, 2)}, 0
    for k, g, q in queries[:-1]:
        every = [(distance(v, q), i) for i, h, v in rows if h == g]
        places = {i: n + 1 for n, (d, i) in enumerate(sorted((math.floor(d * 1e6 + 0.5) if d < math.inf else d, i) for d, i in every))}
        for d, i in sorted(every)[:7]:
            want[k, i] = (math.floor(d * 1e6 + 0.5) / 1e6, places[i])
            beyond += places[i] > 7
    assert {(r["q"], r["vec"]): (r["distance"], r["rank"]) for r in found} == want and beyond > 5
