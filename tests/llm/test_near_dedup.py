import collections
import math
import random

import numpy as np
import pyarrow as pa

from aspectra.llm import near_dedup as N
from aspectra.llm.common import connected_components, stored
from tests.llm.brute import components, jaccard, near_classes, shingles


def mutate(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def corpus():
    rng = random.Random(4)
    docs, k = {}, 0
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 300))]
        for n in (0, 0, 1, 2, 4, 9, 20):
            docs[k] = mutate(rng, base, n)
            k += 1
    docs |= {k: "one two", k + 1: "one  two\n", k + 2: "", k + 3: None, k + 4: " \t", k + 5: "a " * 400, k + 6: "a " * 401, k + 7: "a " * 10, k + 8: "one two three four five"}
    return docs


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(80):
        pool = np.sort(rng.integers(1, 1 << 62, 150).astype(np.uint64))
        a, b = rng.integers(0, 9, 150), rng.integers(0, 9, 150)
        b = np.where(rng.random(150) < 0.7, a, b)
        text = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        sig = N.signatures(text, np.concatenate([pool[a > 0], pool[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 3 * np.std(errors) / np.sqrt(len(errors)) + 1e-3
    assert np.std(errors) < 0.06


def test_signatures_do_not_depend_on_the_batch():
    texts = [t.encode() for t in corpus().values() if t]
    hashes, bounds = N.shingle_hashes(texts)
    whole = N.signatures(*N.multisets(hashes, bounds), len(texts))
    for i in (0, 3, len(texts) - 1):
        h, b = N.shingle_hashes([texts[i]])
        assert (N.signatures(*N.multisets(h, b), 1)[0] == whole[i]).all()


def test_overlap():
    a, b = "a b c d e f g h a b c d e f", "a b c d e f g h x y"
    ha, hb = (N.shingle_hashes([t.encode()])[0] for t in (a, b))
    assert N.overlap(ha, hb) == jaccard(shingles(a), shingles(b))


def test_classes_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r["doc_id"]: r for r in N.near_duplicate_classes(df).collect()}
    want = near_classes(docs)
    assert {k: r["class_id"] for k, r in found.items()} == want
    sizes = collections.Counter(want.values())
    assert all(r["class_size"] == sizes[want[k]] and r["kept"] == (want[k] == k) for k, r in found.items())


def test_odd_rows(spark):
    data = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (None, None), (3, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as class_id", "1 as key", "2 as node")
    found = sorted((r["doc_id"] or -1, r["class_id"] or -1, r["class_size"]) for r in N.near_duplicate_classes(df).collect())
    assert found == [(-1, -1, 1), (-1, 1, 3), (1, 1, 3), (1, 1, 3), (2, 2, 1), (3, 3, 1)]
    left = N.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 1, 2, 3]
    assert N.near_duplicate_classes(df.limit(0)).count() == 0


def test_few_links_are_ruled_out_by_signatures():
    n, p = N.REGISTERS, N.AT_LEAST
    lost = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(math.ceil(N.RULED_OUT * n)))
    assert lost < 1e-6
    ones = np.ones(n, np.uint8)
    other = np.where(np.arange(n) < round(0.68 * n), 1, 2).astype(np.uint8)
    batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "marks_a": [ones.tobytes()], "marks_b": [other.tobytes()]})
    assert [b.num_rows for b in N._likely([batch])] == [1]


def test_unlike_texts_under_one_id_or_none_stay(spark):
    rng = random.Random(6)
    one, two, three, four, five = ([f"{c}{i}" for i in range(60)] for c in "abcde")
    near = lambda w: mutate(rng, w, 1)
    rows = [(None, " ".join(one)), (None, " ".join(two)), (None, near(two)), (None, None), (None, " ")]
    rows += [(5, " ".join(three)), (5, near(three)), (5, " ".join(four)), (9, near(four)), (None, near(four)), (5, None), (7, " ".join(five))]
    for data in (rows, [*rows, rows[0], rows[5], rows[11], rows[3]]):
        df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(data)], "doc_id long, text string, row long")
        left = [(r["doc_id"], r["text"]) for r in N.drop_near_duplicates(df).collect()]
        assert set(left) <= set(rows) and len(set(left)) == len(left) == 8
        groups = [(rows[0],), rows[1:3], (rows[3],), (rows[4],), rows[5:7], (rows[7],), (rows[10],), (rows[11],)]
        assert all(sum(x in g for x in left) == 1 for g in groups)


def near_copies(n, seed=3, words=120):
    """Copies of one text with about a tenth of it changed: pairs lie on both sides of the limit."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    return {k: mutate(rng, base, rng.randrange(1, 4)) for k in range(n)}


def test_recall_of_links_and_classes_in_a_dense_group(spark, monkeypatch):
    """Every class that brute force links is found whole, whichever blocks its texts fall in."""
    docs = near_copies(120) | {1000 + k: t for k, t in near_copies(60, 4).items()}
    found = {k: shingles(t) for k, t in docs.items()}
    links = [(a, b) for a in docs for b in docs if a < b and jaccard(found[a], found[b]) >= 0.8]
    hashes, bounds = N.shingle_hashes([t.encode() for t in docs.values()])
    keys = N.band_keys(N.signatures(*N.multisets(hashes, bounds), len(docs)))
    place = {k: i for i, k in enumerate(docs)}
    assert sum((keys[place[a]] == keys[place[b]]).any() for a, b in links) == len(links) > 1000
    monkeypatch.setattr(N, "BLOCK", 7)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in N.near_duplicate_classes(df).collect()} == near_classes(docs)


def test_rows_dealt_to_blocks(spark, monkeypatch):
    """Rows of the shuffle by blocks, where they are dealt: linear in bands of a block, and else the pairs to compare over the block."""
    seen = collections.Counter()

    def counted(batches, at_least, given=N._open):
        def through():
            for b in batches:
                dealt.add(b.num_rows)
                pairs.add(int((b["left"].to_numpy(zero_copy_only=False)).sum()))
                yield b

        return given(through(), at_least)

    def written(df, label, **options):
        out = stored(df, label, **options)
        seen[label] = max(seen[label], out.count())
        return out

    monkeypatch.setattr(N, "_open", counted)
    monkeypatch.setattr(N, "stored", written)
    rows = []
    for n, block in ((200, 4096), (400, 4096), (800, 4096), (400, 64), (800, 64)):
        dealt, pairs = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        seen.clear()
        monkeypatch.setattr(N, "BLOCK", block)
        N.near_duplicate_classes(spark.createDataFrame(list(near_copies(n).items()), "doc_id long, text string")).count()
        rows.append((dealt.value, pairs.value, seen["pairs"] + seen["links"] + seen["open"]))
    (a, _, wa), (b, _, wb), (c, strays, wc), (_, _, _), (e, _, _) = rows
    assert b <= 2.3 * a and c <= 2.3 * b and wb <= 2.6 * wa and wc <= 2.6 * wb, rows
    assert e <= c * (1 + strays / 42 / 64 + 800 / 64), rows


def test_forest_of_a_block_joins_each_component_once():
    texts = list(near_copies(30).values())
    hashes, bounds = N.shingle_hashes([t.encode() for t in texts])
    sig = N.signatures(*N.multisets(hashes, bounds), len(texts))
    keys = N.band_keys(sig)
    marks = [m.tobytes() for m in (N.mix(sig.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)]
    band = collections.Counter(keys.ravel().tolist()).most_common(1)[0][0]
    among = [i for i in range(len(texts)) if band in keys[i]]
    first = {b: min(i for i in among if b in keys[i]) for b in {band}}[band]
    rows = [(i, left) for i in among for left in (True, False) if not left or i != first]
    columns = {
        "band": [band] * len(rows), "i": [0] * len(rows), "j": [0] * len(rows), "node": [i for i, _ in rows], "component": [i for i, _ in rows],
        "left": [x for _, x in rows], "stray": [i != first for i, _ in rows], "shingles": [int(bounds[i + 1] - bounds[i]) for i, _ in rows],
        "marks": [marks[i] for i, _ in rows], "bands": [keys[i].tolist() for i, _ in rows], "text": [texts[i] for i, _ in rows],
    }
    links = [p for b in N._forest([pa.RecordBatch.from_pydict(columns)], 0.8) for p in zip(b["a"].to_pylist(), b["b"].to_pylist())]
    grams = {i: shingles(texts[i]) for i in among}
    assert all(jaccard(grams[a], grams[b]) >= 0.8 for a, b in links)
    want = components(among, [(a, b) for a in among for b in among if a < b and jaccard(grams[a], grams[b]) >= 0.8 and next(k for k in keys[a] if k in keys[b]) == band])
    assert components(among, links) == want and len(links) == len(among) - len(set(want.values()))


def test_leftover_rounds_join_what_a_first_member_parts(spark, monkeypatch):
    """A bucket whose first text is near none of the others must still link those."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    docs = {0: " ".join(f"z{i}" for i in range(200)), 1: " ".join(base), 2: mutate(rng, base, 1), 3: mutate(rng, base, 2)}
    monkeypatch.setattr(N, "BLOCK", 2)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in N.near_duplicate_classes(df).collect()} == near_classes(docs)


def test_very_long_texts(spark):
    """Hundreds of thousands of words, in one line and as one word."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(90_000)}" for _ in range(150_000)]
    docs = {1: " ".join(base), 2: mutate(rng, base, 2000), 3: mutate(rng, base, 9000), 4: "x" * 1_000_000, 5: "x" * 1_000_000 + " y", 6: "x" * 1_000_000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in N.near_duplicate_classes(df).collect()} == near_classes(docs) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 4}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40) if i % 13] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    df = spark.createDataFrame(links, "a long, b long")
    want = components({x for p in links for x in p if p[0] != p[1]}, [p for p in links if p[0] != p[1]])
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0
