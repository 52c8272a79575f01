"""Compounds learnt from a corpus, and paths through them."""

import collections
import itertools
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aspectra.operators import segment as S
from aspectra.operators.chunking import recursive_chunks, with_token_counts
from aspectra.plans.providers import vocabulary_codec


def brute_compounds(texts, min_count, min_lift, longest=3):
    n = collections.Counter()
    for t in texts:
        for piece in re.findall(r"\w+(?: \w+)*", (t or "").lower()):
            w = piece.split(" ")
            n.update(" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    n = {r: c for r, c in n.items() if c >= min_count}
    total = sum(c for r, c in n.items() if " " not in r)
    out = {}
    for run, c in n.items():
        w = run.split(" ")
        if len(w) > 1:
            lift = min(c * total / (n[" ".join(w[:k])] * n[" ".join(w[k:])]) for k in range(1, len(w)))
            if lift >= min_lift:
                out[run] = (c, lift)
    return out, n, total


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        t = [rng.choice(words) for _ in range(20)]
        for _ in range(3):
            t[rng.randrange(20)] = rng.choice(["Pin trâu", "máy ảnh đẹp", "sạc nhanh"])
        texts.append(" ".join(t) + rng.choice([".", ", pin, trâu", "\nsạc\nnhanh"]))
    return [*texts, None, "", "  ", "pin  trâu" * 3]


def test_compounds_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    learnt = S.learn_compounds(df, "text", 4, 3.0).collect()
    want, n, total = brute_compounds(texts, 4, 3.0)
    got = {r["run"]: r for r in learnt if r["size"] > 1}
    assert got.keys() == want.keys() and {"pin trâu", "máy ảnh đẹp", "sạc nhanh"} <= got.keys()
    assert all(r["n"] == want[k][0] and r["lift"] == pytest.approx(want[k][1]) and r["total"] == total for k, r in got.items())
    assert {r["run"]: r["n"] for r in learnt if r["size"] == 1} == {w: n[w] for k in want for w in k.split(" ")}
    segment = S.viterbi_segmenter(S.Lexicon.of(S.learn_compounds(df, "text", 4, 3.0)))
    assert segment("Pin trâu, máy  ảnh và máy ảnh đẹp; sạc\nnhanh. Sạc nhanh") == "Pin_trâu, máy  ảnh và máy_ảnh_đẹp; sạc\nnhanh. Sạc_nhanh"
    assert S.Lexicon.of(S.learn_compounds(df.limit(0), "text")).best_path(["a", "b"]) == [1, 1]


UNITS = st.dictionaries(st.lists(st.sampled_from("abc"), min_size=1, max_size=3).map(" ".join), st.floats(-9, -1), max_size=15)


@settings(max_examples=200, deadline=None)
@given(UNITS, st.lists(st.sampled_from("abcd"), max_size=9))
def test_path_is_the_best(log_p, words):
    lexicon = S.Lexicon(log_p, -12.0, 3)

    def score(sizes):
        at, total = 0, 0.0
        for k in sizes:
            unit = " ".join(words[at : at + k])
            if k > 1 and unit not in log_p:
                return -math.inf
            total += log_p.get(unit, -12.0)
            at += k
        return total

    every = [c for r in range(len(words) + 1) for c in itertools.product((1, 2, 3), repeat=r) if sum(c) == len(words)]
    got = lexicon.best_path(words)
    assert sum(got) == len(words) and score(got) == pytest.approx(max(map(score, every)))


def test_chunks_keep_the_limits_of_model_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    encode, decode = vocabulary_codec(public.path("word_bpe_49k.json"))
    texts = ["".join(f"Pin trâu {i}. " for i in range(200)), "x" * 4000, "sạc nhanh, " * 90 + "!" * 500, "a b", " ", None, "日本" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    segment = S.viterbi_segmenter(S.Lexicon({"pin trâu": -1.0, "sạc nhanh": -1.0}, -9.0, 2))
    rows = with_token_counts(recursive_chunks(df, "id", "text", encode, decode, segment), "chunk_text", encode).collect()
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["id"], r["chunk_index"])):
        by[r["id"]].append(r)
    assert all(r["n_tokens"] <= 254 and r["chunk_text"].strip() == r["chunk_text"] != "" for r in rows)
    assert by.keys() == {0, 1, 2, 3, 6} and all([r["chunk_index"] for r in x] == list(range(len(x))) for x in by.values())
    assert max(r["n_tokens"] for r in by[0]) <= 160 + 5 and len(by[0]) > 3 and "Pin_trâu" in by[0][0]["chunk_text"]
    for a, b in itertools.pairwise(by[0]):  # neighbours share up to 20 tokens
        tail = next((k for k in range(len(b["chunk_text"]), 0, -1) if a["chunk_text"].endswith(b["chunk_text"][:k])), 0)
        assert len(encode(b["chunk_text"][:tail])) <= 20


def test_chunks_and_their_counts_come_from_one_bounded_step(spark):
    df = spark.createDataFrame([(i, f"pin trâu {i}. " * (i % 90)) for i in range(700)], "id long, text string").coalesce(1)
    segment = S.viterbi_segmenter(S.Lexicon({"pin trâu": -1.0}, -9.0, 2))
    counted = recursive_chunks(df, "id", "text", segment=segment, counts="n_tokens")
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    apart = with_token_counts(recursive_chunks(df, "id", "text", segment=segment), "chunk_text", str.split)
    rows = counted.collect()
    assert sorted(rows) == sorted(apart.collect()) and len({r["id"] for r in rows}) == 700 - 8 and max(r["n_tokens"] for r in rows) > 100
