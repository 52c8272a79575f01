"""Spelling variants, language identification and the filter audit."""

import collections
import itertools
import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aspectra.llm import filter_audit as A
from aspectra.llm import language_id as I
from aspectra.llm import queries as Q
from aspectra.llm import spelling as S
from tests.llm.brute import LOWER, words

RUN = re.compile("[A-Za-zÀ-ÿ]+")
ODD = [None, "", " ", "İstanbul ×abcd÷", "abcde ABCDE Àbcde", "abcd一efghi", "x" * 3000 + " " + "x" * 3001, "w" * 9_000, "banana bananna bannana bananas " * 40]


def neighbours(word, vocabulary):
    """Words exactly one edit away, by making all edits."""
    letters = {c for w in vocabulary for c in w}
    made = {word[:i] + word[i + 1 :] for i in range(len(word))}
    made |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    made |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return (made - {word}) & vocabulary


def brute_variants(docs):
    n = collections.Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    vocabulary, rows = set(n), {}
    for w in n:
        near = neighbours(w, vocabulary)
        best = min(near, key=lambda v: (-n[v], v), default=None)
        good = best is not None and n[best] >= 2 * n[w]
        rows[w] = (best if good else None, n[w], len(near), n[best] if good else None)
    out = {}
    for w, (form, *rest) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out[w] = (form, root, *rest)
    return out


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abàÿ", min_size=1, max_size=5), min_size=1, max_size=40), st.integers(1, 7))
def test_walk_finds_each_neighbour_once(vocabulary, states):
    coded = {w: w.encode("latin-1") for w in vocabulary}
    got = collections.Counter()
    for length in {len(w) for w in vocabulary}:
        shard = sorted(v for v in coded.values() if len(v) == length)
        trie = S.Trie.from_bytes(S.Trie.build(shard, list(range(len(shard)))).to_bytes())
        assert trie.word(np.arange(len(shard))) == shard
        for given_length in {length - 1, length, length + 1} - {0}:
            some = [v for v in coded.values() if len(v) == given_length]
            if some:
                rows, leaves = trie.near(np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1), states)
                got.update(zip([some[i] for i in rows], trie.word(leaves), strict=True))
    want = {(coded[w], coded[v]): 1 for w in vocabulary for v in neighbours(w, vocabulary)}
    assert got == want


def test_variants_against_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute_variants(docs)
    assert as_dict(Q.op11_spelling_variants(spark, small)) == want
    assert any(r[0] for r in want.values()) and max(r[2] for r in want.values()) > 3


def test_variants_of_odd_rows_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD_WORDS", 3)
    rows = [(i % 7, t) for i, t in enumerate(ODD * 4)] + [(None, "bananas banana"), (None, None)] + [(3, ODD[8])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as first")
    got = as_dict(S.spelling_variants(docs, drop_every=97, round_bytes=5000))
    assert got == brute_variants(rows) and len(got) > 5
    assert S.spelling_variants(docs.limit(0)).count() == 0
    names = spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string")
    assert as_dict(S.spelling_variants(names))["banana"][2] == 40 * 6 + 1


def test_chains_of_forms(spark):
    text = " ".join(w for w, n in [("abcdefgh", 300), ("abcdefg", 100), ("abcdef", 40), ("abcde", 10), ("abcdx", 3), ("zzzzz", 4)] for _ in range(n))
    got = as_dict(S.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert got["abcdx"] == ("abcde", "abcdefgh", 3, 1, 10) and got["abcdefgh"] == (None, "abcdefgh", 300, 1, None) and got["zzzzz"] == (None, "zzzzz", 4, 0, None)


def brute_audit(docs, labels):
    first = {}
    for key, _, text in docs:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    good, toxic = ({k for k, *marks in labels if marks[j] == 1 and k is not None} for j in (0, 1))
    rows = collections.defaultdict(list)
    for key, part, text in docs:
        text = text or ""
        w = words(text)
        fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text)) + "E" * (key is not None and first[text] < key)
        rows[part or ""].append((fails, key in good, key in toxic))
    out = {}
    for part, found in rows.items():
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = found
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = [r for r in found if f in r[0]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(r[0] == f for r in found), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_dict(df):
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_against_brute_force(spark, small):
    docs = [(r["doc_id"], r["lang"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{small}/labels.parquet").collect()]
    assert audit_dict(Q.op13_filter_audit(spark, small)) == brute_audit(docs, labels)


def test_audit_of_odd_rows(spark, monkeypatch):
    texts = ["AB cd", "", None, "x # y", "same text here", "w " * 300, " ".join(map(str, range(60_000))), "éÉ \x1f a\x0bb"]
    docs = [(i // 2, ["en", None, "", "de"][i % 4], t) for i, t in enumerate(texts * 5)] + [(None, "en", "same text here"), (None, None, None)] * 3
    docs += [(k, "hot", "same text here") for k in range(500)] + [(0, "hot", "AB cd")] * 3
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (400, 1, None), (77, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").selectExpr("*", "1 as fails", "2 as digest", "3 as n", "4 as part")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "9 as good", "8 as _id")
    want = brute_audit(docs, labels)
    assert audit_dict(A.audit_filters(df, marks)) == want
    monkeypatch.setattr(A.mark_copies, "__defaults__", (1,))  # every group is joined, none broadcast
    assert audit_dict(A.audit_filters(df, marks)) == want
    assert A.audit_filters(df.limit(0), marks).count() == 0
    named = df.selectExpr("lpad(cast(doc_id as string), 9, '0') as doc_id", "lang", "text")
    assert audit_dict(A.audit_filters(named, marks.selectExpr("lpad(cast(doc_id as string), 9, '0') as doc_id", "quality", "toxic"))) == want


def plain_read(text):
    """Characters as the language models read them, behind the boundaries."""
    out = ""
    for c in text:
        kind = unicodedata.category(c)[0]
        small = c.lower() if kind == "L" and len(c.lower()) == 1 else c
        out += small if kind in "LM" else "" if out[-1:] in ("", " ") else " "
    return "\x02" * 4 + out


def plain_models(texts):
    """Probability of a character after a context, by one language's interpolated Kneser-Ney model of given texts."""
    counts = {5: collections.Counter(r[i - 4 : i + 1] for r in map(plain_read, texts) for i in range(4, len(r)))}
    for k in range(4, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def probability(gram, uniform):
        if not gram:
            return uniform
        k = len(gram)
        n1, n2 = (sum(c == j for c in counts[k].values()) for j in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        lower = probability(gram[1:], uniform)
        after = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return lower
        total = sum(after.values())
        left = 1 - sum(max(c - d, 0) / total for c in after.values())
        return max(after.get(gram, 0) - d, 0) / total + left * lower

    return counts[1], probability


TEACH = {"aa": ["abra cadabra", "Ab ra!! Äb", "a", "barbara"], "bb": ["xyz zyx, xyzzy", "zz Top", "日本 xy"]}


@pytest.fixture(scope="module")
def taught(spark):
    """Models of two tiny languages."""
    rows = [(t, lang, False) for lang, texts in TEACH.items() for t in texts]
    counts = I.gram_counts(spark.createDataFrame(rows, "text string, lang string, held boolean"))
    return I.LanguageModels.from_bytes(I.build_models(counts.select("lang", "gram", "n"), ["aa", "bb"]).to_bytes())


def test_models_are_kneser_ney(taught, monkeypatch):
    plain = [plain_models(TEACH[x]) for x in ("aa", "bb")]
    uniform = 1 / (len(plain[0][0].keys() | plain[1][0].keys()) + 1)
    texts = ["abra", "Zyx  -- abä", "", "?", "new words", "x" * 30, "barbara cadabra xyzzy"]
    want = []
    for text in texts:
        r = plain_read(text)
        want.append([-sum(math.log(p(r[i - 4 : i + 1], uniform)) for i in range(4, len(r))) / max(len(r) - 4, 1) for _, p in plain])
    for block in (1 << 18, 7, 3):
        monkeypatch.setattr(I, "BLOCK", block)
        got, n, lettered = taught.cross_entropy(texts)
        assert np.allclose(got, want, atol=1e-5) and n.tolist() == [len(plain_read(t)) - 4 for t in texts]
        assert lettered.tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_probabilities_sum_to_one_when_grams_are_left_out(spark):
    rows = [(t, lang, False) for lang, texts in TEACH.items() for t in texts]
    counts = I.gram_counts(spark.createDataFrame(rows, "text string, lang string, held boolean")).select("lang", "gram", "n")
    models = I.build_models(counts, ["aa", "bb"], model_rows=60)
    assert all(len(k) <= 12 for k in models.grams) and models.grams[4].size
    seen = sorted({c for g in (r["gram"] for r in counts.collect()) for c in g[-1]})
    alphabet = [*seen, *(["?"] * max(0, round(math.exp(-models.uniform)) - len(seen)))]
    for context in ("abra", "\x02\x02\x02\x02", "qqqq", "xyz "):
        chars = [np.array([ord(x) for x in context + c], np.uint64) for c in alphabet]
        hashes = [np.array([I.gram_hashes(x)[k][-1] for x in chars]) for k in range(6)]
        before = [np.array([I.gram_hashes(x)[k][-2] for x in chars]) for k in range(6)]
        assert np.allclose(np.exp(models.log_probs(hashes, before)).sum(axis=0), 1, atol=1e-4)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aÄbß İ,.\n\x02\x00é́日𝒜"), max_size=12), max_size=6))
def test_characters(texts):
    chars, begins, lettered = I.characters(texts)
    assert ["".join(map(chr, chars[a:b].tolist())) for a, b in itertools.pairwise(begins)] == [plain_read(t) for t in texts]
    assert lettered.tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_language_query(spark, small):
    rows = {r["doc_id"]: r for r in Q.op12_language_id(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert {d["doc_id"] for d in held} == {k for k, r in rows.items() if r["held_out"]}
    right = [rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {"en", "de", "fr", "es"} for r in rows.values())


def test_languages_of_odd_rows(spark):
    texts = ["the cat and the dog", "der Hund und die Katze", "the thing that they think", "das Ding und der Dorn"]
    rows = [(str(i), texts[i % 4], ("en", "de")[i % 2]) for i in range(400)] + [(None, None, "en"), ("x", "", None), ("x", "12 !?", "de"), ("y", "the " * 200_000, None), (None, "Ж日本Ж" * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string").selectExpr("*", "1 as held", "2 as gram", "3 as n")
    models = I.train_languages(docs)
    got = collections.defaultdict(list)
    for r in I.identify_languages(docs, models).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows) and all(got[str(i)][0]["lang_pred"] == ("en", "de")[i % 2] for i in range(400))
    assert [r["lang_pred"] for r in got["x"]] == ["und", "und"] and not any(r["accepted"] or r["score"] for r in got["x"])
    assert got["y"][0]["lang_pred"] == "en"
    assert not [r for r in got[None] if r["lang_pred"] != "und"][0]["accepted"]  # unlike anything learnt
    assert {r["lang_pred"] for r in I.identify_languages(docs, I.train_languages(docs.where("lang is null"))).collect()} == {"und"}
    assert I.identify_languages(docs.limit(0), I.train_languages(docs.limit(0))).count() == 0
    one = I.identify_languages(docs, I.train_languages(docs.where("lang = 'en'"))).collect()
    assert {r["lang_pred"] for r in one} == {"en", "und"}


def test_counts_of_a_text_of_many_blocks(spark):
    rng = np.random.default_rng(4)
    long = " ".join(f"{'abcdefgh'[i % 8]}{'xyz'[j]}" for i, j in zip(rng.integers(0, 8, 250_000), rng.integers(0, 3, 250_000)))
    rows = [(long, "aa", False), ("ab", "aa", True), (long[:5], "bb", False)]
    got = {(r["lang"], r["gram"]): (r["n"], r["n_held"]) for r in I.gram_counts(spark.createDataFrame(rows, "text string, lang string, held boolean")).collect()}
    want = collections.Counter()
    for text, lang, held in rows:
        read = plain_read(text)
        for i in range(4, len(read)):
            want[lang, read[i - 4 : i + 1]] += np.array([1, held])
    assert len(long) > 2 * I.BLOCK and got == {k: tuple(v.tolist()) for k, v in want.items()}


def test_models_leave_no_gram_out(spark):
    """However few n-grams a worker holds, texts are scored by all of them, as the models written out above have it."""
    docs = [(i, x, lang) for i, (x, lang) in enumerate((t, lang) for lang, texts in TEACH.items() for t in texts)]
    teach = spark.createDataFrame(docs, "doc_id int, text string, lang string")
    plain = [plain_models(TEACH[x]) for x in ("aa", "bb")]
    uniform = 1 / (len(plain[0][0].keys() | plain[1][0].keys()) + 1)
    texts = ["abra", "Zyx  -- abä", "", None, "new words", "x" * 30, "barbara cadabra xyzzy", "日本 abra", "abra"]
    want = {}
    for i, text in enumerate(texts):
        r = plain_read(text or "")
        found = [-sum(math.log(p(r[j - 4 : j + 1], uniform)) for j in range(4, len(r))) / max(len(r) - 4, 1) for _, p in plain]
        want[i] = (min(found), ("aa", "bb")[found.index(min(found))] if len(r) > 4 else "und")
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for held in (0, 12, 1 << 20):
        got = {r["doc_id"]: r for r in I.identify_languages(asked, I.train_languages(teach, model_rows=held)).collect()}
        assert {k: r["lang_pred"] for k, r in got.items()} == {k: lang for k, (_, lang) in want.items()}
        assert np.allclose([got[k]["entropy"] for k in want], [e for e, _ in want.values()], atol=1e-5)


def test_no_language_is_left_out(spark):
    docs = spark.createDataFrame([(i, chr(0x4E00 + i) * 3, f"l{i:03}") for i in range(260)], "doc_id int, text string, lang string")
    got = I.identify_languages(docs, I.train_languages(docs)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {i: f"l{i:03}" for i in range(260)}
