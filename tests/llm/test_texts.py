import collections
import hashlib
import math
import re
import struct
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aspectra.llm import licenses as L
from aspectra.llm import quality as Y
from aspectra.llm import queries as Q
from aspectra.llm.gru import GruModel, Trainer
from aspectra.llm.hashing import join_texts, word_hashes, word_spans
from aspectra.llm.lm_score import score_documents
from aspectra.llm.near_dedup import drop_near_duplicates, near_duplicate_classes
from aspectra.llm.packing import Packer, best_cuts, pack_documents, packed_digest
from aspectra.llm.sharding import fisher_yates, shard_records
from aspectra.llm.token_files import TokenFile, read_token_files, write_token_files
from aspectra.llm.tokenizing import encoder_for
from tests.llm.brute import LOWER, WORD, words

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "\n", "a  b", "Don't  Stop\tit's", "x.\ny", "\0 a", "é" * 40, "日本 語", "a, b. c", "w " * 5000, "a <|endoftext|> b"]


def documents(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "null id")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"{v} as {k}" for k, v in extra.items()])


def fresh(name, special_as_text=False):
    """The library's own tokenizer, apart from the encoder's."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


VOCABULARIES = [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)]
FRESH = {(n, s): fresh(n, s) for n, _ in VOCABULARIES for s in (False, True)}
BITS = [*" \n\t\r\xa0ab'sAé1.,!|~́\x1c\0<>", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "Word,", "word.", "Éa##", "ñ!?", "x~~", "İ", "Ⱥ.", "'s", "##'s"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=14).map("".join), max_size=4), st.booleans())
@pytest.mark.parametrize(("name", "level"), VOCABULARIES)
def test_pieces_give_the_ids_of_whole_texts(name, level, texts, special_as_text):
    want = [np.array(FRESH[name, special_as_text].encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder_for(name, level, special_as_text).encode(texts) == want


def test_special_tokens_and_a_full_cache(monkeypatch):
    from aspectra.llm import tokenizing as T

    monkeypatch.setattr(T, "CACHE_MOST", 3)
    monkeypatch.setattr(T, "CACHE_KEPT", 2)
    for name, level in VOCABULARIES:
        encoder = T.PieceEncoder(name, level)
        for texts in (["hello <|endoftext|> world", "Hello, world. hello"], ["world, Hello", "x" * 400], ["x" * 400 + ", hello"]):
            assert encoder.encode(texts) == [np.array(FRESH[name, False].encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert 50256 in FRESH["byte_bpe_50k.json", False].encode("a <|endoftext|>").ids


def ids_of(name, text, end):
    return np.array(FRESH[name, False].encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_width_follows_the_vocabulary(spark, monkeypatch):
    from aspectra.llm import token_files as F_

    assert F_.width_for("byte_bpe_50k.json", 0) == 2 and F_.width_for("byte_bpe_50k.json", 70000) == 4
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["ids_crc32"] for r in read_token_files(spark, write_token_files(df, end_id=70000)).collect()}
    assert found[2] == zlib.crc32(np.array([70000], "<u4").tobytes())


def test_dictionary_sample_is_of_distinct_ids(spark):
    """A third of all rows under one id, or none, is one document of the sample."""
    from aspectra.llm import token_files as F_

    rows = [(None if i % 3 else i, f"w{i} " * 30) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert F_.train_dictionary(df, "text", "doc_id", ("byte_bpe_50k.json", False), 0, 2, 50)
    assert F_.train_dictionary(df.limit(0), "text", "doc_id", ("byte_bpe_50k.json", False), 0, 2, 50) == b""


def test_token_files(spark):
    df = documents(spark, ODD * 8, part=1, ids="'x'")
    path = write_token_files(df)
    found = read_token_files(spark, path).collect()
    want, start = [], 0
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in rows:
        ids = ids_of("byte_bpe_50k.json", text, 0)
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    one = spark.read.parquet(f"{path}/files").first()["content"]
    with pytest.raises(ValueError):
        TokenFile(one, b"another")
    assert read_token_files(spark, write_token_files(df.limit(0))).count() == 0


def test_token_files_are_read_by_their_folder_in_a_fresh_session(spark, tmp_path):
    """Nothing but the folder is left of the session that wrote it."""
    df = spark.createDataFrame([(i, f"words {i} and some more of them " * 9) for i in range(60)], "doc_id int, text string")
    assert write_token_files(df, path=str(tmp_path / "tokens")) == str(tmp_path / "tokens")
    want = sorted(map(tuple, read_token_files(spark, str(tmp_path / "tokens")).collect()))
    assert spark.read.parquet(str(tmp_path / "tokens/dictionary")).first()["dictionary"]
    code = (
        "import sys; from aspectra.session import local_session; from aspectra.llm.token_files import read_token_files;"
        "s = local_session(2, 2); print(sorted(map(tuple, read_token_files(s, sys.argv[1]).collect())))"
    )
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path / "tokens")], capture_output=True, text=True, timeout=120, cwd=tmp_path)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip().splitlines()[-1] == str(want)


def test_ids_of_any_type(spark, small):
    """Text ids stay what they are; files that number documents say so."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")))
    labels = spark.read.parquet(f"{small}/labels.parquet").withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")))
    number = lambda x: int(x[1:]) if isinstance(x, str) else x
    rows = lambda df, *c: sorted([tuple(number(r[k]) if k in ("doc_id", "class_id") else r[k] for k in c) for r in df.collect()], key=repr)
    assert rows(L.scan_licenses(named), "doc_id", "n_words", "labels") == rows(L.scan_licenses(docs), "doc_id", "n_words", "labels")
    judged = Y.judge_quality(named, Y.train_quality(named, labels))
    assert rows(judged, "doc_id", "n_words") == rows(Y.judge_quality(docs, b""), "doc_id", "n_words")
    packed = rows(packed_digest(pack_documents(named)), "doc_id", "start", "length")
    assert packed == rows(packed_digest(pack_documents(docs)), "doc_id", "start", "length")
    classes = rows(near_duplicate_classes(named), "doc_id", "class_id", "class_size", "kept")
    assert classes == rows(near_duplicate_classes(docs), "doc_id", "class_id", "class_size", "kept")
    assert rows(drop_near_duplicates(named), "doc_id") == rows(drop_near_duplicates(docs), "doc_id")
    scored = score_documents(named.limit(30))
    assert scored.schema["doc_id"].dataType.simpleString() == "string" and scored.count() == 30
    with pytest.raises(TypeError, match="whole number"):
        write_token_files(named)


def exhaustive(places, penalties, length, fixed):
    p, cost = [0, *places], [0.0]
    for j in range(1, len(p)):
        best = math.inf
        for i in range(j):
            n = p[j] - p[i]
            if n <= length:
                best = min(best, cost[i] + fixed + (0 if n & (n - 1) == 0 else length - n))
        cost.append(best + penalties[j - 1])
    return cost[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0, 2, 5])), min_size=1, max_size=40))
def test_cuts_are_cheapest(steps):
    places = np.cumsum([s for s, _ in steps])
    penalties = np.array([p for _, p in steps])
    fixed = int(penalties.sum()) % 3 * 8
    cuts = best_cuts(places, penalties, 16, fixed)
    by = dict(zip(places.tolist(), penalties.tolist(), strict=True))
    lengths = np.diff([0, *cuts])
    assert cuts[-1] == places[-1] and lengths.max() <= 16
    cost = sum(0 if n & (n - 1) == 0 else 16 - n for n in lengths.tolist()) + sum(by[c] for c in cuts) + fixed * len(cuts)
    assert cost == exhaustive(places.tolist(), penalties.tolist(), 16, fixed)


def test_packing_query_against_brute_force(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = Q.queries()["op8_packing"](spark, small).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(docs)
    for doc_id, own in pieces.items():
        ids, at = ids_of("word_bpe_49k.json", docs[doc_id], 1), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    tokens = sum(r["length"] for r in rows)
    assert len(sequences) <= 1.05 * tokens / 2048 + spark.sparkContext.defaultParallelism


def test_packer_keeps_every_token_once():
    rng = np.random.default_rng(3)
    packer, out, docs = Packer(np.array([7]), 64, 500), [], {}
    for k in range(40):
        docs[k] = rng.integers(0, 9, int(rng.choice([1, 3, 30, 200, 1500]))).astype("<u4")
        out += packer.add(k, docs[k])
    out += packer.flush()
    assert all(0 < sum(len(p[3]) for p in s) <= 64 for s in out)
    back = collections.defaultdict(list)
    for sequence in out:
        for doc_id, start, tokens, ids in sequence:
            assert tokens == len(docs[doc_id]) and start == sum(map(len, back[doc_id]))
            back[doc_id].append(ids)
    assert all((np.concatenate(back[k]) == docs[k]).all() for k in docs)
    assert [p[0] for s in out for p in s] == sorted(p[0] for s in out for p in s)


def test_packing(spark):
    df = documents(spark, ODD, sequence_id=1, part=2)
    found = packed_digest(pack_documents(df)).collect()
    sequences, pieces = collections.defaultdict(list), collections.Counter()
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]] += r["length"]
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    want = collections.Counter()
    for r in df.collect():
        want[r["doc_id"]] += len(ids_of("word_bpe_49k.json", r["text"], 1))
    assert pieces == want
    assert packed_digest(pack_documents(df.limit(0))).count() == 0


def test_shards(spark):
    df = documents(spark, ODD * 30, shard="'x'", _k=1)
    found = shard_records(df, shards=7, bucket_bytes=4000).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in found) == collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in slots.values()]
    assert set(slots) == set(range(7)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    same = [r["doc_id"] for r in found if r["shard"] == 0]
    assert same != sorted(same, key=lambda x: x or -1)
    assert shard_records(df.limit(0)).count() == 0


def test_shards_with_clashing_names_and_a_long_text(spark):
    names = ("_mark", "_bucket", "_pos", "_rows", "_start", "_at", "c0", "a`b")
    rows = [(i if i % 3 else None, "x" * (i % 9)) for i in range(200)] + [(5, "long " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select([F.lit(k).alias(c) for k, c in enumerate(names)] + ["*"])
    found = shard_records(df, shards=5, bucket_bytes=500)
    assert found.columns == [*df.columns, "shard", "slot"]
    found = found.collect()
    assert sorted(map(str, (r[: len(df.columns)] for r in found))) == sorted(map(str, map(tuple, df.collect())))
    counts = collections.Counter(r["shard"] for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_sharding_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs)
    found = Q.op7_sharding(spark, small).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_fisher_yates_is_fair():
    rng = np.random.default_rng(0)
    seen = collections.Counter(tuple(fisher_yates(3, rng).tolist()) for _ in range(6000))
    assert len(seen) == 6 and max(seen.values()) < 1200 and min(seen.values()) > 800
    assert fisher_yates(0, rng).tolist() == [] and fisher_yates(1, rng).tolist() == [0]


LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["mit", "MIT", "license", "General", "public", "apache", " ", "-", ".", "é", "x", "\n", "license mit license"]), max_size=25).map("".join))
def test_license_base(text):
    w = LICENSE_WORD.findall(text.translate(LOWER))
    places = [(i, label) for phrase, label in L.BASE.items() for q in [phrase.split()] for i in range(len(w)) if w[i : i + len(q)] == q]
    n_words, n_base, first, last, base, labels, score, *_ = L.Scanner().scan(text)
    assert (n_words, n_base) == (len(w), len(places))
    assert (first, last) == ((min(places)[0], max(places)[0]) if places else (None, None))
    assert base == ",".join(sorted({x for _, x in places})) and set(base.split(",")) <= set(labels.split(","))
    assert 0 <= score <= 1


def test_license_expressions():
    assert L.to_postfix("a or b and c with d") == ["id:a", "id:b", "id:c", "id:d", "with", "and", "or"]
    assert L.to_postfix("(a or b) and c") == ["id:a", "id:b", "or", "id:c", "and"]
    assert L.evaluate("MIT OR GPL-3.0-only") == ({"mit", "gpl"}, True)
    assert L.evaluate("MIT AND (GPL-2.0+ WITH Classpath-exception-2.0)") == ({"mit", "gpl"}, False)
    for known, label in (("BSD-3-Clause", "bsd"), ("LGPL-2.1-or-later", "lgpl"), ("GPLv3", "gpl"), ("CC-BY-SA-4.0", "cc-by-sa"), ("CC0-1.0", "cc0"), ("Zlib", "zlib"), ("BSL-1.0", "bsl"), ("LicenseRef-x", "other")):
        assert L.label_of(known) == label
    for bad in ("", "and MIT", "(MIT", "MIT)", "MIT or", "the file", "MIT or thing", "MIT with pleasure", "(MIT or ISC) and x"):
        with pytest.raises(ValueError):
            L.evaluate(bad)
    found = L.Scanner().scan("# SPDX-License-Identifier: Apache-2.0 OR MIT\n\nLicensed under CC BY-NC 4.0. SPDX-License-Identifier: (")
    assert found[5] == "apache,cc-by-nc,mit" and found[7:9] == (2, 1)


def test_license_tags_on_one_long_line():
    """Unknown words are no licences, a tag's expression ends with its line, and many tags are read once each."""
    found = L.Scanner().scan("SPDX-License-Identifier: the file\nMIT")
    assert found[5] == "" and found[7:9] == (1, 1)
    found = L.Scanner().scan("SPDX-License-Identifier: ISC " * 20_000)
    assert found[5] == "isc" and found[7:9] == (20_000, 0) and found[9]


def test_license_query_against_brute_force(spark, small):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    docs[max(docs) + 1] = "A MIT  License, the general\npublic license"
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for r in L.scan_licenses(df).collect():
        w = LICENSE_WORD.findall(docs[r["doc_id"]].translate(LOWER))
        places = [(i, label) for phrase, label in L.BASE.items() for q in [phrase.split()] for i in range(len(w)) if w[i : i + len(q)] == q]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))


def test_license_rows(spark):
    found = L.scan_licenses(documents(spark, ODD, labels=1)).collect()
    assert len(found) == len(ODD) + 2 and all(r["score"] == 0 and r["labels"] == "" for r in found)
    assert L.scan_licenses(documents(spark, ODD).limit(0)).count() == 0


def brute_counts(text):
    w = words(text)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", " ", " ", "\n", "\t", "\xa0", "#", "é"]), max_size=60).map("".join))
def test_quality_counts(text):
    assert Y.counts(text) == brute_counts(text)


def plain_mix(x):
    x &= (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def plain_features(text):
    """Feature numbers of one text by kind, one n-gram after the other."""
    hashes = [plain_mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w.encode()))) for w in words(text)]
    raw = text.encode() + b" "
    four = [int.from_bytes(raw[i : i + 4], "little") * 0x9E3779B1 % (1 << 32) >> 16 for i in range(len(raw) - 3)]
    return [[h % 65536 for h in hashes], [65536 + plain_mix(3 * a + 5 * b) % 65536 for a, b in zip(hashes, hashes[1:])], [131072 + f for f in four]]


def test_quality_verdicts_against_a_plain_version(spark, small):
    """Each text's probability by itself, whatever stands beside it in a batch, and kept for every document."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = Y.QualityModel.from_bytes(Y.train_quality(docs, spark.read.parquet(f"{small}/labels.parquet")))
    found = {r["doc_id"]: r for r in Q.op5_quality_rules(spark, small).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        raw = model.bias + sum(sum(model.weights[f] for f in kind) / max(len(kind), 1) for kind in plain_features(text))
        p = 1 / (1 + math.exp(-(model.slope * raw + model.shift)))
        one = found[r["doc_id"]]
        assert one["quality"] == pytest.approx(p, abs=1e-6)
        assert one["kept"] == (not one["base_failed"] and p >= 0.5) or abs(p - 0.5) < 1e-6
    texts = [b"", b"a", b"ab cd", b"", b"xyz", b"some more words"]
    assert np.allclose(model.raw(texts), [model.raw([t])[0] for t in texts], atol=1e-9)


def test_quality_learns(spark, small):
    docs, labels = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{small.replace('0.001', '0.01')}/labels.parquet")
    rows = {r["doc_id"]: r["quality"] for r in labels.collect()}
    texts = [(r["text"].encode(), rows[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in rows]
    half = len(texts) // 2
    model = Y.fit([t for t, _ in texts[:half]], np.array([q for _, q in texts[:half]]))
    good = model.probability([t for t, _ in texts[half:]]) >= Y.KEEP_FROM
    want = np.array([q for _, q in texts[half:]]) == 1
    passing = np.array([not (c[0] < 50 or 2 * c[4] > c[0]) for c in (Y.counts(t.decode()) for t, _ in texts[half:])])
    assert good[want].mean() > 0.97 and (good[passing] == want[passing]).mean() > 0.95
    again = Y.QualityModel.from_bytes(model.to_bytes())
    assert np.allclose(again.probability([b"a b", b""]), model.probability([b"a b", b""]))


def test_quality_rows(spark):
    df = documents(spark, [*ODD, "good words here " * 30, " ".join(f"w{i}" for i in range(80))], kept=1, quality=2)
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = Y.train_quality(df, labels)
    assert model == b""
    found = {r["doc_id"]: r for r in Y.judge_quality(df, model).collect()}
    assert found[len(ODD) + 1]["kept"] and not found[len(ODD)]["kept"] and found[0]["base_failed"] and found[0]["n_words"] == 0
    kept = Y.keep_quality(df, model)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [len(ODD) + 1]
    assert Y.judge_quality(df.limit(0), model).count() == 0 and Y.train_quality(df.limit(0), labels) == b""


def test_word_hashes_across_windows(monkeypatch):
    from aspectra.llm import hashing

    data, _ = join_texts([b"ab cd ab", b"x" * 50 + b" cd"])
    starts, ends = word_spans(data)
    want = word_hashes(data, starts, ends)
    monkeypatch.setattr(hashing, "_WINDOW", 8)
    assert (word_hashes(data, starts, ends) == want).all() and want[0] == want[2] and want[1] == want[4] and len(set(want.tolist())) == 3


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = GruModel(np.array([9.0, 5, 3, 2]), np.array([4.0, 1]), 2, hidden=4)
    model.unpack((rng.normal(size=len(model.pack())) * 0.3).astype(np.float32))
    for name in GruModel.NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64))
    window = rng.integers(0, 6, (3, 5))
    window[1, 4:] = -1
    found = []
    trainer = Trainer(model)
    trainer._adam = lambda grads: found.extend(g.copy() for g in grads)
    warm = np.full((3, 5), -1)
    trainer.update(warm, window)
    for p, g in zip(model.parameters(), found[:6], strict=True):
        for k in rng.integers(0, p.size, 6):
            flat, eps = p.reshape(-1), 1e-5
            keep = flat[k]
            flat[k] = keep + eps
            up = trainer.update(warm, window)
            flat[k] = keep - eps
            down = trainer.update(warm, window)
            flat[k] = keep
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[k]) < 1e-3


def test_scores_carry_state_and_sum_to_one():
    model = GruModel(np.array([9.0, 5, 3]), np.array([4.0, 1]), 2, hidden=4)
    rng = np.random.default_rng(1)
    model.unpack((rng.normal(size=len(model.pack())) * 0.5).astype(np.float32))
    prefix = [0, 3, 2]
    each = model.score([np.array([*prefix, t]) for t in range(5)])
    assert np.exp(each - model.score([np.array(prefix)])[0]).sum() == pytest.approx(1, abs=1e-5)
    long = rng.integers(0, 5, 300)
    h, total, before = np.zeros((1, 4), np.float32), 0.0, len(model.inputs) - 1
    for t in long:
        h = model.step(h, np.array([before]))[0]
        total += model.log_likelihood(h, np.array([t]))[0]
        before = t
    assert model.score([long, np.array([1])])[0] == pytest.approx(total, rel=1e-5)


def test_language_model_rows(spark):
    texts = [*ODD, *(["the cat sat on the mat " * 6, "der hund lief in den wald " * 6] * 20)]
    df = documents(spark, texts, score=1, held_out=2)
    found = score_documents(df).collect()
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = lambda t: [*words((t or "").translate(LOWER)), ""]
    counts = collections.Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((d if d is not None else -1, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want])
    assert all(r["score"] <= 0 for r in found)
    assert score_documents(df.limit(0)).count() == 0


def test_training_reads_every_window_of_every_document(monkeypatch):
    """Also documents shorter than a window, and with the state of the windows before."""
    from aspectra.llm import lm_score

    seen, rng = [], np.random.default_rng(3)
    model = GruModel(np.arange(900.0, 0, -1), np.ones(2), 4, hidden=4)
    trainer = Trainer(model, rate=0.0)
    carry = trainer.carry

    def watched(h, before, window, least):
        out = carry(h, before, window, least)
        seen.extend(zip(h, before, window, strict=True))
        return out

    monkeypatch.setattr(trainer, "carry", watched)
    monkeypatch.setattr(lm_score, "EARLY_LANES", 3)
    monkeypatch.setattr(lm_score, "TRAIN_LANES", 5)
    monkeypatch.setattr(lm_score, "EARLY_TOKENS", 900)
    reader = lm_score.Reader(trainer, 0)
    documents = [np.concatenate([[i], rng.integers(100, 902, n - 1)]) for i, n in enumerate((1, 2, 31, 32, 33, 64, 65, 700, *[40] * 80))]
    for d in documents:
        reader.add(d)
    reader.finish()
    want = []
    for d in documents:
        h, before = trainer.start(1)
        for s in range(0, len(d), 32):
            want.append((before[0], d[s : s + 32].tolist(), h[0]))
            for t in d[s : s + 32]:
                h, before = model.step(h, before)[0], np.array([t])
    key = lambda x: (x[1], x[0])
    got = sorted(((b, w[w >= 0].tolist(), h) for h, b, w in seen), key=key)
    want.sort(key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-5)
    assert reader.trained == sum(map(len, documents)) and trainer.held == 0 and trainer.updates > 0 and reader.lanes == 5


def test_most_frequent_words_fit_the_table(spark):
    from aspectra.llm.lm_score import most_frequent

    data = [(f"w{i}", c) for i, c in enumerate([1] * 50 + [2] * 20 + [300, 301, 10**6, 5, 5])] + [("x" * 65, 10**9)]
    counts = spark.createDataFrame(data, "word string, c long")
    for most, want in ((0, 0), (1, 1), (2, 1), (4, 3), (5, 5), (24, 5), (25, 25), (74, 25), (75, 75), (999, 75)):
        found = most_frequent(counts, most)
        assert len(found) == want and found == sorted(found, key=lambda r: (-r[1], r[0]))
        assert all(c >= max((c for w, c in data if len(w) < 65 and (w, c) not in found), default=0) for _, c in found)


def test_language_model_beats_the_base(spark, small):
    found = [r for r in Q.op4_lm_score(spark, small.replace("0.001", "0.01")).collect() if r["held_out"]]
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_serialisation_width():
    from aspectra.llm.token_files import build_file, compressor

    ids = np.arange(5, dtype="<u4")
    content = build_file(hashlib.sha256(b"").digest(), 4, [3], [5], 0, [compressor(b"").compress(ids.tobytes())])
    assert (TokenFile(content, b"").ids(0) == ids).all() and struct.unpack_from("<B", content, 36)[0] == 4


def test_documents_of_many_small_batches_are_scored_side_by_side():
    from aspectra.llm.lm_score import in_groups

    batches = [pa.RecordBatch.from_pydict({"id": list(range(i, i + 1000)), "text": ["x" * (i // 1000)] * 1000}) for i in range(0, 10_000, 1000)]
    groups = list(in_groups(iter(batches)))
    assert [g.num_rows for g in groups] == [4000, 4000, 2000] and [i for g in groups for i in g["id"].to_pylist()] == list(range(10_000))
    assert [g.num_rows for g in in_groups(iter(batches), size=1)] == [1000] * 10 and not list(in_groups(iter([])))
