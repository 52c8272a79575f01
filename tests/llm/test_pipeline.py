import collections
import random

import pytest
from pyspark.sql import functions as F

from aspectra.llm.near_dedup import near_duplicate_classes
from aspectra.llm.quality import judge_quality, train_quality
from tests.llm.brute import near_classes, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    (_, quality), (_, dedup), (_, mix), (_, pack) = corpus_pipeline.STAGES
    kept = quality(spark, docs, small)
    judged = judge_quality(docs, train_quality(docs, spark.read.parquet(f"{small}/labels.parquet"))).where("kept")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in judged.select("doc_id").collect())
    single = dedup(spark, kept, small)
    classes = near_duplicate_classes(kept).where("kept")
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(r[0] for r in classes.select("doc_id").collect())
    mixed = mix(spark, single, small)
    assert kept.columns == single.columns == mixed.columns == docs.columns
    sizes, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in single.collect():
        sizes[r["source"]] += len(words(r["text"]))
        longest[r["source"]] = max(longest[r["source"]], len(words(r["text"])))
    for r in mixed.collect():
        taken[r["source"]] += len(words(r["text"]))
    total, order = sum(sizes.values()), sorted(sizes)
    assert sum(taken.values()) == pytest.approx(total, rel=0.1)
    assert all(taken[s] <= 3 * sizes[s] + longest[s] for s in order)
    packed = pack(spark, mixed, small)
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    copies = mixed.groupBy("doc_id").count()
    assert whole.join(copies, "doc_id").where("n <> t * count").count() == 0 and whole.count() == copies.count()


CLASHES = ("_key", "_kept_id", "_id", "_n", "_times", "_copy", "_source", "key", "node", "size", "c0", "sequence_id")


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Documents with nulls in every column, repeats, ties, a very long text and columns named like working ones."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)]
    good = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    base = good(300)
    texts = [good(rng.randrange(60, 200)) for _ in range(40)] + [base, base, base + " more", None, "", " ", "short", "a b c " * 90, good(30_000)]
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(None, texts[0], "s0"), (None, texts[1], None), (None, None, None), rows[2], rows[2], (3, texts[4], "s1")]
    folder = str(tmp_path_factory.mktemp("odd"))
    df = spark.createDataFrame([(*r, None, None, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, lang string, n_chars long, row long")
    clashing = [F.lit(None if k % 2 else k).cast("long").alias(c) for k, c in enumerate(CLASHES)]
    df.select("*", *clashing).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_on_odd_rows(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    (_, quality), (_, dedup), (_, mix), (_, pack) = corpus_pipeline.STAGES
    kept = quality(spark, docs, odd_tables)
    passed = [r for r in docs.collect() if len(words(r["text"])) >= 50 and not (r["text"] or "").startswith("a b c")]
    assert sorted(r["row"] for r in kept.collect()) == sorted(r["row"] for r in passed)
    single = dedup(spark, kept, odd_tables)
    want = near_classes({r["row"]: r["text"] for r in passed})
    left = single.collect()
    assert sorted(want[r["row"]] for r in left) == sorted(set(want.values()))
    mixed = mix(spark, single, odd_tables)
    assert kept.columns == single.columns == mixed.columns == docs.columns
    sizes, taken = collections.Counter(), collections.Counter()
    for r in left:
        sizes[r["source"]] += len(words(r["text"]))
    for r in mixed.collect():
        taken[r["source"]] += len(words(r["text"]))
    assert set(taken) <= set(sizes) and all(taken[s] <= 3 * sizes[s] + 30_000 for s in sizes)
    packed = pack(spark, mixed, odd_tables).collect()
    tokens = fresh_ids()
    assert sum(r["length"] for r in packed) == sum(len(tokens(r["text"] or "")) + 1 for r in mixed.collect())


def fresh_ids():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_stages_on_an_empty_table(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd_tables)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
