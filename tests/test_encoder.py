"""The encoder with learnt weights."""

import random

import numpy as np

from aspectra.operators import encoder
from aspectra.operators.encoder import features, learn_weights, learnt_encoder
from aspectra.plans.providers import embed


def corpus():
    rng = random.Random(11)
    topics = [[f"t{k}w{i}" for i in range(80)] for k in range(12)]
    text = lambda k: " ".join(rng.choice(topics[k]) if rng.random() < 0.6 else rng.choice(["the", "a", "of", "and", "to"]) for _ in range(60))
    return [text(i % 12) for i in range(360)], rng


def test_near_copies_rank_above_other_texts(spark):
    texts, rng = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "id long, text string")
    weights, projection = learn_weights(df, "text", 48)
    again = learn_weights(df.repartition(7), "text", 48)
    assert np.allclose(weights, again[0]) and np.allclose(np.abs(projection.T @ again[1]), np.eye(48), atol=1e-2)
    assert np.allclose(projection.T @ projection, np.eye(48), atol=1e-4)
    encode = learnt_encoder(weights, projection)
    vectors = encode(texts)
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1)
    first, topical = 0, 0
    for i in range(60):
        words = texts[i].split()
        for k in rng.sample(range(60), 5):
            words[k] = "and"
        near = vectors @ encode([" ".join(words)])[0]
        order = np.argsort(-near)
        first += order[0] == i
        topical += sum(j % 12 == i % 12 for j in order[:20])
    assert first >= 58 and topical >= 0.9 * 20 * 60  # copies come first, then texts of the same topic


def test_texts_without_words(spark):
    weights, projection = learn_weights(spark.createDataFrame([], "text string"), "text", 8)
    encode = learnt_encoder(weights, projection)
    assert encode([]).shape == (0, 8) and encode(["", "?!"]).tolist() == [[1.0] + [0.0] * 7] * 2
    assert not features([None, ""]).any()
    made = embed(spark.createDataFrame([(1, "a b"), (2, "")], "id long, text string"), ["id"], "text", encode, 8).collect()
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-6 for r in made)


def test_few_texts_and_words_are_held_at_a_time(spark):
    def encode(texts):
        if len(texts) > 512:
            raise ValueError("too many texts at once")
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.range(3000).selectExpr("id", "if(id = 7, null, repeat('a', id % 5)) text").coalesce(1)
    made = embed(df, ["id"], "text", encode, 2).collect()
    assert {r["id"]: list(r["embedding"]) for r in made} == {i: [0.0 if i == 7 else i % 5, 1.0] for i in range(3000)}
    encoder._numbers.clear()
    features([" ".join(f"w{i}" for i in range(50_000))])
    assert len(encoder._numbers) <= 1 << 15
