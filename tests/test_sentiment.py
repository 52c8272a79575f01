"""Naive Bayes over comments, and advice by it."""

import math
import re

import pytest
from pyspark.sql import functions as F

from aspectra.operators.sentiment import Sentiment, advise

LABELLED = [("good good phone", 1), ("great camera", 1), ("bad phone", 0), ("bad bad battery", 0), ("so so", None), (None, 1), ("Good!", 1), ("x", 7)]


def brute(text):
    pos, neg = ([w for t, y in LABELLED if t and y == k for w in re.findall(r"\w+", t.lower())] for k in (1, 0))
    size = len({*pos, *neg})
    score = math.log(3 / 2)
    for w in re.findall(r"\w+", text.lower()):
        if w in pos or w in neg:
            score += math.log((pos.count(w) + 1) / (len(pos) + size)) - math.log((neg.count(w) + 1) / (len(neg) + size))
    return score


@pytest.mark.parametrize("frequent", [0, 2, 1000])
def test_scores_against_a_plain_version(spark, frequent):
    sentiment = Sentiment.learn(spark.createDataFrame(LABELLED, "body string, y int"), "body", "y")
    texts = ["good phone good", "BAD", "", "never seen", "so good, so bad", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["score"] for r in sentiment.scored(df, "id", "text", frequent).collect()}
    assert got.keys() == {i for i, t in enumerate(texts) if t is not None}
    assert all(got[i] == pytest.approx(brute(texts[i])) for i in got)


def test_models_of_few_rows(spark):
    empty = Sentiment.learn(spark.createDataFrame([], "body string, y int"), "body", "y")
    assert empty.scored(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text").first()["score"] == 0
    one = Sentiment.learn(spark.createDataFrame([("fine", 1)], "body string, y int"), "body", "y")
    assert one.scored(spark.createDataFrame([(1, "b")], "id long, text string"), "id", "text").first()["score"] == 0


def test_advice(spark):
    sentiment = Sentiment.learn(spark.createDataFrame(LABELLED, "body string, y int"), "body", "y")
    products = spark.createDataFrame([(1, 900.0), (2, 800.0), (3, 700.0), (4, 5000.0), (5, 10.0)], "product_id int, price double")
    comments = spark.createDataFrame([(10, 1, "bad battery"), (11, 1, "good battery"), (12, 2, "good battery good"), (13, 2, "bad screen"), (14, 3, "good screen"), (15, 4, "good battery")], "comment_id long, product_id int, text string")
    found = advise(products, comments, sentiment, {"battery": ["battery"], "camera": ["camera"]}, 1000)
    assert [tuple(r) for r in found.collect()] == [(2, 800.0, 1.0, 1, 12), (1, 900.0, 0.5, 2, 11), (3, 700.0, None, 0, None)]
    assert advise(products.where(F.lit(False)), comments, sentiment, {"battery": ["battery"]}, 1000).count() == 0
