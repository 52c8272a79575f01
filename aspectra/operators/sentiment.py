"""Whether a comment is positive, by naive Bayes over words, and advice that ranks products by it.

Words of labelled comments are counted by class in one aggregation; a word's
weight is the logarithm of its smoothed shares' ratio. A comment's score is the
prior and the weights of its words, summed by built-in expressions. The model is
a table: of its words the FREQUENT most frequent, which may stand in every
comment, are broadcast, and the others are joined by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.functions.text import aspects_of
from aspectra.operators.search import list_products

FREQUENT, SMOOTHING = 10_000, 1.0


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


@dataclass(frozen=True)
class Sentiment:
    """(word, n, weight) of every word seen, and the log odds of the classes. Both classes have to occur, else every comment is as the labelled ones."""

    words: DataFrame
    prior: float

    @classmethod
    def learn(cls, labelled: DataFrame, text: str, label: str, smoothing: float = SMOOTHING) -> Sentiment:
        """From rows with a label of 1 or 0; others and null texts are left out."""
        rows = labelled.where(F.col(label).isin(0, 1) & F.col(text).isNotNull())
        each = rows.select(F.col(label).alias("y"), F.explode(words_of(F.col(text))).alias("word"))
        counts = each.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q")).persist()
        p, q, size = counts.agg(F.sum("p"), F.sum("q"), F.count("*")).first()
        yes, no = rows.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
        prior = F.log(F.lit(float(max(yes, 1)))) - F.log(F.lit(float(max(no, 1))))
        share = lambda c, total: F.log((F.col(c) + F.lit(smoothing)) / F.lit((total or 0) + smoothing * max(size, 1)))
        words = counts.select("word", (F.col("p") + F.col("q")).alias("n"), (share("p", p) - share("q", q)).alias("weight"))
        return cls(words, labelled.sparkSession.range(1).select(prior.alias("x")).first()[0])

    def scored(self, comments: DataFrame, key: str, text: str, frequent: int = FREQUENT) -> DataFrame:
        """(key, score): a row per comment with a text; above 0 is positive. Words never seen count nothing."""
        each = comments.where(F.col(text).isNotNull()).select(key, F.explode_outer(words_of(F.col(text))).alias("word"))
        each = each.groupBy(key, "word").agg(F.count("*").alias("times"))
        common = self.words.orderBy(F.desc("n"), "word").limit(frequent).select("word", "weight").persist()
        near = each.join(F.broadcast(common), "word", "left")
        rare = near.where("weight is null and word is not null").drop("weight").join(self.words.join(common, "word", "left_anti").select("word", "weight"), "word")
        parts = near.select(key, "times", "weight").unionByName(rare.select(key, "times", "weight"))
        sums = parts.groupBy(key).agg(F.sum(F.coalesce(F.col("times") * F.col("weight"), F.lit(0.0))).alias("s"))
        return sums.select(key, (F.col("s") + F.lit(self.prior)).alias("score"))


def advise(products: DataFrame, comments: DataFrame, sentiment: Sentiment, criteria: dict[str, list[str]], max_price: float, candidates: int = 5, shown: int = 3, key: str = "product_id", price: str = "price", comment: str = "comment_id", text: str = "text") -> DataFrame:
    """(key, price, share, n_comments, evidence): the dearest candidates within the price, reranked by comments on the criteria.

    criteria names aspects and their keywords. A comment counts once for each
    criterion that it speaks of. share is that of positive ones; a product of
    whose criteria no comment speaks has none, and comes last. evidence is the
    comment with the best score.
    """
    chosen = list_products(products, max_price=max_price, price=price, tie=key, limit=candidates)
    own = comments.join(F.broadcast(chosen.select(key)), key, "left_semi")
    met = own.select(key, comment, text, F.size(aspects_of(F.col(text), criteria, {})).alias("n_criteria")).where("n_criteria > 0")
    scored = met.select(key, comment, "n_criteria").join(sentiment.scored(met.select(comment, text), comment, text), comment)
    positive = F.sum(F.when(F.round("score", 6) > 0, F.col("n_criteria")).otherwise(0))
    best = F.max_by(comment, F.struct(F.round("score", 6), -F.col(comment)))
    shares = scored.groupBy(key).agg((positive / F.sum("n_criteria")).alias("share"), F.count("*").alias("n_comments"), best.alias("evidence"))
    ranked = chosen.select(key, price).join(F.broadcast(shares), key, "left").orderBy(F.col("share").desc_nulls_last(), F.col(price).desc(), key).limit(shown)
    return ranked.withColumn("n_comments", F.coalesce("n_comments", F.lit(0).cast("long")))
