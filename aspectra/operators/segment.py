"""Word segmentation: compounds learnt from the corpus, and the best path through them.

Words that white space parts may belong together ("pin trâu"). Runs of two and
three words are counted over the whole corpus, without crossing anything but a
single space; a run is a compound where it stands more often than its parts
would by chance, at every place it can be parted. A text is then cut into the
units of largest probability in all: a Viterbi path over the unigram lexicon of
compounds and single words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A compound stands so often at least, and so many times as often as by chance; the lexicon holds so many of the most frequent.
MIN_COUNT, MIN_LIFT, MOST_COMPOUNDS, LONGEST = 5, 10.0, 100_000, 3
_WORD = re.compile(r"\w+")


def run_counts(docs: DataFrame, text: str, longest: int = LONGEST) -> DataFrame:
    """(run, size, n): lower-case runs of one to `longest` words parted by single spaces, counted over all texts.

    Runs are counted within each text before they are dealt out by run, so that a
    frequent word sends one row per task and text at most.
    """
    words = r"[\p{L}\p{N}_]+"
    pieces = F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"{words}(?: {words})*"), F.lit(0))
    lists = docs.select(F.explode(pieces).alias("_p")).select(F.split("_p", " ").alias("_w"))
    sizes = F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda k: k <= F.size("_w"))
    runs = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.size("_w") - k + 1), lambda i: F.struct(k.alias("size"), F.array_join(F.slice("_w", i, k), " ").alias("run")))))
    return lists.select(F.explode(runs).alias("r")).groupBy("r.run", "r.size").agg(F.count("*").alias("n"))


def learn_compounds(docs: DataFrame, text: str, min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT, longest: int = LONGEST) -> DataFrame:
    """(run, size, n, lift, total): runs that are compounds, and size 1: the words they are made of.

    lift is the least of n * total / (left * right) over the places where a run
    can be parted. Each place is one join by the part before it and one by the
    part behind it, of counted runs, not of occurrences.
    """
    counts = run_counts(docs, text, longest)
    counts = counts.where(F.col("n") >= min_count).persist()
    total = counts.where("size = 1").agg(F.sum("n").alias("total"))
    part = counts.select(F.col("run").alias("part"), F.col("n").alias("n_part"))
    places = counts.where("size > 1").select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("at"))
    words = F.split("run", " ")
    cut = places.select("run", "size", "n", F.array_join(F.slice(words, 1, F.col("at")), " ").alias("left"), F.array_join(F.slice(words, F.col("at") + 1, F.col("size") - F.col("at")), " ").alias("right"))
    met = cut.join(part.withColumnRenamed("n_part", "n_left"), F.col("left") == F.col("part")).drop("part")
    met = met.join(part.withColumnRenamed("n_part", "n_right"), F.col("right") == F.col("part")).drop("part")
    lifts = met.groupBy("run", "size", "n").agg(F.min(F.col("n") / (F.col("n_left").cast("double") * F.col("n_right"))).alias("share"))
    scored = lifts.join(F.broadcast(total)).withColumn("lift", F.col("share") * F.col("total"))
    compounds = scored.where(F.col("lift") >= min_lift).orderBy(F.desc("n"), "run").limit(MOST_COMPOUNDS).select("run", "size", "n", "lift", "total")
    inner = compounds.select(F.explode(F.split("run", " ")).alias("run")).distinct()
    singles = counts.where("size = 1").join(inner, "run", "left_semi").join(F.broadcast(total)).select("run", "size", "n", F.lit(None).cast("double").alias("lift"), "total")
    return compounds.unionByName(singles)


@dataclass(frozen=True)
class Lexicon:
    """Log probabilities of compounds and of the words in them; other words have that of one occurrence."""

    log_p: dict[str, float]
    other: float
    longest: int

    @classmethod
    def of(cls, learnt: DataFrame) -> Lexicon:
        """From learn_compounds; at most MOST_COMPOUNDS of LONGEST words each come to the driver."""
        rows = learnt.select("run", "size", "n", "total").collect()
        if not rows:
            return cls({}, 0.0, 1)
        total = rows[0]["total"]
        return cls({r["run"]: math.log(r["n"] / total) for r in rows}, math.log(1 / total), max(r["size"] for r in rows))

    def best_path(self, words: Sequence[str]) -> list[int]:
        """Sizes of the units of largest probability; of equal paths the one whose last unit is shorter."""
        best, back = [0.0], [0]
        for end in range(1, len(words) + 1):
            score, size = best[end - 1] + self.log_p.get(words[end - 1], self.other), 1
            for k in range(2, min(self.longest, end) + 1):
                p = self.log_p.get(" ".join(words[end - k : end]))
                if p is not None and best[end - k] + p > score:
                    score, size = best[end - k] + p, k
            best.append(score)
            back.append(size)
        sizes, at = [], len(words)
        while at:
            sizes.append(back[at])
            at -= back[at]
        return sizes[::-1]


def viterbi_segmenter(lexicon: Lexicon, joint: str = "_") -> Callable[[str], str]:
    """Joins the words of each unit of the best path; whatever stands between words stays."""

    def segment(text: str) -> str:
        out, at, run = [], 0, []

        def close() -> None:
            k = 0
            for size in lexicon.best_path([text[a:b].lower() for a, b in run]):
                out.append(joint.join(text[a:b] for a, b in run[k : k + size]))
                k += size
                if k < len(run):
                    out.append(" ")

        for found in _WORD.finditer(text):
            a, b = found.span()
            if run and text[at:a] == " ":
                run.append((a, b))
            else:
                close()
                out.append(text[at:a])
                run = [(a, b)]
            at = b
        close()
        return "".join(out) + text[at:]

    return segment
