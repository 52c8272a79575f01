"""Scoring whole documents with a gated recurrent language model learnt from the corpus.

Token counts over all training documents are gathered first (they also give the
unigram base score). The `WORDS` most frequent tokens get output vectors in
frequency classes; all rarer ones fall into `GROUPS` groups by their last bytes,
and within a group a word's share comes from its count:

    p(rare word | state) = p(group | state) * (c + 0.5) / (N_group + 0.5 (V_group + 1))

so that each group's shares and the one of unknown words add up to one. Every
task trains a replica on its documents by truncated backpropagation, on every
window of every training document; the state goes on from window to window to
a document's end. Replicas are averaged, by trained tokens, in two levels. The
work of training so grows with the corpus.
Lanes are few at first, so that small corpora get many updates, and more later.
Counts of the most frequent tokens, `KNOWN` at most, go to every task; they are
those from a count on that a histogram of counts gives, so that no more than
them comes to the driver. The remaining tokens meet their counts in a join,
which is exact too.

Cases: a null text is empty and consists of the end token; a null doc_id is not
held out; repeated rows are scored each; an empty table gives no rows; a corpus
without training documents leaves equal group probabilities; other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import kind_of, partitions_for, stored
from aspectra.llm.gru import WINDOW, GruModel, Trainer, from_bytes, to_bytes
from aspectra.session import ship_code

WORDS, CLASSES, GROUPS = 2048, 16, 32
KNOWN, LONGEST_KNOWN = 200_000, 64
#: Documents read side by side in training: so many before, and after, EARLY_TOKENS trained tokens of a replica.
EARLY_LANES, TRAIN_LANES, EARLY_TOKENS = 64, 256, 1 << 19
END = b""
FLUSH_WORDS = 400_000
#: Documents scored side by side, and bytes of their columns.
SCORED_ROWS, SCORED_BYTES = 4096, 16 << 20


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def group_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % GROUPS


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words = list(counts)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in words], pa.string()), pa.array([group_of(w) for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "grp", "c"],
        )
        counts.clear()
        return batch

    for batch in batches:
        for text in batch["text"]:
            counts.update(tokens_of(text.as_py()))
            if len(counts) > FLUSH_WORDS:
                yield out()
    if counts:
        yield out()


class Lexicon:
    """The frequent tokens with their numbers and counts, and the totals of groups."""

    def __init__(self, known: list[tuple[str, int]], group_counts: np.ndarray, group_types: np.ndarray, total: int, types: int):
        self.words = [w.encode() for w, _ in known]
        self.counts = np.array([c for _, c in known], np.float64)
        self.group_counts, self.group_types, self.total, self.types = group_counts, group_types, total, types
        self.head = min(WORDS, len(known))

    def model(self) -> GruModel:
        return GruModel(self.counts[: self.head], self.group_counts, CLASSES)

    @cached_property
    def lookup(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
        """Place by word; model token and log10(c + 0.5) by place. Made once in each worker."""
        token = np.arange(len(self.words))
        token[self.head :] = [self.head + group_of(w) for w in self.words[self.head :]]
        return {w: i for i, w in enumerate(self.words)}, token, np.log10(self.counts + 0.5)


def _grade(c):
    """A grade that rises with the count: counts to 255 have their own, then sixteen to a doubling."""
    return F.when(c < 256, c).otherwise(F.floor(F.log2(c) * 16) + 128).cast("int")


def most_frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """Words of all grades from the least on with which there are no more than `most`, the most frequent first."""
    short = counts.where(F.octet_length("word") <= LONGEST_KNOWN).select("word", "c", _grade(F.col("c")).alias("grade"))
    grades = short.groupBy("grade").agg(F.count("*").alias("n")).orderBy(F.desc("grade")).collect()
    passed = list(accumulate(r["n"] for r in grades))
    fit = bisect_right(passed, most)
    if not fit:
        return []
    known = [(r[0], r[1]) for r in short.where(F.col("grade") >= grades[fit - 1]["grade"]).select("word", "c").collect()]
    return sorted(known, key=lambda r: (-r[1], r[0].encode()))


def learn_counts(training: DataFrame) -> tuple[DataFrame, Lexicon]:
    """(word, grp, c) over all training texts, written; and the bounded lexicon."""
    counts = training.mapInArrow(_count, "word string, grp int, c long").groupBy("word", "grp").agg(F.sum("c").alias("c"))
    counts = stored(counts, "counts")
    known = most_frequent(counts, KNOWN)
    groups = counts.groupBy("grp").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    group_counts, group_types = np.zeros(GROUPS), np.zeros(GROUPS)
    for g, n, v in groups:
        group_counts[g], group_types[g] = n, v
    total, types = int(group_counts.sum()), int(group_types.sum())
    for word, c in known[: min(WORDS, len(known))]:
        g = group_of(word.encode())
        group_counts[g] -= c
        group_types[g] -= 1
    return counts, Lexicon(known, group_counts, group_types, total, types)


def _numbered(words: list[bytes], places: dict[bytes, int], token: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Place (-1 if not known) and model token of each word."""
    place = np.fromiter(map(places.get, words, repeat(-1)), np.int64, len(words))
    out = token[place] if len(token) else np.zeros(len(words), np.int64)
    for i in np.flatnonzero(place < 0).tolist():
        out[i] = head + group_of(words[i])
    return place, out


def in_groups(batches: Iterable[pa.RecordBatch], rows: int = SCORED_ROWS, size: int = SCORED_BYTES) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one while they have no more than so many rows and bytes, so that few documents are read to their end alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and (sum(b.num_rows for b in held) + batch.num_rows > rows or sum(b.nbytes for b in held) + batch.nbytes > size):
            yield pa.concat_batches(held)
            held.clear()
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


class Reader:
    """Reads documents side by side, a lane each, and trains on every window of them."""

    def __init__(self, trainer: Trainer, seed: int):
        self.trainer, self.lanes, self.rng = trainer, EARLY_LANES, np.random.default_rng(seed)
        self.waiting: list[np.ndarray] = []
        self.reading: list[np.ndarray] = []
        self.h, self.before = trainer.start(0)
        self.windows = self.trained = 0

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        self.windows += -(-len(tokens) // WINDOW)
        if self.windows >= 128 * self.lanes:
            self.rng.shuffle(self.waiting)
            while self.windows >= 64 * self.lanes:
                self._read()

    def finish(self) -> None:
        self.waiting.sort(key=len)  # the longest are read first, so that few lanes are left over
        while self.waiting or self.reading:
            self._read()
        self.trainer.settle()

    def _read(self) -> None:
        """One window of each lane; lanes at their document's end take the next that waits."""
        new = [self.waiting.pop() for _ in range(min(self.lanes - len(self.reading), len(self.waiting)))]
        self.windows -= sum(-(-len(t) // WINDOW) for t in new)
        self.reading += new
        h, before = self.trainer.start(len(new))
        window = np.full((len(self.reading), WINDOW), -1)
        for row, tokens in zip(window, self.reading, strict=True):
            row[: len(tokens)] = tokens[:WINDOW]
        _, h, before = self.trainer.carry(np.concatenate([self.h, h]), np.concatenate([self.before, before]), window, self.lanes * WINDOW // 2)
        self.trained += int((window >= 0).sum())
        if self.trained >= EARLY_TOKENS:
            self.lanes = TRAIN_LANES
        on = [i for i, tokens in enumerate(self.reading) if len(tokens) > WINDOW]
        self.reading = [self.reading[i][WINDOW:] for i in on]
        self.h, self.before = h[on], before[on]


def train(training: DataFrame, shared) -> np.ndarray | None:
    """Average of the replicas that tasks train, weighted by trained tokens."""

    def replica(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        places, token, _ = lexicon.lookup
        trainer = Trainer(lexicon.model())
        reader = Reader(trainer, TaskContext.get().partitionId())
        for batch in batches:
            for text in batch["text"]:
                reader.add(_numbered(tokens_of(text.as_py()), places, token, lexicon.head)[1])
        reader.finish()
        if reader.trained:
            yield pa.RecordBatch.from_pydict({"weight": pa.array([float(reader.trained)]), "model": pa.array([to_bytes(trainer.model.pack())], pa.binary())})

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0.0, None
        for batch in batches:
            for w, raw in zip(batch["weight"].to_pylist(), batch["model"], strict=True):
                flat = from_bytes(raw.as_py()).astype(np.float64) * w
                total = flat if total is None else total + flat
                weight += w
        if total is not None:
            yield pa.RecordBatch.from_pydict({"weight": pa.array([weight]), "model": pa.array([to_bytes(total / weight)], pa.binary())})

    schema = "weight double, model binary"
    replicas = stored(training.mapInArrow(replica, schema), "replicas")
    groups = max(1, math.isqrt(partitions_for(training.sparkSession)))
    found = replicas.repartition(groups).mapInArrow(mean, schema).repartition(1).mapInArrow(mean, schema).collect()
    return from_bytes(bytes(found[0]["model"])) if found else None


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held"))
    training = rows.where(~F.col("held")).select("id", "text")
    counts, lexicon = learn_counts(training)
    context = spark.sparkContext
    shared = context.broadcast(lexicon)
    parameters = context.broadcast(train(training, shared))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        places, token, logs = lexicon.lookup
        model = lexicon.model()
        if parameters.value is not None:
            model.unpack(parameters.value)
        group_log = np.log10(lexicon.group_counts + 0.5 * (lexicon.group_types + 1))
        for batch in in_groups(batches):
            documents, known, base, share, rare, many = [], [], [], [], [], []
            for text in batch["text"]:
                words = tokens_of(text.as_py())
                place, tokens = _numbered(words, places, token, lexicon.head)
                seen = place >= 0
                documents.append(tokens)
                many.append(len(words))
                known.append(int(seen.sum()))
                base.append(float(logs[place[seen]].sum()))
                grouped = tokens >= lexicon.head
                share.append(float(logs[place[seen & grouped]].sum() - group_log[tokens[grouped] - lexicon.head].sum()))
                rare.append([words[i].decode() for i in np.flatnonzero(~seen).tolist()])
            scores = model.score(documents) / math.log(10) + np.array(share)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["held"], batch["row"], *map(pa.array, (many, known, base)), pa.array(scores), pa.array(rare, pa.list_(pa.string()))],
                names=["id", "held", "row", "n_tokens", "known", "base", "score", "rare"],
            )

    schema = f"id {kind_of(docs, id_col)}, held boolean, row long, n_tokens long, known long, base double, score double, rare array<string>"
    scored = stored(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score, schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n"))
    met = rare.join(counts.select("word", "c"), "word", "left")
    logged = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    sums = met.groupBy("row").agg(F.sum(logged).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("more_known"))
    joined = scored.drop("rare").join(sums, "row", "left")
    more, more_known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    per_token = math.log10(lexicon.total + 0.5 * (lexicon.types + 1))
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + more_known).cast("long").alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
