"""Quality rules: fixed limits on counts, then a calibrated n-gram classifier.

Hashed n-grams, of one and two words and of four UTF-8 bytes of text, are the
features of a logistic regression, each weighted by its share among its kind in
the whole text. It is trained on labelled quality rows and calibrated on those
it has not seen (Platt scaling); texts are scored in Arrow batches against a
fixed probability.

The training sample is bounded: the `sample_rows` labelled documents of smallest
hash, at most `sample_bytes` of text, fit in one executor task. Everything else
covers all rows and whole texts.

Cases: a null text has no words and fails; labels that are null or repeat for a
document in conflict are left out; without both classes in the sample the method
has no opinion and every text that passes the limits is kept; repeated rows are
judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import kind_of
from aspectra.llm.hashing import join_texts, mix, word_hashes, word_spans
from aspectra.llm.tokenizing import few_rows, forget_encoders, in_slices
from aspectra.session import ship_code

BITS = 16
KINDS = 3
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 32 << 20
EPOCHS, RATE, DECAY = 5, 0.5, 1e-6
KEEP_FROM = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text, exactly."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which the list holds twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    v = len(number)
    if v < 2_000_000:
        windows = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # three numbers no longer fit one
        windows = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(windows) + 2, bool)
    hit = np.concatenate([order[:-1][same], order[1:][same]])
    for shift in range(3):
        twice[hit + shift] = True
    return int(twice.sum())


def ngrams(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: feature numbers text by text, and where each text's begin (and the end)."""
    data, offsets = join_texts(texts)
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    mask = np.uint64((1 << BITS) - 1)
    pairs = np.append(mix(words[:-1] * np.uint64(3) + words[1:] * np.uint64(5)), np.uint64(0)) if len(words) else words
    text_of_word = np.repeat(np.arange(len(texts)), np.diff(first))
    inner = np.flatnonzero(np.diff(text_of_word, append=-1) == 0)
    pair_first = np.searchsorted(inner, first)
    wide = data.astype(np.uint32)
    four = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24) if len(data) > 3 else wide[:0]
    inside = np.ones(len(four), bool)  # no window reaches into the next text
    for back in (1, 2, 3):
        last = offsets[1:] - back
        inside[last[(last >= 0) & (last < len(four))]] = False
    places = np.flatnonzero(inside)
    chars = (four[places] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    byte_first = np.searchsorted(places, offsets)
    return [
        ((words & mask).astype(np.int64), first),
        ((pairs[inner] & mask).astype(np.int64) + (1 << BITS), pair_first),
        (chars.astype(np.int64) + (2 << BITS), byte_first),
    ]


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def raw(self, texts: list[bytes]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for features, first in ngrams(texts):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[features], dtype=np.float64)])
            n = np.diff(first)
            total += (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
        return total

    def probability(self, texts: list[bytes]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.raw(texts) + self.shift, -30, 30)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weights=self.weights, rest=[self.bias, self.slope, self.shift])
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> QualityModel:
        found = np.load(io.BytesIO(raw))
        return cls(found["weights"], *found["rest"].tolist())


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> QualityModel | None:
    """Adagrad on three quarters, Platt scaling on the rest; None without both classes in both parts."""
    fold = np.arange(len(texts)) % 4 == 3
    if any(len(np.unique(labels[part])) < 2 for part in (fold, ~fold)):
        return None
    rows = []
    for text in texts:
        features, shares = [], []
        for found, _ in ngrams([text]):
            f, n = np.unique(found, return_counts=True)
            features.append(f)
            shares.append(n / max(len(found), 1))
        rows.append((np.concatenate(features), np.concatenate(shares)))
    model = QualityModel(np.zeros(KINDS << BITS), 0.0, 1.0, 0.0)
    squares, bias_square = np.full(KINDS << BITS, 1e-6), 1e-6
    rng, train = np.random.default_rng(seed), np.flatnonzero(~fold)
    balance = np.where(labels == 1, 0.5 / max(labels[train].mean(), 1e-9), 0.5 / max(1 - labels[train].mean(), 1e-9))
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            features, shares = rows[i]
            p = 1.0 / (1.0 + np.exp(-np.clip(model.bias + model.weights[features] @ shares, -30, 30)))
            error = (p - labels[i]) * balance[i]
            gradient = error * shares + DECAY * model.weights[features]
            squares[features] += gradient**2
            model.weights[features] -= RATE * gradient / np.sqrt(squares[features])
            bias_square += error**2
            model.bias -= RATE * error / np.sqrt(bias_square)
    raw = np.array([model.bias + model.weights[rows[i][0]] @ rows[i][1] for i in np.flatnonzero(fold)])
    y, a, b = labels[fold].astype(float), 1.0, 0.0
    smooth = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(200):  # Newton steps on the two calibration parameters
        p = 1.0 / (1.0 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - smooth) * raw).sum() + 1e-3 * (a - 1), (p - smooth).sum()])
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(a), float(b)
    return model


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """The fitted model as bytes, empty if there is nothing to learn; the sample stays in one executor task."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks, size = [], [], 0
        for batch in batches:
            for text, mark in zip(batch["text"].to_pylist(), batch["mark"].to_pylist(), strict=True):
                raw = text.encode()
                if size + len(raw) <= sample_bytes:
                    texts.append(raw)
                    marks.append(mark)
                    size += len(raw)
        model = fit(texts, np.array(marks, np.int64)) if texts else None
        yield pa.RecordBatch.from_pydict({"model": pa.array([model.to_bytes() if model else b""], pa.binary())})

    marked = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("mark")).where("mark in (0, 1) and _id is not null")
    marked = marked.groupBy("_id").agg(F.min("mark").alias("mark"), F.max("mark").alias("most")).where("mark = most").drop("most")
    chosen = marked.withColumn("k", F.xxhash64("_id", F.lit(3))).orderBy("k", "_id").limit(sample_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    joined = texts.join(F.broadcast(chosen), "_id").select("k", "text", "mark").orderBy("k").limit(sample_rows)
    fitted = joined.select("text", "mark").coalesce(1).mapInArrow(train, "model binary").collect()
    return max((bytes(r[0]) for r in fitted), key=len, default=b"")


def judge_quality(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its counts, base_failed, kept and the probability of good quality, see SCHEMA."""
    ship_code(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        fitted = QualityModel.from_bytes(model) if model else None
        for batch in few_rows(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            for a, b in in_slices(texts):
                found = np.array([counts(t) for t in texts[a:b]], np.int64).reshape(-1, 5)
                score = fitted.probability([t.encode() for t in texts[a:b]]) if fitted else np.ones(b - a)
                failed = (found[:, 0] < MIN_WORDS) | (100 * found[:, 4] > MAX_REPEAT_PERCENT * found[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), *map(pa.array, found.T), pa.array(failed), pa.array(~failed & (score >= KEEP_FROM)), pa.array(score)],
                    names=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(judge, SCHEMA.replace("doc_id long", f"doc_id {kind_of(docs, id_col)}", 1))


def keep_quality(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """The documents, all their columns unchanged, that pass the limits and the classifier."""
    ship_code(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        fitted = QualityModel.from_bytes(model) if model else None
        for batch in few_rows(batches):
            texts = [t or "" for t in batch[text_col].to_pylist()]
            good = []
            for a, b in in_slices(texts):
                found = np.array([counts(t) for t in texts[a:b]], np.int64).reshape(-1, 5)
                failed = (found[:, 0] < MIN_WORDS) | (100 * found[:, 4] > MAX_REPEAT_PERCENT * found[:, 0])
                score = fitted.probability([t.encode() for t in texts[a:b]]) if fitted else np.ones(b - a)
                good.append(~failed & (score >= KEEP_FROM))
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(keep, docs.schema)
