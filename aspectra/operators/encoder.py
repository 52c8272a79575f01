"""A text encoder whose weights are learnt from the corpus: inverse document frequencies and a truncated factorisation.

A text is its words, hashed to FEATURES numbers, weighted by rarity and scaled
to unit length. The projection to fewer dimensions spans the range of the
features' products met by a random sketch (one step of a randomised
factorisation): tasks add up their texts' parts of it, which are of one fixed
size, sums go by blocks of features in two steps, and the driver makes the
small matrix orthonormal. Texts are read twice.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.plans.providers import Encoder
from aspectra.session import ship_code

FEATURES, BLOCKS, SPREAD = 4096, 64, 64
#: Words whose features a worker remembers; others are hashed again.
HELD_NUMBERS = 1 << 15
_WORD = re.compile(r"\w+")
_numbers: dict[str, int] = {}


def _number(word: str) -> int:
    """The word's feature; a worker keeps those of a bounded number of words."""
    found = _numbers.get(word)
    if found is None:
        if len(_numbers) >= HELD_NUMBERS:
            _numbers.clear()
        found = _numbers[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little") % FEATURES
    return found


def features(texts: Sequence[str | None], weights: np.ndarray | None = None) -> np.ndarray:
    """Rows of unit length: 1 + log of each feature's count, times its weight; zero for texts without words."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts, strict=True):
        counts = Counter(map(_number, _WORD.findall((text or "").lower())))
        row[list(counts)] = 1.0 + np.log(np.fromiter(counts.values(), float, len(counts)))
    if weights is not None:
        out *= weights
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in table["part"])
        return pa.table({"block": table["block"].slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy(*keys).applyInArrow(add, "block int, part binary")


def learn_weights(docs: DataFrame, text: str, dimensions: int = 64, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(weights by feature, projection FEATURES x dimensions) of all texts; only these come to the driver."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text")).where("text is not null")

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for value in batch["text"]:
                found = {_number(w) for w in _WORD.findall(value.as_py().lower())}
                total[list(found)] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array([-1, *at.tolist()], pa.int32()), "n": pa.array([n, *total[at].tolist()], pa.int64())})

    counts = rows.mapInArrow(document_counts, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    held = {r["feature"]: r["n"] for r in counts}
    n = held.pop(-1, 0)
    weights = np.full(FEATURES, np.log(1.0 + n), np.float32)
    for feature, c in held.items():
        weights[feature] = np.log((1.0 + n) / (1.0 + c)) + 0.05
    sketch = np.random.default_rng(seed).standard_normal((FEATURES, dimensions)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((weights, sketch))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, omega = shared.value
        total = np.zeros((FEATURES, dimensions))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                x = features(batch["text"].slice(i, 256).to_pylist(), learnt)
                total += x.T @ (x @ omega)
        blocks = [b.tobytes() for b in np.split(total, BLOCKS)]
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "part": pa.array(blocks, pa.binary())})

    each = rows.mapInArrow(parts, "block int, part binary").withColumn("task", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    sums = _summed(_summed(each, ["block", "task"]), ["block"]).collect()
    whole = np.zeros((FEATURES, dimensions))
    for r in sums:
        size = FEATURES // BLOCKS
        whole[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["part"], np.float64).reshape(size, dimensions)
    shared.unpersist()
    projection, _ = np.linalg.qr(whole) if whole.any() else (np.eye(FEATURES, dimensions), None)
    return weights, projection.astype(np.float32)


def learnt_encoder(weights: np.ndarray, projection: np.ndarray) -> Encoder:
    """Unit vectors; a text of which nothing is left gets a fixed axis."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        parts = [features(texts[i : i + 256], weights) @ projection for i in range(0, len(texts), 256)]
        out = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, projection.shape[1]))
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        none = norms[:, 0] < 1e-9
        out[none] = np.eye(1, out.shape[1])
        norms[none] = 1.0
        return out / norms

    return encode
