"""Language identification by interpolated Kneser-Ney character models.

Texts are read as lower-case letters and marks, anything else being one space,
with a boundary before the first. Of all training documents the n-grams of
ORDER characters are counted, in tasks first; the counts of shorter ones are
numbers of distinct longer ones that end in them. Each model takes a discount
from every count and gives it to the next shorter context, down to the uniform
distribution. Models of all languages stand side by side in tables that Spark
keeps: a row of probabilities for each n-gram that any of them has seen and a
row of back-off weights for each context, all of them. The n-grams of ORDER
characters met most often are held by every worker, in a sorted array of 64-bit
hashes. What a text has beside those it gives out by name; these n-grams are
looked up in the tables by joins, the longest known first, and their sums go
back to the text. A text gets the language of the lowest cross-entropy per
character.

A tenth of the training documents is scored by models made of the other nine
tenths: a logistic curve through the distance to the second language gives the
chance of being right, and each language a ceiling for its cross-entropy. Texts
of a small chance or beyond the ceiling are not `accepted`. The final models
count all training documents.

What a worker holds is bounded: MODEL_ROWS n-grams and MODEL_CELLS log
probabilities. The bound moves work into joins and changes no result; all
n-grams and all languages count. Calibration takes CALIBRATION_ROWS numbers.

Cases: a text that is null or has no letter is `und`, score 0, not accepted;
without a language to learn from all texts are; a null language teaches
nothing; a null id reads as the empty string; repeated rows count each; equal
cross-entropies go by the smaller name; an empty table gives no rows; very long
texts are read whole, a block of characters at a time; ids may be of any type;
other columns are ignored.
"""

from __future__ import annotations

import io
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from aspectra.llm.common import quoted, stored
from aspectra.llm.tokenizing import few_rows, forget_encoders, in_slices
from aspectra.session import ship_code

ORDER = 5
MODEL_ROWS, MODEL_CELLS = 1 << 20, 1 << 24
CALIBRATION_ROWS = 20_000
ACCEPT_FROM, CEILING = 0.5, 4.0
UNKNOWN = "und"
#: Characters scored at a time, and distinct n-grams held in a counting task before they are given out.
BLOCK, HELD = 1 << 18, 1 << 19
#: Log probabilities looked up at a time.
FOUND = 1 << 22
SPACE, BOUNDARY = 0x20, 0x02
#: What scoring gives for a text: sums by language over n-grams held, characters, whether there is a letter, and the other n-grams.
MEASURES = (
    StructType()
    .add("sums", T.ArrayType(T.DoubleType()))
    .add("n", "long")
    .add("lettered", "boolean")
    .add("rest", T.ArrayType(StructType().add("gram", "string").add("n", "long")))
)
_PRIME = np.uint64(0xD6E8FEB86659FD93)
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point what it is read as, and whether it is a letter."""
    if not _tables:
        codes, letters = np.full(0x110000, SPACE, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                small = chr(c).lower()
                codes[c], letters[c] = ord(small) if len(small) == 1 else c, True
            elif kind == "M":
                codes[c] = c
        _tables.append((codes, letters))
    return _tables[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, each after ORDER - 1 boundaries; where each text's begin (and the end); whether it has a letter."""
    codes, letters = _table()
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    read = codes[raw]
    blank = read == SPACE
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    starts = offsets[:-1][np.diff(offsets) > 0]
    keep[starts] = ~blank[starts]
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    seen = np.concatenate([[0], np.cumsum(letters[raw])])[offsets]
    pad = ORDER - 1
    out = np.full(int(kept[-1]) + pad * len(texts), BOUNDARY, np.uint64)
    begins = kept + pad * np.arange(len(texts) + 1)
    out[np.arange(int(kept[-1])) + np.repeat(pad * np.arange(1, len(texts) + 1), np.diff(kept))] = read[keep]
    return out, begins, np.diff(seen) > 0


def gram_hashes(chars: np.ndarray) -> list[np.ndarray]:
    """hashes[k]: of the k characters up to each place (of fewer at the front); hashes[0] is of none."""
    out = [np.zeros(len(chars), np.uint64), chars]
    for _ in range(2, ORDER + 1):
        out.append(chars + np.concatenate([[np.uint64(0)], out[-1][:-1]]) * _PRIME)
    return out


class SortedHashes:
    """A sorted array of distinct hashes with an index by their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits))])

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 where they are not."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return out
        head = (wanted >> self.shift).astype(np.int64)
        place, end = self.first[head], self.first[head + 1]
        left = np.flatnonzero(place < end)
        place, end = place[left], end[left]
        while len(left):
            same = self.keys[place] == wanted[left]
            out[left[same]] = place[same]
            more = ~same & (place + 1 < end)
            left, place, end = left[more], place[more] + 1, end[more]
        return out


@dataclass
class LanguageModels:
    """Models small enough for one place. Per order k: hashes of n-grams with log probabilities, hashes of contexts with log back-off weights, by language."""

    languages: list[str]
    uniform: float
    grams: list[np.ndarray] = field(default_factory=list)
    probs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._grams, self._contexts = [SortedHashes(k) for k in self.grams], [SortedHashes(k) for k in self.contexts]

    def add_order(self, *arrays: np.ndarray) -> None:
        for mine, new in zip((self.grams, self.probs, self.contexts, self.weights), arrays, strict=True):
            mine.append(new)
        self.__post_init__()

    def log_probs(self, hashes: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Natural log probabilities (places x languages) by the longest n-gram known; before[k] is the hash of the k characters in front."""
        out = np.zeros((len(hashes[0]), len(self.languages)), np.float64)
        left = np.arange(len(out))
        for k in range(len(self.grams), 0, -1):
            place = self._grams[k - 1].find(hashes[k][left])
            known = place >= 0
            out[left[known]] += self.probs[k - 1][place[known]]
            left = left[~known]
            if not len(left):
                return out
            place = self._contexts[k - 1].find(before[k - 1][left])
            known = place >= 0
            out[left[known]] += self.weights[k - 1][place[known]]
        out[left] += self.uniform
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character (texts x languages), numbers of characters, and whether there is a letter."""
        chars, begins, lettered = characters(texts)
        n = np.diff(begins) - (ORDER - 1)
        sums = np.zeros((len(texts), len(self.languages)))
        owner = np.repeat(np.arange(len(texts)), np.diff(begins))
        for start in range(0, len(chars), BLOCK):
            reach = max(0, start - ORDER)
            hashes = [h[start - reach :] for h in gram_hashes(chars[reach : start + BLOCK])]
            inner = np.flatnonzero(chars[start : start + BLOCK] != BOUNDARY)
            if not len(inner):
                continue
            #: A place's context is what ends one place before it; the first places of a table are boundaries.
            shifted = gram_hashes(chars[max(0, start - ORDER - 1) : start + BLOCK - 1])
            gap = len(chars[start : start + BLOCK])
            before = [h[-gap:] if start else np.concatenate([[np.uint64(0)], h])[:gap] for h in shifted]
            found = self.log_probs([h[inner] for h in hashes], [b[inner] for b in before])
            whose = owner[start : start + BLOCK][inner]
            edge = np.flatnonzero(np.diff(whose, prepend=-1))
            sums[whose[edge]] += np.add.reduceat(found, edge, axis=0)
        return -sums / np.maximum(n, 1)[:, None], n, lettered

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        parts = {f"{name}{k}": a for name in ("grams", "probs", "contexts", "weights") for k, a in enumerate(getattr(self, name))}
        np.savez(out, languages=np.array(self.languages, dtype=np.str_), uniform=self.uniform, orders=len(self.grams), **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> LanguageModels:
        found = np.load(io.BytesIO(raw))
        rest = [[found[f"{name}{k}"] for k in range(int(found["orders"]))] for name in ("grams", "probs", "contexts", "weights")]
        return cls(found["languages"].tolist(), float(found["uniform"]), *rest)


class FrequentGrams:
    """The n-grams of ORDER characters that a worker holds: hashes, and log probabilities by language."""

    def __init__(self, keys: np.ndarray, probs: np.ndarray):
        self.probs, self.index = probs, SortedHashes(keys)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, keys=self.index.keys, probs=self.probs)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> FrequentGrams:
        found = np.load(io.BytesIO(raw))
        return cls(found["keys"], found["probs"])

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Sums of log probabilities (texts x languages), numbers of characters, whether there is a letter; the n-grams not held, each once a text, with their numbers."""
        chars, begins, lettered = characters(texts)
        sums = np.zeros((len(texts), self.probs.shape[1]))
        owner = np.repeat(np.arange(len(texts)), np.diff(begins))
        others, size = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        block = min(BLOCK, max(1, FOUND // self.probs.shape[1]))
        for start in range(0, len(chars), block):
            reach = max(0, start - ORDER + 1)
            hashes = gram_hashes(chars[reach : start + block])[ORDER][start - reach :]
            inner = np.flatnonzero(chars[start : start + block] != BOUNDARY)
            place, whose = self.index.find(hashes[inner]), owner[start : start + block][inner]
            known = place >= 0
            if known.any():
                edge = np.flatnonzero(np.diff(whose[known], prepend=-1))
                sums[whose[known][edge]] += np.add.reduceat(self.probs[place[known]], edge, axis=0, dtype=np.float64)
            if not known.all():
                left = inner[~known]
                others.append((whose[~known], hashes[left], start + left, np.ones(len(left), np.int64)))
                size += len(left)
                if size > HELD:
                    others = [_once(others)]
                    size = 0
        whose, _, ends, n = _once(others)
        codes = chars[ends[:, None] + np.arange(1 - ORDER, 1)].astype("<u4")
        text = codes.tobytes().decode("utf-32-le")
        grams = pa.array([text[j : j + ORDER] for j in range(0, len(text), ORDER)], pa.string())
        offsets = pa.array(np.searchsorted(whose, np.arange(len(texts) + 1)).astype(np.int32))
        rest = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([grams, pa.array(n)], names=["gram", "n"]))
        return sums, np.diff(begins) - (ORDER - 1), lettered, rest


def _once(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(owner, hash, place, number) with each hash once an owner, in order of owners."""
    whose, hashes, ends, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((hashes, whose))
    whose, hashes, ends, n = whose[order], hashes[order], ends[order], n[order]
    new = np.ones(len(whose), bool)
    new[1:] = (whose[1:] != whose[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return whose[first], hashes[first], ends[first], np.add.reduceat(n, first) if len(first) else n


@dataclass
class Calibration:
    """Weights of distance, distance by root of length, and bias; mean and deviation of each language's cross-entropy."""

    languages: list[str]
    curve: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))
    spread: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))

    def judge(self, found: np.ndarray, n: np.ndarray, lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number (-1: none), its cross-entropy, distance to the second, chance of being right, accepted."""
        best = np.argmin(found, axis=1)
        ranked = np.sort(found, axis=1)
        distance = ranked[:, 1] - ranked[:, 0] if found.shape[1] > 1 else np.zeros(len(n))
        chance = _sigmoid(_features(distance, n) @ self.curve)
        accepted = lettered & (chance >= ACCEPT_FROM)
        if len(self.spread):
            mean, deviation = self.spread[best].T
            accepted &= ranked[:, 0] <= mean + CEILING * deviation * np.sqrt(np.maximum(1.0, 200.0 / np.maximum(n, 1)))
        return np.where(lettered, best, -1), ranked[:, 0], distance, np.where(lettered, chance, 0.0), accepted

    def fit(self, distance: np.ndarray, n: np.ndarray, entropy: np.ndarray, best: np.ndarray, right: np.ndarray) -> None:
        """Fit the logistic curve by Newton steps with smoothed targets, and the spread of each language that was right."""
        x, y = _features(distance, n), right.astype(float)
        if len(y):
            target = np.where(right, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
            w = np.array([1.0, 1.0, 0.0])
            for _ in range(100):
                p = _sigmoid(x @ w)
                gradient = x.T @ (p - target) + 1e-2 * w
                hessian = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-2 * np.eye(3)
                step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
                w = w - step
                if np.abs(step).max() < 1e-9:
                    break
            self.curve = w
        spread = [[entropy[m].mean(), entropy[m].std()] if (m := right & (best == k)).sum() >= 10 else [np.inf, 0.0] for k in range(len(self.languages))]
        self.spread = np.array(spread).reshape(-1, 2)


@dataclass
class ModelTables:
    """Models of all languages, whole: per order (gram, n, p) and (ctx, w), arrays of natural logarithms by language; and the n-grams that workers hold."""

    languages: list[str]
    uniform: float = 0.0
    grams: list[DataFrame] = field(default_factory=list)
    contexts: list[DataFrame] = field(default_factory=list)
    frequent: bytes = b""
    calibration: Calibration = field(default_factory=lambda: Calibration([]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _features(distance: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([distance, distance * np.sqrt(n), np.ones(len(distance))], axis=1)


def _distinct(hashes: np.ndarray, counts: np.ndarray, held: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    keys, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    return keys, np.bincount(which, counts, len(keys)), np.bincount(which, held, len(keys)), codes[at]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n, n_held) from (text, lang, held): occurrences of each n-gram of ORDER characters, and those in held documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        pending: dict[str, list[tuple[np.ndarray, ...]]] = {}

        def merge(lang: str) -> None:
            pending[lang] = [_distinct(*(np.concatenate(x) for x in zip(*pending[lang], strict=True)))]

        def give(lang: str) -> Iterator[pa.RecordBatch]:
            merge(lang)
            _, n, held, codes = pending.pop(lang)[0]
            for i in range(0, len(n), 1 << 16):
                block = codes[i : i + (1 << 16)]
                text = np.ascontiguousarray(block, "<u4").tobytes().decode("utf-32-le")
                grams = pa.array([text[j : j + ORDER] for j in range(0, len(text), ORDER)], pa.string())
                sums = [pa.array(x[i : i + (1 << 16)].astype(np.int64)) for x in (n, held)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), grams, *sums], names=["lang", "gram", "n", "n_held"])

        for batch in few_rows(batches):
            by_lang: dict[str, tuple[list[str], list[bool]]] = {}
            for text, lang, held in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), batch["held"].to_pylist(), strict=True):
                texts, marks = by_lang.setdefault(lang, ([], []))
                texts.append(text)
                marks.append(held)
            for lang, (texts, marks) in by_lang.items():
                mine = pending.setdefault(lang, [])
                for a, b in in_slices(texts):
                    chars, begins, _ = characters(texts[a:b])
                    owner_held = np.repeat(np.array(marks[a:b], bool), np.diff(begins))
                    for start in range(0, len(chars), BLOCK):
                        reach = max(0, start - ORDER + 1)
                        hashes = gram_hashes(chars[reach : start + BLOCK])[ORDER][start - reach :]
                        inner = np.flatnonzero(chars[start : start + BLOCK] != BOUNDARY)
                        if not len(inner):
                            continue
                        keys, at, which = np.unique(hashes[inner], return_index=True, return_inverse=True)
                        held = np.bincount(which, owner_held[start : start + BLOCK][inner], len(keys))
                        codes = chars[(start + inner[at])[:, None] + np.arange(1 - ORDER, 1)].astype(np.uint32)
                        mine.append((keys, np.bincount(which, minlength=len(keys)).astype(float), held, codes))
                    if sum(len(x[0]) for x in mine) > HELD // 2:
                        merge(lang)
                        mine = pending[lang]
            if sum(len(x[0]) for found in pending.values() for x in found) > HELD:
                for lang in [*pending]:
                    yield from give(lang)
        for lang in [*pending]:
            if pending[lang]:
                yield from give(lang)

    counted = docs.mapInArrow(count, "lang string, gram string, n long, n_held long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_held").alias("n_held"))


def _hashed(grams: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of n-grams of k characters, and (by length) hashes of their last characters."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(-1, k).astype(np.uint64)
    return codes, np.stack([_ends(codes, j) for j in range(k + 1)]) if len(codes) else np.zeros((k + 1, 0), np.uint64)


def _ends(codes: np.ndarray, j: int) -> np.ndarray:
    """Hash of the last j characters of each row, as gram_hashes has it."""
    out = np.zeros(len(codes), np.uint64)
    for i in range(codes.shape[1] - j, codes.shape[1]):
        out = out * _PRIME + codes[:, i]
    return out


def _levels(counts: DataFrame) -> DataFrame:
    """(k, lang, gram, ctx, c) of all orders from (lang, gram, n) of ORDER characters, written once."""
    levels, current = [], counts.where("n > 0").select("lang", "gram", F.col("n").alias("c"))
    for k in range(ORDER, 0, -1):
        levels.append(current.select(F.lit(k).alias("k"), "lang", "gram", F.substring("gram", 1, k - 1).alias("ctx"), "c"))
        current = current.groupBy("lang", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("c"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return stored(every, "grams")


def _discounts(every: DataFrame, languages: list[str]) -> dict[tuple[int, str], float]:
    """What each order and language takes from every count."""
    single, double = (F.sum((F.col("c") == i).cast("long")) for i in (1, 2))
    found = {(r["k"], r["lang"]): r for r in every.groupBy("k", "lang").agg(single.alias("n1"), double.alias("n2")).collect()}
    given = {at: r["n1"] / (r["n1"] + 2 * r["n2"]) for at, r in found.items() if r["n1"] and r["n2"]}
    return {(k, x): given.get((k, x), 0.5) for k in range(1, ORDER + 1) for x in languages}


def _uniform(every: DataFrame) -> float:
    return float(-np.log(every.where("k = 1").select("gram").distinct().count() + 1))


def build_models(counts: DataFrame, languages: list[str], model_rows: int | None = None) -> LanguageModels:
    """Kneser-Ney models from (lang, gram, n) of ORDER characters, brought to one place; of all n-grams, or for a smaller model of those of largest count.

    Only for small tables: train_languages leaves them with Spark (model_tables) and leaves out none.
    """
    every = _levels(counts)
    discounts = _discounts(every, languages)
    kept = every
    if model_rows is not None:
        heights = every.groupBy("k", "lang", "c").agg(F.count("*").alias("rows"))
        above = heights.withColumn("upto", F.sum("rows").over(Window.partitionBy("k", "lang").orderBy(F.desc("c"))))
        limits = above.where(F.col("upto") <= max(1, model_rows // (ORDER * len(languages)))).groupBy("k", "lang").agg(F.min("c").alias("least"))
        kept = every.join(F.broadcast(limits), ["k", "lang"]).where("c >= least").drop("least")
    totals = every.groupBy("k", "lang", "ctx").agg(F.sum("c").alias("total"))
    rows = kept.join(totals, ["k", "lang", "ctx"]).select("k", "lang", "gram", "c", "total").toArrow()
    number = {x: i for i, x in enumerate(languages)}
    order, lang = rows["k"].to_numpy(), np.array([number[x] for x in rows["lang"].to_pylist()], np.int64)
    grams, c, total = rows["gram"].to_pylist(), rows["c"].to_numpy().astype(float), rows["total"].to_numpy().astype(float)
    models = LanguageModels(languages, _uniform(every))
    for k in range(1, ORDER + 1):
        mine = np.flatnonzero(order == k)
        codes, ends = _hashed([grams[i] for i in mine], k)
        who, discount = lang[mine], np.array([discounts[k, x] for x in languages])[lang[mine]]
        share = np.maximum(c[mine] - discount, 0.0) / total[mine]
        keys, at, which = np.unique(ends[k], return_index=True, return_inverse=True)
        fronts = _ends(codes[:, : k - 1], k - 1)
        contexts, of = np.unique(fronts, return_inverse=True)
        given = np.zeros((len(contexts), len(languages)))
        np.add.at(given, (of, who), share)
        weight = np.clip(1.0 - given, 1e-12, 1.0)
        lower = np.exp(models.log_probs([ends[j][at] for j in range(k)], [_ends(codes[at][:, : k - 1], j) for j in range(k)])) if len(at) else np.zeros((0, len(languages)))
        probs = weight[of[at]] * lower
        np.add.at(probs, (which, who), share)
        models.add_order(keys, np.log(probs).astype(np.float32), contexts, np.log(weight).astype(np.float32))
    return models


def _by_language(pairs: Column, languages: list[str], otherwise: float) -> Column:
    """An array by number of language from pairs of number and value."""
    found = F.map_from_entries(pairs)
    return F.transform(F.sequence(F.lit(0), F.lit(len(languages) - 1)), lambda i: F.coalesce(F.try_element_at(found, i), F.lit(otherwise)))


def _logs(values: Column) -> Column:
    return F.transform(values, lambda x: F.log(x).cast("float"))


def model_tables(counts: DataFrame, languages: list[str], model_rows: int = MODEL_ROWS, model_cells: int = MODEL_CELLS) -> ModelTables:
    """Kneser-Ney models of all n-grams from (lang, gram, n) of ORDER characters; workers are to hold model_rows of them at most."""
    every = _levels(counts)
    numbers = [(k, x, languages.index(x), d) for (k, x), d in _discounts(every, languages).items()]
    numbers = counts.sparkSession.createDataFrame(numbers, "k int, lang string, no int, d double")
    cut = every.join(F.broadcast(numbers), ["k", "lang"]).withColumn("part", F.greatest(F.col("c") - F.col("d"), F.lit(0.0)))
    sums = cut.groupBy("k", "no", "ctx").agg(F.sum("c").alias("total"), F.sum("part").alias("given"))
    weight = F.struct("no", F.greatest(1 - F.col("given") / F.col("total"), F.lit(1e-12)).alias("w"))
    contexts = stored(sums.groupBy("k", "ctx").agg(_by_language(F.collect_list(weight), languages, 1.0).alias("w")), "contexts")
    share = F.struct("no", (F.col("part") / F.col("total")).alias("s"))
    shares = cut.join(sums, ["k", "no", "ctx"]).groupBy("k", "gram", "ctx").agg(F.sum("c").alias("n"), _by_language(F.collect_list(share), languages, 0.0).alias("s"))
    rows = stored(shares.join(contexts, ["k", "ctx"]).select("k", "gram", "n", "s", "w"), "shares")
    tables = ModelTables(languages, _uniform(every), calibration=Calibration(languages))
    lower = None
    for k in range(1, ORDER + 1):
        mine = rows.where(F.col("k") == k).withColumn("end", F.substring("gram", 2, k - 1))
        if lower is None:
            mine = mine.withColumn("low", F.transform("s", lambda _: F.lit(float(np.exp(tables.uniform)))))
        else:
            mine = mine.join(lower.select(F.col("gram").alias("end"), F.col("p").alias("low")), "end")
        p = F.transform("s", lambda x, i: x + F.col("w")[i] * F.col("low")[i])
        lower = stored(mine.select("gram", "n", p.alias("p")), f"order-{k}")
        tables.grams.append(lower.select("gram", "n", _logs(F.col("p")).alias("p")))
        tables.contexts.append(contexts.where(F.col("k") == k).select("ctx", _logs(F.col("w")).alias("w")))
    longest = tables.grams[-1]
    above = longest.groupBy("n").agg(F.count("*").alias("rows")).withColumn("upto", F.sum("rows").over(Window.orderBy(F.desc("n"))))
    least = above.where(F.col("upto") <= min(model_rows, model_cells // len(languages))).agg(F.min("n")).first()[0]
    held = longest.where(F.lit(False) if least is None else F.col("n") >= least).select("gram", "p").toArrow()
    codes = np.frombuffer("".join(held["gram"].to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, ORDER).astype(np.uint64)
    keys, at = np.unique(_ends(codes, ORDER), return_index=True)
    probs = held["p"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, len(languages))
    tables.frequent = FrequentGrams(keys, probs[at]).to_bytes()
    return tables


def _resolved(grams: DataFrame, tables: ModelTables) -> DataFrame:
    """(gram, p) for n-grams of ORDER characters, seen or not: from the shortest up, the context's weight is added, and a known n-gram's own row taken instead."""
    out = grams.withColumn("p", F.array(*[F.lit(tables.uniform)] * len(tables.languages)))
    for k in range(1, ORDER + 1):
        end, ctx = F.substring("gram", ORDER + 1 - k, k), F.substring("gram", ORDER + 1 - k, k - 1)
        weights = tables.contexts[k - 1].withColumnRenamed("ctx", "at")
        out = out.withColumn("at", ctx).join(weights, "at", "left").withColumn("p", F.when(F.col("w").isNull(), F.col("p")).otherwise(F.zip_with("p", "w", lambda x, y: x + y.cast("double")))).drop("at", "w")
        known = tables.grams[k - 1].select(F.col("gram").alias("at"), F.col("p").cast("array<double>").alias("own"))
        out = out.withColumn("at", end).join(known, "at", "left").withColumn("p", F.coalesce("own", "p")).drop("at", "own")
    return out


def cross_entropies(rows: DataFrame, tables: ModelTables) -> DataFrame:
    """Rows with a text (null: empty): their other columns, with entropy (nats per character, an array by language), n and lettered."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(tables.frequent)
    others = [c for c in rows.columns if c != "text"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        grams = FrequentGrams.from_bytes(shared.value)
        for batch in few_rows(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            for a, b in in_slices(texts):
                sums, n, lettered, rest = grams.measure(texts[a:b])
                offsets = pa.array(np.arange(b - a + 1, dtype=np.int32) * sums.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(a, b - a) for c in ["_row", *others]), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())), pa.array(n), pa.array(lettered), rest],
                    names=["_row", *others, "sums", "n", "lettered", "rest"],
                )

    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    kinds = StructType([StructField(c, rows.schema[c].dataType) for c in ["_row", *others]] + MEASURES.fields)
    found = stored(rows.select("_row", *others, "text").mapInArrow(measure, kinds), "measured")
    rest = found.select("_row", F.explode("rest").alias("rest")).select("_row", "rest.gram", "rest.n")
    met = rest.join(_resolved(rest.select("gram").distinct(), tables), "gram")
    more = met.groupBy("_row").agg(F.array(*(F.sum(F.col("n") * F.col("p")[i]) for i in range(len(tables.languages)))).alias("more"))
    sums = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda x, y: x + y))
    entropy = F.transform(sums, lambda x: -x / F.greatest("n", F.lit(1)))
    return found.drop("rest").join(more, "_row", "left").select(*others, entropy.alias("entropy"), "n", "lettered")


def train_languages(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model_rows: int = MODEL_ROWS, model_cells: int = MODEL_CELLS) -> ModelTables:
    """Calibrated models from the documents that `learn` picks (all, without it)."""
    ship_code(docs.sparkSession)
    mark = F.crc32(F.coalesce(quoted(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs if learn is None else docs.where(learn)
    rows = rows.select(F.pmod(F.floor(mark / 4), F.lit(10)).alias("tenth"), quoted(text_col).alias("text"), quoted(lang_col).cast("string").alias("lang"), F.xxhash64(mark, quoted(text_col)).alias("_key")).where("text is not null and lang is not null")
    rows = rows.withColumn("held", F.col("tenth") == 0)
    counts = stored(gram_counts(rows.select("text", "lang", "held")), "gram-counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return ModelTables([])
    fitted = model_tables(counts.select("lang", "gram", (F.col("n") - F.col("n_held")).alias("n")), languages, model_rows, model_cells)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n"].to_numpy()
            best, entropy, distance, _, _ = fitted_calibration.judge(_matrix(batch["entropy"]), n, batch["lettered"].to_numpy(zero_copy_only=False))
            right = [k >= 0 and languages[k] == x for k, x in zip(best, batch["lang"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["_key"], pa.array(best.astype(np.int32)), pa.array(entropy), pa.array(distance), pa.array(n), pa.array(right, pa.bool_())],
                names=["_key", "best", "entropy", "distance", "n", "right"],
            )

    fitted_calibration = fitted.calibration
    seen = cross_entropies(rows.where("held").select("_key", "text", "lang"), fitted)
    seen = seen.mapInArrow(check, "_key long, best int, entropy double, distance double, n long, right boolean").where("best >= 0")
    seen = seen.orderBy("_key", "best", "n").limit(CALIBRATION_ROWS).toArrow()
    tables = model_tables(counts.select("lang", "gram", "n"), languages, model_rows, model_cells)
    tables.calibration.fit(*(seen[c].to_numpy() for c in ("distance", "n", "entropy", "best", "right")))
    return tables


def _matrix(arrays: pa.Array) -> np.ndarray:
    return np.asarray(arrays.flatten()).reshape(len(arrays), -1)


def identify_languages(docs: DataFrame, models: ModelTables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted, entropy) for each document; the id keeps its type."""
    ship_code(docs.sparkSession)
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if not models.languages:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(0.0).alias("entropy"))
    names, calibration = np.array([*models.languages, UNKNOWN], dtype=object), models.calibration

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, entropy, _, chance, accepted = calibration.judge(_matrix(batch["entropy"]), batch["n"].to_numpy(), batch["lettered"].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(names[best], pa.string()), pa.array(chance), pa.array(accepted), pa.array(entropy)],
                names=["doc_id", "lang_pred", "score", "accepted", "entropy"],
            )

    return cross_entropies(rows, models).mapInArrow(judge, f"doc_id {kind}, lang_pred string, score double, accepted boolean, entropy double")
