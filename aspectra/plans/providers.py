"""Models from outside, as replaceable functions with offline defaults.

The defaults are deterministic; they stand in for shape and behaviour, not for
the quality of a trained model.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from aspectra.plans.constants import HYPOTHETICALS

Encoder = Callable[[Sequence[str]], np.ndarray]
#: Texts that are encoded at a time.
SLICE = 512


def hashing_encoder(dimensions: int = 768) -> Encoder:
    """Signed hashed words, unit length; a text without words gets a fixed axis."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                mark = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[mark % dimensions] += 1.0 if mark >> 63 else -1.0
            if not row.any():
                row[0] = 1.0
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return encode


def embed(chunks: DataFrame, keys: list[str], text: str, encoder: Encoder, dimensions: int) -> DataFrame:
    """(keys, text, embedding) encoded SLICE texts at a time; a wrong number of dimensions raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                vectors = np.asarray(encoder([t or "" for t in part.column(text).to_pylist()]), np.float32)
                if vectors.shape != (part.num_rows, dimensions):
                    raise ValueError(f"encoder gave {vectors.shape}, not {(part.num_rows, dimensions)}")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * dimensions, pa.int32()), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "embedding"])

    wanted = chunks.select(*keys, text)
    return wanted.mapInArrow(run, StructType([*wanted.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def query_vector(query: str, encoder: Encoder, hypothetical: Callable[[str, int], Sequence[object]] | None = None, most: int = HYPOTHETICALS) -> list[float]:
    """Mean of the query's and its hypothetical comments' vectors, made unit length."""
    made = [h for h in (hypothetical(query, most) if hypothetical else []) if isinstance(h, str) and h.strip()][:most]
    vectors = np.asarray(encoder([*made, query]), np.float64)
    if not made:
        return vectors[0].tolist()
    mean = vectors.mean(axis=0)
    return (mean / (np.linalg.norm(mean) + 1e-12)).tolist()


_NOISE = r"(?iu)\([^)]*\)|\b\d{1,3}\s*%|\b\d+\s*(?:gb|tb)(?:\s*/\s*\d+\s*(?:gb|tb))?|(?<!\S)(?:cũ|mới|chính hãng|vn/a|xách tay|giảm(?: giá)?|hot|kèm quà tặng|bản mỹ|ram|rom)(?!\S)"
_CHIP = r"(Snapdragon \d+(?:\+| Plus)?(?: Gen \d+)?|Exynos \d+|Dimensity \d+|Helio [A-Z]\d+|Apple A\d+(?: Pro| Bionic)?|Kirin \d+)"


def normalized_name(name: Column, chipset: Column) -> Column:
    """Rule-based query name: marketing words and sizes removed, chip line names from the chipset added."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(name, _NOISE, " "), r"(?U)\s+", " "))
    chips = F.array_distinct(F.regexp_extract_all(F.coalesce(chipset, F.lit("")), F.lit(_CHIP), F.lit(1)))
    new = F.filter(chips, lambda c: ~F.contains(F.lower(plain), F.lower(c)))
    return F.coalesce(F.nullif(F.array_join(F.concat(F.array(plain), new), " "), F.lit("")), name)


def vocabulary_codec(path: str) -> tuple[Callable[[str], list[int]], Callable[[list[int]], str]]:
    """(encode, decode) by a vocabulary file of the tokenizers library, loaded once in each worker."""
    loaded: dict[str, object] = {}

    def tokenizer():
        if path not in loaded:
            from tokenizers import Tokenizer

            loaded[path] = Tokenizer.from_file(path)
        return loaded[path]

    return (lambda text: tokenizer().encode(text, add_special_tokens=False).ids), (lambda ids: tokenizer().decode(ids))


def compound_segmenter(compounds: Sequence[str], joint: str = "_") -> Callable[[str], str]:
    """Joins the words of known compounds, longest first, as word segmenters do; no trained model is needed."""
    many = sorted({" ".join(c.split()) for c in compounds if len(c.split()) > 1}, key=lambda c: (-len(c), c))
    if not many:
        return lambda text: text
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, many)) + r")(?!\w)", re.IGNORECASE)
    return lambda text: pattern.sub(lambda m: m[0].replace(" ", joint), text)


class ExhaustedKeys(RuntimeError):
    pass


@dataclass
class KeyPool:
    """API keys in rotation on the driver; exhausted ones drop out."""

    keys: Sequence[str]

    def __post_init__(self) -> None:
        from threading import Lock

        self._lock, self._open = Lock(), deque(dict.fromkeys(k for k in self.keys if k))

    def take(self) -> str:
        with self._lock:
            if not self._open:
                raise ExhaustedKeys("all keys are used up")
            self._open.rotate(-1)
            return self._open[-1]

    def exhaust(self, key: str) -> None:
        with self._lock:
            if key in self._open:
                self._open.remove(key)
