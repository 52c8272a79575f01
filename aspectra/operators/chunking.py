"""Chunks of comment texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from aspectra.plans.constants import CHUNK_OVERLAP, CHUNK_SEPARATORS, CHUNK_TOKENS, MODEL_TOKENS, MODEL_TOKENS_RETRY

#: Texts whose chunks a task holds at a time.
SLICE = 256


def window_chunks(docs: DataFrame, key: str, text: str, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_index, chunk_text): windows of `size` words, each `overlap` words into the one before."""
    words = F.filter(F.split(F.col(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    listed = docs.select(key, words.alias("_words")).where(F.size("_words") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("_words") - size) / F.lit(size - overlap))).cast("int")
    each = listed.select(key, "_words", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    piece = F.slice("_words", F.col("chunk_index") * (size - overlap) + 1, F.lit(size))
    return each.select(key, "chunk_index", F.array_join(piece, " ").alias("chunk_text"))


def split_recursively(text: str, length: Callable[[str], int], size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = CHUNK_SEPARATORS) -> list[str]:
    """Chunks of at most `size` by the first separator that occurs, finer ones for parts still too long.

    A separator stays at the start of the part after it; neighbours are merged
    while they fit and share up to `overlap` with the chunk before.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        first, *rest = text.split(separator)
        parts = [p for p in [first, *(separator + r for r in rest)] if p]
    else:
        parts = list(text)
    chunks: list[str] = []
    window: list[tuple[str, int]] = []

    def close() -> None:
        joined = "".join(p for p, _ in window).strip()
        if joined:
            chunks.append(joined)

    for part in parts:
        n = length(part)
        if n > size and finer:
            close()
            window.clear()
            chunks.extend(split_recursively(part, length, size, overlap, finer))
            continue
        if window and sum(k for _, k in window) + n > size:
            close()
            while window and (sum(k for _, k in window) > overlap or sum(k for _, k in window) + n > size):
                window.pop(0)
        window.append((part, n))
    close()
    return chunks


def hard_limit(chunk: str, encode: Callable[[str], list], decode: Callable[[list], str]) -> str:
    """At most MODEL_TOKENS model tokens; fewer where decoding gives more again."""
    tokens = encode(chunk)
    if len(tokens) <= MODEL_TOKENS:
        return chunk
    out = decode(tokens[:MODEL_TOKENS]).strip() or chunk
    return out if len(encode(out)) <= MODEL_TOKENS else decode(tokens[:MODEL_TOKENS_RETRY]).strip() or out


def recursive_chunks(
    docs: DataFrame, key: str, text: str, encode: Callable[[str], list] = str.split, decode: Callable[[list], str] = " ".join, segment: Callable[[str], str] | None = None, counts: str | None = None
) -> DataFrame:
    """(key, chunk_index, chunk_text) with an injected word segmenter and tokenizer; with `counts`, a column of that name holds the chunks' model tokens.

    Chunks are made, and counted, by one Python worker for each task, that holds
    SLICE texts and their chunks at a time.
    """

    def chunked(value: str | None) -> list[str]:
        if value is None:
            return []
        prepared = ((segment(value).strip() if segment else value) or value)
        found = split_recursively(prepared, lambda t: len(encode(t)))
        return [hard_limit(c, encode, decode) for c in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                found = [chunked(value.as_py()) for value in part.column(1)]
                flat = [c for chunks in found for c in chunks]
                columns = [
                    part.column(0).take(pa.array([i for i, chunks in enumerate(found) for _ in chunks], pa.int64())),
                    pa.array([i for chunks in found for i in range(len(chunks))], pa.int32()),
                    pa.array(flat, pa.string()),
                ]
                if counts:
                    columns.append(pa.array([len(encode(c)) for c in flat], pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    collapsed: Column = F.trim(F.regexp_replace(F.col(text), r"(?U)\s+", " "))
    names = [key, "chunk_index", "chunk_text", *([counts] if counts else [])]
    fields = [docs.select(key).schema[0], StructField("chunk_index", IntegerType()), StructField("chunk_text", StringType()), *([StructField(counts, IntegerType())] if counts else [])]
    return docs.select(key, collapsed.alias("_text")).mapInArrow(run, StructType(fields))


def with_token_counts(chunks: DataFrame, text: str, encode: Callable[[str], list], out: str = "n_tokens") -> DataFrame:
    """Chunks with their numbers of model tokens."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else len(encode(t)) for t in texts.to_pylist()], pa.int32())

    return chunks.withColumn(out, count(F.col(text)))
