"""Packing documents, in order, into sequences by dynamic programming.

Token streams of documents in id order are cut into sequences of at most
`length` tokens. Allowed cuts are document ends (free), sentence ends and, where
those are far apart, fixed token places (each with a penalty in tokens for the
document it breaks). A sequence costs a fixed number of tokens, so that short
ones are not preferred, and its padding up to `length`, or none where its own
length is a power of two. Over cut places p with cost c the least cost is

    c[j] = fixed + penalty[j] + min( min{c[i] + p[i] : p[j] - p[i] <= length} + length - p[j],
                                     min{c[i] : p[j] - p[i] a power of two} )

and the inner minimum over the sliding window is kept in a monotone queue. A
task works through its stream in stretches; the last, unfinished sequence of a
stretch is carried into the next.

Cases: a null text is empty and has the end id alone; documents longer than a
sequence are cut; null ids come first; repeated rows are packed each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import exclusive_prefix, join_summary, kind_of, partitions_for, stored
from aspectra.llm.tokenizing import encoder_for, few_rows, in_slices
from aspectra.session import ship_code

LENGTH = 2048
SENTENCE_PENALTY, TOKEN_PENALTY, TOKEN_GAP, SEQUENCE_COST = 8, 64, 128, 1024
STRETCH = 1 << 19
SENTENCE_MARKS = (".", "!", "?", "...", "。")


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH, fixed: int = SEQUENCE_COST) -> list[int]:
    """Ends of the cheapest sequences over a stream that starts at 0 and ends at places[-1].

    places: strictly increasing, no two neighbours (nor 0 and the first) more than length apart.
    """
    p = np.concatenate([[0], places])
    n = len(p)
    powers = 1 << np.arange(length.bit_length() - 1 if length & (length - 1) == 0 else length.bit_length())
    ends, begins = [], []
    for q in powers.tolist():
        at = np.searchsorted(p, p - q)
        hit = np.flatnonzero((p[np.minimum(at, n - 1)] == p - q) & (p >= q))
        ends.append(hit)
        begins.append(at[hit])
    order = np.argsort(np.concatenate(ends), kind="stable")
    ends, begins = np.concatenate(ends)[order].tolist(), np.concatenate(begins)[order].tolist()
    place, penalty = p.tolist(), [0, *(penalties + fixed).tolist()]
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + place, index), rising
    k, m = 0, len(ends)
    for j in range(1, n):
        at = place[j]
        while place[queue[0][1]] < at - length:
            queue.popleft()
        best, i = queue[0]
        best += length - at
        while k < m and ends[k] == j:
            if cost[begins[k]] < best:
                best, i = cost[begins[k]], begins[k]
            k += 1
        best += penalty[j]
        cost[j], back[j] = best, i
        value = best + at
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(place[j])
        j = back[j]
    return cuts[::-1]


def cut_places(doc_ends: np.ndarray, ids: np.ndarray, marks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate places and their penalties in a stream of ids: fixed token places fill wide gaps."""
    sentences = np.flatnonzero(np.isin(ids, marks)) + 1
    penalties = np.full(len(ids) + 1, -1, np.int32)
    penalties[TOKEN_GAP :: TOKEN_GAP] = TOKEN_PENALTY
    penalties[sentences] = SENTENCE_PENALTY
    penalties[doc_ends] = 0
    penalties[len(ids)] = 0
    places = np.flatnonzero(penalties >= 0)
    places = places[places > 0]
    return places, penalties[places]


class Packer:
    """Takes documents one by one, gives finished sequences as lists of pieces."""

    def __init__(self, marks: np.ndarray, length: int = LENGTH, stretch: int = STRETCH):
        self.marks, self.length, self.stretch = marks, length, stretch
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, tokens of the document, ids
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        for start in range(0, len(ids), self.stretch):
            piece = ids[start : start + self.stretch]
            self.docs.append((doc_id, start, len(ids), piece))
            self.size += len(piece)
            if self.size >= self.stretch:
                yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[list[tuple]]:
        if not self.docs:
            return
        ids = np.concatenate([d[3] for d in self.docs])
        ends = np.cumsum([len(d[3]) for d in self.docs])
        whole = np.array([d[1] + len(d[3]) == d[2] for d in self.docs])
        cuts = best_cuts(*cut_places(ends[whole], ids, self.marks, self.length), self.length)
        if not last:
            cuts = cuts[:-1]
        begin, k, rest = 0, 0, self.docs
        starts = ends - [len(d[3]) for d in self.docs]
        for cut in cuts:
            sequence = []
            while k < len(rest) and starts[k] < cut:
                doc_id, offset, tokens, piece = rest[k]
                a, b = max(begin, starts[k]), min(cut, ends[k])
                sequence.append((doc_id, offset + int(a - starts[k]), tokens, piece[a - starts[k] : b - starts[k]]))
                if ends[k] > cut:
                    break
                k += 1
            yield sequence
            begin = cut
        kept = []
        for (doc_id, offset, tokens, piece), s in zip(rest[k:], starts[k:], strict=True):
            skip = int(max(begin - s, 0))
            if skip < len(piece):
                kept.append((doc_id, offset + skip, tokens, piece[skip:]))
        self.docs, self.size = kept, sum(len(d[3]) for d in kept)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", end_id: int = 1, length: int = LENGTH, special_as_text: bool = False, path: str | None = None, cached: int | None = None
) -> DataFrame:
    """Written pieces: doc_id, start, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset.

    `path` names the folder they are written to; `cached` bounds the pieces that a worker keeps. Strings of the vocabulary's special tokens in a text get those tokens' ids, or with special_as_text the ids of ordinary text.
    """
    spark = docs.sparkSession
    ship_code(spark)
    schema = f"part long, sequence long, doc_id {kind_of(docs, id_col)}, start long, doc_tokens long, offset long, ids binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        encoder = encoder_for(vocabulary, True, special_as_text, cached)
        marks = np.unique([x[-1] for x in (encoder._ids(m) for m in SENTENCE_MARKS) if len(x) == 1])
        packer, tail, rows, id_kind = Packer(marks, length), struct.pack("<I", end_id), [], [pa.null()]

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 2 + [id_kind[0]] + [pa.int64()] * 3 + [pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "sequence", "doc_id", "start", "doc_tokens", "offset", "ids"])
            rows.clear()
            return batch

        def keep(sequences: Iterator[list[tuple]]) -> None:
            nonlocal number
            for sequence in sequences:
                offset = 0
                for doc_id, start, tokens, ids in sequence:
                    rows.append((part, number, doc_id, start, tokens, offset, ids.tobytes()))
                    offset += len(ids)
                number += 1

        for batch in few_rows(batches):
            texts, doc_ids = [t or "" for t in batch["text"].to_pylist()], batch["id"].to_pylist()
            id_kind[0] = batch["id"].type
            for a, b in in_slices(texts):
                for doc_id, raw in zip(doc_ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    keep(packer.add(doc_id, np.frombuffer(raw + tail, "<u4")))
                if len(rows) >= 2000:
                    yield out()
        keep(packer.flush())
        if rows:
            yield out()

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(partitions_for(spark), "id", "row").sortWithinPartitions("id", "row").select("id", "text")
    pieces = stored(ordered.mapInArrow(pack, schema), "packed", path, compression="zstd")
    counts = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("n"))
    starts = exclusive_prefix(counts, "part", "n", "before").select("part", "before")
    return join_summary(pieces, starts, "part", partitions_for(spark)).select("doc_id", "start", "doc_tokens", (F.col("before") + F.col("sequence")).alias("sequence_id"), "offset", "ids")


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
