"""Token ids in binary files with a shared zstandard dictionary.

A dictionary is trained on the serialized id arrays of a bounded sample, the
`sample_docs` documents of smallest hash; only hashes are compared to find them,
then their texts are fetched. Ids take two bytes where the vocabulary and the
end id allow it, else four. Every document's ids are one frame of
their own, compressed with it. A file holds a run of documents in id order:

    magic "TKZ1" | sha256 of the dictionary | id width | documents | offsets, doc ids, counts, starts | frames

so that one short document is read by its offset without the rest. Files are
rows of a written table (part, file, content), which commits whole or not at all;
beside it a table holds the dictionary under its hash, so that the folder alone
is enough to read it.

Cases: a null text is empty and has the end id alone; ids are whole numbers, others raise TypeError; null ids come first;
repeated rows keep their places side by side; an empty table gives no rows; too
small a sample trains no dictionary, and frames are then compressed without one;
strings of the vocabulary's special tokens in a text get those tokens' ids, or
with special_as_text the ids of ordinary text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.llm.common import exclusive_prefix, kind_of, partitions_for, shared_folder, stored
from aspectra.llm.tokenizing import encoder_for, few_rows, forget_encoders, in_slices
from aspectra.session import ship_code

MAGIC = b"TKZ1"
NO_ID = -(1 << 63)
SAMPLE_DOCS, DICTIONARY_BYTES = 1000, 64 << 10
FILE_DOCS, FILE_BYTES = 4096, 8 << 20


def serialize(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def width_for(vocabulary: str, end_id: int) -> int:
    """Bytes that hold every id of the vocabulary and the end id."""
    most = max(encoder_for(vocabulary, False).size - 1, end_id)
    forget_encoders()
    return 2 if most < 1 << 16 else 4


def train_dictionary(docs: DataFrame, text_col: str, id_col: str, encoder_args: tuple, end_id: int, width: int, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """Train on the sample in one executor task; only the dictionary comes to the driver."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, samples = encoder_for(*encoder_args), []
        for batch in batches:
            ids = encoder.encode([t or "" for t in batch["text"].to_pylist()])
            samples += [serialize(x + struct.pack("<I", end_id), width) for x in ids]
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
        except zstandard.ZstdError:
            trained = b""
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([trained], pa.binary())})

    chosen = docs.select(F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.lit(11)).alias("k"))
    last = chosen.select("k").orderBy("k").limit(sample_docs).agg(F.max("k")).first()[0]
    if last is None:
        return b""
    sample = chosen.where(F.col("k") <= F.lit(last)).groupBy("k").agg(F.first("text").alias("text")).select("text").coalesce(1)
    return max((r[0] for r in sample.mapInArrow(train, "dictionary binary").collect()), key=len, default=b"")


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=False, write_dict_id=False)


def build_file(digest: bytes, width: int, ids: list[int], counts: list[int], start: int, frames: list[bytes]) -> bytes:
    n = len(frames)
    offsets = np.zeros(n + 1, "<u8")
    np.cumsum([len(f) for f in frames], out=offsets[1:])
    starts = start + np.concatenate([[0], np.cumsum(counts[:-1])]) if n else np.zeros(0)
    head = MAGIC + digest + struct.pack("<BI", width, n)
    return b"".join([head, offsets.tobytes(), np.array(ids, "<i8").tobytes(), np.array(counts, "<u4").tobytes(), starts.astype("<u8").tobytes(), *frames])


class TokenFile:
    """One file's content: doc_ids, counts, starts (ids of earlier documents of its part), and ids by place."""

    def __init__(self, content: bytes, dictionary: bytes):
        if content[:4] != MAGIC or content[4:36] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file, or another dictionary")
        self.width, n = struct.unpack_from("<BI", content, 36)
        at = 41
        self.offsets = np.frombuffer(content, "<u8", n + 1, at)
        self.doc_ids = np.frombuffer(content, "<i8", n, at := at + 8 * (n + 1))
        self.counts = np.frombuffer(content, "<u4", n, at := at + 8 * n)
        self.starts = np.frombuffer(content, "<u8", n, at := at + 4 * n)
        self.content, self.base = content, at + 8 * n
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.decompressor = zstandard.ZstdDecompressor(dict_data=shared)

    def ids(self, place: int) -> np.ndarray:
        frame = self.content[self.base + int(self.offsets[place]) : self.base + int(self.offsets[place + 1])]
        raw = self.decompressor.decompress(frame, max_output_size=int(self.counts[place]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write_token_files(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, special_as_text: bool = False, path: str | None = None
) -> str:
    """The folder (a new shared one, without `path`) with `files` (part, file, content, in ascending order of id_col) and `dictionary`."""
    spark = docs.sparkSession
    if kind_of(docs, id_col) not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"token files number documents: {id_col} is {kind_of(docs, id_col)}, no whole number")
    path = path or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    ship_code(spark)
    encoder_args, width = (vocabulary, False, special_as_text), width_for(vocabulary, end_id)
    dictionary = train_dictionary(docs, text_col, id_col, encoder_args, end_id, width)
    digest = hashlib.sha256(dictionary).digest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = encoder_for(*encoder_args), compressor(dictionary)
        tail = struct.pack("<I", end_id)
        for batch in few_rows(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            for a, b in in_slices(texts):
                ids = [x + tail for x in encoder.encode(texts[a:b])]
                part = batch.slice(a, b - a)
                frames = [press.compress(serialize(x, width)) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["row"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(frames, pa.binary())],
                    names=["id", "row", "n", "frame"],
                )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, size = [], [], [], 0

        def file() -> pa.RecordBatch:
            content = build_file(digest, width, ids, counts, start, frames)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": pa.array([number], pa.int64()), "ids": pa.array([sum(counts)], pa.int64()), "content": pa.array([content], pa.binary())})

        for batch in batches:
            for i, n, frame in zip(batch["id"].to_pylist(), batch["n"].to_pylist(), batch["frame"].to_pylist(), strict=True):
                ids.append(NO_ID if i is None else i)
                counts.append(n)
                frames.append(frame)
                size += len(frame)
                if len(frames) >= FILE_DOCS or size >= FILE_BYTES:
                    yield file()
                    start += sum(counts)
                    number += 1
                    ids, counts, frames, size = [], [], [], 0
        if frames:
            yield file()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    frames = stored(rows.mapInArrow(encode, "id long, row long, n long, frame binary"), "frames", compression="none")
    ordered = frames.repartitionByRange(partitions_for(spark), "id", "row").sortWithinPartitions("id", "row")
    stored(ordered.mapInArrow(build, "part long, file long, ids long, content binary"), "files", f"{path}/files", compression="none")
    stored(spark.createDataFrame([(digest, dictionary)], "digest binary, dictionary binary"), "dictionary", f"{path}/dictionary")
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decompressed from the files of a folder."""
    ship_code(spark)
    (dictionary,) = (bytes(r["dictionary"]) for r in spark.read.parquet(f"{path}/dictionary").collect())
    files = spark.read.parquet(f"{path}/files")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch["part"].to_pylist(), batch["content"].to_pylist(), strict=True):
                one = TokenFile(content, dictionary)
                for a in range(0, len(one.counts), 512):
                    places = range(a, min(a + 512, len(one.counts)))
                    doc_ids = [None if one.doc_ids[i] == NO_ID else int(one.doc_ids[i]) for i in places]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([part] * len(places), pa.int64()),
                            "doc_id": pa.array(doc_ids, pa.int64()),
                            "in_part": pa.array(one.starts[a : a + 512].astype(np.int64)),
                            "ids": pa.array([one.ids(i).tobytes() for i in places], pa.binary()),
                        }
                    )

    totals = files.groupBy("part").agg(F.sum("ids").alias("n"))
    starts = exclusive_prefix(totals, "part", "n", "before").select("part", "before")
    content = files.select("part", "content").mapInArrow(read, "part long, doc_id long, in_part long, ids binary")
    digest = content.select("part", "doc_id", "in_part", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return digest.join(starts, "part").select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")
