"""Spelling variant grouping: words one edit apart, by automata over broadcast trie shards.

Words are counted over all whole texts, first per task, then by key. The
vocabulary is cut into shards of words of one length that are neighbours in
code-point order, each a compact trie: an array of (parent, character) keys per
level. Shards are broadcast in rounds of at most ROUND_BYTES, so that neither
the driver nor a worker ever holds more of the vocabulary; in each round every
word's distance-one automaton meets every shard whose words its edits can
reach: by a replacement shards of its own length, by an insertion those of the
next, by a deletion those of the one before. The walk is depth-first over the
trie in blocks of states, each of which stands at one place of the word and one
level. Equal results of several edits (a letter put into a run of itself) are
walked once. Counts of neighbours and the best of them are reduced by word, and
chains of forms are followed by doubling.

Letters are A-Z, a-z and U+00C0 to U+00FF, one byte each in tries.

Cases: a null text has no words; a null id reads as the empty string; repeated
rows count each; forms of equal counts go by the smaller word; words without a
neighbour have none and are their own root; an empty table gives no rows; ids
may be of any type; very long texts and words are read whole (a trie has a level
for each of a word's letters, so that shards of very long words hold few); other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import exclusive_prefix, partitions_for, quoted, stored
from aspectra.llm.tokenizing import few_rows, forget_encoders
from aspectra.session import ship_code

MIN_LENGTH, MIN_COUNT, FORM_TIMES = 5, 3, 2
#: A shard's words and letters, a round's bytes of shards, states walked at a time, words counted in a task before they are given out.
SHARD_WORDS, SHARD_LETTERS, ROUND_BYTES, STATES, HELD_WORDS = 32_768, 1 << 20, 32 << 20, 16_384, 300_000
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """The maximal runs of letters, A-Z lower-cased, a byte for each code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int | None = None) -> DataFrame:
    """(word, n) of all words of at least min_length letters that occur at least min_count times.

    With drop_every, a word of whose CRC-32 of `<id>:<word>` that number is a
    divisor loses the letter at the CRC's remainder by its length.
    """
    ship_code(docs.sparkSession)

    def batch_of(counts: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        total: dict[bytes, int] = {}
        for batch in few_rows(batches):
            for key, text in zip(batch["_id"], batch["text"], strict=True):
                found = Counter(w for w in runs(text.as_py() or "") if len(w) >= min_length)
                start = zlib.crc32((key.as_py() or "").encode() + b":") if drop_every else 0
                for word, n in found.items():
                    if drop_every:
                        h = zlib.crc32(word if word.isascii() else _utf8(word), start)
                        if not h % drop_every:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                    total[word] = total.get(word, 0) + n
                if len(total) >= HELD_WORDS:
                    yield batch_of(total)
                    total = {}
        yield batch_of(total)

    rows = docs.select(quoted(id_col).cast("string").alias("_id"), quoted(text_col).alias("text")).where("text is not null")
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


@dataclass
class Trie:
    """Words of one length: per level the sorted keys parent << 8 | letter; a key's place is its node, a leaf's its word."""

    keys: list[np.ndarray]
    counts: np.ndarray

    @classmethod
    def build(cls, words: list[bytes], counts: list[int]) -> Trie:
        """From distinct words of one length in ascending order."""
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        parts = np.argmax(letters[1:] != letters[:-1], axis=1)
        node, keys = np.zeros(len(words), np.uint32), []
        for level in range(letters.shape[1]):
            new = np.concatenate([[True], parts <= level])
            keys.append(node[new] << np.uint32(8) | letters[new, level])
            node = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        return cls(keys, np.array(counts, np.int64))

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.keys), *map(len, self.keys)], "<u4")
        return sizes.tobytes() + b"".join(k.astype("<u4").tobytes() for k in self.keys) + self.counts.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Trie:
        levels = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes = np.frombuffer(raw, "<u4", levels, 4).astype(np.int64)
        ends = np.cumsum(sizes)
        flat = np.frombuffer(raw, "<u4", int(ends[-1]), 4 + 4 * levels)
        keys = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        return cls(keys, np.frombuffer(raw, "<i8", int(sizes[-1]), 4 + 4 * levels + 4 * int(ends[-1])))

    def __post_init__(self) -> None:
        #: Where each node's children begin, and which letters (by their last five bits) they have.
        self.first, self.has = [], []
        for level, keys in enumerate(self.keys):
            parents = len(self.keys[level - 1]) if level else 1
            self.first.append(np.searchsorted(keys >> np.uint32(8), np.arange(parents + 1)))
            self.has.append(np.bitwise_or.reduceat(np.uint32(1) << (keys & np.uint32(31)), self.first[-1][:-1]))

    def word(self, leaves: np.ndarray) -> list[bytes]:
        """The words of leaves, read upwards."""
        out, node = np.empty((len(leaves), len(self.keys)), np.uint8), leaves
        for level in range(len(self.keys) - 1, -1, -1):
            key = self.keys[level][node]
            out[:, level], node = key & np.uint32(255), key >> np.uint32(8)
        return [row.tobytes() for row in out]

    def near(self, words: np.ndarray, states: int = STATES) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a matrix of words of one length, and the leaves exactly one edit away from them."""
        n, length = words.shape
        levels = len(self.keys)
        edit = levels - length  # 0: replaced, 1: inserted, -1: deleted
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(0, 0, False, np.arange(i, min(i + states, n)), np.zeros(min(states, n - i), np.uint32)) for i in range(0, n, states)]

        def push(at: int, level: int, edited: bool, rows: np.ndarray, nodes: np.ndarray) -> None:
            if edited and at == length:
                if len(rows):
                    found.append((rows, nodes))
                return
            if at < length and level < levels and edited and len(rows):
                seen = self.has[level][nodes] >> (words[rows, at] & np.uint8(31)).astype(np.uint32) & np.uint32(1)
                rows, nodes = rows[seen > 0], nodes[seen > 0]
            stack.extend((at, level, edited, rows[i : i + states], nodes[i : i + states]) for i in range(0, len(rows), states))

        def children(level: int, rows: np.ndarray, nodes: np.ndarray, besides: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            """All children of all nodes, but those by the letter of `besides`."""
            start, size = self.first[level][nodes], self.first[level][nodes.astype(np.int64) + 1]
            size = size - start
            every = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            rows = np.repeat(rows, size)
            if besides is not None:
                other = (self.keys[level][every] & np.uint32(255)) != np.repeat(besides, size)
                rows, every = rows[other], every[other]
            return rows, every.astype(np.uint32)

        while stack:
            at, level, edited, rows, nodes = stack.pop()
            if not edited:
                letter = words[rows, at] if at < length else None
                if edit == 0 and at < length:
                    push(at + 1, level + 1, True, *children(level, rows, nodes, letter))
                elif edit == 1:
                    push(at, level + 1, True, *children(level, rows, nodes, letter))
                elif edit == -1 and at < length:
                    last = words[rows, at + 1] != letter if at + 1 < length else np.ones(len(rows), bool)
                    push(at + 1, level, True, rows[last], nodes[last])
            if at < length and level < levels:
                keys, wanted = self.keys[level], nodes << np.uint32(8) | words[rows, at]
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                there = keys[place] == wanted
                push(at + 1, level + 1, edited, rows[there], place[there].astype(np.uint32))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        return np.concatenate([r for r, _ in found]), np.concatenate([x for _, x in found])


SHARD = "length int, first string, n_words int, trie binary"


def trie_shards(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Tries over the words (word, n), see SHARD; each holds neighbours in the order of length and word."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        counts: list[int] = []

        def shard() -> pa.RecordBatch:
            row = [[len(held[0])], [held[0].decode("latin-1")], [len(held)], [Trie.build(held, counts).to_bytes()]]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["length", "first", "n_words", "trie"])
            held.clear()
            counts.clear()
            return out

        for batch in batches:
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
                raw = word.encode("latin-1")
                if held and (len(raw) != len(held[0]) or len(held) >= shard_words or len(held) * len(raw) >= SHARD_LETTERS):
                    yield shard()
                held.append(raw)
                counts.append(n)
        if held:
            yield shard()

    dealt = words.select("word", "n", F.length("word").alias("length")).repartitionByRange(partitions_for(words.sparkSession), "length", "word")
    return dealt.sortWithinPartitions("length", "word").select("word", "n").mapInArrow(build, SHARD)


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words of one length and their letters, a bounded number of letters at a time."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        numbers = np.flatnonzero(lengths == length)
        step = max(1, SHARD_LETTERS // length)
        for i in range(0, len(numbers), step):
            some = numbers[i : i + step]
            yield some, np.frombuffer(b"".join(words[k] for k in some), np.uint8).reshape(len(some), length)


def near_in(words: list[bytes], tries: list[Trie]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For each word the number of words of the tries one edit away, the largest of their counts and the first word that has it."""
    n_near, best_n, best = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [b""] * len(words)
    for numbers, letters in _by_length(words):
        for trie in tries:
            if abs(len(trie.keys) - letters.shape[1]) > 1:
                continue
            rows, leaves = trie.near(letters)
            if not len(rows):
                continue
            n_near[numbers] += np.bincount(rows, minlength=len(numbers))
            counts = trie.counts[leaves]
            order = np.lexsort((leaves, -counts, rows))
            order = order[np.diff(rows[order], prepend=-1) > 0]
            order = order[counts[order] >= best_n[numbers[rows[order]]]]
            for k, n, word in zip(numbers[rows[order]].tolist(), counts[order].tolist(), trie.word(leaves[order]), strict=True):
                if n > best_n[k] or word < best[k]:
                    best_n[k], best[k] = n, word
    return n_near, best_n, best


def near_words(words: DataFrame, shards: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n_near, best_n, best) for each word that has one within an edit, shards taken round by round."""
    spark = words.sparkSession
    sized = shards.select("length", "first", F.length("trie").cast("long").alias("bytes"))
    rounds = exclusive_prefix(sized.withColumn("place", F.struct("length", "first")), "place", "bytes", "before")
    rounds = rounds.select("length", "first", F.floor(F.col("before") / round_bytes).cast("int").alias("round"))
    dealt = stored(shards.join(rounds, ["length", "first"]), "shards")
    parts = []
    for (k,) in dealt.select("round").distinct().orderBy("round").collect():
        rows = dealt.where(F.col("round") == k).select("length", "trie").collect()
        lengths = [r["length"] for r in rows]
        shared = spark.sparkContext.broadcast([bytes(r["trie"]) for r in rows])

        def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tries = [Trie.from_bytes(t) for t in shared.value]
            for batch in batches:
                given = [w.encode("latin-1") for w in batch["word"].to_pylist()]
                n_near, best_n, best = near_in(given, tries)
                hit = np.flatnonzero(n_near)
                yield pa.RecordBatch.from_arrays(
                    [batch["word"].take(pa.array(hit)), pa.array(n_near[hit]), pa.array(best_n[hit]), pa.array([best[i].decode("latin-1") for i in hit], pa.string())],
                    names=["word", "n_near", "best_n", "best"],
                )

        met = words.select("word").where(F.length("word").between(min(lengths) - 1, max(lengths) + 1))
        parts.append(stored(met.mapInArrow(meet, "word string, n_near long, best_n long, best string"), "near"))
        shared.unpersist()
    if not parts:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(0).cast("long").alias("best_n"), F.lit("").alias("best")).limit(0)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain. A form outnumbers its word, so that there are no rings."""
    current = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        current = stored(current.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if current.where("moved").limit(1).count() == 0:
            return current.drop("moved")
        current = current.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, form_times: int = FORM_TIMES, drop_every: int | None = None, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n. A form is the most frequent word within one edit, if at least form_times as frequent."""
    words = stored(word_counts(docs, id_col, text_col, min_length, min_count, drop_every), "words")
    spread = words.repartition(partitions_for(docs.sparkSession), "word")
    near = near_words(spread, stored(trie_shards(words), "tries"), round_bytes)
    far = F.col("best_n") >= form_times * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("best")).alias("form"), F.when(far, F.col("best_n")).alias("form_n")
    )
    found = stored(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
