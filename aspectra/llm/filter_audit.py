"""Filter interaction audit: which filter removes what, for every order of the filters.

A packed bitmap index holds, for each block of rows, a bit set for each filter
(fails), each label and each part. For each subset of filters the rows that
fail none of them are counted by AND-NOT and popcount, per part and label, and
summed over the blocks. Whatever an order removes at a step is a difference of
two such counts, so that all orders cost no more than the subsets.

Filters on the text alone are read off whole texts in Arrow batches. The filter
on copies compares ids with the least one of each text: by its SHA-256 digest;
the few digests with a large share of all rows are broadcast (at most
HOT_SHARE of them), all others joined, so that no task gets one group whole.

Cases: a null text is empty; a null part is the empty string; a row with a null
id is no copy of a smaller one, makes none, and has no labels; rows that share
the smallest id of a text are no copies; of several labels of an id any that is
1 counts; an empty table gives no rows; very long texts are read whole; ids may
be of any type that can be ordered; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import quoted, stored
from aspectra.llm.tokenizing import few_rows, forget_encoders
from aspectra.session import ship_code

SYMBOLS = "#$%&*|"
#: A digest of more than one row in so many is joined by broadcast: so many digests at most.
HOT_SHARE = 2000
_CAPITALS = bytes(range(0x41, 0x5B))


class Facts(NamedTuple):
    """What the filters on single texts look at."""

    words: int
    distinct: int
    capitals: int
    chars: int
    symbol: bool


Rule = Callable[[Facts], bool]
#: Failure conditions by letter; the letter of copies comes after them.
RULES: dict[str, Rule] = {
    "A": lambda f: f.words < 100,
    "B": lambda f: 100 * f.distinct < 80 * f.words,
    "C": lambda f: 100 * f.capitals > 10 * f.chars,
    "D": lambda f: f.symbol,
}
COPIES = "E"
LABELS = {"good": "quality", "toxic": "toxic"}


def facts_of(text: str, raw: bytes) -> Facts:
    words = raw.split()  # bytes part at the six ASCII blanks only
    return Facts(len(words), len(set(words)), len(raw) - len(raw.translate(None, _CAPITALS)), len(text), any(c in text for c in SYMBOLS))


def judged(docs: DataFrame, rules: dict[str, Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(_id, part, fails, digest) for each document: a bit for each rule it fails, and the SHA-256 of its text."""
    ship_code(docs.sparkSession)
    rules = rules or RULES

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in few_rows(batches):
            fails, digests = [], []
            for text in batch["text"]:
                text = text.as_py() or ""
                raw = text.encode()
                facts = facts_of(text, raw)
                fails.append(sum(1 << k for k, rule in enumerate(rules.values()) if rule(facts)))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["part"], pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], names=["_id", "part", "fails", "digest"])

    rows = docs.select(quoted(id_col).alias("_id"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"), quoted(text_col).alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"_id {kind}, part string, fails int, digest binary")


def mark_copies(rows: DataFrame, bit: int, hot_share: int = HOT_SHARE) -> DataFrame:
    """The rows with one more bit in `fails` where a smaller id has the same digest; the digest goes."""
    groups = stored(rows.groupBy("digest").agg(F.min("_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    limit = rows.count() // hot_share
    hot, rest = groups.where(F.col("n") > limit).drop("n"), groups.where(F.col("n") <= limit).drop("n")
    both = rows.join(F.broadcast(hot), "digest").unionByName(rows.join(F.broadcast(hot), "digest", "left_anti").join(rest, "digest", "left"), allowMissingColumns=True)
    copy = F.coalesce((F.col("_id") > F.col("first")).cast("int"), F.lit(0))
    return both.select("_id", "part", (F.col("fails") + copy * F.lit(1 << bit)).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame, names: dict[str, str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The rows with a 0/1 column for each label, 1 where any label row of the id says 1."""
    names = names or LABELS
    sums = [F.max((quoted(c) == 1).cast("int")).alias(k) for k, c in names.items()]
    found = labels.select(quoted(id_col).alias("_id"), *(quoted(c) for c in dict.fromkeys(names.values()))).where("_id is not null").groupBy("_id").agg(*sums)
    marked = rows.where("_id is not null").join(found, "_id", "left")
    none = rows.where("_id is null").select("*", *(F.lit(None).cast("int").alias(k) for k in names))
    return marked.unionByName(none).select("part", "fails", *(F.coalesce(k, F.lit(0)).alias(k) for k in names))


INDEX = "n_rows int, filters array<binary>, labels array<binary>, parts array<string>, members array<binary>"


def _packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def bitmap_index(rows: DataFrame, n_filters: int, label_names: tuple[str, ...] = tuple(LABELS)) -> DataFrame:
    """Packed bit sets, a row per block of rows of one partition, see INDEX; `members` are the bit sets of `parts`."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fails = batch["fails"].to_numpy(zero_copy_only=False)
            coded = batch["part"].dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.num_rows], pa.int32()),
                    pa.array([[_packed(fails >> k & 1) for k in range(n_filters)]], pa.list_(pa.binary())),
                    pa.array([[_packed(batch[k].to_numpy(zero_copy_only=False)) for k in label_names]], pa.list_(pa.binary())),
                    pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())),
                    pa.array([[_packed(codes == k) for k in range(len(coded.dictionary))]], pa.list_(pa.binary())),
                ],
                names=["n_rows", "filters", "labels", "parts", "members"],
            )

    return rows.mapInArrow(pack, INDEX)


def subset_counts(index: DataFrame, n_filters: int, label_names: tuple[str, ...] = tuple(LABELS)) -> DataFrame:
    """(part, subset, kept, one column per label): rows that fail no filter of the subset, summed over all blocks."""
    names = ["kept", *label_names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in range(batch.num_rows):
                filters, labels, members = (
                    [np.frombuffer(x, np.uint8) for x in batch[c][block].as_py()] for c in ("filters", "labels", "members")
                )
                members = np.stack(members)
                counts = np.empty((len(members), 1 << n_filters, len(names)), np.int64)
                for subset in range(1 << n_filters):
                    failing = np.zeros(members.shape[1], np.uint8)
                    for k in range(n_filters):
                        if subset >> k & 1:
                            failing |= filters[k]
                    passing = members & ~failing
                    for j, wanted in enumerate([None, *labels]):
                        chosen = passing if wanted is None else passing & wanted
                        counts[:, subset, j] = np.bitwise_count(chosen).sum(axis=1, dtype=np.int64)
                parts = batch["parts"][block].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array(parts, object), 1 << n_filters), pa.string()),
                        pa.array(np.tile(np.arange(1 << n_filters, dtype=np.int32), len(parts))),
                        *(pa.array(counts[:, :, j].ravel()) for j in range(len(names))),
                    ],
                    names=["part", "subset", *names],
                )

    found = index.mapInArrow(count, "part string, subset int, " + ", ".join(f"{k} long" for k in names))
    return found.groupBy("part", "subset").agg(*(F.sum(k).alias(k) for k in names))


def audit_filters(docs: DataFrame, labels: DataFrame, rules: dict[str, Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step.

    Counts: kept after the step, removed at it, redundant (failing its filter, but
    removed before), unique_fails (failing its filter alone), good_lost and
    toxic_lost (removed at it, with that label), shapley (its filter's removed,
    summed over all orders).
    """
    rules = rules or RULES
    letters = [*rules, COPIES]
    n = len(letters)
    rows = mark_copies(stored(judged(docs, rules, id_col, text_col, part_col), "filter-facts"), n - 1)
    counts = subset_counts(bitmap_index(with_labels(rows, labels, id_col=id_col), n), n)
    names = ["kept", *LABELS]
    #: One row per part, with an array by subset: a subset's number is its place.
    by_part = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", *names))).alias("found"))
    by_part = by_part.select("part", *(F.col(f"found.{k}").alias(k) for k in names))

    def kept(subset: int):
        return F.col("kept")[subset]

    shapley = [
        sum(
            F.lit(math.factorial(subset.bit_count()) * math.factorial(n - 1 - subset.bit_count())) * (kept(subset) - kept(subset | 1 << k))
            for subset in range(1 << n)
            if not subset >> k & 1
        )
        for k in range(n)
    ]
    steps = [
        {"o": "".join(letters[k] for k in order), "s": i + 1, "k": k, "b": sum(1 << j for j in order[:i]), "a": sum(1 << j for j in order[: i + 1])}
        for order in itertools.permutations(range(n))
        for i, k in enumerate(order)
    ]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,s:int,k:int,b:int,a:int>>")
    every = by_part.select("*", F.array(*shapley).alias("shapley")).select("*", F.explode(listed).alias("x"))
    before, after, whole = F.col("x.b"), F.col("x.a"), (1 << n) - 1
    alone = F.element_at(F.array(*(F.lit(1 << k) for k in range(n))), F.col("x.k") + 1)

    def at(name: str, subset):
        return F.element_at(F.col(name), subset + 1)

    removed = at("kept", before) - at("kept", after)
    return every.select(
        "part",
        F.col("x.o").alias("filter_order"),
        F.col("x.s").alias("step"),
        at("kept", after).alias("kept"),
        removed.alias("removed"),
        (at("kept", F.lit(0)) - at("kept", alone) - removed).alias("redundant"),
        (at("kept", F.lit(whole) - alone) - at("kept", F.lit(whole))).alias("unique_fails"),
        (at("good", before) - at("good", after)).alias("good_lost"),
        (at("toxic", before) - at("toxic", after)).alias("toxic_lost"),
        F.element_at("shapley", F.col("x.k") + 1).alias("shapley"),
    )
