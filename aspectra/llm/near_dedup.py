"""Near-duplicate documents by BagMinHash signatures over multisets of word shingles.

A shingle's count w is cut at powers of two into intervals (0,1], (1,2], (2,4],
... Each interval of each shingle carries a Poisson process of its own whose
rate is the interval's width; of the last, partly covered interval only points
whose place lies below w count, found by halving the interval towards the
point. Points come in rising order of time and fall on one of the registers; a
register keeps its earliest point. Two documents agree on a register with a
probability equal to their weighted Jaccard similarity, without bias, and once
all registers are filled later points need not be made, so that a signature
costs little more than one point per shingle.

Bands of registers make candidates. Of texts that share a band each meets the
band's first; links are verified by exact multiset overlap, and components are
formed. In bands whose texts still lie in several components, the texts outside
the band's largest component then meet all others of the band, block against
block: signatures rule out most of these pairs, and the texts of what is left
are brought to the block, verified there, and given out as a forest of verified
links. So no rows are made for pairs, neither inside a component nor across; a
task gives at most one row for each text it holds. Rows dealt to blocks are two
for each text of a small band; in a large one they are one for each BLOCK pairs
that have to be compared, and as many again on the other side. A link between different
components is lost by chance only: at a similarity of just 0.8 the bands miss it
with 2.9e-6 and the signatures rule it out with 5.0e-7, together 3.4e-6 at most;
at 0.82 2.5e-7 and 3.9e-9.

Cases: shingles are five words, words are runs of characters other than ASCII
white space; a text of one to four words is one shingle; null texts and texts
without words form no class but their own; equal texts are one node with a
count; a null doc_id is kept, as the class of its text is; repeated rows belong
to the same class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import by_name, by_place, connected_components, kind_of, partitions_for, quoted, stored
from aspectra.llm.hashing import join_texts, mix, word_hashes, word_spans
from aspectra.llm.tokenizing import few_rows, forget_encoders, in_slices
from aspectra.session import ship_code

SHINGLE, REGISTERS, ROWS, BANDS, AT_LEAST = 5, 256, 6, 42, 0.8
#: A block of texts that meets another one holds so many texts, and shingles, on average at most.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20
#: Agreement of signatures below which a similarity of 0.8 is ruled out: 5.2 standard deviations of 256 registers.
RULED_OUT = 0.67
TICKS = float(1 << 32)
FAR = np.iinfo(np.int64).max


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, sorted within each text, and where each text's begin (and the end)."""
    data, offsets = join_texts(texts)
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(bounds[-1], np.uint64)
    total = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        total += mix(words[k : k + len(total)] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
    total = mix(total)
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if n[i] >= size:
            out[a:b] = total[first[i] : first[i] + many[i]]
            out[a:b].sort()
        elif n[i]:
            short = words[first[i] : first[i + 1]]
            out[a] = mix(np.array([int(sum(int(w) * (j + 3) for j, w in enumerate(short))) & (1 << 64) - 1], np.uint64))[0]
    return out, bounds


def multisets(sorted_hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with counts: text number, hash, count."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if not len(text):
        return text, sorted_hashes, text
    new = np.concatenate([[True], (np.diff(text) != 0) | (sorted_hashes[1:] != sorted_hashes[:-1])])
    at = np.flatnonzero(new)
    return text[at], sorted_hashes[at], np.diff(np.append(at, len(text)))


def signatures(text: np.ndarray, hashes: np.ndarray, counts: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Times of the earliest point by text and register, in ticks; FAR where a text has no shingle."""
    least = np.full(texts * registers, FAR, np.int64)
    levels = [np.zeros(len(hashes), np.int64)]
    owners = [np.arange(len(hashes))]
    k = 1
    while (more := np.flatnonzero(counts > 1 << (k - 1))).size:
        owners.append(more)
        levels.append(np.full(len(more), k, np.int64))
        k += 1
    owner, level = np.concatenate(owners), np.concatenate(levels)
    doc, weight = text[owner], counts[owner]
    seed = mix(hashes[owner] ^ mix(level.astype(np.uint64) + np.uint64(1)))
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0))
    low = np.where(level == 0, 0, width)
    partial = low + width > weight
    now = np.zeros(len(owner), np.int64)
    step = 0
    active = np.arange(len(owner))
    while active.size:
        block = int(np.clip(32768 // active.size, 1, 64))
        number = np.arange(step, step + block, dtype=np.uint64)
        step += block
        bits = mix(seed[active, None] + (number + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
        unit = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        gaps = np.ceil(-np.log(unit) / width[active, None] * TICKS).astype(np.int64)
        times = now[active, None] + np.cumsum(gaps, axis=1)
        now[active] = times[:, -1]
        register = (bits & np.uint64(registers - 1)).astype(np.int64)
        good = times < least.reshape(texts, registers).max(axis=1)[doc[active]][:, None]
        if (part := partial[active]).any():
            place = (mix(bits[part] + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            inside = low[active][part, None] + place * width[active][part, None] < weight[active][part, None]
            good[part] &= inside
        row, col = np.nonzero(good)
        np.minimum.at(least, doc[active[row]] * registers + register[row, col], times[row, col])
        bar = least.reshape(texts, registers).max(axis=1)
        active = active[now[active] < bar[doc[active]]]
    return least.reshape(texts, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per text and band."""
    grouped = signature[:, : bands * rows].astype(np.uint64).reshape(len(signature), bands, rows)
    key = np.zeros(grouped.shape[:2], np.uint64) + np.arange(grouped.shape[1], dtype=np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x100000001B3) + grouped[:, :, r])
    return key.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays with repeats."""
    if not len(a) or not len(b):
        return 0.0
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    shared = int(np.minimum(ca[i], cb[j]).sum())
    return shared / (len(a) + len(b) - shared)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_encoders()
    for batch in few_rows(batches):
        texts = [t or "" for t in batch["text"].to_pylist()]
        for a, b in in_slices(texts):
            hashes, bounds = shingle_hashes([t.encode() for t in texts[a:b]])
            sig = signatures(*multisets(hashes, bounds), b - a)
            keys = band_keys(sig)
            marks = (mix(sig.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)
            part = batch.slice(a, b - a)
            offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["key"], pa.array(np.diff(bounds)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), pa.array([m.tobytes() for m in marks], pa.binary())],
                names=["doc_id", "key", "shingles", "bands", "marks"],
            )


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("marks_a", "marks_b"))
            yield batch.select(["a", "b"]).filter(pa.array((one == two).mean(axis=1) >= RULED_OUT))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (band, i, j), cut into the tables of each."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = np.stack([batch[c].to_numpy() for c in ("band", "i", "j")], 1)
        edges = [0, *(np.flatnonzero(np.diff(keys, axis=0).any(1)) + 1).tolist(), len(keys)]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if s == e:
                continue
            if current is not None and (keys[s] != current).any():
                yield pa.Table.from_batches(held)
                held = []
            current = keys[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(rows: pa.Table, at_least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Rows on the left with the rows on the right that may link with them: of another component, of like size, in the
    first band that both share, and not ruled out by signatures. Two texts that stand on both sides meet once."""
    left, stray = rows["left"].to_numpy(), rows["stray"].to_numpy()
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    if not len(x) or not len(y):
        return
    node, part, many = (rows[c].to_numpy() for c in ("node", "component", "shingles"))
    band = rows["band"][0].as_py()
    marks = np.frombuffer(b"".join(rows["marks"].to_pylist()), np.uint8).reshape(len(node), -1)
    bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    for i in x.tolist():
        ratio = np.minimum(many[i], many[y]) >= at_least * np.maximum(many[i], many[y])
        j = y[(part[y] != part[i]) & ratio & ~(stray[y] & (node[y] < node[i]))]
        j = j[(marks[j] == marks[i]).mean(axis=1) >= RULED_OUT]
        j = j[bands[i, (bands[j] == bands[i]).argmax(axis=1)] == band]
        if len(j):
            yield i, j


def _open(batches: Iterator[pa.RecordBatch], at_least: float) -> Iterator[pa.RecordBatch]:
    """The rows of block tasks that have a candidate."""
    for rows in _blocks(batches):
        wanted = np.zeros(rows.num_rows, bool)
        for i, j in _candidates(rows, at_least):
            wanted[i] = True
            wanted[j] = True
        if wanted.any():
            yield from rows.select(["band", "i", "j", "node", "component", "left", "stray"]).filter(pa.array(wanted)).to_batches()


def elements(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Numbers for (shingle, how often it came before in its text): multiset overlap is overlap of these sets."""
    text, _, counts = multisets(hashes, bounds)
    before = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.unique(mix(hashes + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)[1]


def _forest(batches: Iterator[pa.RecordBatch], at_least: float) -> Iterator[pa.RecordBatch]:
    """Block tasks with texts: verified links that join what is still apart within the task."""
    for rows in _blocks(batches):
        node, part = rows["node"].to_numpy(), rows["component"].to_numpy()
        place = {n: k for k, n in enumerate(dict.fromkeys(node.tolist()))}
        texts: list[bytes] = [b""] * len(place)
        for n, t in zip(node.tolist(), rows["text"].to_pylist(), strict=True):
            texts[place[n]] = t.encode()
        hashes, bounds = shingle_hashes(texts)
        code, has = elements(hashes, bounds), np.zeros(len(hashes) + 1, bool)
        size, of = np.diff(bounds), np.array([place[n] for n in node.tolist()])
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        links = []
        for i, j in _candidates(rows, at_least):
            own = root(int(part[i]))
            j = j[[root(c) != own for c in part[j].tolist()]]
            if not len(j):
                continue
            one, two = of[i], of[j]
            mine = code[bounds[one] : bounds[one + 1]]
            has[mine] = True
            theirs = np.concatenate([code[bounds[t] : bounds[t + 1]] for t in two.tolist()])
            shared = np.add.reduceat(has[theirs], np.cumsum(size[two]) - size[two], dtype=np.int64)
            has[mine] = False
            for k in np.flatnonzero(shared >= at_least * (size[one] + size[two] - shared)).tolist():
                p, q = root(int(part[i])), root(int(part[j[k]]))
                if p != q:
                    parent[p] = q
                    links.append((int(min(node[i], node[j[k]])), int(max(node[i], node[j[k]]))))
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], at_least: float) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts, sorted by the first: those whose overlap reaches the limit."""
    last, last_hashes = None, None
    for batch in few_rows(batches):
        keep = []
        texts = batch["text_b"].to_pylist()
        firsts = batch["text_a"].to_pylist()
        for a, b in in_slices(texts):
            hashes, bounds = shingle_hashes([t.encode() for t in texts[a:b]])
            for k in range(a, b):
                if firsts[k] != last:
                    last = firsts[k]
                    last_hashes, _ = shingle_hashes([last.encode()])
                keep.append(overlap(last_hashes, hashes[bounds[k - a] : bounds[k - a + 1]]) >= at_least)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = AT_LEAST) -> DataFrame:
    """doc_id, class_id (smallest id of its class), class_size (documents), kept, for every row."""
    return _classes(docs, id_col, text_col, at_least).select("doc_id", "class_id", "class_size", "kept")


def _classes(docs: DataFrame, id_col: str, text_col: str, at_least: float) -> DataFrame:
    """The same with each row's text key, and whether it has the one (id, text) that stays of its class."""
    spark = docs.sparkSession
    ship_code(spark)
    n = partitions_for(spark)
    source = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    source = source.withColumn("key", F.unhex(F.md5("text")))
    digest = stored(source.select("doc_id", "key", "text").mapInArrow(_digest, f"doc_id {kind_of(docs, id_col)}, key binary, shingles long, bands array<long>, marks binary"), "shingled")
    nodes = (
        digest.where("shingles > 0")
        .groupBy("key")
        .agg(F.min("doc_id").alias("smallest"), F.count("*").alias("copies"), F.first(F.struct("shingles", "bands", "marks")).alias("s"))
        .select(F.monotonically_increasing_id().alias("node"), "key", "smallest", "copies", "s.*")
    )
    nodes = stored(nodes, "nodes")
    banded = nodes.select("node", "shingles", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("band", "first")
    members = stored(banded.join(shared, "band"), "bands")
    texts = source.select("doc_id", "key", "text")

    def likely(pairs: DataFrame) -> DataFrame:
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("shingles").alias(f"n_{x}"), F.col("marks").alias(f"marks_{x}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        sized = sized.where(F.least("n_a", "n_b") >= F.lit(at_least) * F.greatest("n_a", "n_b"))
        return sized.select("a", "b", "marks_a", "marks_b").mapInArrow(_likely, "a long, b long")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(node, text) of the nodes in question, each fetched once and written."""
        wanted = wanted.distinct().join(nodes.select("node", "key", "smallest"), "node")
        same = (texts["key"] == wanted["key"]) & texts["doc_id"].eqNullSafe(wanted["smallest"])
        return stored(texts.join(wanted.hint("shuffle_hash"), same).select("node", "text").dropDuplicates(["node"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        found = texts_of(pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()))
        both = pairs.join(found.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        both = both.join(found.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(lambda b: _verified(b, at_least), "a long, b long")

    def placed_in(parts: DataFrame) -> DataFrame:
        """Members of bands with their components."""
        return members.select("band", "node", "shingles").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def mixed_bands(placed: DataFrame) -> DataFrame:
        """Bands that hold several components: the largest, and numbers of blocks of the texts outside it and of all."""
        held = placed.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
        mixed = held.groupBy("band").agg(F.max(F.struct("n", "s", "component")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("main.n < n")
        blocks = lambda n, s: F.ceil(F.greatest(n / F.lit(BLOCK), s / F.lit(BLOCK_SHINGLES))).cast("int")
        outside = F.col("n") - F.col("main.n")
        return mixed.select("band", F.col("main.component").alias("main"), blocks(outside, F.col("s") - F.col("main.s")).alias("lefts"), blocks(F.col("n"), F.col("s")).alias("rights"))

    def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
        """Components after more links between them."""
        of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}"))
        ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
        joined = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("joined"))
        alone = joined.select(F.col("component").alias("node")).join(parts, "node", "left_anti").withColumn("component", F.col("node"))
        every = parts.select("node", "component").unionByName(alone)
        return stored(every.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component")), "parts")

    def across(parts: DataFrame) -> DataFrame:
        """Verified links between components, from bands that hold several: a forest of each block task."""
        placed = placed_in(parts)
        sized = mixed_bands(placed)
        rest = placed.select("band", "node", "component").join(sized, "band").withColumn("stray", F.col("component") != F.col("main"))
        block = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
        other = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        names = ["band", "i", "j", "node", "component", "left", "stray"]
        ones = rest.where("stray").select("*", block("lefts").alias("i"), other("rights").alias("j"), F.lit(True).alias("left")).select(names)
        twos = rest.select("*", block("rights").alias("j"), other("lefts").alias("i"), F.lit(False).alias("left")).select(names)
        facts = nodes.select("node", "shingles", "marks", "bands")

        def dealt(rows: DataFrame) -> DataFrame:
            return rows.repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j")

        open_ = dealt(ones.unionByName(twos).join(facts, "node")).mapInArrow(lambda b: _open(b, at_least), "band long, i int, j int, node long, component long, left boolean, stray boolean")
        open_ = stored(open_, "open")
        full = open_.join(facts, "node").join(texts_of(open_.select("node")), "node")
        return dealt(full).mapInArrow(lambda b: _forest(b, at_least), "a long, b long")

    first = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    parts = connected_components(stored(verified(stored(likely(first), "pairs")), "links"))
    parts = merged(parts, stored(across(parts), "links"))

    classed = nodes.select("key", "node", "smallest", "copies").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = F.min(F.struct(F.col("smallest").isNull().alias("none"), "smallest", "key")).alias("least")
    summary = classed.groupBy("component").agg(F.min("smallest").alias("class_id"), F.sum("copies").alias("class_size"), least)
    of_key = classed.join(summary, "component").select("key", "class_id", "class_size", (F.col("key") == F.col("least.key")).alias("chosen"))
    rows = digest.select("doc_id", "key").join(of_key, "key", "left")
    class_id = F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    kept = class_id.eqNullSafe(F.col("doc_id"))
    return rows.select(
        "doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), kept.alias("kept"), "key", (kept & F.coalesce("chosen", F.lit(True))).alias("stays")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, all its columns unchanged: the one of smallest id, once.

    Rows are found again by id and text, either of which may be null. Under one
    id, or none, unlike texts stay; of near copies one text stays. Repeats of an
    id with the same text come once; without any, that step would change nothing
    and is left out.
    """
    rows = _classes(docs, id_col, text_col, AT_LEAST).where("stays")
    kept = stored(rows.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("_n")), "kept")
    placed = docs.select(*by_place(docs))
    id_, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    same = F.col(id_).eqNullSafe(F.col("_id")) & F.unhex(F.md5(text)).eqNullSafe(F.col("_key"))
    out = placed.join(kept.hint("shuffle_hash"), same, "left_semi")
    if kept.where("_n > 1").limit(1).count():
        out = out.dropDuplicates([id_, text])
    return out.select(*by_name(docs.columns))
