"""Mixing sources to target weights, in DataFrame functions only.

Every document has a hash-random key. The keys' leading digits cut each source
into key ranges; sums by range give distributed prefix sums, and the one range
in which a source's budget ends is cut again by the next digits while it holds
many rows, or at once by the first digits in which its rows differ. Only the
last, small one is sorted row by row. A source's budget of
several times its size is met by whole epochs and one partial epoch.

Cases: a null text has size 0 and takes nothing; the null source is a source of
its own, last in order; repeated rows are mixed as separate documents; rows of
one id and text go by a hash of their other columns, and where these are equal
too by their place in the input, so that any number of copies is dealt to many
tasks; an empty table gives no rows; sources
without words get target 0; texts of any length count whole; other columns pass
through untouched under any name, but for those named like the results, which
the results replace.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.common import SMALL_ROWS, WORD, by_name, by_place, quoted, stored

#: Digits that cut a range into 4,096, where a key's digits of id and text, of other columns and of the place end, and the rows of a range that one task sorts.
STEP, KEY_DIGITS, SORTED_ROWS = 3, (32, 48, 64), 1 << 16
RESULTS = ("size", "source_size", "target", "taken")
#: The cuts, a row per source, are broadcast only while their names stay below this size in all.
SMALL_NAMES = 4 << 20


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(id_col: str, text_col: str, seed: str) -> Column:
    part = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(seed + ":"), part(id_col), F.lit(":"), part(text_col)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """(_source, source_size) -> and target: shares by weight, none above max_epochs times its size.

    Raising the level common to all uncapped sources until the total is spent
    is where resharing any excess by weight comes to rest: in order of cap over
    weight, sources are capped up to the first whose cap exceeds its share of
    what the earlier ones left. A row per source meets in these windows.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_w", F.element_at(pattern, ((rank - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))
    weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))
    level = ranked.withColumn("_level", left.cast("double") / weight)
    open_ = level.withColumn("_capped", F.col("_cap") / F.col("_w") <= F.col("_level"))
    final = open_.withColumn("_final", F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("l")))).over(whole)["l"])
    share = F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_final"))
    return final.select("_source", "source_size", F.coalesce(share, F.col("_cap").cast("double")).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """The documents with size, source_size, target and taken (words the mix takes)."""
    ties = [quoted(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    digits_of = lambda x: F.lpad(F.hex(x), 16, "0")
    keyed = docs.select(
        *by_place(docs),
        word_count(text_col).alias("size"),
        quoted(source_col).cast("string").alias("_source"),
        hash_key(id_col, text_col, seed).alias("_id_text"),
        F.xxhash64(*ties).alias("_rest_of_row"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_place"),
    )
    keyed = keyed.withColumn("_key", F.concat("_id_text", digits_of(F.col("_rest_of_row")), digits_of(F.col("_place"))))
    ranges = _ranges(keyed, STEP)
    sizes = ranges.groupBy("_source").agg(F.sum("_n").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    targets = targets.withColumn("_epochs", F.coalesce(F.expr("try_divide(round(target), source_size)"), F.lit(0)).cast("long"))
    targets = targets.withColumn("_rest", F.round("target").cast("long") - F.col("_epochs") * F.col("source_size"))
    digits, cut = STEP, stored(_narrowed(ranges, targets), "cuts")
    while (held := _held_in(cut)).widest > SORTED_ROWS and digits < KEY_DIGITS[-1]:
        inside = _met(keyed, cut, held).where(F.substring("_key", 1, digits) == F.col("_cut"))
        digits = min(max(digits, held.alike) + STEP, KEY_DIGITS[-1])
        cut = stored(_narrowed(_ranges(inside, digits), cut), "cuts")

    ready = _met(keyed.withColumn("_range", F.substring("_key", 1, digits)), cut, held)
    names = [F.col(f"c{i}") for i in range(len(docs.columns))]
    whole = F.col("_epochs") * F.col("size")
    sure = ready.where("_range <> _cut").select(
        *names, "size", "source_size", "target", (whole + F.when(F.col("_range") < F.col("_cut"), F.col("size")).otherwise(F.lit(0))).cast("long").alias("taken")
    )
    order = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - passed))
    cut_range = ready.where("_range = _cut").withColumn("_part", part)
    cut_range = cut_range.select(*names, "size", "source_size", "target", (whole + F.col("_part")).cast("long").alias("taken"))
    return sure.unionByName(cut_range).select(*by_name(docs.columns, RESULTS), *RESULTS)


class _Held(NamedTuple):
    """What a table of cuts holds: sources, bytes of their names, rows of the widest range, and digits that are alike in all ranges still wide."""

    sources: int
    names: int
    widest: int
    alike: int


def _held_in(cut: DataFrame) -> _Held:
    row = cut.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_of")), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0)), F.coalesce(F.min(F.when(F.col("_rows") > SORTED_ROWS, F.col("_alike"))), F.lit(0))).first()
    return _Held(*row)


def _met(keyed: DataFrame, cut: DataFrame, held: _Held) -> DataFrame:
    """Rows with their source's cut, which is broadcast while it is small."""
    small = held.sources <= SMALL_ROWS and held.names <= SMALL_NAMES
    return keyed.join(F.broadcast(cut) if small else cut, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")


def _ranges(rows: DataFrame, digits: int) -> DataFrame:
    """Words and rows by source and leading digits of the key, and how many digits are known to be alike: those of one id and text, or of one whole row."""
    one_text = F.xxhash64("_id_text")
    found = rows.groupBy("_source", F.substring("_key", 1, digits).alias("_range")).agg(
        F.sum("size").alias("_n"), F.count("*").alias("_rows"), F.min(one_text).alias("_t0"), F.max(one_text).alias("_t1"), F.min("_rest_of_row").alias("_r0"), F.max("_rest_of_row").alias("_r1")
    )
    alike = F.when(F.col("_t0") != F.col("_t1"), 0).when(F.col("_r0") != F.col("_r1"), KEY_DIGITS[0]).otherwise(KEY_DIGITS[1])
    return found.select("_source", "_range", "_n", "_rows", alike.alias("_alike"))


def _narrowed(ranges: DataFrame, targets: DataFrame) -> DataFrame:
    """By source the range in which `_rest` ends, as `_cut`, and what is left of it there; at most 4,096 ranges of a source meet in a task."""
    run = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    if "_of" not in targets.columns:
        targets = targets.withColumnRenamed("_source", "_of")
    kept = ["source_size", "target", "_epochs", "_rest"]
    held = before.join(targets.select("_of", *kept), F.col("_source").eqNullSafe(F.col("_of"))).where("_before <= _rest")
    last = held.groupBy("_source").agg(F.max(F.struct("_range", "_before", "_rows", "_alike")).alias("_last"), *[F.first(c).alias(c) for c in kept])
    return last.select(
        F.col("_source").alias("_of"), "source_size", "target", "_epochs", F.col("_last._range").alias("_cut"), (F.col("_rest") - F.col("_last._before")).alias("_rest"), F.col("_last._rows").alias("_rows"), F.col("_last._alike").alias("_alike")
    )


def repeat_taken(mixed: DataFrame) -> DataFrame:
    """Whole documents as often as the mix takes them; a part of half or more counts as one.

    Takes the rows of mix_sources and gives their columns but for its results. Documents without words come no time.
    """
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(F.lit(0)).cast("int")
    placed = mixed.select(*by_place(mixed), times.alias("_times")).where("_times > 0")
    repeated = placed.select("*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))
    return repeated.select(*by_name(mixed.columns, RESULTS))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns, whatever their names."""
    placed = docs.select(*by_place(docs))
    names = (f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col))
    return repeat_taken(mix_sources(placed, *names, **options)).select(*by_name(docs.columns))
