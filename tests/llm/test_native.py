import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aspectra.llm import chat_format as C
from aspectra.llm import mixing as M
from aspectra.llm import queries as Q
from aspectra.llm.oracle import oracle_sql
from tests.llm.brute import words

PIECES = st.sampled_from([*C.LLAMA_LIKE.controls, "\\", "\\e", "\\a", "<", "[", "/", "INST]", "s>", "é", "\n", " ", "x", "1"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=8).map("".join), min_size=1, max_size=6))
def test_round_trip(spark, texts):
    rows = [(1, i, ["user", "assistant", "system", "tool", None, "</s>[INST]"][i % 6], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = C.format_conversations(df)
    got = made.select(C.parse_formatted(F.col("formatted")).alias("t"), "formatted").first()
    assert [(r["role"], r["text"]) for r in got["t"]] == [(r[2] or "", r[3]) for r in rows]
    assert got["formatted"].count("</s>") == len(rows)


def test_digest_and_order(spark):
    rows = [(1, 2, "assistant", "B"), (1, 1, "user", "a"), (1, None, "system", None), (2, 0, "assistant", "x"), (None, 0, "user", "q"), (3, 0, "user", "a"), (3, 1, "user", "b"), (3, 2, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    found = {r["conv_id"]: r for r in C.formatted_digest(df).collect()}
    one = found[1]
    assert one["n_turns"] == 3 and one["valid"] and one["loss_chars"] == 1
    assert one["turns_sha256"] == hashlib.sha256("system\n\nuser\na\nassistant\nB\n".encode()).hexdigest()
    assert one["loss_sha256"] == hashlib.sha256(b"B").hexdigest()
    assert (found[2]["valid"], found[2]["first_bad_turn"]) == (False, 0)
    assert (found[3]["valid"], found[3]["first_bad_turn"]) == (False, 1)
    assert not found[None]["valid"] and found[None]["first_bad_turn"] is None
    assert C.formatted_digest(df.limit(0)).count() == 0


def test_ties_of_turns_and_very_long_texts(spark):
    """Equal turns go by role, then text; a text of a million characters comes back whole."""
    long = "</s>[INST] é \\" * 70_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (2, 0, "user", long), (2, 1, "assistant", long), (2, 1, "assistant", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for frame in (df, df.orderBy(F.desc("text")).repartition(3)):
        found = {r["conv_id"]: r for r in C.formatted_digest(frame).collect()}
        assert found[1]["turns_sha256"] == hashlib.sha256(b"assistant\nz\nuser\na\nuser\nb\n").hexdigest()
        assert found[2]["loss_sha256"] == hashlib.sha256((long * 2).encode()).hexdigest() and found[2]["loss_chars"] == 2 * len(long)


def test_mixing_takes_very_long_texts_whole(spark):
    rows = [(1, "w " * 400_000, "s"), (2, "w w", "s"), (3, None, None), (4, "one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in M.mix_sources(df).collect()}
    assert found[1]["size"] == 400_000 and found[1]["source_size"] == 400_002 and found[3]["size"] == found[3]["taken"] == 0
    assert found[1]["taken"] + found[2]["taken"] == round(found[1]["target"])


def brute_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left, mass = total - sum(capped.values()), sum(w[s] for s in order if s not in capped)
        share = {s: left * w[s] / mass for s in order if s not in capped}
        over = [s for s, x in share.items() if x > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 4}") for i in range(400)] + [(i, "w w", None) for i in range(400, 420)] + [(999, None, "empty"), (5, "w " * 5, "s1"), (None, "w", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))
    found = M.mix_sources(df).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes, (1, 2, 3), 3)
    for s in sizes:
        own = [r for r in found if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    again = M.mix_sources(df.repartition(9)).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert M.mix_sources(df.limit(0)).count() == 0
    assert M.mix_sources(df.where("source = 'empty'")).first()["target"] == 0


WORKING = ("_key", "_source", "_of", "_cut", "_epochs", "_range", "_rest", "_rows", "_part", "_n", "_w", "_cap", "_level", "_times", "_copy", "c0", "c1", "a`b", "Size")


def test_mixing_with_clashing_names(spark):
    rows = [(i, "w " * (i % 5), "s") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = {r["doc_id"]: r["taken"] for r in M.mix_sources(df).collect()}
    df = df.select([F.lit(k).alias(c) for k, c in enumerate(WORKING)] + ["*"])
    mixed = M.mix_sources(df)
    assert mixed.columns == [*(c for c in df.columns if c != "Size"), "size", "source_size", "target", "taken"]
    assert {r["doc_id"]: r["taken"] for r in mixed.collect()} == plain
    repeated = M.repeat_taken(mixed)
    assert repeated.columns == [c for c in df.columns if c != "Size"]
    assert all(r["_key"] == 0 and r["c1"] == WORKING.index("c1") for r in repeated.collect())


def test_cuts_go_as_deep_as_needed(spark, monkeypatch):
    """A source whose cut range holds many rows is cut by further digits, to the same result."""
    rows = [(i, "w " * (i % 7 + 1), "hot" if i % 3 else f"s{i % 4}") for i in range(600)] + [(1, "w w", "hot")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.monotonically_increasing_id())
    key = lambda r: (r["source"], r["doc_id"], r["row"], r["taken"], r["target"])
    want = sorted(map(key, M.mix_sources(df).collect()))
    monkeypatch.setattr(M, "STEP", 1)
    for rows_sorted in (200, 10, 1):
        monkeypatch.setattr(M, "SORTED_ROWS", rows_sorted)
        assert sorted(map(key, M.mix_sources(df).collect())) == want
    assert sorted(map(key, M.mix_sources(df.orderBy(F.desc("row"))).collect())) == want


@pytest.mark.parametrize("rest", ["1", "id"])
def test_copies_of_one_row_are_dealt_to_many_tasks(spark, monkeypatch, rest):
    """100,000 rows of one id and text, alike in all columns or not, need at most two rounds to a range that one task sorts."""
    held = []

    def seen(cut, given=M._held_in):
        held.append(given(cut))
        return held[-1]

    monkeypatch.setattr(M, "_held_in", seen)
    hot = spark.range(100_000).select(F.lit(5).alias("doc_id"), F.lit("three words here").alias("text"), F.lit("hot").alias("source"), F.expr(rest).cast("long").alias("more"))
    cold = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("cold").alias("source"), F.lit(0).cast("long").alias("more"))
    mixed = M.mix_sources(hot.unionByName(cold))
    sums = {r["source"]: (r["taken"], r["target"], r["rows"]) for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("rows")).collect()}
    assert len(held) <= 3 and held[-1].widest <= M.SORTED_ROWS < held[0].widest
    assert sums["hot"][2] == 100_000 and all(abs(taken - target) <= 1 for taken, target, _ in sums.values())


def test_repeats(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, None, "s")], "doc_id long, text string, source string")
    mixed = M.mix_sources(df).withColumn("taken", F.when(F.col("doc_id") == 1, 5).otherwise(0))
    assert [r["doc_id"] for r in M.repeat_taken(mixed).collect()] == [1, 1, 1]
    assert M.repeat_taken(mixed).columns == df.columns


def test_against_sql(spark, small):
    import duckdb

    from tools.compare import TABLES, canonical

    db = duckdb.connect()
    for t in TABLES.split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        df = Q.queries()[name](spark, small)
        result = db.execute(sql)
        assert canonical(df.collect(), df.columns) == canonical(result.fetchall(), [c[0] for c in result.description]), name


def test_native_plans_run_no_python(spark, small):
    for name in ("op2_chat_format", "op3_mixing"):
        plan = Q.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not any(k in plan for k in ("Python", "Pandas", "Arrow")), name
