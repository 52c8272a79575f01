"""Inserts into a bucketed table."""

import re

import pytest

from aspectra.operators.bucketed import create_bucketed, insert_new_bucketed, new_rows
from aspectra.operators.dedup import insert_new

SCHEMA = "dim_id long, dim_table string, chunk_index int, body string"
KEYS = ["dim_id", "dim_table", "chunk_index"]


@pytest.fixture
def table(spark, tmp_path):
    name = "bucketed_chunks"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    create_bucketed(spark, name, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, KEYS, 6)
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def batch(spark, low, high):
    rows = [(i, f"t{i % 2}", i % 3, f"{'b' if k else 'a'}{i}") for i in range(low, high) for k in (0, 1)]
    return spark.createDataFrame([*rows, (None, "t0", 1, "none")], SCHEMA)


def test_inserts_leave_known_keys_alone(spark, table):
    first, second = batch(spark, 0, 200), batch(spark, 150, 260)
    want = insert_new(spark.table(table), first.where("dim_id is not null"), KEYS, "body").collect()
    assert insert_new_bucketed(spark, table, first, KEYS, "body") == 200
    assert sorted(map(tuple, spark.table(table).collect())) == sorted(map(tuple, want))
    assert insert_new_bucketed(spark, table, second, KEYS, "body") == 60
    held = sorted(map(tuple, spark.table(table).collect()))
    assert len(held) == 260 and all(r[3].startswith("a") for r in held)
    for again in (first, second, batch(spark, 0, 0)):
        assert insert_new_bucketed(spark, table, again, KEYS, "body") == 0
    assert sorted(map(tuple, spark.table(table).collect())) == held


def test_the_table_is_not_shuffled_and_history_is_skipped(spark, table):
    insert_new_bucketed(spark, table, batch(spark, 0, 200), KEYS, "body")
    plan = new_rows(spark, table, batch(spark, 190, 230), KEYS, "body")._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.rindex("FileScan parquet") - 600 :]
    tail = plan[plan.index("SortMergeJoin") :] if "SortMergeJoin" in plan else ""
    assert tail, plan
    # from the join down, the branch of the stored keys has no exchange
    lines = tail.splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan parquet" in x)
    depth = lambda x: len(re.match(r"[\s:+\-*()\d]*", x)[0])
    branch, d = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < d:
            branch.append(x)
            d = depth(x)
    assert not [x for x in branch[:-1] if "Exchange" in x], branch
    assert "Bucketed: true" in side and "SelectedBucketsCount: 6 out of 6" in side
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(dim_id,190\), LessThanOrEqual\(dim_id,229\)", side)
    with pytest.raises(ValueError, match="no buckets"):
        spark.range(1).createOrReplaceTempView("plain_view")
        from aspectra.operators.bucketed import _bucket_spec

        _bucket_spec(spark, "plain_view")
