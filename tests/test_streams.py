"""Streams with state: threads that expire by themselves."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aspectra.operators.sessions import session_threads
from aspectra.plans.constants import SESSION_TTL_SECONDS
from aspectra.session import with_conf
from aspectra.streaming.threads import STATE_STORE, closed_threads

SCHEMA = "event_id long, user_id string, ts timestamp"
BEGAN = datetime(2024, 3, 1)


def events():
    """Requests of four users, some just at the limit, some at one moment, some of nobody."""
    rng, rows, at = random.Random(4), [], {u: 0 for u in "abcd"}
    for k in range(240):
        user = rng.choice("aaabcd")
        at[user] += rng.choice([0, 1, 60, 600, SESSION_TTL_SECONDS - 1, SESSION_TTL_SECONDS, SESSION_TTL_SECONDS + 1, 9000])
        rows.append((k, user, BEGAN + timedelta(seconds=at[user], microseconds=rng.choice([0, 1, 999_999]))))
    return rows


def run(spark, folder, late):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with with_conf(spark, **{STATE_STORE[0].replace(".", "__"): STATE_STORE[1]}):
        out = closed_threads(stream, "user_id", "ts", "event_id", late=late)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@pytest.mark.parametrize("cuts", [(80, 160), (1, 239)])
def test_threads_do_not_depend_on_batches_and_restarts(spark, tmp_path, cuts):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    want = session_threads(df, "user_id", "ts", "event_id").groupBy("user_id", "thread").agg(F.min("ts"), F.max("ts"), F.count("*")).collect()
    shuffled = random.Random(7).sample(rows, len(rows))  # batches overlap in time by the whole span
    parts = [shuffled[: cuts[0]], shuffled[cuts[0] : cuts[1]], shuffled[cuts[1] :]]
    put = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(parts[0])
    put(parts[1])
    assert run(spark, tmp_path, "30 days").count() == 0
    put(parts[2])
    put([(None, None, BEGAN + timedelta(days=90))])
    got = run(spark, tmp_path, "30 days")  # a new query goes on from the state
    assert sorted((r["user"], r["started"], r["ended"], r["n"]) for r in got.collect()) == sorted((r[0], r[2], r[3], r[4]) for r in want)
    assert all(r["first"] == min(k for k, u, t in rows if (u, t) == (r["user"], r["started"])) for r in got.collect())


def test_threads_come_out_as_their_time_is_over(spark, tmp_path):
    put = lambda *part: spark.createDataFrame(list(part), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    minute = lambda m: BEGAN + timedelta(minutes=m)
    put((1, "a", minute(0)), (2, "b", minute(5)))
    put((3, "b", minute(31)))
    put((4, "c", minute(50)))
    found = run(spark, tmp_path, "10 minutes").collect()  # the clock stands at 40: a is over since 30, b open until 61
    assert [(r["user"], r["n"]) for r in found] == [("a", 1)]
    put((5, "c", minute(75)), (6, "a", minute(20)))  # the last is late: its time was over
    found = run(spark, tmp_path, "10 minutes").collect()
    assert sorted((r["user"], r["n"]) for r in found) == [("a", 1), ("b", 2)]
