"""Running steps in order, those skipped whose output is there."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession

from aspectra.plans.constants import BLOCKED_SECONDS
from aspectra.plans.providers import ExhaustedKeys


@dataclass(frozen=True)
class Step:
    name: str
    output: str
    run: Callable[[], None]
    always: bool = False


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark can open."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a step's output is there whole: a file, or a folder that its job committed. What a job left that died is not."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(where) and (not system.getFileStatus(where).isDirectory() or system.exists(jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS")))


def run_steps(spark: SparkSession, steps: list[Step]) -> list[str]:
    """Names of the steps that ran."""
    ran = []
    for step in steps:
        if step.always or not finished(spark, step.output):
            step.run()
            ran.append(step.name)
    return ran


class Blocked(RuntimeError):
    """A service turned the caller away for a while (status 403)."""


def with_retries[T](call: Callable[[], T], retries: int, pause: Callable[[int], float], kinds: tuple[type[Exception], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result; an error of the kinds is tried again after pause(attempt) seconds, the last one raised."""
    for attempt in range(retries):
        try:
            return call()
        except kinds:
            sleep(pause(attempt))
    return call()


def ingest(names: list[str], one: Callable[[str], None], workers: int = 3, blocked_seconds: float = BLOCKED_SECONDS, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Names done by a pool of workers; when keys run out, what has not begun is cancelled and the error raised.

    A name that is blocked waits once, then is tried again; other errors of one name are raised too.
    """
    done: list[str] = []
    with ThreadPoolExecutor(workers) as pool:
        patient = lambda name: with_retries(lambda: one(name), 1, lambda _: blocked_seconds, (Blocked,), sleep)
        waiting = {pool.submit(patient, name): name for name in names}
        try:
            for future, name in waiting.items():
                future.result()
                done.append(name)
        except ExhaustedKeys:
            for future in waiting:
                future.cancel()
            raise
    return done
