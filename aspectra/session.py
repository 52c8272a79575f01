"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory, by any path Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter's settings hold."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Where PYTHONPATH already names the repository nothing is done; elsewhere a
    zip of the package is added to the job once per Spark context.
    """
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if getattr(context, "_aspectra_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="aspectra-code-")) / "aspectra_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted((ROOT / "aspectra").rglob("*.py")):
            out.write(source, source.relative_to(ROOT))
    context.addPyFile(str(target))
    context._aspectra_shipped = True


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share; a temporary one on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="aspectra-shared-")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def with_conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings of the session for a while; names take __ for dots."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
