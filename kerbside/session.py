"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings every job wants. Shuffle width is left to the cluster's own default
#: (AQE coalesces it downwards), so nothing here is tuned to one machine.
JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str, master: str | None = None, **settings: str) -> SparkSession:
    """Create (or get) a session with the job settings applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**JOB_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python functions
    import it, wherever the driver found it."""
    root = Path(__file__).resolve().parents[1]
    application = spark.sparkContext.applicationId
    if application in _shipped or not root.is_dir():
        return
    _shipped.add(application)
    folder = tempfile.mkdtemp(prefix="kerbside-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/kerbside", "zip", root, "kerbside"))


def pin(spark: SparkSession) -> SparkSession:
    """Apply the job settings to a session somebody else created."""
    ship_package(spark)
    for key, value in JOB_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


_written: list[str] = []


def new_table_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten there."""
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    _written.append(path)
    return path


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the intermediate tables written to the shared folder within."""
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a table that outlives lost executors, for relations that
    several jobs, or several branches of one plan, read. With ``partition_by`` rows are
    first rebalanced: a directory gets few files, and a hot one is split between tasks.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    if partition_by:
        df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_all(tables: Mapping[str, DataFrame], partition_by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Materialize independent relations as jobs that share the cluster."""
    with ThreadPoolExecutor(max(1, len(tables))) as pool:
        done = pool.map(lambda item: (item[0], materialize(item[1], item[0], partition_by)), tables.items())
        return dict(done)
