"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a job needs whatever the size of the cluster. The number of shuffle partitions
# is left to the cluster; adaptive execution coalesces from there.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("folioframe")
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, also registered for ``DataFrame.checkpoint``.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to
    a folder of this machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


_made: list[str] = []  # paths of this process's tables in the shared folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def scratch_tables() -> Iterator[list[str]]:
    """Collects the paths of the tables that are made inside, for ``drop_tables``."""
    paths: list[str] = []
    before = len(_made)
    try:
        yield paths
    finally:
        paths += _made[before:]


def drop_tables(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes tables of the shared folder once nothing reads them any more: those given, or all
    that this process has made."""
    for path in list(_made) if paths is None else paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        if path in _made:
            _made.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder, and read that.

    Every later pass then sees the same rows, a lost executor costs a read and not a
    recomputation, and passes that need few columns read only those.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

