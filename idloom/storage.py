"""Cutting lineage with tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Folder of each application's tables -> a function that deletes it.
_RUNS: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master without that setting, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="idloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def run_dir(spark: SparkSession) -> str:
    """This application's folder; deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/idloom/{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        _RUNS[path] = (p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p)
    return path


def clear() -> None:
    """Delete the tables of all runs of this process. Results not read yet are lost."""
    while _RUNS:
        fs, p = _RUNS.popitem()[1]
        try:
            fs.delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone
            pass


atexit.register(clear)


class Table:
    """A written intermediate: ``df`` reads it back, ``drop()`` deletes its files."""

    def __init__(self, df: DataFrame, path: str):
        self.df, self.path = df, path

    def drop(self) -> None:
        _delete(self.df.sparkSession, self.path)


def cut(df: DataFrame) -> Table:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` the plan runs once, the files are columnar, and later reads prune columns. Losing an
    executor loses nothing, as the folder is shared. Drop the table once nothing reads it; what a lazy result still
    reads goes with the run's folder when the driver ends.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    return Table(spark.read.schema(df.schema).parquet(path), path)
