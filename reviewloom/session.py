"""Session helpers: package shipping, the shared folder, lineage cuts and temporary tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_shipped: set[str] = set()
_paths: dict[str, list[str]] = {}


def ensure_package(spark: SparkSession) -> None:
    """Ships this package to the Python workers once per application.

    Functions handed to mapInArrow are pickled by reference, so workers must be able to import the package even
    where the driver found it through its own sys.path.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="reviewloom-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "reviewloom_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("reviewloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder serves a session
    in one process, as in tests; on a cluster, whose nodes would each write to a folder of their own, it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="reviewloom-shared-")
        atexit.register(shutil.rmtree, d, True)
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder, so lost executors cost no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by release() or when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/reviewloom-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a compressed Parquet table in the shared folder and reads it back.

    Smaller on disk than a checkpoint and columnar, so later steps read only the columns they need.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_stash(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
    """The same, with aggregates of the rows taken in the pass that writes them."""
    seen = Observation()
    return stash(df.observe(seen, *measures), name), seen.get


def release(spark: SparkSession) -> None:
    """Deletes the tables written so far in the shared folder. Frames that read them are void afterwards: for a long session,
    between queries."""
    for path in _paths.pop(spark.sparkContext.applicationId, []):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
