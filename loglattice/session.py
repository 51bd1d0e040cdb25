"""Session helpers: the settings the jobs rely on, and where scratch tables go."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

ENGINE_CONF = {
    # Reports render UTC; a local zone would move rows between days.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Documents differ in size by orders of magnitude; rows alone do not bound a
    # batch handed to Python.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    # A run sums up the progress of all its micro-batches.
    "spark.sql.streaming.numRecentProgressUpdates": "100000",
}


def build_session(app: str = "loglattice", master: str | None = None, **conf) -> SparkSession:
    """A session with the engine settings; `conf` overrides or adds to them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session made elsewhere."""
    for key in (
        "spark.sql.session.timeZone",
        "spark.sql.execution.arrow.maxBytesPerBatch",
        "spark.sql.streaming.numRecentProgressUpdates",
    ):
        spark.conf.set(key, ENGINE_CONF[key])
    return spark


@lru_cache(maxsize=None)
def _local_root(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="loglattice-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables and stream state that outlive one job.

    On a cluster it lies in the shared folder named by `spark.checkpoint.dir`.
    Only a local session (tests, one machine) may leave that unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root(context.applicationId)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if the path (or glob) names anything on its own file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, but for hidden ones; none if there is no such folder."""
    path, fs = _file_system(spark, folder)
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return [n for n in names if not n.startswith((".", "_"))]


def read_text(spark: SparkSession, file: str) -> str:
    path, fs = _file_system(spark, file)
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, file: str, text: str) -> bool:
    """Write a small file whole, or not at all: False if there is one by that name."""
    path, fs = _file_system(spark, file)
    draft, _ = _file_system(spark, f"{file.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    if fs.exists(path):
        return False
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    # A rename that never replaces, as the engine's own checkpoints use it.
    context = hadoop.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, path, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of the caller's own making, if it is there."""
    hadoop_path, fs = _file_system(spark, path)
    fs.delete(hadoop_path, True)
