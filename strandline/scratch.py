"""Tables in the cluster's shared folder: they cut lineage, so a lost executor costs the step that was running and no more.

The folder is the one that spark.checkpoint.dir names. A table lies in a folder of its application, which goes when the
driver's JVM ends; tables that no later step reads go at once (drop).
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = threading.Lock()
_local: dict[str, str] = {}  # application: its folder where none is set
_marked: set[str] = set()  # application folders that go with the JVM
_writing: dict[str, list] = {}  # application: how many tables are being written and the setting before
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_passing = threading.local()  # stack: for each open passing() of the thread the tables written in it


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. One of our own only in local mode, where driver and executors are one process."""
    context = spark.sparkContext
    found = spark.conf.get(SHARED, None) or context.getConf().get(SHARED)
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(f"set {SHARED} to a folder that the driver and all executors share")
    with _lock:
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="strandline-")
        return _local[context.applicationId]


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the application's folder that nothing else uses."""
    home = f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}"
    with _lock:
        if home not in _marked:
            p, fs = _file_system(spark, home)
            fs.mkdirs(p)
            fs.deleteOnExit(p)
            _marked.add(home)
    return f"{home}/{uuid.uuid4().hex}-{name}"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Spark may drop a job's shuffle files once its table is there. The setting is put back when no thread writes any more."""
    app = spark.sparkContext.applicationId
    with _lock:
        state = _writing.setdefault(app, [0, spark.conf.get(CLEANUP, None)])
        state[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                del _writing[app]
                if state[1] is None:
                    spark.conf.unset(CLEANUP)
                else:
                    spark.conf.set(CLEANUP, state[1])


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    for tables in getattr(_passing, "stack", [])[-1:]:
        tables.append((spark, path))
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more; frames that table() didn't write are left alone."""
    for t in tables:
        path = _paths.pop(t, None)
        if path:
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


@contextmanager
def passing() -> Iterator[None]:
    """Tables that this thread writes in the block go when it ends: for steps whose results are written or fetched by then."""
    stack = _passing.stack = getattr(_passing, "stack", [])
    stack.append([])
    try:
        yield
    finally:
        for spark, path in stack.pop():
            _delete(spark, path)
