"""Results that are computed once and read by many queries: tables in the folder that driver and executors share.

``kept`` writes what a plan gives, under a name and the state of the inputs
(their size, number and time of change), and hands out the table from then on.
A table that is read back has no lineage: an executor that is lost later costs
nothing of it.  Tables live as long as the application.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple[str, str], tuple[SparkSession, str, DataFrame]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; a local one only under a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("siftlake.store", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='siftlake-store-')}"
        spark.conf.set("siftlake.store", root)
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state_of(spark: SparkSession, *paths: str) -> str:
    """Changes whenever files under the paths are added, removed or rewritten."""
    seen = []
    for path in paths:
        p, fs = _file_system(spark, path)
        if not fs.exists(p):
            seen.append((path, None))
            continue
        total = fs.getContentSummary(p)
        seen.append((path, total.getLength(), total.getFileCount(), fs.getFileStatus(p).getModificationTime()))
    return hashlib.sha256(repr(seen).encode()).hexdigest()


def plan_state(df: DataFrame) -> str:
    """The plan and the state of the files it reads; a plan over no files is like no other."""
    files = df.inputFiles()
    if not files:
        return uuid.uuid4().hex
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    folders = sorted({f.rsplit("/", 1)[0] for f in files})
    return hashlib.sha256(repr((df.semanticHash(), plan, sorted(files), state_of(df.sparkSession, *folders))).encode()).hexdigest()


def kept(spark: SparkSession, name: str, state: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The table ``name`` for this state of its inputs; built and written at the first call."""
    key = (spark.sparkContext.applicationId, f"{name}:{state}")
    if key not in _KEPT:
        path = f"{shared_folder(spark)}/siftlake-kept-{uuid.uuid4().hex[:16]}"
        df = build()
        df.write.partitionBy(*partition_by).parquet(path)
        _KEPT[key] = (spark, path, spark.read.schema(df.schema).parquet(path))
    return _KEPT[key][2]


def written(df: DataFrame) -> DataFrame:
    """The rows, written and read back: what a loop needs between its rounds."""
    return kept(df.sparkSession, "round", uuid.uuid4().hex, lambda: df)


def forget(spark: SparkSession | None = None) -> None:
    """Remove the tables of a session, or all."""
    for key, (own, path, _) in list(_KEPT.items()):
        if spark is None or own is spark:
            del _KEPT[key]
            if getattr(own.sparkContext, "_jsc", None) is not None:
                p, fs = _file_system(own, path)
                fs.delete(p, True)


@atexit.register
def _at_exit() -> None:
    try:
        forget()
    except Exception:  # the session has ended: the folder goes with it
        return
