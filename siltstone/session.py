"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_made: list[str] = []
_used: set[str] = set()


def build_session(app: str = "siltstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; `conf` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class SharedFolderMissing(RuntimeError):
    """A cluster whose nodes have no folder in common."""


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in spark.checkpoint.dir, or by SparkContext.setCheckpointDir. Only on
    one machine, as in tests, a temporary folder is made where both are unset; it is set and removed
    at exit. On a cluster that would be a folder of each node's own, so that is an error.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = own.get() if own.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise SharedFolderMissing(f"{CHECKPOINT_KEY} is to name a folder that all nodes of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set(CHECKPOINT_KEY, root)
        _made.append(root[len("file://"):])
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which goes with the application."""
    root = f"{scratch_root(spark)}/siltstone-{spark.sparkContext.applicationId}"
    if root not in _used:
        _used.add(root)
        # registered after the session's own, and so run before the session ends
        atexit.register(release, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession, root: str | None = None) -> None:
    """Delete what was written to the shared folder so far; tables read from there end with it."""
    for path in [root] if root else list(_used):
        _used.discard(path)
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; a temporary folder is removed below
            pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    This cuts lineage (a lost executor costs no upstream work) and, unlike an RDD
    checkpoint, keeps the rows columnar and compressed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a table may have to be sent to every executor.
SMALL = 100_000


def small(table: DataFrame, name: str) -> DataFrame:
    """A table that is written, counted and marked for broadcast only if it has few rows."""
    table = materialize(table, name)
    return F.broadcast(table) if table.count() <= SMALL else table


@atexit.register
def _clean() -> None:
    for path in _made:
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
