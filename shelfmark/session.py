"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings a job session should carry. Duplicate JSON keys keep the last
# value (as a streaming JSON decoder does) instead of failing the parse.
JOB_CONF = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply JOB_CONF to a running session (SQL settings only).

    Callers do this once; operators never change a session's settings.
    """
    for k, v in JOB_CONF.items():
        spark.conf.set(k, v)
    return spark


def require_conf(spark: SparkSession, key: str) -> None:
    """Tell the caller when a setting that an operator relies on is missing."""
    if spark.conf.get(key, None) != JOB_CONF[key]:
        raise ValueError(f"{key} has to be {JOB_CONF[key]}: call shelfmark.session.configure(spark) first")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a working folder, in whatever file system holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name, in whatever file system holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "shelfmark") -> SparkSession:
    """A local session for tests and benches (UI off)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in JOB_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session (driver and executors in one process) that names
    none gets a fresh local folder. On a cluster a folder of one machine
    would lose rows, so there a missing setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # no SparkContext handle (remote session)
            d = None
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        try:
            spark.sparkContext.setCheckpointDir(d)
        except Exception:
            pass
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # core setting; setCheckpointDir already holds it
            pass
    return d.rstrip("/")


def parallelism(spark: SparkSession) -> int:
    """Cores available to the job (shuffle partitions when not known)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# The working paths of the scopes that this thread is in, innermost last.
_SCOPES = threading.local()


def scratch_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path under the shared folder; ``unique`` adds a fresh suffix."""
    base = os.path.join(shared_dir(spark), "shelfmark", *parts)
    if not unique:
        return base
    path = f"{base}-{uuid.uuid4().hex[:12]}"
    for paths in getattr(_SCOPES, "open", [])[-1:]:
        paths.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the working tables that operators write inside the ``with`` block when it ends.

    Frames built inside read those tables: their results have to be written
    or collected before the end.
    """
    stack = _SCOPES.__dict__.setdefault("open", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            remove_path(spark, path)
