"""Cutting lineage safely: every cut goes to storage that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the master is local
(tests, a laptop) does the library pick a folder of its own; on a cluster that would be one machine's disk, so it refuses.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


class NoSharedFolder(RuntimeError):
    """A cluster without ``spark.checkpoint.dir``."""


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; also makes sure that ``DataFrame.checkpoint`` uses one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master.split("[")[0] != "local":
            raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all machines of {sc.master} share")
        named = _OWN.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="stepweave-"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; a lost executor costs a re-read, not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new place below the shared folder for an operator's own files. It stays until ``discard`` or ``tidy``."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete what ``fresh_path`` named, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    made = _MADE.get(spark.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)


def tidy(spark: SparkSession) -> int:
    """Delete all operators' own files of this session and return how many places there were.

    For when its results have been written: DataFrames that operators returned may still read them.
    """
    paths = [*_MADE.get(spark.sparkContext.applicationId, [])]
    for path in paths:
        discard(spark, path)
    return len(paths)


def release(spark: SparkSession) -> None:
    """Have shuffle files of finished work deleted now; else they stay until the driver happens to collect garbage.

    Worth full collections after a step whose shuffle is of the input's size. Callers drop their own references first. A
    collection frees what the one before it let go, and the cleaner works in the background, hence rounds and waits.
    It only saves disk: where the session has no JVM of its own to ask, nothing happens.
    """
    if getattr(spark, "_jvm", None) is None:
        return
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
