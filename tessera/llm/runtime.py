"""Where intermediate tables go, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join of at most so many bytes may be broadcast; with narrow rows of a few numbers that is so many rows.
BROADCAST_BYTES = 8 << 20
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one, in local mode only: on a cluster that would scatter tables over machines."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        application = spark.sparkContext.applicationId
        path = _TEMPORARY.get(application) or _TEMPORARY.setdefault(application, tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return path.rstrip("/")


#: Temporary folders of local applications without a shared one.
_TEMPORARY: dict[str, str] = {}


def own_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    if spark.sparkContext.applicationId not in _CLEARED:
        _CLEARED.add(spark.sparkContext.applicationId)
        atexit.register(clear, spark)
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Applications whose folder goes when the driver's Python ends.
_CLEARED: set[str] = set()


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that read them must have been written by then. The driver's end calls it, too."""
    if spark.sparkContext._jsc is not None:
        remove(spark, own_dir(spark))


def stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write a table (in folders by parts) to the shared folder and read it again: cuts lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: What the operator whose tasks run in this worker process keeps between them.
_KEPT: dict[tuple, Any] = {}


def kept_in_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """An object that is made once and kept for the next tasks of a worker process, until those of another operator take it over."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def take_over(key: tuple | None = None) -> None:
    """Frees what other operators kept, all but ``key``, and gives memory that is free already back to the system: Spark reuses worker processes, so that theirs would count with that of this one."""
    for other in [k for k in _KEPT if k != key]:
        del _KEPT[other]
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only when the counted rows are within the bound; otherwise a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing holds any more, without waiting for its periodic collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
