"""Spark sessions with the settings this engine expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session; on a cluster, size shuffle_partitions so that a partition holds 100 to 200 MB."""
    builder = SparkSession.builder.master(master).appName("tessera")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan over at least as many partitions as there are cores; no change where the files already give so many.

    For work that is heavy per row on small tables of one file. df must be a plain scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; where none is set, local mode takes a temporary one, and a cluster has to name a shared one."""
    import re
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The table as Parquet in the shared checkpoint folder: computed once, compressed, cuts lineage, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """The table in the shared checkpoint folder with its partitions, and the order in them, as they are."""
    spark = df.sparkSession
    folder = _shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared checkpoint folder."""
    import uuid

    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this package to Python workers that would not find it, once per context.

    Workers find it by PYTHONPATH or their working folder; elsewhere it goes out
    as a zip file through Spark's own file server.
    """
    import os
    import shutil
    import tempfile

    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    context = spark.sparkContext
    near = [os.path.abspath(p) for p in (os.environ.get("PYTHONPATH", "").split(os.pathsep) + [os.getcwd()]) if p]
    if root in near or getattr(context, "_tessera_shipped", False):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera"), "zip", root, os.path.basename(package))
    context.addPyFile(made)
    context._tessera_shipped = True
