"""Tables in order with gapless positions, without sorting a group in one task.

Rows are dealt into ranges of their keys, sorted in each range and written; the number
of a file and a row's place in it give its position. Rows of equal keys are told apart
by where they stood in the input, so that they may be cut between ranges, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import new_path, small_or_shuffled, stored

POSITION = "__at"


def write_in_order(df: DataFrame, path: str, keys: list[Column], parts: list[str]) -> None:
    """Writes df to path in ascending ranges of keys, sorted in each file; parts (folders) lead the keys.

    As many ranges as spark.sql.shuffle.partitions says, fewer where adaptive execution joins small ones.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    order = [*map(F.col, parts), *keys, F.col("__tie")]
    dealt = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")
    dealt.write.partitionBy(*parts).option("compression", "zstd").parquet(path)


def read_in_order(spark, path: str, schema, parts: list[str]) -> DataFrame:
    """The rows under path with __at, their position from 0 in each of parts.

    Positions before a file come from one row a file, the rows in it from the file itself.
    """
    rows = spark.read.schema(schema).parquet(path).withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    files = rows.groupBy(*parts, "__file").agg(F.count("*").alias("rows"))
    number = [F.regexp_extract("__file", pattern, 1).cast("long") for pattern in (r"/part-(\d+)-[^/]*$", r"\.?c(\d+)[^/]*$")]
    before = F.sum("rows").over(Window.partitionBy(*parts).orderBy(*number).rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    files = stored(files.select("__file", F.coalesce(before, F.lit(0)).alias("before")), "files")
    return rows.join(small_or_shuffled(files, files.count()), "__file").withColumn(POSITION, F.col("before") + F.col("__row")).drop("__file", "__row", "before")


def in_order(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df, written in order of keys and read again, with __at: its position from 0. An empty table stays empty."""
    path = new_path(df.sparkSession, name)
    write_in_order(df, path, keys, [])
    return read_in_order(df.sparkSession, path, df.schema, [])
