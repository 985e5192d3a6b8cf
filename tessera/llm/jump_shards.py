"""Sharding by jump consistent hashing.

A stable key and the number of shards give a row's shard by a short walk of a linear
congruential generator: no ring, no table. Each step jumps to the next number of
shards at which the key would move, so when shards are appended, a key either
stays or goes to an appended shard, and the share that moves is just what they hold.

Shards are folders ``shard=N`` of Parquet files, sorted by id; a row's slot is its
place in its shard's files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import POSITION, read_in_order, write_in_order
from .runtime import new_path

SHARDS = 16
#: The generator of the published algorithm (fixed values).
MULTIPLIER, HIGH_BITS = 2862933555777941757, 33


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; every pass moves the keys that still jump, some ln(shards) passes on average."""
    at = np.zeros(len(keys), dtype=np.int64)
    walking, key = np.arange(len(keys)), keys.astype(np.uint64)
    while len(walking):
        key = key * np.uint64(MULTIPLIER) + np.uint64(1)
        ahead = ((at[walking] + 1) * (2.0**31 / ((key >> np.uint64(HIGH_BITS)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        inside = ahead < shards
        walking, key = walking[inside], key[inside]
        at[walking] = ahead[inside]
    return at


def stable_key(column: Column) -> Column:
    """64 bits of the MD5 of a key's text, as a signed number; a null key counts as an empty text."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")


def shard_of(column: Column, shards: int) -> Column:
    """The shard of a key among so many; the same for equal keys, whatever else a row has."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return walk(stable_key(column))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> T.StructType:
    """Writes the rows of docs, whole, to folders shard=0 .. shards-1 of path; returns the schema to read them with.

    Rows with equal keys share a shard, a null key is one key and equal texts need not
    meet. Rows of one key, repeated or not, may span files, so neither a frequent key
    nor a large shard is one task. A shard that gets no row has no folder. A column named
    shard gives way to the operator's; other columns pass unchanged.
    """
    placed = docs.drop("shard").withColumn("shard", shard_of(F.col(key), shards))
    write_in_order(placed, path, [F.col(key).asc_nulls_first()], ["shard"])
    return placed.schema


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all shards with shard and slot, gapless from 0 in each shard, by ascending key, null first. Repeated keys take slots in any order."""
    return read_in_order(spark, path, schema, ["shard"]).withColumn("slot", F.col(POSITION)).drop(POSITION)


def moved(docs: DataFrame, shards: int, to: int, key: str = "doc_id") -> DataFrame:
    """The rows that leave their shard when shards become to, more than before: just those that an appended shard gets, with that as shard."""
    if to < shards:
        raise ValueError("shards are appended, never taken away")
    placed = docs.drop("shard").withColumns({"__was": shard_of(F.col(key), shards), "shard": shard_of(F.col(key), to)})
    return placed.where(F.col("__was") != F.col("shard")).drop("__was")


def op13_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in SHARDS shards by the law of keys; sizes and checksums come from the shards as written.

    A null text counts as empty: size 1, checksum 0. Under this law doc_id and the
    number of shards decide alone, so equal texts of different ids may part.
    """
    path = new_path(spark, "shards")
    schema = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return read_shards(spark, path, schema).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )


#: Checksums in SQL: the table of 256 by its rule, then a fold over the bytes.
CRC_TABLE = """list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
  lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END))"""


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of a text in DuckDB, where a relation crc with its table t is joined."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(crc.t[(xor(a, b) & 255) + 1], a >> 8)))"""


OP13_SQL = f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS t),
walk AS (
  SELECT doc_id, n, 0::BIGINT AS place, 0::BIGINT AS ahead, ('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 16))::UBIGINT::HUGEINT AS key
  FROM documents, (VALUES ({SHARDS}), ({SHARDS + 1})) AS s(n)
  UNION ALL
  SELECT doc_id, n, ahead, CAST(floor((ahead + 1) * (2147483648.0::DOUBLE / CAST((k >> {HIGH_BITS}) + 1 AS DOUBLE))) AS BIGINT), k
  FROM (SELECT doc_id, n, ahead, (key * {MULTIPLIER} + 1) % 18446744073709551616 AS k FROM walk WHERE ahead < n)
),
placed AS (SELECT doc_id, CAST(max(place) FILTER (WHERE n = {SHARDS}) AS INTEGER) AS shard, CAST(max(place) FILTER (WHERE n = {SHARDS + 1}) AS INTEGER) AS grown_shard FROM walk GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, CAST({crc_sql("coalesce(text, '')")} AS BIGINT) AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM documents JOIN placed USING (doc_id), crc
"""
