"""The ordered merge, batch by batch: a batch reads only the keys it shares a bucket with, and appends.

Below its folder a state has, for each batch, the batch's records with the founder that each joined,
and the keys of its new founders, in folders by a hash of the key. A batch is part of the state once its row in
``done`` is written, which comes last; what a failed run left is written over by the next one of that number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .merge import _KEYS, assembled, founders

FILL = ("abstract", "venue", "doi", "url", "authors")


class MergeState:
    """Records (record_id, batch, ordinal, doi_key, title_key, source, ...) merged so far; batches come in order.

    buckets is the number of key folders of a batch: keep a bucket at some 10,000 keys.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def batches(self) -> list[int]:
        """Numbers of the batches in the state."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return []
        return sorted(r["number"] for r in self.spark.read.parquet(f"{self.path}/done").select("number").collect())  # a row a batch

    def _bucket(self, kind: Column, key: Column) -> Column:
        return F.pmod(F.xxhash64(kind, key), F.lit(self.buckets)).cast("int")

    def _keys(self, numbers: list[int], touched: list[int]) -> DataFrame:
        """(kind, key, row) of founders in the touched buckets; the others' files are not opened."""
        if not numbers or not touched:
            return self.spark.createDataFrame([], "kind string, key string, row string")
        paths = [f"{self.path}/keys/number={n}" for n in numbers]
        schema = "kind string, key string, row string, number int, bucket int"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/keys").parquet(*paths).where(F.col("bucket").isin(touched)).select("kind", "key", "row")

    def add(self, records: DataFrame, number: int) -> dict[str, int]:
        """Merges a batch, which comes after all before it, and returns how many records it has, how many found a row, and how many keys were read.

        Doing a batch again that is in the state already is an error.
        """
        done = self.batches()
        if any(n >= number for n in done):
            raise ValueError(f"batch {number} is not after {done[-1]}")
        keyed = cut(records.withColumns({k: F.nullif(F.col(k), F.lit("")) for k in _KEYS}))
        narrow = keyed.select("record_id", "batch", "ordinal", *_KEYS)
        wanted = narrow.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in _KEYS))).alias("k")).select("k.*").where("key IS NOT NULL").distinct()
        wanted = cut(wanted.withColumn("bucket", self._bucket(F.col("kind"), F.col("key"))))
        touched = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
        known = self._keys(done, touched)
        found = cut(known.join(wanted, ["kind", "key"]).select("kind", "key", "row"))
        marked = narrow
        for k in _KEYS:
            marked = marked.join(found.where(F.col("kind") == k).select(F.col("key").alias(k), F.col("row").alias(f"__old_{k}")), k, "left")
        marked = cut(marked)
        fresh = marked.where(" AND ".join(f"__old_{k} IS NULL" for k in _KEYS)).select(*narrow.columns)
        new = cut(founders(fresh))
        at = F.struct("batch", "ordinal", "record_id")
        home = marked.withColumn("__at", at).join(new.select("record_id", "founder"), "record_id", "left")
        for k in _KEYS:
            of = new.where(F.col("founder") & F.col(k).isNotNull()).select(k, F.col("record_id").alias(f"__to_{k}"), at.alias(f"__at_{k}"))
            home = home.join(of, k, "left").withColumn(f"__to_{k}", F.when(F.col(f"__at_{k}") < F.col("__at"), F.col(f"__to_{k}")))
        first = F.coalesce(*(F.col(f"{side}{k}") for k in _KEYS for side in ("__old_", "__to_")))
        home = home.select("record_id", F.when(F.coalesce("founder", F.lit(False)), F.col("record_id")).otherwise(first).alias("__row"))
        keyed.join(home, "record_id").write.mode("overwrite").parquet(f"{self.path}/records/number={number}")
        keys = new.where("founder").select("record_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in _KEYS))).alias("k")).where("k.key IS NOT NULL")
        keys = keys.select("k.kind", "k.key", F.col("record_id").cast("string").alias("row")).withColumn("bucket", self._bucket(F.col("kind"), F.col("key")))
        keys.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/number={number}")
        counts = {"records": keyed.count(), "joined": keyed.count() - new.where("founder").count(), "keys_read": known.count()}
        self.spark.createDataFrame([(number, *counts.values())], "number int, records long, joined long, keys_read long").coalesce(1).write.mode("append").parquet(f"{self.path}/done")
        return counts

    def records(self) -> DataFrame:
        """All records with __row, the founder that each joined or is."""
        paths = [f"{self.path}/records/number={n}" for n in self.batches()]
        return self.spark.read.option("basePath", f"{self.path}/records").parquet(*paths).drop("number")

    def merged(self, fill: Sequence[str] = FILL) -> DataFrame:
        """The rows of the whole merge, as merge_exact gives them for all batches at once."""
        rows = self.records()
        return assembled(rows, [c for c in rows.columns if c != "__row"], [c for c in fill if c in rows.columns])

    def changed(self, number: int, fill: Sequence[str] = FILL) -> DataFrame:
        """The merged rows that a batch founded or added to."""
        rows = self.records()
        touched = self.spark.read.parquet(f"{self.path}/records/number={number}").select("__row").distinct()
        return assembled(rows.join(touched, "__row", "left_semi"), [c for c in rows.columns if c != "__row"], [c for c in fill if c in rows.columns])
