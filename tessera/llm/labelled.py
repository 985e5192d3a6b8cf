"""Bounded samples of labelled documents, by a fold rule on the document id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrow_text as at
from .runtime import stored

#: Least hashes of a text by which copies are told: near copies share at least one of them almost surely.
MINIMA, GRAM = 3, 4


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def fold_of(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hashes of each text's word n-grams; rows are (doc_id, text, label)."""
    for batch in batches:
        least = []
        for _, _, data, offsets in at.parts(at.text_column(batch, "text")):
            w = at.words_of(at.lower_ascii(data), offsets)
            hashes, first = w.span_hash(w.start, w.end), w.first
            for k in range(w.texts):
                grams = hashes[first[k] : first[k + 1]]
                grams = at.ngram_hash(grams, min(GRAM, max(1, len(grams))))
                least.append([int(at.mix(grams ^ np.uint64(m)).view(np.int64).min()) if len(grams) else 0 for m in range(MINIMA)])
        columns = [pa.array([x[m] for x in least], pa.int64()) for m in range(MINIMA)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["doc_id", "text", "label", *(f"m{m}" for m in range(MINIMA))])


def sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out fold, copies once.

    The sample is the ids of least hash, so it does not depend on partitions. An
    id with several labels takes the largest; null labels and ids are left out. Of
    rows that repeat an id, the text of least 64-bit hash is taken, so reruns agree. Of
    texts that share a least n-gram hash the least id stays, so a large group of
    copies does not pass for evidence. Very long texts are taken whole. Extra columns
    are ignored; an empty table, or labels of other documents, give no rows.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("doc_id"), modulus) != held_out)
    )
    chosen = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` pairs of numbers
    schema = "doc_id long, text string, label int, " + ", ".join(f"m{m} long" for m in range(MINIMA))
    signed = stored(found.mapInArrow(_signed, schema).withColumn("which", F.xxhash64("text")), "sample")
    ids = signed.drop("text", "label").distinct()
    first = ids.groupBy("doc_id").agg(F.min("which").alias("which"))
    ids = ids.join(F.broadcast(first), ["doc_id", "which"], "left_semi")  # this and the joins below: at most ``rows`` rows of a few numbers
    for m in range(MINIMA):
        ids = ids.join(F.broadcast(ids.groupBy(f"m{m}").agg(F.min("doc_id").alias(f"l{m}"))), f"m{m}")
    kept = ids.where(" AND ".join(f"l{m} = doc_id" for m in range(MINIMA))).select("doc_id", "which")
    return signed.join(F.broadcast(kept), ["doc_id", "which"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text", "label")
