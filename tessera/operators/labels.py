"""Topic labels: evidence, resumable drafting, merging of drafts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def evidence(topics: DataFrame, weights: DataFrame, documents: DataFrame, n: int = 5) -> DataFrame:
    """(topic, top_words, documents, prompt, digest): words by rank and the n documents of greatest weight; ties by id."""
    words = topics.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "term")))["term"].alias("top_words"))
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "doc_id")
    best = weights.where("weight > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    best = best.join(documents.select("doc_id", "title"), "doc_id")
    shown = best.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "title", "weight"))).alias("documents"))
    out = words.join(shown, "topic", "left")
    out = out.withColumn("prompt", T.label_prompt(F.col("top_words"), F.col("documents.title")))
    return out.withColumn("digest", T.sha256(F.col("prompt")))


def checked_evidence(topics: DataFrame, weights: DataFrame, documents: DataFrame, n: int = 5) -> DataFrame:
    """evidence() with a digest of each input, after checks: weights are finite and not negative, their documents exist and ids are unique.

    Digests are sums of row hashes, so they do not depend on the order of rows or partitions.
    """
    bad = weights.where(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") == float("inf")))
    lost = weights.select("doc_id").distinct().join(documents.select("doc_id"), "doc_id", "left_anti")
    twice = documents.groupBy("doc_id").count().where("count > 1")
    for name, rows in (("invalid weights", bad), ("weights of unknown documents", lost), ("repeated documents", twice)):
        if not rows.isEmpty():
            raise ValueError(name)
    hashed = lambda df, name: df.agg(F.sha2(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string"), 256).alias(name))
    out = evidence(topics, weights, documents, n)
    for name, df in (("topics_hash", topics), ("weights_hash", weights), ("documents_hash", documents)):
        out = out.crossJoin(F.broadcast(hashed(df, name)))
    return out


def draft(pending: DataFrame, client: Callable[[list[dict]], list[str]], batch: int = 5, save: Callable[[list[dict]], None] | None = None, secret: str = "") -> list[dict]:
    """States of topics (a few dozen rows) after drafting in batches; it stops after the first batch that fails.

    client takes evidence rows and gives a response each; save gets all states after
    every batch, so a run that ends early resumes with what is not generated. A
    failing batch is marked failed and the rest stays pending. A secret that a response or an
    error repeats is blotted out.
    """
    rows = [r.asDict(recursive=True) for r in pending.orderBy("topic").collect()]
    out = [{"topic": r["topic"], "state": "pending", "response": None, "error": None} for r in rows]
    clean = lambda t: t.replace(secret, "[REDACTED]") if secret else t
    for k in range(0, len(rows), batch):
        part = out[k : k + batch]
        try:
            answers = client(rows[k : k + batch])
            if len(answers) != len(part):
                raise ValueError("a response is missing")
            for o, a in zip(part, answers, strict=True):
                o.update(state="generated", response=clean(a))
        except Exception as e:
            for o in part:
                o.update(state="failed", error=clean(str(e))[:200])
        if save is not None:
            save(out)
        if part[0]["state"] == "failed":
            break
    return out


def merge_drafts(topics: DataFrame, drafts: DataFrame) -> DataFrame:
    """Topics with their draft label, if any; never marked as reviewed."""
    return topics.join(drafts.select("topic", "label"), "topic", "left").withColumn("human_reviewed", F.lit(False))


def batch_errors(expected: DataFrame, responses: DataFrame) -> DataFrame:
    """(key, error): expected keys that are missing, keys not expected, and keys given twice."""
    missing = expected.join(responses, "key", "left_anti").select("key", F.lit("missing").alias("error"))
    unknown = responses.join(expected, "key", "left_anti").select("key", F.lit("unknown").alias("error")).distinct()
    twice = responses.groupBy("key").count().where("count > 1").select("key", F.lit("repeated").alias("error"))
    return missing.unionByName(unknown).unionByName(twice)
