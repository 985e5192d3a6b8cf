"""Mixing sources to target weights by capped water-filling.

A source may be repeated up to a maximum number of epochs. Targets follow the
weights; a source over its cap is clamped and the excess goes to the others by
weight, again and again. The fixed point is min(cap, level x weight), whose
level comes from one ordered pass over the sources: sort by cap / weight and
find the first source that the remaining words no longer fill.

Each source then gives whole repetitions of all its documents, and the rest of
its target from documents in a seeded order, the last one in part. Running
sums go over buckets of the order's hash, then over smaller ones inside the bucket in
which a source's target ends, so no source is sorted as a whole: only the last of
these is, one in some sixteen million of a source.

DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import small_or_shuffled, stored

#: A word, as a Java and as an RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order's hash that make a bucket, at each of LEVELS: 4,096 buckets.
DIGITS, LEVELS = 3, 2


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in order of code points, null last; share: target words in hundredths of all words."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: int = 150
    epochs: int = 2
    seed: int = 17


def _order(p: Mix) -> Column:
    return F.md5(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _measured(docs: DataFrame, p: Mix) -> DataFrame:
    """docs with the columns this operator works on; their names do not clash with plain ones."""
    source = F.col("source").cast("string")
    return (
        docs.withColumn("__none", source.isNull())
        .withColumn("__source", F.coalesce(source, F.lit("")))
        .withColumn("__size", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("__order", _order(p))
    )


def source_targets(sizes: DataFrame, p: Mix) -> DataFrame:
    """(__none, __source, source_size, target) of each source; a row per source, so the windows are over sources."""
    totals = sizes.groupBy("__none", "__source").agg(F.sum("__size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy("__none", "__source")))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, p.weights)), (F.col("rank") - 1) % len(p.weights) + 1).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * p.epochs).cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", "rank")
    total = F.sum("source_size").over(Window.partitionBy()) * p.share / 100.0
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (total - before) / left)
    found = F.min_by(F.when(F.col("level") <= F.col("fill"), F.col("level")), F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank")))
    levels = levels.withColumn("at", found.over(Window.partitionBy()))
    return levels.select("__none", "__source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def _bucket(level: int) -> Column:
    return F.conv(F.substring("__order", 1 + level * DIGITS, DIGITS), 16, 10).cast("int")


def _plan(sizes: DataFrame, p: Mix) -> tuple[DataFrame, int]:
    """Per source: whole repetitions, and at each level the bucket in which the rest of its target ends, with the words before it."""
    keys = ["__none", "__source"]
    plan = None
    for level in range(LEVELS):
        rows = sizes
        for k in range(level):  # only what lies in the last bucket so far
            rows = rows.join(small_or_shuffled(plan.select(*keys, f"__last{k}"), sources), keys).where(_bucket(k) == F.col(f"__last{k}")).drop(f"__last{k}")
        buckets = stored(rows.groupBy(*keys, _bucket(level).alias("bucket")).agg(F.sum("__size").alias("__size")), "mix-buckets")
        if plan is None:
            plan = source_targets(buckets, p).withColumn("words", F.floor("target"))
            plan = plan.withColumn("__whole", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0))
            plan = plan.withColumn("__rest", F.col("words") - F.col("__whole") * F.col("source_size"))
            plan = plan.select(*keys, F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__whole", "__rest", F.lit(0).cast("long").alias("__base"))
        running = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = buckets.withColumn("before", F.coalesce(F.sum("__size").over(running), F.lit(0))).join(plan.select(*keys, "__rest", "__base"), keys)
        before = F.col("__base") + F.col("before")
        reached = F.when(before < F.col("__rest"), F.col("bucket"))
        ends = placed.groupBy(*keys).agg(F.coalesce(F.max(reached), F.lit(-1)).alias(f"__last{level}"), F.max_by(before, reached).alias("new"))
        plan = plan.join(ends, keys, "left").withColumn("__base", F.coalesce("new", "__base")).withColumn(f"__last{level}", F.coalesce(f"__last{level}", F.lit(-1))).drop("new")
        plan = stored(plan, "mix-plan")
        sources = plan.count()
    return plan, sources


def _taken(measured: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """measured with __source_size, __target, __whole and __extra: words of a further, perhaps partial, repetition."""
    joined = measured.join(small_or_shuffled(plan, sources), ["__none", "__source"])
    last, extra = F.lit(True), F.lit(0)
    for level in reversed(range(LEVELS)):
        at = F.col(f"__last{level}")
        last = (_bucket(level) == at) & last
        extra = F.when(_bucket(level) < at, F.col("__size")).when(_bucket(level) == at, extra).otherwise(0)
    joined = joined.withColumn("__ends", last)
    sure = joined.where(~F.col("__ends")).withColumn("__extra", extra)
    order = Window.partitionBy("__none", "__source").orderBy("__order", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__base") + F.coalesce(F.sum("__size").over(order), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__rest") - before))
    return sure.unionByName(joined.where("__ends").withColumn("__extra", extra))


def mix(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs (doc_id, text, source, ...).

    size counts words (null text: 0); a null source is a source of its own, the
    last in order; taken is the words the mix takes, repetitions counted, and
    sums to the floor of each source's target. The order of ties is by doc_id
    and size; repeated rows are taken each by itself. Sources without words have
    target 0. A very long text is one document, taken in part where the target ends in
    it. Reruns agree; an empty table gives no rows; other columns are ignored.
    """
    sizes = stored(_measured(docs.select("doc_id", "text", "source"), p).drop("text", "source"), "mix-sizes")
    out = _taken(sizes, *_plan(sizes, p))
    return out.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__whole") * F.col("__size") + F.col("__extra")).alias("taken"),
    )


def mixture(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """The mix itself, with the columns of docs: a row per repetition; a partial one holds its leading words, joined by blanks.

    Null, empty and blank texts have no words and are repeated like the rest of their
    source; null ids and sources, repeated rows, ties and very long texts are as in
    mix(); an empty table stays empty. Columns of any name pass unchanged, but for
    text and, where there is one, n_chars of partial rows.
    """
    columns = docs.columns
    measured = _measured(docs, p)
    sizes = stored(measured.select("doc_id", "__none", "__source", "__size", "__order"), "mix-sizes")
    out = _taken(measured, *_plan(sizes, p))
    full = (F.col("__whole") + F.when((F.col("__size") > 0) & (F.col("__extra") == F.col("__size")), 1).otherwise(0)).cast("int")
    partial = (F.col("__extra") > 0) & (F.col("__extra") < F.col("__size"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({WORD})")), 1, F.greatest(F.lit(1), F.col("__extra").cast("int"))), " ")
    out = out.withColumn("__texts", F.concat(F.array_repeat(F.col("text"), full), F.when(partial, F.array(part)).otherwise(F.array().cast("array<string>"))))
    out = out.withColumn("__text", F.explode("__texts")).withColumn("text", F.col("__text"))
    if "n_chars" in columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(partial, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_P = Mix()
OP2_SQL = rf"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
  md5('{_P.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM totals),
weighed AS (SELECT *, CAST([{", ".join(map(str, _P.weights))}][(r - 1) % {len(_P.weights)} + 1] AS DOUBLE) AS w, CAST({_P.epochs} * source_size AS DOUBLE) AS cap FROM ranked),
levels AS (SELECT *, cap / w AS fill, (sum(source_size) OVER () * {_P.share} / 100.0 - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
target AS (SELECT source, source_size, least(cap, (SELECT level FROM levels WHERE level <= fill ORDER BY fill, r LIMIT 1) * w) AS target FROM levels),
plan AS (SELECT *, CAST(floor(target) AS BIGINT) AS words FROM target),
run AS (SELECT s.doc_id, s.size, p.source_size, p.target, p.words,
  coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(size, words % source_size - before)) END AS BIGINT) AS taken
FROM run
"""
