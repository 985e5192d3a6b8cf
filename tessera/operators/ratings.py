"""Rater agreement, rating summaries and the review state of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pairs(ratings: DataFrame) -> DataFrame:
    """Counts of ordered value pairs within items, from value counts per item: a hot item makes no pairs of rows."""
    counts = ratings.where("rating is not null").groupBy("item", "rating").agg(F.count("*").alias("c"))
    per = counts.withColumn("m", F.sum("c").over(Window.partitionBy("item"))).where("m >= 2")
    other = per.select("item", F.col("rating").alias("other"), F.col("c").alias("d"))
    same = F.when(F.col("rating") == F.col("other"), F.col("d") - 1).otherwise(F.col("d"))
    return per.join(other, "item").select("rating", "other", "m", (F.col("c") * same).alias("n"))


def krippendorff_alpha(ratings: DataFrame) -> DataFrame:
    """One row, alpha: ordinal Krippendorff's alpha over (item, rater, rating); constant ratings give 1, no pairs null."""
    seen = _pairs(ratings)
    o = seen.groupBy("rating", "other").agg(F.sum(F.col("n") / (F.col("m") - 1)).alias("o"))
    margin = o.groupBy("rating").agg(F.sum("o").alias("n"))
    upto = margin.withColumn("cum", F.sum("n").over(Window.orderBy("rating").rowsBetween(Window.unboundedPreceding, 0)))  # a row per rating value
    a = upto.select(F.col("rating"), F.col("n").alias("na"), F.col("cum").alias("ca"))
    b = upto.select(F.col("rating").alias("other"), F.col("n").alias("nb"), F.col("cum").alias("cb"))
    between = F.greatest("ca", "cb") - F.least(F.col("ca") - F.col("na"), F.col("cb") - F.col("nb"))
    grid = a.crossJoin(F.broadcast(b)).withColumn("delta", F.pow(between - (F.col("na") + F.col("nb")) / 2, F.lit(2)))
    total = margin.agg(F.sum("n").alias("total"))
    joined = grid.join(o, ["rating", "other"], "left").crossJoin(F.broadcast(total))
    apart = F.when(F.col("rating") != F.col("other"), F.col("delta")).otherwise(0.0)
    sums = joined.agg(F.sum(F.coalesce("o", F.lit(0.0)) * apart).alias("seen"), F.sum(F.col("na") * F.col("nb") * apart).alias("expected"), F.max("total").alias("total"))
    return sums.select(
        F.when(F.col("total").isNull(), F.lit(None).cast("double")).when(F.col("expected") == 0, 1.0).otherwise(1 - (F.col("total") - 1) * F.col("seen") / F.col("expected")).alias("alpha")
    )


def percent_agreement(ratings: DataFrame, tolerance: int = 0) -> DataFrame:
    """One row: share of rater pairs of an item within the tolerance."""
    near = F.when(F.abs(F.col("rating") - F.col("other")) <= tolerance, F.col("n")).otherwise(0)
    return _pairs(ratings).agg((F.sum(near) / F.sum("n")).alias("agreement"))


def rating_summary(ratings: DataFrame, part: str) -> DataFrame:
    """n, mean, true median, sample deviation, extremes and share of 4 and above."""
    r = F.col("rating")
    return ratings.where(r.isNotNull()).groupBy(part).agg(
        F.count("*").alias("n"), F.avg(r).alias("mean"), F.percentile(r, F.lit(0.5)).alias("median"), F.stddev_samp(r).alias("sd"), F.min(r).alias("min"),
        F.max(r).alias("max"), F.avg((r >= 4).cast("double")).alias("share_high"),
    )


def spread(ratings: DataFrame, k: int = 4) -> DataFrame:
    """Items on which raters differ most; ties by item."""
    return ratings.groupBy("item").agg((F.max("rating") - F.min("rating")).alias("spread")).orderBy(F.desc("spread"), "item").limit(k)


def current_state(events: DataFrame, item: str, at: list[str], state: str) -> DataFrame:
    """The latest review of each item from an append-only table."""
    return events.groupBy(item).agg(F.max_by(state, F.struct(*at)).alias(state), F.count("*").alias("reviews"))


def verdicts(labels: DataFrame, part: str, verdict: str) -> DataFrame:
    """Counts by part and verdict with totals (a rollup)."""
    grouped = labels.rollup(part, verdict).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return grouped.select(F.coalesce(F.col(part).cast("string"), F.lit("all")).alias(part), F.coalesce(F.col(verdict).cast("string"), F.lit("all")).alias(verdict), "n", F.col("level").cast("int").alias("level"))


REVIEWS = ("accept", "revise", "reject")


def review(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Labels with their state after reviews (item, verdict, label, at): drafts stay pending, revised ones take the new label."""
    last = reviews.where(F.col("verdict").isin(*REVIEWS)).groupBy("item").agg(F.max_by(F.struct("verdict", F.col("label").alias("new_label")), "at").alias("r"))
    joined = labels.join(last, "item", "left")
    status = F.coalesce(F.col("r.verdict"), F.lit("pending"))
    final = F.when(status == "revise", F.coalesce("r.new_label", "label")).when(status == "reject", F.lit(None)).otherwise(F.col("label"))
    return joined.select("item", final.alias("label"), status.alias("status"), F.col("r").isNotNull().alias("human_reviewed"))


def approved(reviewed: DataFrame) -> DataFrame:
    """Only reviewed labels that were not rejected."""
    return reviewed.where("human_reviewed AND status <> 'reject'")


def panel(pack: DataFrame, ratings: DataFrame, reviews: DataFrame, raters: Sequence[str]) -> DataFrame:
    """pack (item, ...) with a rating column per rater, their mean, and the item's verdict; items that lack a rating or the review are left out.

    ratings is (item, rater, rating) with one row per item and rater, reviews (item,
    verdict) with one per item: four tables joined by item.
    """
    out = pack
    for r in raters:
        out = out.join(ratings.where(F.col("rater") == r).select("item", F.col("rating").alias(f"rating_{r}")), "item")
    mean = sum((F.col(f"rating_{r}") for r in raters), F.lit(0)) / len(raters)
    return out.join(reviews.select("item", "verdict"), "item").withColumn("mean", mean)


def export(reviewed: DataFrame, run: str, reviewed_only: bool = True) -> DataFrame:
    """One row per model with its labels by topic, and the provenance of the export.

    reviewed has model, topic, label (the draft's), final_label, verdict (null before
    review) and state. Of reviewed labels the rejected are left out; else all generated
    drafts go. A partial export says how many of the expected topics it holds.
    """
    accepted = F.col("verdict").isin("accept", "revise")
    label = F.when(F.col("verdict") == "revise", F.coalesce("final_label", "label")).otherwise(F.col("label"))
    kept = reviewed.where(accepted).withColumn("out", label) if reviewed_only else reviewed.where("state = 'generated'").withColumn("out", F.col("label"))
    labels = kept.groupBy("model").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("topic").cast("string").alias("k"), F.col("out").alias("v"))))).alias("labels"))
    total = reviewed.agg(F.count("*").alias("expected_topics"))
    done = kept.agg(F.count("*").alias("exported_topics"))
    return labels.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(done)).withColumns({"run_id": F.lit(run), "reviewed_only": F.lit(reviewed_only)})
