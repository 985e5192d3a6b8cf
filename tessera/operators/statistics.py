"""Errors, run summaries, rank tests and running curves."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import cut


def nrmse(df: DataFrame, outputs: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """One row: per output the RMSE over its span, and their mean; an undefined prediction is charged the full span."""
    terms = []
    for name, (predicted, actual, span) in outputs.items():
        error = F.coalesce(F.nanvl(predicted - actual, F.lit(None).cast("double")), F.lit(float(span)))
        terms.append((F.sqrt(F.avg(error * error)) / span).alias(name))
    names = list(outputs)
    return df.agg(*terms).withColumn("nrmse", sum((F.col(n) for n in names), F.lit(0.0)) / len(names))


def run_summary(runs: DataFrame, part: list[str], optimum: Column) -> DataFrame:
    """Mean, sample deviation, best, worst, median and mean error of repeated runs; lower is better."""
    v = F.col("value")
    return runs.groupBy(*part).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("best"), F.max(v).alias("worst"),
        F.percentile(v, F.lit(0.5)).alias("median"), F.avg(v - optimum).alias("mean_error"), F.min(v - optimum).alias("best_error"),
    )


def winners(summary: DataFrame, cell: list[str]) -> DataFrame:
    """The algorithm of least mean and its runner-up in each cell."""
    order = Window.partitionBy(*cell).orderBy("mean", "algorithm")
    return summary.withColumn("place", F.row_number().over(order)).where("place <= 2").select(*cell, "place", "algorithm", "mean")


@F.pandas_udf(DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2)))


def mann_whitney(runs: DataFrame, cell: list[str], group: str = "algorithm") -> DataFrame:
    """(cell, a, b, n_a, n_b, u, p) for each pair of groups in a cell: two-sided, normal approximation with tie and continuity corrections.

    U comes from counts per value: pairs of groups are joined on the cell's
    distinct values, and ranks are running sums, so no rows are paired.
    """
    counts = runs.groupBy(*cell, F.col(group).alias("g"), "value").agg(F.count("*").alias("c"))
    groups = counts.groupBy(*cell, "g").agg(F.sum("c").alias("n"))
    a = groups.select(*cell, F.col("g").alias("a"), F.col("n").alias("n_a"))
    b = groups.select(*cell, F.col("g").alias("b"), F.col("n").alias("n_b"))
    pairs = a.join(b, cell).where("a < b")  # a few groups per cell
    sides = pairs.select(*cell, "a", "b", "n_a", "n_b", F.explode(F.array("a", "b")).alias("g"))
    values = sides.join(counts, [*cell, "g"]).groupBy(*cell, "a", "b", "n_a", "n_b", "value").agg(
        F.sum(F.when(F.col("g") == F.col("a"), F.col("c")).otherwise(0)).alias("ca"), F.sum("c").alias("c")
    )
    run = Window.partitionBy(*cell, "a", "b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("rank", F.sum("c").over(run) - (F.col("c") - 1) / 2)
    sums = ranked.groupBy(*cell, "a", "b", "n_a", "n_b").agg(F.sum(F.col("ca") * F.col("rank")).alias("r"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    n1, n2 = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = n1 + n2
    u = F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / sd
    return sums.select(*cell, "a", "b", "n_a", "n_b", u.alias("u"), F.when(sd > 0, _normal_tail(z)).otherwise(1.0).alias("p"), z.alias("z"))


def holm(tests: DataFrame, key: list[str], p: str = "p") -> DataFrame:
    """Adds p_holm: the running maximum of min(1, (m - rank) p) over ascending p; ties by key.

    Tests are ordered in ranges; a range knows the tests and the greatest step before
    it by one row a range, so a family of any size has no single task.
    """
    ranges = int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(tests.repartitionByRange(ranges, p, *key).withColumn("__span", F.spark_partition_id()))
    over = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = placed.groupBy("__span").agg(F.count("*").alias("__n"))
    sizes = sizes.select("__span", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__m"))
    inside = Window.partitionBy("__span").orderBy(p, *key)
    step = F.least(F.lit(1.0), (F.col("__m") - F.col("__before") - F.row_number().over(inside) + 1) * F.col(p))
    stepped = placed.join(F.broadcast(sizes), "__span").withColumn("__step", step)
    tops = stepped.groupBy("__span").agg(F.max("__step").alias("__top"))
    tops = tops.select("__span", F.max("__top").over(over).alias("__top"))
    highest = F.max("__step").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = stepped.join(F.broadcast(tops), "__span").withColumn("p_holm", F.greatest("__top", highest))
    return out.select(*tests.columns, "p_holm")


def comparison(metrics: DataFrame, models: Sequence[str], lower_is_better: Sequence[str] = (), defaults: Mapping[str, float] | None = None) -> DataFrame:
    """(metric, a column per model, winner) of metrics (model, metric, value).

    A metric that a model lacks takes its default, if it has one, so a model without
    outliers competes with 0. The winner is the greatest value, of lower_is_better the
    least; ties go to the first name.
    """
    wide = metrics.groupBy("metric").pivot("model", list(models)).agg(F.max("value"))
    for metric, value in (defaults or {}).items():
        wide = wide.withColumns({m: F.coalesce(F.col(m), F.when(F.col("metric") == metric, float(value))) for m in models})
    sign = F.when(F.col("metric").isin(*lower_is_better), 1.0).otherwise(-1.0) if lower_is_better else F.lit(-1.0)
    scores = F.filter(F.array(*(F.struct((sign * F.col(m)).alias("s"), F.lit(m).alias("m")) for m in sorted(models))), lambda x: x["s"].isNotNull())
    return wide.withColumn("winner", F.array_min(scores)["m"])


def running_best(df: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """Cumulative maximum in order, per part."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.max(value).over(w))


def steps(df: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """Adds step: the difference from the value before, in order, per part; null for the first."""
    return df.withColumn("step", F.col(value) - F.lag(value).over(Window.partitionBy(*part).orderBy(*order)))


def largest_rise(df: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """(part, rise): the largest step up of each curve; a curve that only falls has none above 0."""
    return steps(df, part, order, value).groupBy(*part).agg(F.greatest(F.max("step"), F.lit(0.0)).alias("rise"))


def on_grid(trace: DataFrame, grid: DataFrame, part: list[str], at: str, value: str) -> DataFrame:
    """The last value at or before each grid point (an as-of join as a union and a window)."""
    marks = trace.select(*part).distinct().crossJoin(F.broadcast(grid.select(F.col(at))))
    both = trace.select(*part, at, F.col(value).alias("v"), F.lit(0).alias("mark")).unionByName(marks.select(*part, at, F.lit(None).cast("double").alias("v"), F.lit(1).alias("mark")))
    w = Window.partitionBy(*part).orderBy(at, "mark").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("v", ignorenulls=True).over(w)).where("mark = 1").select(*part, at, value)


def band(df: DataFrame, at: str, value: str) -> DataFrame:
    """Median and interquartile band over runs at each grid point."""
    return df.groupBy(at).agg(*(F.percentile(value, F.lit(q)).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))


def generations(evaluations: DataFrame, generation: str, value: str) -> DataFrame:
    """Best, mean and best so far per generation; a generation is a row, so the window is over few."""
    per = evaluations.groupBy(generation).agg(F.max(value).alias("best"), F.avg(value).alias("mean"))
    return per.withColumn("best_so_far", F.max("best").over(Window.orderBy(generation).rowsBetween(Window.unboundedPreceding, 0)))


def against_baseline(metrics: DataFrame, model: str, baseline: str, lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """(metric, model, delta, flag) of each model's metrics (model, metric, value) against a baseline's."""
    base = metrics.where(F.col(model) == baseline).select("metric", F.col("value").alias("base"))
    joined = metrics.where(F.col(model) != baseline).join(base, "metric").withColumn("delta", F.col("value") - F.col("base"))
    gain = F.when(F.col("metric").isin(*lower_is_better), -F.col("delta")).otherwise(F.col("delta")) if lower_is_better else F.col("delta")
    flag = F.when(gain > 0, "better").when(gain < 0, "worse").otherwise("same")
    return joined.select("metric", model, "delta", flag.alias("flag"))


def search_verdict(best: DataFrame, search: str, control: str) -> DataFrame:
    """One row: the difference of two strategies' best fitness (strategy, fitness) and its verdict."""
    pick = lambda s: F.max(F.when(F.col("strategy") == s, F.col("fitness")))
    d = F.col("delta")
    out = best.agg((pick(search) - pick(control)).alias("delta"))
    return out.select("delta", F.when(d > 0.005, "material").when(d > 0, "marginal").when(d == 0, "matched").otherwise("beaten").alias("verdict"))
