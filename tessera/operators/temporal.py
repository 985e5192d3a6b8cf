"""Topic shares over windows, trends and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import trend_label


def window_shares(rows: DataFrame, members: DataFrame, mass: str = "active") -> DataFrame:
    """(window, topic, share, n): mean topic weight per window, scaled so that a window's shares sum to 1.

    rows has (window, doc_id, topic, weight); members has every (window, doc_id).
    ``active`` averages over documents with any weight, ``all`` over all of them
    without scaling; n counts all documents either way. A window without weight
    has null shares.
    """
    n = members.groupBy("window").agg(F.count("*").alias("n"))
    sums = rows.groupBy("window", "topic").agg(F.sum("weight").alias("s"))
    topics = sums.select("topic").distinct()  # from the sums, so that their exchange is reused
    grid = n.crossJoin(F.broadcast(topics)).join(sums, ["window", "topic"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    if mass == "all":
        return grid.select("window", "topic", (F.col("s") / F.col("n")).alias("share"), "n")
    active = rows.where("weight > 0").groupBy("window").agg(F.count_distinct("doc_id").alias("m"))
    mean = F.when(F.col("m") > 0, F.col("s") / F.col("m"))
    total = F.sum("mean").over(Window.partitionBy("window"))
    out = grid.join(active, "window", "left").withColumn("mean", mean)
    return out.select("window", "topic", F.when(total > 0, F.col("mean") / total).alias("share"), "n")


def trends(shares: DataFrame, index: str, least: int = 30) -> DataFrame:
    """Slope over eligible windows (n of at least ``least``; two are needed), change between the first and last, and a label."""
    ok = shares.where((F.col("n") >= least) & F.col("share").isNotNull())
    fit = ok.groupBy("topic").agg(
        F.count("*").alias("windows"),
        F.regr_slope("share", F.col(index).cast("double")).alias("slope"),
        F.min_by("share", index).alias("first_share"),
        F.max_by("share", index).alias("last_share"),
    )
    two = F.col("windows") >= 2
    fit = fit.withColumn("slope", F.when(two, F.col("slope"))).withColumn("change", F.when(two, F.col("last_share") - F.col("first_share")))
    all_topics = shares.select("topic").distinct().join(fit, "topic", "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
    return all_topics.withColumn("trend", trend_label(F.col("slope"), F.col("change"))).orderBy(F.coalesce("change", F.lit(0.0)).desc(), "topic")


#: Groups of documents that are drawn as one; their number does not grow with the table.
BLOCKS = 1024


def bootstrap_change(rows: DataFrame, first: str, last: str, draws: int = 2000, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """(topic, low, high): 95 % interval of the change in mean weight over active documents, by a Poisson bootstrap of blocks.

    Documents fall into blocks by a hash of their id, independently of their weights,
    and a block is drawn as one: sums per block and draw have the expectation and the
    variance that draws of documents have, and their number depends on blocks, draws and
    topics only. Every (block, draw) has a weight from a hash, so partitions and reruns do
    not matter. A topic's mean is over all documents of the window with any weight, also
    those without the topic; a draw that takes no document of a window has no change.
    """
    spark = rows.sparkSession
    hashed = lambda *c: F.conv(F.substring(F.md5(F.concat_ws(":", *c).cast("binary")), 1, 8), 16, 10).cast("long")
    active = rows.where(F.col("window").isin(first, last) & (F.col("weight") > 0)).withColumn("block", hashed(F.col("doc_id").cast("string")) % blocks)
    members = active.groupBy("window", "block").agg(F.count_distinct("doc_id").alias("n"))
    sums = active.groupBy("window", "block", "topic").agg(F.sum("weight").alias("s"))
    grid = F.broadcast(spark.range(draws).withColumnRenamed("id", "draw"))
    u = (hashed(F.lit(str(seed)), F.col("block").cast("string"), F.col("draw").cast("string")) + 0.5) / float(1 << 32)
    times = F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.9196986, 2).when(u < 0.98101184, 3).when(u < 0.99634015, 4).otherwise(5)
    drawn = F.broadcast(spark.range(blocks).withColumnRenamed("id", "block")).crossJoin(grid).withColumn("k", times).where("k > 0")
    taken = members.join(drawn, "block").groupBy("window", "draw").agg(F.sum(F.col("k") * F.col("n")).alias("n"))
    found = sums.join(drawn, "block").groupBy("topic", "draw", "window").agg(F.sum(F.col("k") * F.col("s")).alias("s"))
    topics = active.select("topic").distinct()
    means = taken.where("n > 0").crossJoin(topics).join(found, ["topic", "draw", "window"], "left").withColumn("m", F.coalesce("s", F.lit(0.0)) / F.col("n"))
    wide = means.groupBy("topic", "draw").pivot("window", [first, last]).agg(F.first("m"))
    return wide.groupBy("topic").agg(*(F.percentile(F.col(last) - F.col(first), F.lit(q)).alias(n) for n, q in (("low", 0.025), ("high", 0.975))))


def by_window(shares: DataFrame, least: int = 30) -> DataFrame:
    """(topic, shares): a map from each eligible window (n of at least ``least``) to the topic's share; windows are a handful."""
    ok = shares.where((F.col("n") >= least) & F.col("share").isNotNull())
    return ok.groupBy("topic").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("window").cast("string").alias("k"), F.col("share").alias("v"))))).alias("shares"))


def top_changes(shares: DataFrame, first, last, n: int) -> DataFrame:
    """The n topics whose share differs most between two windows, undefined shares counting as no change; ties by topic."""
    at = lambda w: F.max(F.when(F.col("window") == w, F.col("share")))
    change = shares.groupBy("topic").agg(F.coalesce(at(last) - at(first), F.lit(0.0)).alias("change"))
    return change.orderBy(F.abs("change").desc(), "topic").limit(n)


def assigned(rows: DataFrame) -> DataFrame:
    """(window, assigned): documents with any topic weight per window."""
    return rows.where("weight > 0").groupBy("window").agg(F.count_distinct("doc_id").alias("assigned"))
