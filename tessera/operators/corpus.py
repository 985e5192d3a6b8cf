"""Corpus filters, the one-pass funnel, windows and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T

WINDOWS = ((2015, 2017), (2018, 2020), (2021, 2023), (2024, 2025))
HARVEST_WINDOWS = ((2015, 2017), (2018, 2020), (2021, 2023), (2024, 2026))


def window_label(year: Column, windows: Sequence[tuple[int, int]] = WINDOWS) -> Column:
    """Label of the closed range that holds a year, else null; always recomputed from the year."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(windows):
        out = F.when(year.between(lo, hi), f"{lo}-{hi}").otherwise(out)
    return out


def window_counts(df: DataFrame, year: str, windows: Sequence[tuple[int, int]] = WINDOWS) -> DataFrame:
    """(time_window, n) with zero for empty windows and a row ``none`` for years outside."""
    spark = df.sparkSession
    names = spark.range(1).select(F.explode(F.array(*(F.lit(f"{a}-{b}") for a, b in windows), F.lit("none"))).alias("time_window"))
    counts = df.groupBy(F.coalesce(window_label(F.col(year), windows), F.lit("none")).alias("time_window")).agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, "time_window", "left").select("time_window", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]], example: str, ordinal: str, examples: int = 3) -> DataFrame:
    """(position, step, kept, dropped, examples) in one pass: each row is charged to the first step it fails.

    A null predicate counts as failed. examples are the first titles dropped, by
    ordinal, cut to 110 characters; they come from the first rows of each step, so no
    step's rows are gathered.
    """
    failed = F.lit(len(steps))
    for k in range(len(steps) - 1, -1, -1):
        failed = F.when(~F.coalesce(steps[k][1], F.lit(False)), k).otherwise(failed)
    charged = df.select(failed.alias("position"), F.substring(F.col(example), 1, 110).alias("title"), F.col(ordinal).alias("ordinal"))
    counts = charged.groupBy("position").agg(F.count("*").alias("dropped"))
    first = charged.where(F.col("position") < len(steps)).withColumn("n", F.row_number().over(Window.partitionBy("position").orderBy("ordinal")))
    first = first.where(F.col("n") <= examples).groupBy("position").agg(F.sort_array(F.collect_list(F.struct("n", "title"))).alias("t"))
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(n) for n, _ in steps))).alias("position", "step"))
    total = counts.agg(F.sum("dropped").alias("total"))
    # a row per step: the running sum is over a handful of rows
    rows = names.join(counts, "position", "left").join(first, "position", "left").crossJoin(F.broadcast(total))
    gone = F.sum(F.coalesce("dropped", F.lit(0))).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        "position", "step", (F.coalesce("total", F.lit(0)) - gone).cast("long").alias("kept"), F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"),
        F.coalesce(F.col("t")["title"], F.array().cast("array<string>")).alias("examples"),
    )


def literal_filter(c: Column, patterns: Sequence[str]) -> Column:
    """True unless a pattern occurs, in any case; no patterns keep everything."""
    keep = F.lit(True)
    for p in patterns:
        keep = keep & ~F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(p.lower()))
    return keep


def nearest_rank(df: DataFrame, group: Sequence[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Order statistics s[floor(n * p)] per group, with n, min, max and the mean.

    Values are counted first, so the running sum is over distinct values and no
    group's rows are gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    part = Window.partitionBy(*group)
    counts = counts.withColumn("n", F.sum("c").over(part)).withColumn("upto", F.sum("c").over(part.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    stats = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("v"))).alias(name) for name, p in ranks.items()]
    return counts.groupBy(*group).agg(
        F.max("n").alias("n"), F.min("v").alias("min"), *stats, F.max("v").alias("max"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")
    )


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most common values; ties by value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def non_latin_share(c: Column) -> Column:
    """Share of letters outside ASCII; null without letters."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, (letters - F.regexp_count(c, F.lit("[A-Za-z]"))) / letters)


def hygiene(df: DataFrame, text: str) -> DataFrame:
    """One row of conditional counts in one pass."""
    c = F.coalesce(F.col(text), F.lit(""))

    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).cast("long").alias(name)

    return df.agg(
        F.count("*").alias("n"),
        count(F.trim(c) == "", "blank"),
        count(c.rlike(r"(?i)^\s*abstract\b"), "leading_abstract"),
        count(c.rlike(r"https?://"), "with_url"),
        count(c.rlike(T.EMAIL), "with_email"),
        count(~c.rlike(r"^[\x00-\x7F]*$"), "non_ascii"),
        count(F.coalesce(non_latin_share(c) > 0.3, F.lit(False)), "mostly_non_latin"),
        F.count_distinct(c).cast("long").alias("distinct_texts"),
    )


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """(key, n) of keys that occur more than once; blank keys do not count."""
    return df.select(key.alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def report(df: DataFrame) -> DataFrame:
    """One row on documents (doc_id, title, abstract, venue, doi, n_authors, home_affiliations): venues, coverage, hygiene and integrity.

    All but the distinct and repeated keys are conditional counts of one pass; shares
    are in hundredths at one decimal. Blank strings count as missing.
    """
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    count = lambda condition, name: F.count_if(condition).cast("long").alias(name)
    venue, abstract = F.trim(F.coalesce("venue", F.lit(""))), F.coalesce("abstract", F.lit(""))
    preprint = venue.rlike(fixed.PREPRINT_VENUE)
    one = df.agg(
        F.count("*").alias("n"), count((venue != "") & ~preprint, "published"), count(preprint, "preprint"), count(venue == "", "no_venue"),
        F.count_distinct(F.nullif(venue, F.lit(""))).cast("long").alias("distinct_venues"), count(filled("doi"), "with_doi"), count(filled("venue"), "with_venue"),
        count(F.size(F.coalesce("home_affiliations", F.array().cast("array<string>"))) > 0, "with_affiliation"), count(abstract.rlike(fixed.REPORT_LEADING), "leading_abstract"),
        count(abstract.rlike(fixed.REPORT_COPYRIGHT), "copyright_tail"), count(~abstract.rlike(r"^[\x00-\x7F]*$"), "non_ascii"),
        count(F.coalesce(non_latin_share(abstract) > 0.3, F.lit(False)), "mostly_non_latin"), count(~filled("title"), "empty_titles"), count(~filled("abstract"), "empty_abstracts"),
    )
    repeated = lambda key, name: df.groupBy(key.alias("k")).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).cast("long").alias(name))
    out = one.crossJoin(F.broadcast(repeated(T.title_key(F.col("title")), "repeated_titles"))).crossJoin(F.broadcast(repeated(F.col("doc_id"), "repeated_ids")))
    return out.withColumn("published_share", F.round(100 * F.col("published") / F.col("n"), 1))


def split_counted(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that pass a predicate (null: they do not), and one row with kept and dropped counts."""
    passed = F.coalesce(condition, F.lit(False))
    return df.where(passed), df.agg(F.count_if(passed).cast("long").alias("kept"), F.count_if(~passed).cast("long").alias("dropped"))
