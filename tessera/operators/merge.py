"""Merging harvested records: single-key passes, the exact ordered merge, seen keys."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components


def _missing(c: str, kind: str) -> Column:
    return F.col(c).isNull() | ((F.size(c) == 0) if kind.startswith("array") else (F.trim(F.col(c).cast("string")) == ""))


def merge_pass(df: DataFrame, key: str, fill: list[str], order: list[str], sources: str = "source") -> DataFrame:
    """One row per key: the first by order, its gaps (null, blank, empty) filled from later rows; distinct sources in order.

    Rows without a key pass unchanged. Fills are aggregates with a map-side
    part, so a hot key is not gathered; distinct sources are few by nature.
    """
    kinds = dict(df.dtypes)
    at = F.struct(*order)
    keyed = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    filled = [F.min_by(F.when(~_missing(c, kinds[c]), F.col(c)), F.when(~_missing(c, kinds[c]), at)).alias(c) for c in fill]
    rest = [c for c in df.columns if c not in (*fill, key, "sources")]
    firsts = F.min_by(F.struct(*rest), at).alias("__first")
    merged = keyed.groupBy(key).agg(firsts, *filled).select(key, "__first.*", *fill)
    names = keyed.groupBy(key, F.col(sources).alias("__s")).agg(F.min(at).alias("__at"))
    names = names.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__at", "__s")))["__s"].alias("sources"))
    out = merged.join(names, key).select(*[c for c in df.columns if c != "sources"], "sources")
    alone = df.where(F.col(key).isNull() | (F.col(key) == "")).drop("sources").withColumn("sources", F.array(F.col(sources)))
    return out.unionByName(alone.select(*out.columns))


def first_by_id(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each id; only the ordering columns and the row itself are aggregated, map-side first."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("__r")).select(key, "__r.*").select(*df.columns)


def unseen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of df (doi_key, title_key, ...) whose keys are not in seen (key_type, key)."""
    for kind, column in (("doi", "doi_key"), ("title", "title_key")):
        known = seen.where(F.col("key_type") == kind).select(F.col("key").alias(column)).where(F.col(column) != "").distinct()
        df = df.join(known, column, "left_anti")
    return df


#: Rounds that decide founders in parallel before what is left is folded component by component.
ROUNDS = 4
_KEYS = ("doi_key", "title_key")


def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    """Founders among the undecided records of one component, in order."""
    dois, titles, out = set(), set(), []
    for r in frame.sort_values(["batch", "ordinal", "record_id"]).itertuples():
        found = r.doi_key in dois or r.title_key in titles
        out.append(not found)
        if not found:
            dois.update({r.doi_key} - {None})
            titles.update({r.title_key} - {None})
    return frame.sort_values(["batch", "ordinal", "record_id"])[["record_id", "batch", "ordinal", "doi_key", "title_key"]].assign(founder=out)


def founders(records: DataFrame) -> DataFrame:
    """(record_id, batch, ordinal, doi_key, title_key, founder): whether no founder before a record has its DOI or its title key.

    records has these columns but the last; keys are null where there is none. In a
    round, records that come first among the undecided of both their keys are
    founders, and those that share a key with a founder are not; a key of any number
    of records is settled by one aggregate. Long chains of keys would take a round for
    every two links, so after ROUNDS what is left is folded in order, component by
    component, on these narrow rows alone.
    """
    columns = records.columns
    at = F.struct("batch", "ordinal", "record_id")
    undecided, decided = cut(records), None
    for _ in range(ROUNDS):
        marked = undecided
        for k in _KEYS:
            first = undecided.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(at).alias(f"__{k}"))
            marked = marked.join(first, k, "left")
        is_first = F.lit(True)
        for k in _KEYS:
            is_first = is_first & (F.col(k).isNull() | (F.col(f"__{k}") == at))
        marked = cut(marked.select(*columns, is_first.alias("founder")))
        new = marked.where("founder")
        gone = marked.where("NOT founder")
        for k in _KEYS:
            taken = new.where(F.col(k).isNotNull()).select(k, F.lit(True).alias(f"__{k}")).distinct()
            gone = gone.join(taken, k, "left")
        gone = cut(gone.select(*columns, F.coalesce(*(F.col(f"__{k}") for k in _KEYS), F.lit(False)).alias("merged")))
        done = new.select(*columns, "founder").unionByName(gone.where("merged").select(*columns, F.lit(False).alias("founder")))
        decided = done if decided is None else decided.unionByName(done)
        undecided = gone.where("NOT merged").select(*columns)
        if undecided.isEmpty():
            return decided
    named = undecided.select("record_id", F.explode(F.array(*(F.concat(F.lit(k), F.col(k)) for k in _KEYS))).alias("k")).where("k IS NOT NULL")
    links = named.join(named.groupBy("k").agg(F.min("record_id").alias("b")), "k").select(F.col("record_id").alias("a"), "b")
    label = components(links).withColumnRenamed("node", "record_id")
    parts = undecided.join(label, "record_id", "left").withColumn("component", F.coalesce("component", "record_id"))
    schema = ", ".join(f"{n} {t}" for n, t in records.dtypes) + ", founder boolean"
    return decided.unionByName(parts.groupBy("component").applyInPandas(_fold, schema).select(*columns, "founder"))


def merge_exact(df: DataFrame, fill: Sequence[str] = ("abstract", "venue", "doi", "url", "authors")) -> DataFrame:
    """The order-dependent merge, exactly: a row per founder, its gaps filled and its sources in order.

    df has record_id (unique), batch, ordinal, doi_key, title_key, source and the
    columns of fill, as far as it has them. In order of (batch, ordinal), a record
    whose DOI an earlier founder has joins that one, else one whose title key; else it
    founds a row. Keys gained by filling and keys of joined records are never looked
    up. Null, blank and (of arrays) empty values are gaps, filled from the first
    record that has a value. All but founders() are aggregates, so no group of
    copies is gathered.
    """
    kinds = dict(df.dtypes)
    fill = [c for c in fill if c in kinds]
    keyed = df.withColumns({k: F.nullif(F.col(k), F.lit("")) for k in _KEYS})
    state = cut(founders(keyed.select("record_id", "batch", "ordinal", *_KEYS)))
    at = F.struct("batch", "ordinal", "record_id")
    home = state.select("record_id", "founder", *_KEYS, at.alias("__at"))
    for k in _KEYS:  # each key has at most one founder
        of = state.where(F.col("founder") & F.col(k).isNotNull()).select(k, F.col("record_id").alias(f"__to_{k}"), at.alias(f"__at_{k}"))
        home = home.join(of, k, "left").withColumn(f"__to_{k}", F.when(F.col(f"__at_{k}") < F.col("__at"), F.col(f"__to_{k}")))
    home = home.select("record_id", F.when(F.col("founder"), F.col("record_id")).otherwise(F.coalesce(*(f"__to_{k}" for k in _KEYS))).alias("__row"))
    return assembled(df.join(home, "record_id"), df.columns, fill)


def assembled(rows: DataFrame, columns: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """A row per founder from records with __row, the founder's record_id: gaps filled from the first record that has a value, distinct sources in order."""
    kinds, at = dict(rows.dtypes), F.struct("batch", "ordinal", "record_id")
    given = lambda c: ~_missing(c, kinds[c])
    filled = rows.groupBy("__row").agg(*(F.min_by(F.when(given(c), F.col(c)), F.when(given(c), at)).alias(f"__{c}") for c in fill))
    names = rows.groupBy("__row", F.col("source").alias("__s")).agg(F.min(at).alias("__at"))
    names = names.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("__at", "__s")))["__s"].alias("sources"))  # distinct sources are few by nature
    out = rows.where("record_id = __row").join(filled, "__row").join(names, "__row")
    return out.select(*(F.coalesce(f"__{c}", c).alias(c) if c in fill else F.col(c) for c in columns), "sources")


def resume(previous: DataFrame, *batches: DataFrame) -> DataFrame:
    """Previous export first, then new batches, numbered in order."""
    out = previous.withColumn("batch", F.lit(0))
    for k, b in enumerate(batches, start=1):
        out = out.unionByName(b.withColumn("batch", F.lit(k)), allowMissingColumns=True)
    return out


def enrich(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Rows replaced by those of more with the same key, else kept."""
    other = more.select(F.col(key), F.struct(*[c for c in df.columns if c != key]).alias("__new"))
    joined = df.join(other, key, "left")
    return joined.select(key, *[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) for c in df.columns if c != key]).select(*df.columns)
