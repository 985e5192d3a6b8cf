"""Reviews of drafted labels as an append-only table of events: each is taken or refused, none is lost.

An item is pending until a draft is generated; a failed try may be repeated, a draft is made once. Only
generated items are reviewed, as often as wanted: the last review taken counts, all stay in the history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENERATED, FAILED = "generated", "failed"
DECISIONS = ("accept", "revise", "reject")
LONGEST_LABEL = 120

NOT_GENERATED, AGAIN, NO_NAME, NO_LABEL, UNKNOWN = "not generated", "already generated", "no reviewer or note", "no label or a long one", "unknown event"
TAKEN = "taken"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _outcome(kind: Column, made: Column, draft: Column) -> tuple[Column, Column]:
    """(what becomes of an event, the label it leaves), where made says whether the item has a draft by then."""
    own = F.when(kind == "accept", F.coalesce(draft, F.lit(""))).otherwise(_trimmed(F.col("label")))
    named = (_trimmed(F.col("reviewer")) != "") & (_trimmed(F.col("note")) != "")
    fits = (own != "") & (F.char_length(own) <= LONGEST_LABEL)
    decided = F.when(~made, NOT_GENERATED).when(~named, NO_NAME).when((kind != "reject") & ~fits, NO_LABEL).otherwise(TAKEN)
    outcome = F.when(kind.isin(GENERATED, FAILED), F.when(made, AGAIN).otherwise(TAKEN)).when(kind.isin(*DECISIONS), decided).otherwise(UNKNOWN)
    return outcome, F.when(kind.isin("accept", "revise"), own).when(kind == GENERATED, F.col("label"))


def outcomes(events: DataFrame) -> DataFrame:
    """events (item, at, seq, kind, label, reviewer, note) with outcome and final_label (null where refused, rejected or failed).

    Order is by at, then seq. An item's first draft decides for all its events, so they
    need not be gathered; that draft comes by an aggregate. Null texts are empty, a null kind is unknown.
    """
    order = F.struct("at", "seq")
    drafts = events.where(F.col("kind") == GENERATED).groupBy("item").agg(F.min(F.struct("at", "seq", "label")).alias("draft"))
    joined = events.join(drafts, "item", "left")
    made = F.coalesce(F.struct("draft.at", "draft.seq") < order, F.lit(False))
    outcome, label = _outcome(F.coalesce("kind", F.lit("")), made, F.col("draft.label"))
    return joined.withColumn("outcome", outcome).withColumn("final_label", F.when(F.col("outcome") == TAKEN, label)).drop("draft")


def history(log: DataFrame) -> DataFrame:
    """The reviews taken, all of them: (item, at, seq, kind, final_label, reviewer, note)."""
    return log.where((F.col("outcome") == TAKEN) & F.col("kind").isin(*DECISIONS)).select("item", "at", "seq", "kind", "final_label", "reviewer", "note")


def current(log: DataFrame) -> DataFrame:
    """(item, status, decision, final_label, reviews, refused) of each item: the last review taken and how many there were."""
    taken = F.col("outcome") == TAKEN
    review = taken & F.col("kind").isin(*DECISIONS)
    last = F.max(F.when(review, F.struct("at", "seq", "kind", "final_label")))
    rows = log.groupBy("item").agg(
        last.alias("r"), F.count_if(review).alias("reviews"), F.count_if(~taken).alias("refused"), F.max(F.when(taken & (F.col("kind") == GENERATED), 2).when(taken & (F.col("kind") == FAILED), 1).otherwise(0)).alias("made")
    )
    status = F.when(F.col("made") == 2, GENERATED).when(F.col("made") == 1, FAILED).otherwise("pending")
    return rows.select("item", status.alias("status"), F.col("r.kind").alias("decision"), F.col("r.final_label").alias("final_label"), "reviews", "refused")


def _pythonic(kind: str | None, made: bool, draft: str | None, label: str | None, reviewer: str | None, note: str | None) -> tuple[str, str | None]:
    text = lambda v: v.strip() if isinstance(v, str) else ""
    if kind in (GENERATED, FAILED):
        return (AGAIN, None) if made else (TAKEN, label if kind == GENERATED else None)
    if kind not in DECISIONS:
        return UNKNOWN, None
    own = (draft or "") if kind == "accept" else text(label)
    if not made:
        return NOT_GENERATED, None
    if not text(reviewer) or not text(note):
        return NO_NAME, None
    if kind != "reject" and not 0 < len(own) <= LONGEST_LABEL:
        return NO_LABEL, None
    return TAKEN, None if kind == "reject" else own


def outcomes_of_stream(events: DataFrame) -> DataFrame:
    """(item, seq, outcome, final_label) of a stream of events, by a state an item: whether it has a draft, and which.

    Inside a batch of the stream order is by at and seq; what comes later is later. The state of an
    item is a flag and a label, whatever the number of its events.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        made, draft = state.get if state.exists else (False, None)
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        out = []
        for r in rows.itertuples():
            none = lambda v: None if v is None or v is pd.NA or v != v else v
            outcome, label = _pythonic(none(r.kind), made, draft, none(r.label), none(r.reviewer), none(r.note))
            if outcome == TAKEN and r.kind == GENERATED:
                made, draft = True, none(r.label)
            out.append((r.seq, outcome, label))
        state.update((made, draft))
        yield pd.DataFrame({"item": [key[0]] * len(out), "seq": [x[0] for x in out], "outcome": [x[1] for x in out], "final_label": [x[2] for x in out]})

    kinds = dict(events.dtypes)
    schema = f"item {kinds['item']}, seq {kinds['seq']}, outcome string, final_label string"
    return events.groupBy("item").applyInPandasWithState(step, schema, "made boolean, draft string", "append", "NoTimeout")
