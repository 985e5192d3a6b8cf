"""A record service as a stream, and sessions of its records.

The stream's offset is the cursor of the service, so a query that is stopped goes on from the last
committed cursor; a batch that failed asks for its pages again.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources.harvest import with_retry


class RecordStream(DataSource):
    """``record_stream``: options ``client`` as "module:function", ``query``, and ``pages``, the most pages of a batch (10).

    The client is function(query, place) -> {"results": [json text], "next": place or None}; place is "*" at first.
    At the end of what there is, it is asked for the last page again until it has a next one or more results.
    """

    @classmethod
    def name(cls) -> str:
        return "record_stream"

    def schema(self) -> str:
        return "ordinal long, value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Cursor(dict(self.options))


class _Cursor(SimpleDataSourceStreamReader):
    """Offsets hold the place, how many results of its page are read, and how many records came before."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"place": "*", "taken": 0, "ordinal": 0}

    def _pages(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        module, _, name = self.options["client"].partition(":")
        client = getattr(importlib.import_module(module), name)
        at, rows = dict(start), []
        for _ in range(int(self.options.get("pages", 10)) if end is None else 2**31):
            if end is not None and (at["place"], at["taken"]) == (end["place"], end["taken"]):
                break
            page = with_retry(lambda place=at["place"]: client(self.options["query"], place))
            results = page["results"]
            if end is not None and at["place"] == end["place"]:
                results = results[: end["taken"]]
            new = results[at["taken"] :]
            rows += [(at["ordinal"] + k, value) for k, value in enumerate(new)]
            at["ordinal"] += len(new)
            if page.get("next") and (end is None or at["place"] != end["place"]):
                at.update(place=page["next"], taken=0)
            else:
                at["taken"] = len(results)
                break
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._pages(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._pages(start, end)[0])

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that are done."""


def record_stream(spark, client: str, query: str, pages: int = 10) -> DataFrame:
    """(ordinal, value) of all records of a query, as they come."""
    spark.dataSource.register(RecordStream)
    return spark.readStream.format("record_stream").option("client", client).option("query", query).option("pages", str(pages)).load()


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n, total) of runs of events (key, ts, value) of a key that are less than gap apart.

    On a stream, a session is final, and its state goes, when the watermark has passed its end;
    events that come later than late are dropped, and counted by late_events.
    """
    timed = events.withColumn("time", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("time", late)
    out = timed.groupBy(key, F.session_window("time", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def late_events(query) -> int:
    """Rows that a running or ended query has dropped as too late."""
    states = [s for p in query.recentProgress for s in json.loads(p.json if isinstance(p.json, str) else p.json())["stateOperators"]]
    return sum(s.get("numRowsDroppedByWatermark", 0) for s in states)
