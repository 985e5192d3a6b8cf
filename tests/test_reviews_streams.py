"""Reviews as events, in batch and as a stream; a record stream that resumes; sessions."""

import datetime as dt
import json
import os
import random
import tempfile

from tessera.operators import reviews
from tessera.streaming import records

EVENTS = "item long, at timestamp, seq long, kind string, label string, reviewer string, note string"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def plain_outcomes(rows):
    """The rules one event after another."""
    drafts, out = {}, {}
    for item, _, seq, kind, label, reviewer, note in sorted(rows, key=lambda r: (r[1], r[2])):
        made = item in drafts
        strip = lambda v: (v or "").strip()
        final = None
        if kind in ("generated", "failed"):
            outcome = "already generated" if made else "taken"
            if not made and kind == "generated":
                drafts[item] = final = label
        elif kind not in ("accept", "revise", "reject"):
            outcome = "unknown event"
        elif not made:
            outcome = "not generated"
        elif not strip(reviewer) or not strip(note):
            outcome = "no reviewer or note"
        else:
            final = None if kind == "reject" else (drafts[item] or "") if kind == "accept" else strip(label)
            outcome = "taken" if kind == "reject" or 0 < len(final) <= 120 else "no label or a long one"
            final = final if outcome == "taken" else None
        out[seq] = (item, outcome, final)
    return out


def review_rows(n=400, seed=4):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [
        (rng.randrange(8) if k % 2 else 7, at(k // 3), k, pick("generated", "failed", "accept", "revise", "reject", "odd", None), pick(None, "", " x ", "\tlong" * 40, "label"), pick(None, " ", "ann", "bo", "cy"), pick("\n", "n", "note", None))
        for k in range(n)
    ]


def test_reviews_against_plain_rules(spark):
    rows = review_rows()
    log = reviews.outcomes(spark.createDataFrame(rows, EVENTS).repartition(5)).cache()
    want = plain_outcomes(rows)
    assert {r.seq: (r.item, r.outcome, r.final_label) for r in log.collect()} == want
    assert set(o for _, o, _ in want.values()) == {"taken", "already generated", "not generated", "no reviewer or note", "no label or a long one", "unknown event"}
    kept = reviews.history(log).collect()
    assert {r.seq for r in kept} == {k for k, (_, o, _) in want.items() if o == "taken" and rows[k][3] in ("accept", "revise", "reject")}
    for r in reviews.current(log).collect():
        mine = sorted((x for x in kept if x.item == r.item), key=lambda x: (x["at"], x.seq))
        assert (r.reviews, r.decision, r.final_label) == (len(mine), mine[-1].kind if mine else None, mine[-1].final_label if mine else None)
    assert reviews.current(reviews.outcomes(spark.createDataFrame([], EVENTS))).count() == 0


def test_a_stream_of_reviews_equals_the_batch(spark, tmp_path):
    """Three batches of events, with a restart between them; the state of an item carries over."""
    rows = review_rows(120)
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = reviews.outcomes_of_stream(spark.readStream.schema(EVENTS).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", sink).trigger(availableNow=True).start().awaitTermination()
    got = {r.seq: (r.item, r.outcome, r.final_label) for r in spark.read.parquet(sink).collect()}
    assert got == plain_outcomes(rows)


SERVICE = os.path.join(tempfile.gettempdir(), f"tessera-service-{os.getuid()}.json")


def service(query, place):
    """Pages of three of what the file holds by now; the last page may grow."""
    with open(SERVICE) as f:
        held = json.load(f)
    k = 0 if place == "*" else int(place)
    return {"results": held[3 * k : 3 * k + 3], "next": str(k + 1) if len(held) > 3 * k + 3 else None}


def test_a_stopped_stream_goes_on_from_its_cursor(spark, tmp_path):
    sink, state = str(tmp_path / "out"), str(tmp_path / "state")
    held = []
    try:
        for size in (4, 4, 11, 12, 20):
            held += [f"r{k}" for k in range(len(held), size)]
            with open(SERVICE, "w") as f:
                json.dump(held, f)
            stream = records.record_stream(spark, f"{__name__}:service", "q", pages=2)
            running = stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", sink).start()
            running.processAllAvailable()
            running.stop()
        got = sorted((r.ordinal, r.value) for r in spark.read.parquet(sink).collect())
        assert got == [(k, f"r{k}") for k in range(20)]
    finally:
        os.remove(SERVICE)


def test_a_batch_is_read_again_alike():
    with open(SERVICE, "w") as f:
        json.dump([f"r{k}" for k in range(8)], f)
    try:
        reader = records._Cursor({"client": f"{__name__}:service", "query": "q", "pages": "2"})
        start = reader.initialOffset()
        rows, end = reader.read(start)
        rows = list(rows)
        with open(SERVICE, "w") as f:
            json.dump([f"r{k}" for k in range(30)], f)
        assert list(reader.readBetweenOffsets(start, end)) == rows == [(k, f"r{k}") for k in range(6)]
        more, last = reader.read(end)
        more = list(more)
        assert list(reader.readBetweenOffsets(end, last)) == more and more[0] == (6, "r6")
    finally:
        os.remove(SERVICE)


def test_sessions_of_a_stream(spark, tmp_path):
    """Finished sessions come out once the watermark passes; an event beyond it is dropped and counted."""
    schema = "user long, ts timestamp, value double"
    parts = [[(1, 0, 1.0), (1, 20, 2.0), (2, 5, 4.0)], [(1, 300, 8.0), (2, 301, 16.0)], [(1, 10, 32.0), (2, 320, 64.0)], [(1, 900, 0.5)]]
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    late = 0
    for rows in parts:
        spark.createDataFrame([(u, at(m), v) for u, m, v in rows], schema).coalesce(1).write.mode("append").parquet(source)
        out = records.sessions(spark.readStream.schema(schema).parquet(source), "user")
        query = out.writeStream.format("parquet").option("checkpointLocation", state).option("path", sink).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        late += records.late_events(query)
    got = sorted((r.user, r.start, r.n, r.total) for r in spark.read.parquet(sink).collect())
    assert got == [(1, at(0), 2, 3.0), (1, at(300), 1, 8.0), (2, at(5), 1, 4.0), (2, at(301), 2, 80.0)]
    assert late == 1
    batch = records.sessions(spark.createDataFrame([(u, at(m), v) for rows in parts for u, m, v in rows], schema), "user")
    assert batch.count() == 5
