"""The merge batch by batch against the whole merge."""

import numpy as np
import pytest

from tessera.operators import merge as M
from tessera.operators.merge_state import MergeState

SCHEMA = "record_id string, batch int, ordinal int, doi_key string, title_key string, abstract string, venue string, doi string, url string, source string, authors array<string>"


def batch_rows(number, n, keys, rng):
    out = []
    for k in range(n):
        doi = f"10/{rng.integers(keys)}" if rng.random() < 0.5 else rng.choice(["", None])
        title = f"t{rng.integers(2 * keys)}" if rng.random() < 0.8 else ""
        out.append((f"b{number}r{k:03d}", number, k, doi, title, "" if rng.random() < 0.5 else f"a{number}.{k}", None, doi, f"u{k}", f"s{rng.integers(4)}", [] if rng.random() < 0.7 else [f"n{k}"]))
    return out


def shown(df):
    return sorted((r.record_id, r.abstract, r.doi, r.url, tuple(r.authors or ()), tuple(r.sources)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_every_batch_equals_the_whole_merge(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    state, rows = MergeState(spark, str(tmp_path / "state"), buckets=8), []
    for number, n in enumerate((150, 40, 60)):
        new = batch_rows(number, n, 25, rng)
        rows += new
        before = {r[0] for r in shown(state.merged())} if number else set()
        counts = state.add(spark.createDataFrame(new, SCHEMA).repartition(3), number)
        whole = shown(M.merge_exact(spark.createDataFrame(rows, SCHEMA)))
        assert shown(state.merged()) == whole
        assert counts["records"] == n and counts["joined"] == n - len({r[0] for r in whole} - before)
        changed = shown(state.changed(number))
        assert set(changed) <= set(whole) and {r[0] for r in whole} - before <= {r[0] for r in changed}
    assert state.batches() == [0, 1, 2]


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    state = MergeState(spark, str(tmp_path / "state"), buckets=50)
    rows = [(f"r{k}", 0, k, f"10/{k}", f"t{k}", f"a{k}", None, f"10/{k}", "u", "s", []) for k in range(1_000)]
    assert state.add(spark.createDataFrame(rows, SCHEMA), 0)["keys_read"] == 0
    small = spark.createDataFrame([("x", 1, 0, "10/7", "new", "", "v", None, "u", "z", [])], SCHEMA)
    counts = state.add(small, 1)
    assert counts["joined"] == 1 and 0 < counts["keys_read"] < 150  # two of fifty buckets of 2,000 keys
    (row,) = state.changed(1).collect()
    assert (row.record_id, row.abstract, row.venue, row.sources) == ("r7", "a7", "v", ["s", "z"])


def test_a_failed_batch_leaves_no_trace(spark, tmp_path, monkeypatch):
    state = MergeState(spark, str(tmp_path / "state"), buckets=4)
    first = batch_rows(0, 30, 10, np.random.default_rng(3))
    second = batch_rows(1, 30, 10, np.random.default_rng(4))
    state.add(spark.createDataFrame(first, SCHEMA), 0)
    before, whole = shown(state.merged()), state.spark.createDataFrame

    def broken(rows, schema):
        if schema.startswith("number int"):
            raise RuntimeError("lost")
        return whole(rows, schema)

    monkeypatch.setattr(spark, "createDataFrame", broken)
    with pytest.raises(RuntimeError):
        state.add(whole(second, SCHEMA), 1)
    monkeypatch.setattr(spark, "createDataFrame", whole)
    assert state.batches() == [0] and shown(state.merged()) == before
    state.add(spark.createDataFrame(second, SCHEMA), 1)
    assert shown(state.merged()) == shown(M.merge_exact(spark.createDataFrame(first + second, SCHEMA)))
    with pytest.raises(ValueError):
        state.add(spark.createDataFrame(second, SCHEMA), 1)


def test_a_resumed_merge_takes_the_export_first(spark):
    """The previous export is batch 0, whatever it was before; batches may lack columns."""
    previous = spark.createDataFrame([("p", 7, 0, "10/1", "t", "a", None, "10/1", "u", "s", [])], SCHEMA)
    new = spark.createDataFrame([("n", 0, "10/1", "x", "v")], "record_id string, ordinal int, doi_key string, title_key string, venue string")
    both = M.resume(previous, new.withColumn("source", new.title_key), new.limit(0).withColumn("source", new.title_key))
    assert sorted((r.record_id, r.batch) for r in both.collect()) == [("n", 1), ("p", 0)]
    (row,) = M.merge_exact(both).collect()
    assert (row.record_id, row.abstract, row.venue, row.sources) == ("p", "a", "v", ["s", "x"])
