"""Work that must not be done twice, nor grow with what is no part of it."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import latent
from tessera.operators import vectors as V



def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def table(tmp_path, name, sql, files=1):
    (tmp_path / f"{name}.parquet").mkdir()
    for k in range(files):
        duckdb.execute(f"COPY (SELECT * FROM ({sql}) WHERE part = {k}) TO '{tmp_path}/{name}.parquet/{k}.parquet'")
    return str(tmp_path)


def test_holm_means_run_in_the_order_of_events(spark, tmp_path):
    """Means right at a thousandth, over files that cut the sum in two: as one sum in order."""
    rng, rows, want = random.Random(4), [], {}
    while len(want) < 5:
        values = [rng.randrange(1, 99999) / 100 for _ in range(10)]
        whole = 0.0
        for v in values:
            whole += v
        halves = [0.0, 0.0]
        for k, v in enumerate(values):
            halves[k // 5] += v
        if int(whole / 10 * 1000) != int((halves[0] + halves[1]) / 10 * 1000):
            user = len(want)
            want[user] = round((1 + int(whole / 10 * 1000) % 997) / 20000.0, 6)
            rows += [(user * 10 + k, user, v, k // 5) for k, v in enumerate(values)]
    folder = table(tmp_path, "events", "SELECT * FROM (VALUES " + ", ".join(f"({e}::BIGINT, {u}::BIGINT, {v}::DOUBLE, {p})" for e, u, v, p in rows) + ") x(event_id, user_id, value, part)", files=2)
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        got = {r["user_id"]: r["p"] for r in catalog.QUERIES["holm_adjust"](spark, folder).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def documents(tmp_path):
    return table(tmp_path, "documents", """SELECT *, 0 AS part FROM (VALUES (1::BIGINT, 'en', 'a', 'the one two  one'), (1, 'en', 'a', 'two six'), (1, 'en', 'b', 'ten'), (2, 'en', 'b', NULL), (3, 'en', 'a', ''), (4, 'en', 'b', 'one ten'))
x(doc_id, lang, source, text)""")


def test_rebuilt_texts_are_rows_of_their_own(spark, tmp_path):
    folder = documents(tmp_path)
    out = catalog.QUERIES["abstract_reconstruction"](spark, folder)
    assert "Aggregate" not in plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "ten"), (1, "the one two one"), (1, "two six"), (2, None), (3, ""), (4, "one ten")]


@pytest.mark.parametrize("name", ["representative_documents", "tfidf_top_terms", "base_form_frequency", "class_phrase_topics"])
def test_repeated_ids_as_in_sql(spark, tmp_path, name):
    folder, db = documents(tmp_path), duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, folder).toPandas()
    want = db.execute(catalog.ORACLES[name]).df()[list(got.columns)]
    key = lambda frame: sorted(map(str, frame.itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_a_dictionary_does_not_move_the_counts(spark):
    counts = spark.createDataFrame([(1, "a", 2)], "doc_id long, term string, tf long")
    vocab = spark.createDataFrame([("a", 0)], "term string, term_id long")
    assert "broadcast" in plan(V.bow(counts, vocab))


def test_rows_meet_their_bases_once(spark):
    rows = spark.createDataFrame([(1, "cats", 2)], "doc_id long, term string, tf long")
    out = V.with_bases(rows, spark.createDataFrame([("cat",)], "term string"))
    assert [tuple(r) for r in out.collect()] == [(1, "cat", 2)] and plan(out).count("Join") == 1


def test_class_terms_are_counted_from_one_reading(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def read(text):
        seen.add(1)
        return text.split()

    docs = spark.createDataFrame([("x", "a b c"), ("y", "a b")], "topic string, text string").select("topic", read("text").alias("tokens"))
    assert V.class_tfidf(docs, "topic", longest=2, least=2).count() == 6 and seen.value == 2


def pair_lists():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(30)]
    lists = [[rng.choice(words[: rng.choice((3, 30))]) for _ in range(rng.randrange(0, 40))] for _ in range(60)]
    return [*lists, None, [], ["w0"], ["once", "w1", "w2", "w1", "w2", "w1"], ["w1"] * 7]


@pytest.mark.parametrize(("pairs", "words"), [(4_000_000, 5_000_000), (50, 5_000_000), (50, 3)])
def test_pairs_are_counted_as_numbers(spark, monkeypatch, pairs, words):
    """Scores as by plain counts, whatever is packed at once; pairs cross an exchange as packed numbers, not as two words a row."""
    monkeypatch.setattr(V, "PAIRS", pairs)
    monkeypatch.setattr(V, "WORDS", words)
    lists = pair_lists()
    c, n = {}, {}
    for t in lists:
        for w in t or []:
            c[w] = c.get(w, 0) + 1
        for p in zip(t or [], (t or [])[1:], strict=False):
            n[p] = n.get(p, 0) + 1
    want = {p: (m, float(m - 3) * len(c) / c[p[0]] / c[p[1]]) for p, m in n.items() if m > 3}
    want = {p: v for p, v in want.items() if v[1] > 0.01}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lists)], "doc_id long, tokens array<string>").repartition(5)
    out = V.bigram_scores(docs, min_count=3, threshold=0.01)
    assert {(r.a, r.b): (r.n, r.score) for r in out.collect()} == want and len(want) > 20
    if words > 3:
        assert "explode" not in plan(out) and "pairs" in plan(out)


@pytest.mark.parametrize("small", [2_000_000, 2])
def test_phrases_are_joined_as_by_the_plain_loop(spark, small):
    lists = pair_lists()
    phrases = {("w1", "w1"), ("w1", "w2"), ("w2", "w1"), ("w0", "w1"), ("w2", "w0"), ("w9", "absent")}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lists)], "doc_id long, tokens array<string>").repartition(3)
    got = V.join_phrases(docs, spark.createDataFrame(sorted(phrases), "a string, b string"), small=small)
    assert {r.doc_id: r.tokens for r in got.collect()} == {k: V._fold(t, phrases) for k, t in enumerate(lists)}
    none = V.join_phrases(docs, spark.createDataFrame([], "a string, b string"), small=small)
    assert {r.doc_id: r.tokens for r in none.collect()} == dict(enumerate(lists))


def test_bags_of_rows_are_counted_where_the_rows_are(spark):
    """Documents with ids of their own: no exchange, and what the joins give; repeated or null ids still meet."""
    from tessera.operators import topic_stack

    lists = pair_lists()
    apart = spark.createDataFrame([(k, t) for k, t in enumerate(lists)], "doc_id long, tokens array<string>").repartition(3)
    vocab = V.dictionary(V.document_frequency(apart), len(lists), no_below=2)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(V.row_frequency(apart)) == rows(V.document_frequency(apart))
    out = topic_stack.bags(apart, vocab)
    executed = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in executed and "Aggregate" not in executed and "Join" not in executed
    ids, want = {r.term: r.term_id for r in vocab.collect()}, {}
    for k, t in enumerate(lists):
        known = [ids[w] for w in t or [] if w in ids]
        want[k] = (sorted(set(known)), [known.count(w) for w in sorted(set(known))]) if known else (None, None)
    assert {r.doc_id: (r.terms, r.counts) for r in out.collect()} == want
    again = spark.createDataFrame([(1, ["w1", "w2"]), (1, ["w2"]), (None, ["w1"])], "doc_id long, tokens array<string>")
    assert not V.apart(again) and not V.apart(again.where("doc_id IS NULL")) and V.apart(apart)
    two = spark.createDataFrame([("w1", 0), ("w2", 1)], "term string, term_id long")
    assert rows(topic_stack.bags(again, two)) == rows(spark.createDataFrame([(1, [0, 1], [1, 2]), (1, [0, 1], [1, 2]), (None, None, None)], "doc_id long, terms array<long>, counts array<long>"))


def test_batches_are_multiplied_in_pieces():
    sizes = [5, None, 40_000, 3, 30_000, 0]
    lists = pa.array([None if n is None else list(range(n)) for n in sizes], pa.list_(pa.int32()))
    weights = pa.array([None if n is None else [1.0] * n for n in sizes], pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), lists, weights], names=["doc_id", "terms", "weights"])
    pieces = list(latent._pieces([batch]))
    assert [p.num_rows for p in pieces] == [2, 1, 3]
    basis = np.random.default_rng(1).standard_normal((40_000, 4))
    got = np.concatenate([latent._projected(p, basis)[0] for p in pieces])
    assert np.allclose(got, [basis[: n or 0].sum(axis=0) for n in sizes])
