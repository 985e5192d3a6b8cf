import json
import os
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, harvest
from tessera.streaming import windows


def test_abstract(spark):
    rows = [({"Deep": [0], "learning": [1], "for": [2], "text": [3]},), ({"Deep": [0], "NLP": [4]},), ({},), (None,), ({"a": [0, 2], "b": [1]},)]
    df = spark.createDataFrame(rows, "m map<string, array<int>>").select(harvest.abstract_from_positions(F.col("m")))
    assert [r[0] for r in df.collect()] == ["Deep learning for text", "Deep NLP", "", "", "a b a"]


def test_formats(spark):
    work = {"id": "W1", "display_name": "T", "doi": "https://doi.org/10.1/A", "publication_year": 2020, "abstract_inverted_index": {"x": [0]}, "authorships": [{"author": {"display_name": "N"}, "institutions": [{"display_name": "I", "country_code": "NP"}], "raw_affiliation_strings": ["I", "J"]}]}
    paper = {"paperId": "p", "externalIds": {"DOI": "10.2/B"}, "year": 2021, "authors": [{"name": "N", "affiliations": ["I", {"name": "J"}]}]}
    article = {"article_number": 7, "authors": {"authors": [{"full_name": "N", "affiliation": "I"}]}, "pdf_url": "u"}
    record = {"identifier": "r", "creators": [{"creator": "N"}, {"creator": "O", "affiliation": "own"}], "affiliations": [{"name": "I"}], "publicationDate": "2019-02-01", "url": [{"value": "u"}]}
    got = []
    for f, x in ((harvest.works, work), (harvest.papers, paper), (harvest.articles, article), (harvest.chapters, record)):
        got.append(f(spark.createDataFrame([(json.dumps(x),)], "value string")).first())
    assert got[0]["doi"] == "10.1/a" and got[0]["abstract"] == "x" and got[0]["title"] == "T" and got[0]["url"] == "W1"
    assert got[0]["authors"][0]["affiliations"] == ["I", "J"] and got[0]["authors"][0]["country_codes"] == ["NP"]
    assert got[1]["authors"][0]["affiliations"] == ["I", "J"] and got[1]["year"] == 2021
    assert got[2]["paper_id"] == "7" and got[2]["url"] == "u"
    assert [a["affiliations"] for a in got[3]["authors"]] == [["I"], ["own"]] and got[3]["url"] == "u" and got[3]["year"] == 2019
    union = harvest.works(spark.createDataFrame([(json.dumps(work),)], "value string"))
    assert harvest.to_documents(union.withColumn("ordinal", F.lit(1))).first()["text"] == "T. x"


def client(rule, cursor):
    start = 0 if cursor == "*" else int(cursor)
    return {"results": [f"{rule}#{k}" for k in range(start, min(5, start + 2))], "next": str(start + 2)}


def test_paged_scan(spark):
    spark.dataSource.register(harvest.RecordSource)
    df = spark.read.format("records").option("windows", "2015-2017,2018-2020").option("client", f"{__name__}:client").load()
    got = df.groupBy("window").count().collect()
    assert sorted(map(tuple, got)) == [("2015-2017", 5), ("2018-2020", 5)]
    assert harvest.render_filter((2015, 2017), subfields=("1", "2"), keyword="k").endswith("subfield.id:1|2,title_and_abstract.search:k")


def token_client(query, place):
    start = int(place or 0)
    names = [f"{k}" for k in range(5)] + ["shared"]
    return {"results": [json.dumps({"paperId": n if n == "shared" else f"{query}{n}"}) for n in names[start : start + 2]], "next": str(start + 2) if start + 2 < 6 else None}


def offset_client(query, place):
    return {"results": [f"{query}#{k}" for k in range(place, min(8, place + 3))], "total": 7}


def test_scans_by_token_and_offset(spark):
    records = harvest.scan(spark, f"{__name__}:token_client", ["a", "b"], paging="token")
    assert records.count() == 12
    got = harvest.first_of_queries(harvest.papers(records).withColumns({"part": F.lit(0), "ordinal": F.lit(0)}).limit(0).unionByName(
        records.select(F.get_json_object("value", "$.paperId").alias("paper_id"), "part", "ordinal"), allowMissingColumns=True))
    assert got.count() == 11 and got.where("paper_id = 'shared'").first()["part"] == 0
    offsets = harvest.scan(spark, f"{__name__}:offset_client", ["q", "r"], paging="offset", page=3)
    assert sorted(r["value"] for r in offsets.collect()) == sorted(f"{q}#{k}" for q in "qr" for k in range(1, 8))
    some = harvest.scan(spark, f"{__name__}:offset_client", ["q", "r"], paging="offset", page=3, limit=9)
    assert sorted(r["value"] for r in some.collect()) == sorted([f"q#{k}" for k in range(1, 8)] + ["r#1", "r#2"])  # over the whole scan, in order of queries


CALLS = os.path.join(tempfile.gettempdir(), f"tessera-calls-{os.getuid()}.txt")


def calls():
    with open(CALLS) as f:
        return [line.rstrip("\n").split("\t") for line in f]


def note(*parts):
    with open(CALLS, "a") as f:
        f.write("\t".join(map(str, parts)) + "\n")


@pytest.fixture
def noted():
    open(CALLS, "w").close()
    yield calls
    os.remove(CALLS)


def yearly_client(rule, place):
    """Two records of each year asked for, one a page; a word asked for is in the title."""
    note(rule, place)
    a, b = map(int, re.search(r"publication_year:(\d+)-(\d+)", rule).groups())
    word = (re.search(r"search:(.*)$", rule) or ["", "none"])[1]
    found = [{"id": f"{y}.{k}", "publication_year": y, "title": word} for y in range(a, b + 1) for k in range(2)]
    at = 0 if place == "*" else int(place)
    return {"results": [json.dumps(x) for x in found[at : at + 1]], "next": str(at + 1) if at + 1 < len(found) else None}


def test_predicates_reach_the_service(spark, noted):
    asked = lambda where=None: harvest.scan(spark, f"{__name__}:yearly_client", windows=[(2010, 2014), (2015, 2017), (2018, 2020)], where=where)
    years = lambda df: sorted(r["year"] for r in df.select("year").collect())
    assert years(asked()) == sorted(2 * list(range(2010, 2021))) and len(noted()) == 22
    for condition, want, count in (
        ("year = 2016", [2016], 2), ("year > 2016 AND year <= 2018", [2017, 2018], 4), ("year >= 2019", [2019, 2020], 4), ("year IN (2012, 2014)", [2012, 2014], 6),
        ("year > 2020", [], 0), ("year = 2011 OR year = 2019", [2011, 2019], 22), ("year IS NULL", [], 22),
    ):
        open(CALLS, "w").close()
        found = asked(condition)
        assert years(found) == years(found) == sorted(2 * want) and len(noted()) == count, condition
    open(CALLS, "w").close()
    found = asked("search = 'deep nets' AND year = 2016").collect()
    assert [(r["search"], json.loads(r["value"])["title"]) for r in found] == [("deep nets", "deep nets")] * 2
    assert {rule for rule, _ in noted()} == {"authorships.countries:np,publication_year:2016-2016,title_and_abstract.search:deep nets"}
    assert asked("search = 'a' AND search = 'b'").count() == 0
    assert asked("search IS NULL").count() == 22


def test_no_year_is_invented():
    assert [harvest._year(v) for v in ('{"year": "2020"}', '{"publicationDate": "2019-02"}', '{"year": null}', '{"year": "n.d."}', "[1]", "text", '{"publication_year": 20201}')] == [2020, 2019, None, None, None, None, 2020]


def growing_client(query, place):
    """Eleven records when first asked, fourteen later; the second page of a query fails once."""
    before = [c for c in calls() if c[:2] == [query, str(place)]]
    note(query, place, os.getpid())
    if place == 4 and not before:
        raise harvest.Transient(0.0)
    total = 11 if place == 1 else 14
    return {"results": [json.dumps({"id": f"{query}{k}"}) for k in range(place, min(total + 1, place + 3))], "total": total}


def test_offsets_are_planned_from_the_total(spark, noted):
    records = harvest.scan(spark, f"{__name__}:growing_client", ["q"], paging="offset", page=3, span=2)
    assert records.rdd.getNumPartitions() == 2
    got = sorted((r["ordinal"], json.loads(r["value"])["id"]) for r in records.collect())
    assert got == [(k, f"q{k + 1}") for k in range(14)]  # with those that came while reading
    asked = Counter(int(place) for _, place, _ in noted())
    assert asked == {1: 1, 4: 2, 7: 1, 10: 1, 13: 1}  # the planned page is not asked for twice, and only the failing one is again
    assert len({pid for _, place, pid in noted() if place in ("4", "7")}) == 2
    one = harvest.scan(spark, f"{__name__}:growing_client", ["q"], paging="offset", page=3, span=100)
    assert one.rdd.getNumPartitions() == 1
    assert sorted(r["value"] for r in one.collect()) == sorted(r["value"] for r in records.collect())


def test_empty_offset_scans(spark, noted):
    assert harvest.scan(spark, f"{__name__}:no_client", ["q", "r"], paging="offset").count() == 0


def no_client(query, place):
    return {"results": [], "total": 0}


def test_queries_of_scans():
    assert harvest.term_queries(("x y",), ("A", "B")) == ['("x y") + ("A" | "B")'] and harvest.or_query(("x", "y z")) == '("x" OR "y z")'
    assert harvest.dated_query("q", (2015, 2017)) == "q AND onlinedatefrom:2015-01-01 AND onlinedateto:2017-12-31"


def test_home_records_of_asked_scans(spark):
    a = lambda *affs: [{"name": "n", "affiliations": list(affs), "country_codes": []}]
    rows = [(1, a()), (2, a("Kathmandu University")), (3, a("Elsewhere")), (4, a("Kathmandu University") + a("Elsewhere")), (5, None)]
    df = spark.createDataFrame(rows, "id int, authors array<struct<name: string, affiliations: array<string>, country_codes: array<string>>>")
    assert sorted(r["id"] for r in harvest.keep_home(df).collect()) == [1, 2, 4, 5]
    assert sorted(r["id"] for r in harvest.keep_home(df, foreign=True).collect()) == [4]


def test_small_exports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.12345, None), ("c_d", float("nan"), 3)], "name string, score double, n int").coalesce(1)
    path = f"{tmp_path}/out/x.json"
    files.export_json_array(df, path)
    files.export_json_array(df, path)  # replaces
    assert [r["name"] for r in json.loads(open(path).read())] == ["a|b", "c_d"] and [p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".tmp"] == []
    assert files.read_json_array(spark, path, "name string, score double, n int").count() == 2
    assert files.markdown_table(df) == "| name | score | n |\n| --- | --- | --- |\n| a\\|b | 0.123 | - |\n| c_d | - | 3 |\n"
    assert files.latex_table(df).splitlines()[2] == r"c\_d & -- & 3 \\"
    for f in (lambda: files.markdown_table(df, most=1), lambda: files.export_json_array(df, path, most=1)):
        try:
            f()
        except ValueError:
            continue
        raise AssertionError


def test_runs_know_their_artefacts(spark, tmp_path):
    run = files.new_run(spark, str(tmp_path), "t", {"a": 1}, commit="abc")
    for name in ("x", "y", "x"):
        files.write_artefact(spark.range(2), str(tmp_path), run, name)
    files.new_run(spark, str(tmp_path), "t", {})
    got = {r["run_id"]: r for r in files.runs(spark, str(tmp_path)).collect()}
    assert set(got[run]["artefacts"]) == {"x", "y"} and json.loads(got[run]["config"]) == {"a": 1, "commit": "abc"} and len(got) == 2
    assert spark.read.parquet(got[run]["artefacts"]["x"]).count() == 2


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n3 4 3\n1 1 2\n1 4 1.5\n3 2 7\n")
    assert sorted(map(tuple, files.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect())) == [(0, 0, 2.0), (0, 3, 1.5), (2, 1, 7.0)]


def test_sql_functions(spark):
    from tessera.functions import register, scalar
    from tessera.functions import text as T

    assert "title_key" in register.register(spark)
    texts = [" A naïve  é_x! ", "https://doi.org/10.1/AB ", "2020-05-01", "", None]
    spark.createDataFrame([(t,) for t in texts], "t string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT t, title_key(t) AS a, doi_key(t) AS b, raw_token_count(t) AS c, coerce_year(t) AS d, collapse(t) AS e FROM texts")
    t = F.col("t")
    want = spark.table("texts").select("t", T.title_key(t), T.doi_key(t), T.raw_token_count(t), T.coerce_year(t), T.collapse(t))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    x = spark.range(-5, 16).select(F.col("id").cast("double").alias("x"))
    for p in ((0, 5, 10), (0, 0, 10), (0, 10, 10), (0, 2, 6, 9), (0, 0, 6, 9), (0, 2, 9, 9)):
        name = "trimf" if len(p) == 3 else "trapmf"
        rows = x.select(F.expr(f"{name}(x, {', '.join(f'{v}D' for v in p)})").alias("a"), scalar.membership(F.col("x"), tuple(map(float, p))).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows)


def test_manifest_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"x" * 10)
    r = files.manifest(spark, str(tmp_path)).first()
    assert (r["bytes"], r["sha256"]) == (10, hashlib.sha256(b"x" * 10).hexdigest())


def test_retry():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise harvest.Transient(5.0 if len(calls) == 1 else None)
        return {"ok": 1}

    assert harvest.with_retry(call, sleep=waits.append) == {"ok": 1} and waits == [5.0, 2.0]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"paper_id": "1", "title": "T", "authors": [{"name": "N", "affiliations": ["I"]}], "sources": ["s"]}]')
    df = files.read_json_array(spark, str(tmp_path / "a.json"))
    files.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert len(back.columns) == 13 and back.first()["affiliations"] == "I"
    assert files.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    assert sorted(r["key"] for r in files.seen_keys(df).collect()) == ["t"]
    run = files.new_run(spark, str(tmp_path), "lda", {"k": 1})
    files.new_run(spark, str(tmp_path), "smoke", {})
    assert files.latest_run(spark, str(tmp_path), "lda") == run and files.latest_run(spark, str(tmp_path), "other") is None
    topics = spark.createDataFrame([("m", 0, 1, "a"), ("m", 0, 2, "b"), ("n", 0, 1, "c")], "model string, topic_id int, rank int, term string")
    sheet, key = files.blind_sheet(topics, 3)
    assert sheet.columns == ["item", "words"] and key.count() == 2


def test_stream_equals_batch(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    a = sorted((r["start"], r["event_type"], r["n"]) for r in spark.table("tumbled").collect())
    assert a == sorted((r["start"], r["event_type"], r["n"]) for r in windows.tumbling(events).collect())
    assert windows.unseen(events, ["user_id"]).count() == events.select("user_id").distinct().count()
