"""Normalising harvested records of four JSON formats, and a paged scan of a record service."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType

from ..functions import fixed
from ..functions import text as T
from ..session import cut

_STRINGS = "array<string>"


@F.pandas_udf(MapType(StringType(), ArrayType(IntegerType())))
def positions(words: pd.Series) -> pd.Series:
    """The {word: [positions]} map of each row's words, what a service sends for a text; null for null. A row at a time, so nothing is shuffled."""

    def index(row):
        if row is None:
            return None
        out: dict[str, list[int]] = {}
        for k, word in enumerate(row):
            out.setdefault(word, []).append(k)
        return out

    return words.map(index)


def abstract_from_positions(index: Column) -> Column:
    """Text of a {word: [positions]} map: words in order of position, gaps skipped; of words at one position the last stays."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e, k: F.transform(e["value"], lambda p: F.struct(p.alias("p"), k.alias("k"), e["key"].alias("w")))))
    # a one-element array binds the sorted pairs to a name, so they are sorted once and not per word
    last = lambda s: F.filter(s, lambda x, i: ~(F.get(s, i + 1)["p"].eqNullSafe(x["p"])))
    words = F.transform(F.array(F.array_sort(pairs)), lambda s: F.transform(last(s), lambda x: x["w"]))
    return F.when(index.isNull(), "").otherwise(F.array_join(F.get(words, F.lit(0)), " "))


def _array(c: Column, kind: str = _STRINGS) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _named(values: Column, keys: Sequence[str]) -> Column:
    """Plain strings, or the first of some fields of objects, of a JSON array read as strings; blanks go."""
    pick = lambda x: F.when(F.startswith(F.trim(x), F.lit("{")), F.coalesce(*(F.get_json_object(x, f"$.{k}") for k in keys))).otherwise(x)
    return F.filter(F.transform(_array(values), pick), lambda x: x.isNotNull() & (x != ""))


def _filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def _no_codes() -> Column:
    return F.array().cast(_STRINGS)


# --- Fixed values: field names of the four formats ---
WORK = (
    "id string, doi string, title string, display_name string, publication_year string, abstract_inverted_index map<string,array<int>>, "
    "primary_location struct<landing_page_url:string,source:struct<display_name:string>>, primary_topic struct<display_name:string,subfield:struct<display_name:string>>, "
    "authorships array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string,country_code:string>>,raw_affiliation_strings:array<string>,countries:array<string>>>"
)
PAPER = (
    "paperId string, title string, abstract string, year string, venue string, url string, externalIds struct<DOI:string>, "
    "authors array<struct<name:string,affiliations:array<string>>>"
)
ARTICLE = (
    "article_number string, doi string, title string, abstract string, publication_year string, publication_title string, html_url string, pdf_url string, "
    "authors struct<authors:array<struct<full_name:string,affiliation:string>>>"
)
RECORD = (
    "identifier string, doi string, title string, abstract string, publicationDate string, publicationName string, url string, affiliations string, affiliation string, "
    "organization string, creators array<struct<creator:string,affiliation:string,affiliations:string>>"
)


def _output(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    extra = {"primary_topic": F.lit(None).cast("string"), "primary_subfield": F.lit(None).cast("string")}
    all_columns = {**extra, **columns, "source": F.lit(source)}
    order = ("paper_id", "doi", "title", "abstract", "year", "venue", "authors", "url", "source", "primary_topic", "primary_subfield")
    return df.select(*(all_columns[c].alias(c) for c in order))


def works(raw: DataFrame) -> DataFrame:
    """Records of the inverted-index format from a column ``value`` of JSON text."""
    df = raw.select(F.from_json("value", WORK).alias("w")).select("w.*")

    def author(a: Column) -> Column:
        institutions = _array(a["institutions"], "array<struct<display_name:string,country_code:string>>")
        names = F.concat(F.transform(institutions, lambda i: i["display_name"]), _array(a["raw_affiliation_strings"]))
        codes = F.concat(F.transform(institutions, lambda i: i["country_code"]), _array(a["countries"]))
        full = lambda x: F.array_distinct(F.filter(x, lambda v: v.isNotNull() & (v != "")))
        return F.struct(a["author"]["display_name"].alias("name"), full(names).alias("affiliations"), full(codes).alias("country_codes"))

    return _output(
        df, "openalex", paper_id=F.col("id"), doi=T.doi_key(F.col("doi")), title=_filled(F.col("title"), F.col("display_name")),
        abstract=abstract_from_positions(F.col("abstract_inverted_index")), year=T.coerce_year(F.col("publication_year")), venue=F.col("primary_location.source.display_name"),
        authors=F.transform(F.coalesce("authorships", F.array().cast(WORK.split("authorships ")[1])), author), url=_filled(F.col("primary_location.landing_page_url"), F.col("id")),
        primary_topic=F.col("primary_topic.display_name"), primary_subfield=F.col("primary_topic.subfield.display_name"),
    )


def papers(raw: DataFrame) -> DataFrame:
    """Records whose affiliations are strings or objects."""
    df = raw.select(F.from_json("value", PAPER).alias("p")).select("p.*")
    author = lambda a: F.struct(a["name"].alias("name"), _named(a["affiliations"], ("name", "affiliation")).alias("affiliations"), _no_codes().alias("country_codes"))
    return _output(
        df, "semantic_scholar", paper_id=F.col("paperId"), doi=T.doi_key(F.col("externalIds.DOI")), title=F.col("title"), abstract=F.coalesce("abstract", F.lit("")),
        year=T.coerce_year(F.col("year")), venue=F.col("venue"), authors=F.transform(F.coalesce("authors", F.array().cast(PAPER.split("authors ")[1])), author), url=F.col("url"),
    )


def articles(raw: DataFrame) -> DataFrame:
    """Records with one affiliation per author."""
    df = raw.select(F.from_json("value", ARTICLE).alias("a")).select("a.*")

    def author(a: Column) -> Column:
        own = F.when(F.coalesce(a["affiliation"], F.lit("")) != "", F.array(a["affiliation"])).otherwise(_no_codes())
        return F.struct(a["full_name"].alias("name"), own.alias("affiliations"), _no_codes().alias("country_codes"))

    people = F.coalesce("authors.authors", F.array().cast("array<struct<full_name:string,affiliation:string>>"))
    return _output(
        df, "ieee_xplore", paper_id=F.coalesce("article_number", F.lit("")), doi=T.doi_key(F.col("doi")), title=F.col("title"), abstract=F.coalesce("abstract", F.lit("")),
        year=T.coerce_year(F.col("publication_year")), venue=F.col("publication_title"), authors=F.transform(people, author), url=_filled(F.col("html_url"), F.col("pdf_url")),
    )


def _loose(c: Column, keys: Sequence[str]) -> Column:
    """A field that is a string, an array of strings or an array of objects, as names."""
    listed = F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, _STRINGS)).otherwise(F.array(c))
    return _named(F.when(c.isNotNull(), listed), keys)


def chapters(raw: DataFrame) -> DataFrame:
    """Records whose authors without an affiliation inherit that of the record."""
    df = raw.select(F.from_json("value", RECORD).alias("r")).select("r.*")
    keys = ("name", "affiliation", "organization")
    df = df.withColumn("own", F.concat(*(_loose(F.col(c), keys) for c in ("affiliations", "affiliation", "organization"))))

    def author(a: Column) -> Column:
        extra = F.concat(_loose(a["affiliation"], keys), _loose(a["affiliations"], keys))
        return F.struct(a["creator"].alias("name"), F.when(F.size(extra) > 0, extra).otherwise(F.col("own")).alias("affiliations"), _no_codes().alias("country_codes"))

    url = F.when(F.startswith(F.trim("url"), F.lit("[")), F.get(_named(F.from_json("url", _STRINGS), ("value",)), F.lit(0))).otherwise(F.col("url"))
    return _output(
        df, "springer", paper_id=F.col("identifier"), doi=T.doi_key(F.col("doi")), title=F.col("title"), abstract=F.coalesce("abstract", F.lit("")),
        year=T.coerce_year(F.col("publicationDate")), venue=F.col("publicationName"), authors=F.transform(F.coalesce("creators", F.array().cast(RECORD.split("creators ")[1])), author), url=url,
    )


def keep_relevant(df: DataFrame, foreign: bool = False) -> DataFrame:
    """Relevant records with a home author; without any known affiliation, a home institution in the text decides."""
    known = F.exists("authors", lambda a: F.size(a["affiliations"]) > 0)
    home = T.any_author_home(F.col("authors"))
    if foreign:
        home = home & T.any_author_foreign(F.col("authors"))
    named = T.mentions_home_institution(F.concat_ws(" ", "title", "abstract", "venue"))
    return df.where(T.is_relevant(F.col("title"), F.col("abstract")) & F.when(known, home).otherwise(named))


def keep_home(df: DataFrame, foreign: bool = False) -> DataFrame:
    """Records of scans that ask for the country: they go only if affiliations are known and none is home (or, asked for, none is foreign)."""
    known = F.exists("authors", lambda a: F.size(a["affiliations"]) > 0)
    kept = ~F.coalesce(known, F.lit(False)) | T.any_author_home(F.col("authors"))
    return df.where(kept & T.any_author_foreign(F.col("authors")) if foreign else kept)


def term_queries(terms: Sequence[str] = fixed.QUERY_TERMS, institutions: Sequence[str] = fixed.QUERY_INSTITUTIONS) -> list[str]:
    """One query a term, bound to any of the institutions."""
    either = " | ".join(f'"{i}"' for i in institutions)
    return [f'("{t}") + ({either})' for t in terms]


def or_query(terms: Sequence[str] = fixed.QUERY_TERMS) -> str:
    """All terms, quoted, in one query."""
    return "(" + " OR ".join(f'"{t}"' for t in terms) + ")"


def dated_query(text: str, years: tuple[int, int]) -> str:
    """A query with bounds on the date."""
    return f"{text} AND onlinedatefrom:{years[0]}-01-01 AND onlinedateto:{years[1]}-12-31"


def scan(spark, client: str, queries: Sequence[str] = (), paging: str = "cursor", page: int = 100, limit: int | None = None, windows: Sequence[tuple[int, int]] = (), span: int = 10, where: str | None = None) -> DataFrame:
    """(window, part, ordinal, year, search, value) of a paged scan of queries, or of windows of years; ``limit`` bounds the whole scan, in order of queries.

    paging is ``cursor`` or ``token`` (the client returns what the next call takes), with a partition a query,
    or ``offset`` (it takes the number of the first record, from 1, and returns the total), with a partition
    for each ``span`` pages. What ``where`` says of year and search reaches the service (see RecordSource); such a scan runs once
    and is stored, because Spark keeps what it has pushed into a source for later plans of the same DataFrame.
    """
    spark.dataSource.register(RecordSource)
    reader = spark.read.format("records").option("client", client).option("paging", paging).option("page", str(page)).option("span", str(span))
    if windows:
        reader = reader.option("windows", ",".join(f"{a}-{b}" for a, b in windows))
    else:
        reader = reader.option("queries", json.dumps(list(queries)))
    if where is not None:
        setting = "spark.sql.python.filterPushdown.enabled"
        before = spark.conf.get(setting)
        spark.conf.set(setting, "true")
        try:
            found = cut(reader.option("pushdown", "true").load().where(where))
        finally:
            spark.conf.set(setting, before)
        return found if limit is None else found.orderBy("part", "ordinal").limit(limit)
    if limit is None:
        return reader.load()
    # a query alone may fill the scan, and none needs more than that
    return reader.option("limit", str(limit)).load().orderBy("part", "ordinal").limit(limit)


def first_of_queries(records: DataFrame, key: str = "paper_id") -> DataFrame:
    """Records (part, ordinal, key, ...) once each, from the first query that found them; records without a key all stay."""
    from ..operators.merge import first_by_id

    keyed = records.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return first_by_id(keyed, key, ["part", "ordinal"]).unionByName(records.where(F.col(key).isNull() | (F.col(key) == "")))


def to_documents(df: DataFrame) -> DataFrame:
    """Documents of the analysis from records with an ``ordinal``; ids fall back to the ordinal, text is composed."""
    names = F.filter(F.transform("authors", lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
    home = T.home_affiliations(F.flatten(F.transform("authors", lambda a: a["affiliations"])))
    return df.select(
        F.coalesce(F.nullif("paper_id", F.lit("")), F.format_string("doc_%05d", F.col("ordinal"))).alias("doc_id"), F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        F.trim(F.coalesce("abstract", F.lit(""))).alias("abstract"), "year", "venue", "doi", "url", "source", "primary_topic", "primary_subfield", names.alias("authors"),
        home.alias("home_affiliations"), F.size("authors").alias("n_authors"), T.compose(F.col("title"), F.col("abstract")).alias("text"),
    )


def render_filter(years: tuple[int, int], country: str = "np", subfields: Sequence[str] = (), types: str = "", keyword: str = "") -> str:
    """The predicate string that a service takes: what is pushed down to it."""
    parts = [f"authorships.countries:{country}", f"publication_year:{years[0]}-{years[1]}"]
    if subfields:
        parts.append("primary_topic.subfield.id:" + "|".join(subfields))
    if types:
        parts.append(f"type:{types}")
    if keyword:
        parts.append(f"title_and_abstract.search:{keyword}")
    return ",".join(parts)


class Transient(Exception):
    """A response that is worth another try (429 or 5xx), with the seconds to wait if it says so."""

    def __init__(self, wait: float | None = None):
        super().__init__(wait)
        self.wait = wait


def with_retry(call: Callable[[], Mapping], tries: int = 6, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Mapping:
    """Exponential backoff up to a minute; what the service asks for goes first."""
    for n in range(tries):
        try:
            return call()
        except Transient as e:
            if n + 1 == tries:
                raise
            sleep(min(longest, e.wait if e.wait is not None else 2.0**n))
    raise AssertionError


@dataclass
class Query(InputPartition):
    """What a task reads: a query from a place on, up to a record number (none: to its end); ready holds a page that planning has fetched."""

    part: int
    name: str
    text: str
    place: object = None
    end: int | None = None
    ready: Mapping | None = None


class RecordSource(DataSource):
    """``records``: a paged scan with one partition per query, window of years, or range of pages, so that a failure repeats one of them.

    Options: ``windows`` as "2015-2017,2018-2020" or ``queries`` as a JSON list,
    ``client`` as "module:function", ``paging`` (see scan), ``page`` and ``span`` for offsets and
    ``limit``, the most records of a query. The client is function(query, place) ->
    {"results": [json text], "next": place or None, "total": records of the query}.

    With ``pushdown`` (see scan's where), of windows, a predicate on ``year`` leaves those it can touch and narrows what they ask the service for; Spark
    applies it again to each record. ``search = 'word'`` asks the service for the word; the column
    repeats it, and is null in a scan without. Queries are texts of their own, to which nothing is pushed.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "window string, part int, ordinal long, year int, search string, value string"

    def reader(self, schema) -> DataSourceReader:
        return (_NarrowedPages if self.options.get("pushdown") == "true" else _Pages)(dict(self.options))


#: Fields of the four formats that begin with a year.
YEAR_FIELDS = ("publication_year", "year", "publicationDate")


def _year(value: str) -> int | None:
    """The year of a record of any of the formats, if it has one."""
    try:
        record = json.loads(value)
    except ValueError:
        return None
    text = next((str(record[f]) for f in YEAR_FIELDS if isinstance(record, dict) and record.get(f) is not None), "")[:4]
    return int(text) if len(text) == 4 and text.isascii() and text.isdigit() else None


class _Pages(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.first, self.last, self.search = -(2**31), 2**31 - 1, None

    def _queries(self) -> list[tuple[int, str, str]]:
        if "queries" in self.options:
            return [(k, q, q) for k, q in enumerate(json.loads(self.options["queries"]))]
        out = []
        for k, w in enumerate(self.options["windows"].split(",")):
            a, b = map(int, w.split("-"))
            a, b = max(a, self.first), min(b, self.last)
            if a <= b:
                out.append((k, w, render_filter((a, b), keyword=self.search or "")))
        return out

    def _client(self) -> Callable:
        import importlib

        module, _, name = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), name)

    def partitions(self) -> list[Query]:
        start = {"cursor": "*", "token": None, "offset": 1}[self.options.get("paging", "cursor")]
        queries = [Query(k, name, text, start) for k, name, text in self._queries()]
        if start != 1:
            return queries
        client, page, limit = self._client(), int(self.options.get("page", 100)), int(self.options.get("limit", 2**62))
        step, out = page * int(self.options.get("span", 10)), []
        for q in queries:
            q.ready = with_retry(lambda q=q: client(q.text, 1))  # the one page that says how many there are
            total = min(limit, q.ready.get("total") or 0)
            out.append(q)
            for at in range(1 + step, total + 1, step):
                out[-1].end = at
                out.append(Query(q.part, q.name, q.text, at))
        return out  # the last range of a query has no end: what has come meanwhile is read, too

    def read(self, partition: Query | None) -> Iterator[tuple]:
        if partition is None:  # no window is left
            return
        client, paging, page = self._client(), self.options.get("paging", "cursor"), int(self.options.get("page", 100))
        limit = int(self.options.get("limit", 2**62))
        place, ready = partition.place, partition.ready
        n = place - 1 if paging == "offset" else 0
        end = min(limit, partition.end - 1 if partition.end else 2**62)
        while n < end:
            answer, ready = ready or with_retry(lambda p=place: client(partition.text, p)), None
            for value in answer["results"][: end - n]:
                yield partition.name, partition.part, n, _year(value), self.search, value
                n += 1
            if paging == "offset":
                place += page
                done = bool(answer.get("total")) and place > answer["total"]
                n = place - 1
            else:
                place = answer.get("next")
                done = not place
            if done or not answer["results"]:
                return


class _NarrowedPages(_Pages):
    """Pages of a session in which predicates may reach a source."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the years and takes a word to search for; gives back what Spark has to apply itself."""
        for f in filters:
            if "windows" not in self.options:
                yield f
                continue
            if getattr(f, "attribute", None) == ("search",) and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None and self.search in (None, f.value):
                self.search = f.value
                continue
            if getattr(f, "attribute", None) == ("year",):
                low, high = self.first, self.last
                if isinstance(f, EqualTo):
                    low, high = f.value, f.value
                elif isinstance(f, In) and f.value:
                    low, high = min(f.value), max(f.value)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    low = f.value + isinstance(f, GreaterThan)
                elif isinstance(f, LessThan | LessThanOrEqual):
                    high = f.value - isinstance(f, LessThan)
                self.first, self.last = max(self.first, low), min(self.last, high)
            yield f
