"""Queries on cleaning, filters, windows and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import corpus as C
from ..session import spread, table
from ._base import query

RANKS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
ORDER_WINDOWS = ((1995, 1996), (1997, 1998), (1999, 2000), (2001, 2001))


@query(
    r"""
WITH d AS (SELECT lang, CAST(len(regexp_extract_all(coalesce(text, ''), '\S+')) AS BIGINT) AS v FROM documents),
s AS (SELECT lang, count(*) AS n, list_sort(list(v)) AS l, avg(v) AS m FROM d WHERE v >= 20 GROUP BY lang)
SELECT lang, n, l[1] AS min, l[CAST(floor(n * 0.25) AS INT) + 1] AS p25, l[CAST(floor(n * 0.5) AS INT) + 1] AS p50,
  l[CAST(floor(n * 0.75) AS INT) + 1] AS p75, l[n] AS max, round(m, 6) AS mean FROM s"""
)
def corpus_profile(spark, folder):
    """Token counts of cleaned texts of at least 20 tokens, per language."""
    docs = spread(table(spark, folder, "documents").select("lang", "text")).select("lang", T.raw_token_count(T.collapse(F.col("text"))).alias("v")).where("v >= 20")
    return C.nearest_rank(docs, ["lang"], "v", RANKS).withColumn("mean", F.round("mean", 6))


_HEADERS = "|".join(fixed.SECTION_HEADERS)
_CLEAN = rf"""
WITH a AS (SELECT lang, text AS t0, regexp_replace(replace(coalesce(text, ''), '…', '...'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g') AS t FROM documents),
b AS (SELECT lang, t0, regexp_replace(t, '(?i)(©\s*\d{{4}}.*$|copyright\s+\d{{4}}.*$|all rights reserved.*$|this article is licensed under.*$|creative commons.*$)', ' ', 'g') AS t FROM a),
c AS (SELECT lang, t0, regexp_replace(regexp_replace(regexp_replace(t, '(?i)https?://\S+|www\.\S+', ' ', 'g'), '(?i)\b(?:doi:\s*)?10\.\d{{4,9}}/\S+', ' ', 'g'), '\b[\w.+-]+@[\w-]+\.[\w.]+\b', ' ', 'g') AS t FROM b),
e AS (SELECT lang, t0, regexp_replace(regexp_replace(regexp_replace(t, '(?i)^\s*abstract\b[\s:.–—-]*', ''), '(?i)\b({_HEADERS})\s*:\s*', '', 'g'), '\(\s*[A-Z][A-Za-z]{{1,7}}s?\s*\)', ' ', 'g') AS t FROM c)
SELECT lang, count(*) AS n, CAST(sum(length(t0)) AS BIGINT) AS raw_chars, CAST(sum(length(trim(regexp_replace(t, '\s+', ' ', 'g')))) AS BIGINT) AS clean_chars FROM e GROUP BY lang"""


@query(
    _CLEAN.replace("SELECT lang, text AS t0", "SELECT doc_id, lang, text AS t0").replace("SELECT lang, t0", "SELECT doc_id, lang, t0").split("SELECT lang, count(*)")[0]
    + r"SELECT doc_id, sha256(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS digest FROM e"
)
def clean_text_digests(spark, folder):
    """Digest of every text after cleaning."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.sha2(T.clean(F.col("text"), nfkc=False), 256).alias("digest"))


@query(_CLEAN)
def clean_text_lengths(spark, folder):
    """Characters before and after cleaning, per language."""
    docs = spread(table(spark, folder, "documents").select("lang", "text"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.char_length("text")).cast("long").alias("raw_chars"),
        F.sum(F.char_length(T.clean(F.col("text"), nfkc=False))).cast("long").alias("clean_chars"),
    )


@query()
def clean_text_nfkc(spark, folder):
    """Cleaned text with NFKC of every document; tested against Python."""
    return table(spark, folder, "documents").select("doc_id", T.clean(F.col("text")).alias("text"))


@query(
    """
WITH s AS (SELECT o_orderkey, o_orderpriority, CASE
    WHEN year(o_orderdate) NOT BETWEEN 1996 AND 2000 THEN 0 WHEN coalesce(trim(o_orderpriority), '') = '' THEN 1
    WHEN o_totalprice < 50000 THEN 2 WHEN contains(lower(o_orderpriority), 'low') THEN 3 ELSE 4 END AS position FROM orders),
names(position, step) AS (VALUES (0, 'year_range'), (1, 'require_priority'), (2, 'min_price'), (3, 'exclude_patterns')),
c AS (SELECT position, count(*) AS dropped FROM s GROUP BY position),
x AS (SELECT position, list(left(o_orderpriority, 110) ORDER BY o_orderkey)[1:3] AS examples FROM s GROUP BY position),
j AS (SELECT n.position, step, coalesce(dropped, 0) AS dropped, coalesce(examples, []) AS examples FROM names n LEFT JOIN c USING (position) LEFT JOIN x USING (position))
SELECT position, step, CAST((SELECT count(*) FROM orders) - sum(dropped) OVER (ORDER BY position) AS BIGINT) AS kept, CAST(dropped AS BIGINT) AS dropped,
  array_to_string(examples, '|') AS examples FROM j"""
)
def inclusion_funnel(spark, folder):
    """Four filters in one pass, with kept and dropped counts and examples."""
    orders = table(spark, folder, "orders")
    steps = [
        ("year_range", F.year("o_orderdate").between(1996, 2000)),
        ("require_priority", F.trim(F.coalesce("o_orderpriority", F.lit(""))) != ""),
        ("min_price", F.col("o_totalprice") >= 50000),
        ("exclude_patterns", C.literal_filter(F.col("o_orderpriority"), ["LOW"])),
    ]
    return C.funnel(orders, steps, "o_orderpriority", "o_orderkey").withColumn("examples", F.array_join("examples", "|"))


@query(
    """
WITH w(time_window, a, b) AS (VALUES ('1995-1996', 1995, 1996), ('1997-1998', 1997, 1998), ('1999-2000', 1999, 2000), ('2001-2001', 2001, 2001), ('none', 0, 0)),
o AS (SELECT CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN '1995-1996' WHEN year(o_orderdate) BETWEEN 1997 AND 1998 THEN '1997-1998'
  WHEN year(o_orderdate) BETWEEN 1999 AND 2000 THEN '1999-2000' WHEN year(o_orderdate) = 2001 THEN '2001-2001' ELSE 'none' END AS time_window FROM orders)
SELECT w.time_window, count(o.time_window) AS n FROM w LEFT JOIN o USING (time_window) GROUP BY w.time_window"""
)
def time_windows(spark, folder):
    """Orders per window of years, empty windows included."""
    return C.window_counts(table(spark, folder, "orders").select(F.year("o_orderdate").alias("year")), "year", ORDER_WINDOWS)


@query(
    r"""
WITH d AS (SELECT coalesce(text, '') AS c FROM documents)
SELECT count(*) AS n, CAST(count_if(trim(c) = '') AS BIGINT) AS blank, CAST(count_if(regexp_matches(c, '(?i)^\s*abstract\b')) AS BIGINT) AS leading_abstract,
  CAST(count_if(regexp_matches(c, 'https?://')) AS BIGINT) AS with_url, CAST(count_if(regexp_matches(c, '\b[\w.+-]+@[\w-]+\.[\w.]+\b')) AS BIGINT) AS with_email,
  CAST(count_if(NOT regexp_full_match(c, '(?s)[\x00-\x7F]*')) AS BIGINT) AS non_ascii,
  CAST(count_if(len(regexp_extract_all(c, '\p{L}')) > 0 AND (len(regexp_extract_all(c, '\p{L}')) - len(regexp_extract_all(c, '[A-Za-z]')))::DOUBLE / greatest(1, len(regexp_extract_all(c, '\p{L}'))) > 0.3) AS BIGINT) AS mostly_non_latin,
  count(DISTINCT c) AS distinct_texts FROM d"""
)
def hygiene_counts(spark, folder):
    """Conditional counts of one pass."""
    return C.hygiene(table(spark, folder, "documents"), "text")


@query(
    r"""
WITH k AS (SELECT trim(regexp_replace(regexp_replace(lower(string_split(coalesce(text, ''), chr(10))[1]), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM documents)
SELECT key, count(*) AS n FROM k WHERE key <> '' GROUP BY key HAVING count(*) > 1"""
)
def duplicate_titles(spark, folder):
    """Title keys (first lines) that occur more than once."""
    docs = table(spark, folder, "documents")
    return C.duplicates(docs, T.title_key(F.get(F.split("text", "\n"), F.lit(0))))


@query(
    """
WITH s AS (SELECT l_returnflag, count(*) AS n, list_sort(list(l_quantity)) AS l, avg(l_quantity) AS m FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, n, l[1] AS min, l[CAST(floor(n * 0.25) AS INT) + 1] AS p25, l[CAST(floor(n * 0.5) AS INT) + 1] AS p50,
  l[CAST(floor(n * 0.75) AS INT) + 1] AS p75, l[n] AS max, round(m, 6) AS mean FROM s"""
)
def nearest_rank_percentiles(spark, folder):
    """Order statistics of quantities per return flag."""
    return C.nearest_rank(table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity", RANKS).withColumn("mean", F.round("mean", 6))


@query("SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 8")
def top_k_composition(spark, folder):
    """The eight most sold brands; ties by name."""
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    return C.top_k(table(spark, folder, "lineitem").select("l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")), "p_brand", 8)


@query(
    r"""
WITH d AS (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS t, trim(coalesce(array_to_string(string_split(text, chr(10))[2:], ' '), '')) AS a FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN a WHEN a = '' THEN t WHEN right(t, 1) IN ('.', '?', '!') THEN t || ' ' || a ELSE t || '. ' || a END AS text FROM d"""
)
def composed_text(spark, folder):
    """Title (first line) and abstract (the rest) as one text."""
    docs = table(spark, folder, "documents").withColumn("lines", F.split("text", "\n"))
    rest = F.array_join(F.slice("lines", F.lit(2), F.size("lines")), " ")
    return docs.select("doc_id", T.compose(F.get("lines", F.lit(0)), rest).alias("text"))


_TERMS = "|".join(fixed.METHOD_TERMS)


@query(
    rf"""
WITH d AS (SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)', 1), '') AS t, html FROM pages)
SELECT page_id, regexp_matches(t || ' ' || html, '(?i)\b(?:{_TERMS})\b|\b(?:{"|".join(fixed.METHOD_PREFIXES)})\b') OR regexp_matches(t, '(^|[^A-Za-z])(AI|ML)([^A-Za-z]|$)') AS relevant FROM d"""
)
def method_relevance(spark, folder):
    """Whether a page's title and body use method vocabulary."""
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return table(spark, folder, "pages").select("page_id", T.is_relevant(title, F.col("html")).alias("relevant"))


@query("SELECT doc_id, sha256(lang || '|' || text) AS digest FROM documents")
def evidence_hashes(spark, folder):
    """SHA-256 of each document's evidence."""
    return table(spark, folder, "documents").select("doc_id", T.sha256(F.concat_ws("|", "lang", "text")).alias("digest"))


@query(
    r"""
WITH k AS (SELECT doc_id, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents),
b AS (SELECT DISTINCT trim(regexp_replace(lower(regexp_extract(html, '<h1>([^<]*)', 1)), '[^a-z0-9]+', ' ', 'g')) AS key FROM pages)
SELECT doc_id FROM k WHERE key = '' OR key NOT IN (SELECT key FROM b)"""
)
def already_seen_antijoin(spark, folder):
    """Documents whose title key is not among those of harvested pages."""
    from ..operators.merge import unseen

    squeezed = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    docs = table(spark, folder, "documents").select("doc_id", squeezed(F.get(F.split("text", "\n"), F.lit(0))).alias("title_key"), F.lit(None).cast("string").alias("doi_key"))
    seen = table(spark, folder, "pages").select(F.lit("title").alias("key_type"), squeezed(F.regexp_extract("html", "<h1>([^<]*)", 1)).alias("key"))
    return unseen(docs, seen).select("doc_id")


def _report_documents(spark, folder):
    """Documents as corpus records: title and abstract from the text, venues, DOIs and affiliations by language."""
    lang = F.col("lang")
    return table(spark, folder, "documents").select(
        "doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("abstract"), F.when(lang == "fr", "arXiv (preprint)").when(lang == "de", " ").otherwise(F.col("source")).alias("venue"),
        F.when(lang == "en", F.concat(F.lit("10.1/"), "doc_id")).alias("doi"), F.lit(1).alias("n_authors"), F.when(lang == "es", F.array("source")).otherwise(F.array().cast("array<string>")).alias("home_affiliations"),
    )


@query(
    rf"""
WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, coalesce(text, '') AS a, trim(coalesce(CASE lang WHEN 'fr' THEN 'arXiv (preprint)' WHEN 'de' THEN ' ' ELSE source END, '')) AS v, lang FROM documents),
p AS (SELECT *, regexp_matches(v, '{fixed.PREPRINT_VENUE}') AS pre FROM d),
k AS (SELECT trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM d)
SELECT count(*) AS n, CAST(count_if(v <> '' AND NOT pre) AS BIGINT) AS published, CAST(count_if(pre) AS BIGINT) AS preprint, CAST(count_if(v = '') AS BIGINT) AS no_venue, count(DISTINCT nullif(v, '')) AS distinct_venues,
  CAST(count_if(lang = 'en') AS BIGINT) AS with_doi, CAST(count_if(v <> '') AS BIGINT) AS with_venue, CAST(count_if(lang = 'es') AS BIGINT) AS with_affiliation,
  CAST(count_if(regexp_matches(a, '{fixed.REPORT_LEADING}')) AS BIGINT) AS leading_abstract, CAST(count_if(regexp_matches(a, '{fixed.REPORT_COPYRIGHT}')) AS BIGINT) AS copyright_tail,
  CAST(count_if(NOT regexp_full_match(a, '(?s)[\x00-\x7F]*')) AS BIGINT) AS non_ascii,
  CAST(count_if(len(regexp_extract_all(a, '\p{{L}}')) > 0 AND (len(regexp_extract_all(a, '\p{{L}}')) - len(regexp_extract_all(a, '[A-Za-z]')))::DOUBLE / greatest(1, len(regexp_extract_all(a, '\p{{L}}'))) > 0.3) AS BIGINT) AS mostly_non_latin,
  CAST(count_if(trim(coalesce(title, '')) = '') AS BIGINT) AS empty_titles, CAST(count_if(trim(a) = '') AS BIGINT) AS empty_abstracts,
  (SELECT count(*) FROM (SELECT key FROM k GROUP BY key HAVING count(*) > 1)) AS repeated_titles, (SELECT count(*) FROM (SELECT doc_id FROM d GROUP BY doc_id HAVING count(*) > 1)) AS repeated_ids,
  round(100 * count_if(v <> '' AND NOT pre) / count(*), 1) AS published_share FROM p"""
)
def corpus_report(spark, folder):
    """Venues, coverage, hygiene and integrity of the corpus."""
    return C.report(_report_documents(spark, folder))


@query(
    rf"""
WITH d AS (SELECT coalesce(regexp_extract(html, '<title>([^<]*)', 1), '') AS t, html FROM pages),
r AS (SELECT regexp_matches(t || ' ' || html, '(?i)\b(?:{_TERMS})\b|\b(?:{"|".join(fixed.METHOD_PREFIXES)})\b') OR regexp_matches(t, '(^|[^A-Za-z])(AI|ML)([^A-Za-z]|$)') AS ok FROM d)
SELECT CAST(count_if(ok) AS BIGINT) AS kept, CAST(count_if(NOT ok) AS BIGINT) AS dropped FROM r"""
)
def relevance_counts(spark, folder):
    """Pages that the relevance filter keeps and drops."""
    _, counts = C.split_counted(table(spark, folder, "pages"), T.is_relevant(F.regexp_extract("html", "<title>([^<]*)", 1), F.col("html")))
    return counts
