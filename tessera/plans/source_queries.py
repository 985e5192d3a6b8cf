"""Queries on record normalising, exports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import harvest as H
from ..streaming.windows import tumbling
from ..session import spread, table
from ._base import query


@query(
    """SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '[ \t\n\r\x0B\x0C]+', ' ', 'g'), ' '), lambda w: w <> ''), ' ') AS abstract FROM documents"""
)
def abstract_reconstruction(spark, folder):
    """Texts rebuilt from their {word: positions} index."""
    words = F.filter(F.split(F.regexp_replace("text", r"[ \t\n\r\x0B\x0C]+", " "), " "), lambda w: w != "")
    index = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "text", H.positions(words).alias("index"))
    return index.select("doc_id", F.when(F.col("text").isNotNull(), H.abstract_from_positions(F.col("index"))).alias("abstract"))


@query(
    r"""SELECT 'p' || page_id AS paper_id, nullif(lower(regexp_replace(trim(url), '(?i)^https?://(dx\.)?doi\.org/', '')), '') AS doi, regexp_extract(html, '<title>([^<]*)', 1) AS title, '' AS abstract,
  CAST(2000 + page_id % 25 AS INTEGER) AS year, 'x' AS author, url, 'semantic_scholar' AS source FROM pages"""
)
def record_normalise(spark, folder):
    """Pages as JSON records of one service, normalised."""
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    raw = table(spark, folder, "pages").select(
        F.to_json(F.struct(
            F.concat(F.lit("p"), "page_id").alias("paperId"), title.alias("title"), F.concat(F.lit(""), (2000 + F.col("page_id") % 25).cast("string"), F.lit("-05-01")).alias("year"), "url",
            F.struct(F.col("url").alias("DOI")).alias("externalIds"), F.array(F.struct(F.lit("x").alias("name"))).alias("authors"),
        )).alias("value")
    )
    return H.papers(raw).select("paper_id", "doi", "title", "abstract", "year", F.get("authors", F.lit(0))["name"].alias("author"), "url", "source")


@query(
    """SELECT time_bucket(INTERVAL 60 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def stream_tumbling(spark, folder):
    """Hourly counts per event type; the same plan runs on a stream with a watermark."""
    out = tumbling(table(spark, folder, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """SELECT item_id, len(regexp_extract_all(text, '[^\\s]+'))::BIGINT AS tokens, sha256('{"top_words":["' || array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')))[1:3], '","') || '"],"titles":["' || item_id || '"]}') AS digest FROM benchmark"""
)
def label_prompts(spark, folder):
    """Digests of canonical label evidence."""
    words = F.slice(F.sort_array(F.array_distinct(T.raw_words(F.col("text")))), 1, 3)
    prompt = T.label_prompt(words, F.array(F.col("item_id").cast("string")))
    return table(spark, folder, "benchmark").select("item_id", T.raw_token_count(F.col("text")).alias("tokens"), T.sha256(prompt).alias("digest"))


@query(
    """WITH g AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTES, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark, folder):
    """Sessions of each user, ended by half an hour without an event; the same plan runs on a stream with a watermark."""
    from ..streaming.records import sessions

    out = sessions(table(spark, folder, "events"), "user_id")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))
