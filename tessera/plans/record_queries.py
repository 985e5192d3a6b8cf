"""Queries on shares and trends, ratings, tests, merging and label records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import merge as M
from ..operators import ratings as R
from ..operators import statistics as S
from ..operators import temporal as P
from ..session import table
from ._base import query

_YEARS = "CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN 0 WHEN year(o_orderdate) BETWEEN 1997 AND 1998 THEN 1 WHEN year(o_orderdate) BETWEEN 1999 AND 2000 THEN 2 ELSE 3 END"
_MASS = f"""members AS (SELECT {_YEARS} AS win, o_orderkey AS doc_id FROM orders),
parts AS (SELECT l_orderkey AS doc_id, p_type AS topic, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
mass AS (SELECT m.win, doc_id, topic, v / sum(v) OVER (PARTITION BY doc_id) AS weight FROM parts JOIN members m USING (doc_id)),
n AS (SELECT win, count(*) AS n FROM members GROUP BY win),
act AS (SELECT win, count(DISTINCT doc_id) AS m FROM mass WHERE weight > 0 GROUP BY win),
s AS (SELECT win, topic, sum(weight) AS s FROM mass GROUP BY ALL), grid AS (SELECT win, topic, n, coalesce(s, 0) AS s, m FROM n CROSS JOIN (SELECT DISTINCT topic FROM mass) LEFT JOIN s USING (win, topic) LEFT JOIN act USING (win)),
shares AS (SELECT win, topic, (s / m) / sum(s / m) OVER (PARTITION BY win) AS share, n FROM grid)"""


def _mass(spark, folder):
    """Revenue shares of part types per order as topic weights, with the window of each order."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("y"))
    window = F.when(F.col("y").between(1995, 1996), 0).when(F.col("y").between(1997, 1998), 1).when(F.col("y").between(1999, 2000), 2).otherwise(3)
    members = orders.select(window.alias("window"), "doc_id")
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_partkey", "l_extendedprice")
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("topic"))
    v = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("doc_id", "topic").agg(F.sum("l_extendedprice").alias("v"))
    rows = v.join(members, "doc_id").withColumn("weight", F.col("v") / F.sum("v").over(Window.partitionBy("doc_id")))
    return rows.select("window", "doc_id", "topic", "weight"), members


@query(f'WITH {_MASS} SELECT win AS "window", topic, round(share, 6) AS share, n FROM shares')
def window_shares(spark, folder):
    """Mean topic share per window over documents with weight; n counts all."""
    return P.window_shares(*_mass(spark, folder)).withColumn("share", F.round("share", 6))


@query(f'WITH {_MASS} SELECT win AS "window", topic, round(s / n, 6) AS share, n FROM grid')
def all_docs_shares(spark, folder):
    """Mean topic share per window over all documents."""
    return P.window_shares(*_mass(spark, folder), mass="all").withColumn("share", F.round("share", 6))


@query(
    f"""WITH {_MASS}, ok AS (SELECT * FROM shares WHERE n >= 30), f AS (SELECT topic, count(*) AS windows, regr_slope(share, win::DOUBLE) AS slope, arg_min(share, win) AS a, arg_max(share, win) AS b FROM ok GROUP BY topic)
SELECT topic, windows, round(slope, 6) AS slope, round(a, 6) AS first_share, round(b, 6) AS last_share, round(b - a, 6) AS change,
  CASE WHEN abs(b - a) < 0.01 THEN 'stable' WHEN b > a THEN 'rising' ELSE 'falling' END AS trend FROM f"""
)
def topic_trends(spark, folder):
    """Slope, change and direction of each topic."""
    out = P.trends(P.window_shares(*_mass(spark, folder)), "window")
    return out.select("topic", "windows", *(F.round(c, 6).alias(c) for c in ("slope", "first_share", "last_share", "change")), "trend")


_HASH = "CAST('0x' || left(md5({}), 8) AS BIGINT)"


@query(
    f"""WITH {_MASS}, active AS (SELECT win, topic, weight, doc_id, {_HASH.format("CAST(doc_id AS VARCHAR)")} % {P.BLOCKS} AS block FROM mass WHERE win IN (0, 2) AND weight > 0),
blocked AS (SELECT win, block, count(DISTINCT doc_id) AS n FROM active GROUP BY ALL), bsums AS (SELECT win, block, topic, sum(weight) AS s FROM active GROUP BY ALL),
hu AS (SELECT block, draw, ({_HASH.format("'7:' || block || ':' || draw")} + 0.5) / 4294967296.0::DOUBLE AS u FROM (SELECT unnest(range({P.BLOCKS})) AS block), (SELECT unnest(range(2000)) AS draw)),
k AS (SELECT block, draw, CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.9196986 THEN 2 WHEN u < 0.98101184 THEN 3 WHEN u < 0.99634015 THEN 4 ELSE 5 END AS k FROM hu),
taken AS (SELECT win, draw, sum(k * n) AS n FROM blocked JOIN k USING (block) GROUP BY ALL HAVING sum(k * n) > 0), found AS (SELECT win, draw, topic, sum(k * s) AS s FROM bsums JOIN k USING (block) GROUP BY ALL),
means AS (SELECT t.win, t.draw, topic, coalesce(s, 0) / t.n AS m FROM (SELECT * FROM taken CROSS JOIN (SELECT DISTINCT topic FROM active)) t LEFT JOIN found USING (win, draw, topic)),
diffs AS (SELECT a.topic, b.m - a.m AS d FROM means a JOIN means b ON a.topic = b.topic AND a.draw = b.draw AND a.win = 0 AND b.win = 2)
SELECT topic, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM diffs GROUP BY topic"""
)
def share_change_interval(spark, folder):
    """Bootstrap interval of the change in mean share."""
    rows, _ = _mass(spark, folder)
    out = P.bootstrap_change(rows.withColumn("window", F.col("window").cast("string")), "0", "2")
    return out.select("topic", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_R = "ratings AS (SELECT user_id AS item, event_type AS rater, 1 + CAST(floor(value) AS BIGINT) % 5 AS rating FROM events WHERE value IS NOT NULL)"
_V = """c AS (SELECT item, rating, count(*) AS c FROM ratings GROUP BY ALL), p AS (SELECT *, sum(c) OVER (PARTITION BY item) AS m FROM c),
x AS (SELECT a.rating, b.rating AS other, a.m, a.c * (b.c - (a.rating = b.rating)::INT) AS n FROM p a JOIN p b USING (item) WHERE a.m >= 2)"""


def ratings(spark, folder):
    """Events as ratings: user as item, event type as rater, value as a score of 1 to 5."""
    score = (1 + F.floor("value") % 5).cast("long")
    return table(spark, folder, "events").where("value is not null").select(F.col("user_id").alias("item"), F.col("event_type").alias("rater"), score.alias("rating"))


@query(
    f"""WITH {_R}, {_V}, o AS (SELECT rating, other, sum(n / (m - 1)) AS o FROM x GROUP BY ALL), g AS (SELECT rating, sum(o) AS n FROM o GROUP BY rating),
u AS (SELECT rating, n, sum(n) OVER (ORDER BY rating) AS cum FROM g),
d AS (SELECT a.rating, b.rating AS other, a.n * b.n AS e, pow(greatest(a.cum, b.cum) - least(a.cum - a.n, b.cum - b.n) - (a.n + b.n) / 2, 2) AS delta FROM u a, u b WHERE a.rating <> b.rating)
SELECT round(1 - ((SELECT sum(n) FROM g) - 1) * sum(coalesce(o, 0) * delta) / sum(e * delta), 6) AS alpha FROM d LEFT JOIN o USING (rating, other)"""
)
def rating_alpha(spark, folder):
    """Ordinal Krippendorff's alpha."""
    return R.krippendorff_alpha(ratings(spark, folder)).select(F.round("alpha", 6).alias("alpha"))


@query(f"WITH {_R}, {_V} SELECT round(sum(CASE WHEN abs(rating - other) <= 1 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS agreement FROM x")
def rating_agreement(spark, folder):
    """Share of rater pairs within one point."""
    return R.percent_agreement(ratings(spark, folder), 1).select(F.round("agreement", 6).alias("agreement"))


@query(
    f"""WITH {_R} SELECT rater, count(*) AS n, round(avg(rating), 6) AS mean, median(rating)::DOUBLE AS median, round(stddev_samp(rating), 6) AS sd, min(rating) AS min, max(rating) AS max,
  round(avg((rating >= 4)::INT), 6) AS share_high FROM ratings GROUP BY rater"""
)
def rating_summary(spark, folder):
    """Summary of ratings per rater."""
    out = R.rating_summary(ratings(spark, folder), "rater")
    return out.select("rater", "n", F.round("mean", 6).alias("mean"), "median", F.round("sd", 6).alias("sd"), "min", "max", F.round("share_high", 6).alias("share_high"))


@query(f"WITH {_R} SELECT item, max(rating) - min(rating) AS spread FROM ratings GROUP BY item ORDER BY spread DESC, item LIMIT 4")
def rating_spread(spark, folder):
    """The four items on which raters differ most."""
    return R.spread(ratings(spark, folder))


@query(
    """SELECT coalesce(lang, 'all') AS lang, coalesce(v, 'all') AS verdict, count(*) AS n, CAST(grouping(lang) * 2 + grouping(v) AS INTEGER) AS level FROM
(SELECT lang, CASE WHEN quality = 0 THEN 'reject' WHEN toxic = 1 THEN 'revise' ELSE 'accept' END AS v FROM labels JOIN documents USING (doc_id)) GROUP BY ROLLUP (lang, v)"""
)
def verdict_rollup(spark, folder):
    """Verdicts by language with totals."""
    verdict = F.when(F.col("quality") == 0, "reject").when(F.col("toxic") == 1, "revise").otherwise("accept")
    labels = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").select("lang", verdict.alias("verdict"))
    return R.verdicts(labels, "lang", "verdict")


@query(
    """WITH m AS (SELECT event_type AS model, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n FROM events GROUP BY event_type),
o AS (SELECT event_type AS model, avg((value > mean + 2 * sd)::INT) AS far FROM events JOIN m ON model = event_type WHERE event_type <> 'view' GROUP BY event_type),
l AS (SELECT model, 'mean' AS metric, round(mean, 6) AS v FROM m UNION ALL SELECT model, 'n', n::DOUBLE FROM m UNION ALL SELECT model, 'sd', round(sd, 6) FROM m UNION ALL SELECT model, 'outliers', round(far, 6) FROM o
  UNION ALL SELECT 'view', 'outliers', 0)
SELECT metric, max(CASE WHEN model = 'click' THEN v END) AS click, max(CASE WHEN model = 'purchase' THEN v END) AS purchase, max(CASE WHEN model = 'view' THEN v END) AS view,
  first(model ORDER BY CASE WHEN metric IN ('sd', 'outliers') THEN v ELSE -v END, model) AS winner FROM l WHERE model IN ('click', 'purchase', 'view') GROUP BY metric"""
)
def model_comparison_pivot(spark, folder):
    """Metrics by model with the winner of each by its direction; a model without an outlier share has 0."""
    events = table(spark, folder, "events").select(F.col("event_type").alias("model"), "value")
    m = events.groupBy("model").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").cast("double").alias("n"))
    far = events.where("model <> 'view'").join(F.broadcast(m), "model").groupBy("model").agg(F.avg((F.col("value") > F.col("mean") + 2 * F.col("sd")).cast("int")).alias("far"))
    long = m.select("model", F.explode(F.create_map(F.lit("mean"), F.round("mean", 6), F.lit("n"), F.col("n"), F.lit("sd"), F.round("sd", 6))).alias("metric", "value"))
    long = long.unionByName(far.select("model", F.lit("outliers").alias("metric"), F.round("far", 6).alias("value")))
    return S.comparison(long, ["click", "purchase", "view"], ("sd", "outliers"), {"outliers": 0.0})


_RUNS = "runs AS (SELECT CAST(user_id % 3 AS BIGINT) AS cell, event_type AS algorithm, floor(value) AS value FROM events WHERE value IS NOT NULL)"


def runs(spark, folder):
    """Events as runs of algorithms in three cells."""
    return table(spark, folder, "events").where("value is not null").select((F.col("user_id") % 3).alias("cell"), F.col("event_type").alias("algorithm"), F.floor("value").cast("double").alias("value"))


_U = f"""{_RUNS}, c AS (SELECT cell, algorithm AS g, count(*) AS n FROM runs GROUP BY ALL), pr AS (SELECT x.cell, x.g AS a, y.g AS b, x.n AS n_a, y.n AS n_b FROM c x JOIN c y ON x.cell = y.cell AND x.g < y.g),
v AS (SELECT pr.*, r.value, count(*) AS c, count_if(r.algorithm = a) AS ca FROM pr JOIN runs r ON r.cell = pr.cell AND r.algorithm IN (a, b) GROUP BY ALL),
k AS (SELECT *, sum(c) OVER (PARTITION BY cell, a, b ORDER BY value) - (c - 1) / 2 AS rank FROM v),
u AS (SELECT cell, a, b, n_a, n_b, sum(ca * rank) - any_value(n_a * (n_a + 1) / 2) AS u, sum(c * c * c - c)::DOUBLE AS ties FROM k GROUP BY cell, a, b, n_a, n_b),
z AS (SELECT *, greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(n_a * n_b / 12 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1)))) AS z FROM u)"""


#: erf(x) as its series of positive terms, exp(-x^2) sum of 2^n x^(2n+1) / (2n+1)!!.
_ERF = """CASE WHEN x = 0 THEN 0 ELSE 2 / sqrt(pi()) * list_sum(list_transform(range(0, 400),
  lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln(x) + lgamma(n + 1) - lgamma(2 * n + 2) - x * x))) END"""


@query(f"WITH {_U}, x AS (SELECT *, z / sqrt(2) AS x FROM z) SELECT cell, a, b, n_a, n_b, u::DOUBLE AS u, round(z, 6) AS z, round(1 - {_ERF}, 6) AS p FROM x")
def mannwhitney_u(spark, folder):
    """U, z and the two-sided p of every pair of algorithms in each cell."""
    return S.mann_whitney(runs(spark, folder), ["cell"]).select("cell", "a", "b", "n_a", "n_b", "u", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query(
    """WITH p AS (SELECT user_id, (1 + CAST(floor(avg(value) * 1000) AS BIGINT) % 997) / 20000.0::DOUBLE AS p FROM events GROUP BY user_id),
r AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, user_id) + 1) * p) AS s FROM p)
SELECT user_id, round(p, 6) AS p, round(max(s) OVER (ORDER BY p, user_id ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r"""
)
def holm_adjust(spark, folder):
    """Holm's adjustment of a family of p-values."""
    # a mean right at a thousandth hangs on the order of the sum: it runs over a user's events in their order, whatever the partitions
    upto = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = table(spark, folder, "events").select("user_id", "event_id", "value").withColumns({"n": F.count("value").over(upto), "total": F.sum("value").over(upto), "at": F.row_number().over(upto)})
    means = summed.groupBy("user_id").agg(F.max_by(F.col("total") / F.nullif(F.col("n"), F.lit(0)), "at").alias("mean"))
    p = means.select("user_id", ((1 + F.floor(F.col("mean") * 1000) % 997) / F.lit(20000.0)).alias("p"))
    return S.holm(p, ["user_id"]).select("user_id", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


@query(
    """WITH b AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events) SELECT user_id, event_id, value, best FROM b"""
)
def running_best(spark, folder):
    """Best value so far of each user's events."""
    return S.running_best(table(spark, folder, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").drop("ts")


@query(
    """WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value FROM events),
b AS (SELECT user_id, step, max(value) OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS best FROM o), g AS (SELECT unnest(range(5, 51, 5)) AS step),
a AS (SELECT u.user_id, g.step, (SELECT arg_max(best, b.step) FROM b WHERE b.user_id = u.user_id AND b.step <= g.step) AS best FROM (SELECT DISTINCT user_id FROM o) u, g)
SELECT step, round(quantile_cont(best, 0.25), 6) AS q1, round(quantile_cont(best, 0.5), 6) AS median, round(quantile_cont(best, 0.75), 6) AS q3 FROM a GROUP BY step"""
)
def asof_convergence_grid(spark, folder):
    """Best-so-far curves resampled on a common grid, with their band."""
    events = table(spark, folder, "events")
    steps = events.withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    best = S.running_best(steps.select("user_id", "step", "value"), ["user_id"], ["step"], "value").select("user_id", "step", "best")
    grid = spark.range(5, 51, 5).withColumnRenamed("id", "step")
    out = S.band(S.on_grid(best, grid, ["user_id"], "step", "best"), "step", "best")
    return out.select("step", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3")))


@query(
    """WITH r AS (SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, event_type || repeat('x', CAST(k % 130 AS INT)) AS label, CASE WHEN k IS NULL THEN 'shape' WHEN length(event_type) + k % 130 > 120 THEN 'label' WHEN k % 4 = 3 THEN 'coherence'
  WHEN k % 10 NOT IN (1, 2, 3, 5, 7) THEN 'supporting_doc_ids' END AS error FROM r"""
)
def json_label_validation(spark, folder):
    """JSON label responses, half of them in code fences, checked field by field against allowed ids."""
    k = F.from_json("props", "k bigint")["k"]
    coherence = F.get(F.array(*map(F.lit, ("high", "medium", "low", "odd"))), (k % 4).cast("int"))
    label = F.concat(F.col("event_type"), F.repeat(F.lit("x"), (k % 130).cast("int")))
    body = F.to_json(F.struct(label.alias("label"), F.lit("because").alias("rationale"), coherence.alias("coherence"), F.array((k % 10).cast("string")).alias("supporting_doc_ids")))
    response = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    got = T.parse_label(response, F.array(*map(F.lit, ("1", "2", "3", "5", "7"))))
    return table(spark, folder, "events").select("event_id", got["label"].alias("label"), got["error"].alias("error"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, count(*) AS reviews FROM events GROUP BY user_id")
def review_latest_state(spark, folder):
    """Latest state of each item from its event history."""
    return R.current_state(table(spark, folder, "events"), "user_id", ["event_id"], "event_type")


def _records(spark, folder):
    """Documents and pages as harvested records of two batches."""
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("record_id"), F.lit(0).alias("batch"), F.col("doc_id").alias("ordinal"), F.lit(None).cast("string").alias("doi_key"),
        F.trim(F.regexp_replace(F.lower(F.get(F.split("text", "\n"), F.lit(0))), r"[^a-z0-9]+", " ")).alias("title_key"), F.lit("").alias("abstract"), F.col("lang").alias("venue"),
        F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("url"), F.col("source"),
    )
    key = F.regexp_replace("url", r"^https?://(www\.|blog\.|m\.)?|[?#].*$", "")
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("record_id"), F.lit(1).alias("batch"), F.col("page_id").alias("ordinal"), key.alias("doi_key"),
        F.trim(F.regexp_replace(F.lower(F.regexp_extract("html", "<h1>([^<]*)", 1)), r"[^a-z0-9]+", " ")).alias("title_key"), F.md5(F.col("html").cast("binary")).alias("abstract"),
        F.lit(None).cast("string").alias("venue"), key.alias("doi"), F.col("url"), F.lit("web").alias("source"),
    )
    return docs.unionByName(pages)


_REC = r"""rec AS (SELECT 'd' || doc_id AS record_id, 0 AS batch, doc_id AS ordinal, NULL::VARCHAR AS doi_key, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g')) AS title_key, '' AS abstract, lang AS venue, NULL::VARCHAR AS url, source FROM documents
UNION ALL SELECT 'p' || page_id, 1, page_id, regexp_replace(url, '^https?://(www\.|blog\.|m\.)?|[?#].*$', '', 'g'), trim(regexp_replace(lower(regexp_extract(html, '<h1>([^<]*)', 1)), '[^a-z0-9]+', ' ', 'g')), md5(html), NULL, url, 'web' FROM pages)"""


def _pass_sql(key: str) -> str:
    gap = lambda c: f"arg_min({c}, batch * 1000000000 + ordinal) FILTER (WHERE coalesce(trim({c}), '') <> '')"
    return f"""WITH {_REC}, s AS (SELECT {key}, source, min(batch * 1000000000 + ordinal) AS first_at FROM rec WHERE coalesce({key}, '') <> '' GROUP BY ALL), l AS (SELECT {key}, array_to_string(list(source ORDER BY first_at), ',') AS sources FROM s GROUP BY {key}),
m AS (SELECT {key}, arg_min(record_id, batch * 1000000000 + ordinal) AS record_id, {gap("abstract")} AS abstract, {gap("venue")} AS venue, {gap("url")} AS url FROM rec WHERE coalesce({key}, '') <> '' GROUP BY {key})
SELECT record_id, coalesce(abstract, '') AS abstract, coalesce(venue, '') AS venue, coalesce(url, '') AS url, sources FROM m JOIN l USING ({key})
UNION ALL SELECT record_id, abstract, coalesce(venue, ''), coalesce(url, ''), source FROM rec WHERE coalesce({key}, '') = ''"""


def _merged(df):
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return df.select("record_id", blank("abstract"), blank("venue"), blank("url"), F.array_join("sources", ",").alias("sources"))


@query(_pass_sql("doi_key"))
def merge_doi_pass(spark, folder):
    """One record per DOI key, gaps filled in order."""
    return _merged(M.merge_pass(_records(spark, folder), "doi_key", ["abstract", "venue", "url"], ["batch", "ordinal"]))


@query(_pass_sql("title_key"))
def merge_title_pass(spark, folder):
    """One record per title key, gaps filled in order."""
    return _merged(M.merge_pass(_records(spark, folder), "title_key", ["abstract", "venue", "url"], ["batch", "ordinal"]))


def _exact_sql() -> str:
    """A recursion over records in order that carries the keys of founders; then joins and aggregates."""
    gap = lambda c: f"arg_min(r.{c}, n) FILTER (WHERE coalesce(trim(r.{c}), '') <> '')"
    return f"""WITH RECURSIVE {_REC}, o AS (SELECT *, doi_key AS doi, nullif(doi_key, '') AS d, nullif(title_key, '') AS t, row_number() OVER (ORDER BY batch, ordinal) AS n FROM rec),
f AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS ds, CAST([] AS VARCHAR[]) AS ts, false AS founder
  UNION ALL SELECT o.n, CASE WHEN x OR d IS NULL THEN ds ELSE list_append(ds, d) END, CASE WHEN x OR t IS NULL THEN ts ELSE list_append(ts, t) END, NOT x
  FROM (SELECT o.n, d, t, ds, ts, coalesce(list_contains(ds, d), false) OR coalesce(list_contains(ts, t), false) AS x FROM f JOIN o ON o.n = f.n + 1) o),
s AS (SELECT o.*, founder FROM o JOIN f USING (n)),
h AS (SELECT s.*, CASE WHEN s.founder THEN s.n ELSE coalesce(a.n, b.n) END AS home FROM s LEFT JOIN s a ON a.founder AND a.d = s.d AND a.n < s.n LEFT JOIN s b ON b.founder AND b.t = s.t AND b.n < s.n),
src AS (SELECT home, source, min(n) AS pos FROM h GROUP BY ALL), l AS (SELECT home, array_to_string(list(source ORDER BY pos), ',') AS sources FROM src GROUP BY home),
m AS (SELECT home, {gap("abstract")} AS abstract, {gap("venue")} AS venue, {gap("doi")} AS doi, {gap("url")} AS url, arg_min(CASE WHEN batch = 1 THEN url END, n) FILTER (WHERE batch = 1) AS author FROM h r GROUP BY home)
SELECT s.record_id, coalesce(m.abstract, '') AS abstract, coalesce(m.venue, '') AS venue, coalesce(m.doi, '') AS doi, coalesce(m.url, '') AS url, coalesce(m.author, '') AS authors, l.sources
FROM m JOIN s ON s.n = m.home JOIN l USING (home)"""


@query(_exact_sql())
def merge_exact(spark, folder):
    """The ordered merge of documents and pages; pages have an author each, who fills documents without."""
    records = _records(spark, folder).withColumn("authors", F.when(F.col("batch") == 1, F.array("url")).otherwise(F.array().cast("array<string>")))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    out = M.merge_exact(records)
    return out.select("record_id", *(blank(c) for c in ("abstract", "venue", "doi", "url")), F.array_join("authors", ",").alias("authors"), F.array_join("sources", ",").alias("sources"))


@query(_exact_sql())
def merge_incremental(spark, folder):
    """The same merge in two batches: pages are added to a state that holds the documents."""
    from ..operators.merge_state import MergeState
    from ..session import shared_path

    records = _records(spark, folder).withColumn("authors", F.when(F.col("batch") == 1, F.array("url")).otherwise(F.array().cast("array<string>")))
    state = MergeState(spark, shared_path(spark, "merge"))
    for number in (0, 1):
        state.add(records.where(F.col("batch") == number), number)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return state.merged().select("record_id", *(blank(c) for c in ("abstract", "venue", "doi", "url")), F.array_join("authors", ",").alias("authors"), F.array_join("sources", ",").alias("sources"))


@query(
    """WITH t AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY ALL) SELECT user_id, event_type, n, first_event FROM t"""
)
def first_seen_dedupe(spark, folder):
    """First event of each user and type, with the number of repeats."""
    events = table(spark, folder, "events").select(F.concat_ws("|", "user_id", "event_type").alias("key"), "user_id", "event_type", "event_id")
    first = M.first_by_id(events, "key", ["event_id"]).withColumnRenamed("event_id", "first_event")
    return first.join(events.groupBy("key").agg(F.count("*").alias("n")), "key").select("user_id", "event_type", "n", "first_event")


@query("SELECT item_id, sha256(text) AS digest, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS tokens FROM benchmark")
def evidence_manifest(spark, folder):
    """Digest and size of each pinned input."""
    return table(spark, folder, "benchmark").select("item_id", T.sha256(F.col("text")).alias("digest"), T.raw_token_count(F.col("text")).alias("tokens"))


@query()
def file_manifest(spark, folder):
    """Name, size and digest of the files of the pinned inputs, as they lie in the store; tested against their bytes."""
    from ..sources import files

    names = ("benchmark", "labels", "customer", "supplier", "part")
    found = None
    for name in names:
        part = files.manifest(spark, f"{folder}/{name}.parquet").select(F.lit(name).alias("input"), F.substring_index("path", "/", -1).alias("file"), "bytes", "sha256")
        found = part if found is None else found.unionByName(part)
    return found


_HOME = (*T.fixed.HOME_KEYWORDS, *T.fixed.HOME_CITIES)


def _affiliations():
    """Affiliations of a customer by its number: a home keyword, a generic name with or without a context word, elsewhere, or none; every fifth has a country code."""
    pick = lambda words, step: F.get(F.array(*map(F.lit, words)), ((F.col("c_custkey") * step) % len(words)).cast("int"))
    kind = F.col("c_custkey") % 5
    texts = (
        F.when(kind == 0, F.array(F.concat(F.lit("Dept, "), F.initcap(pick(_HOME, 7))), F.col("c_name")))
        .when(kind == 1, F.array(F.upper(pick(T.fixed.HOME_GENERIC, 3)), F.concat(F.col("c_name"), F.lit(" "), pick(T.fixed.HOME_CONTEXT, 5))))
        .when(kind == 2, F.array(pick(T.fixed.HOME_GENERIC, 3), F.col("c_name"))).when(kind == 3, F.array("c_name")).otherwise(F.array().cast("array<string>"))
    )
    codes = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(T.fixed.HOME_CODE.lower()))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("XX"))).otherwise(F.array().cast("array<string>"))
    return texts, codes


def _affiliation_sql() -> str:
    listed = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
    pick = lambda words, step: f"{listed(words)}[CAST((c_custkey * {step}) % {len(words)} AS INTEGER) + 1]"
    has = lambda text, words: f"len(list_filter({listed(words)}, lambda w: contains({text}, w))) > 0"
    cap = "array_to_string(list_transform(string_split({0}, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
    return f"""a AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 5 WHEN 0 THEN ['Dept, ' || {cap.format(pick(_HOME, 7))}, c_name] WHEN 1 THEN [upper({pick(T.fixed.HOME_GENERIC, 3)}), c_name || ' ' || {pick(T.fixed.HOME_CONTEXT, 5)}]
  WHEN 2 THEN [{pick(T.fixed.HOME_GENERIC, 3)}, c_name] WHEN 3 THEN [c_name] ELSE [] END AS t, CASE c_custkey % 3 WHEN 0 THEN ['{T.fixed.HOME_CODE}'] WHEN 1 THEN ['XX'] ELSE [] END AS codes FROM customer),
b AS (SELECT *, lower(array_to_string(t, ' ')) AS j FROM a),
c AS (SELECT *, len(list_filter(t, lambda x: {has("lower(x)", _HOME)})) > 0 OR ({has("j", T.fixed.HOME_GENERIC)} AND {has("j", T.fixed.HOME_CONTEXT)}) AS by_text FROM b),
d AS (SELECT *, by_text OR (len(t) = 0 AND list_contains(codes, '{T.fixed.HOME_CODE}')) AS home, len(t) > 0 OR len(codes) > 0 AS known, {has("j", [w for w in T.fixed.HOME_KEYWORDS if w != T.fixed.HOME_CONTEXT[0]])} AS mentioned FROM c)"""


@query(f"WITH {_affiliation_sql()} SELECT c_custkey, by_text, home, mentioned FROM d")
def author_affiliations(spark, folder):
    """Customers as authors: at home by affiliation text, or by country code without any; and whether the text names an institution."""
    texts, codes = _affiliations()
    author = F.struct(F.col("c_name").alias("name"), texts.alias("affiliations"), codes.alias("country_codes"))
    return table(spark, folder, "customer").select(
        "c_custkey", T.is_home(texts).alias("by_text"), T.author_is_home(author).alias("home"), T.mentions_home_institution(F.array_join(texts, " ")).alias("mentioned")
    )


@query(f"WITH {_affiliation_sql()} SELECT c_nationkey, c_custkey // 3 AS record, coalesce(bool_or(home), false) AS home, coalesce(bool_or(known AND NOT home), false) AS abroad FROM d GROUP BY ALL")
def record_affiliations(spark, folder):
    """Records of up to three authors of a nation: any at home, any known to be abroad."""
    texts, codes = _affiliations()
    authors = table(spark, folder, "customer").select("c_nationkey", F.floor(F.col("c_custkey") / 3).alias("record"), F.struct(F.col("c_name").alias("name"), texts.alias("affiliations"), codes.alias("country_codes")).alias("a"))
    records = authors.groupBy("c_nationkey", "record").agg(F.collect_list("a").alias("authors"))  # three at most
    return records.select("c_nationkey", "record", T.any_author_home(F.col("authors")).alias("home"), T.any_author_foreign(F.col("authors")).alias("abroad"))


@query(
    """WITH g AS (SELECT day(ts) AS generation, max(value) AS best, avg(value) AS mean FROM events GROUP BY day(ts))
SELECT generation, best, round(mean, 6) AS mean, max(best) OVER (ORDER BY generation) AS best_so_far FROM g"""
)
def generation_curve(spark, folder):
    """Best, mean and best so far per generation (day)."""
    out = S.generations(table(spark, folder, "events").select(F.dayofmonth("ts").cast("long").alias("generation"), "value"), "generation", "value")
    return out.withColumn("mean", F.round("mean", 6))


_METRICS = """m AS (SELECT event_type AS model, 'mean' AS metric, avg(value) AS value FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'sd', stddev_samp(value) FROM events GROUP BY event_type)"""


@query(
    f"""WITH {_METRICS}, j AS (SELECT m.metric, m.model, m.value - b.value AS delta FROM m JOIN m b ON b.metric = m.metric AND b.model = 'view' WHERE m.model <> 'view')
SELECT metric, model, round(delta, 6) AS delta, CASE WHEN (metric = 'sd') = (delta < 0) AND delta <> 0 THEN 'better' WHEN delta = 0 THEN 'same' ELSE 'worse' END AS flag FROM j"""
)
def baseline_deltas(spark, folder):
    """Metrics of each model against a baseline; less spread is better."""
    e = table(spark, folder, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    long = e.select("model", F.explode(F.create_map(F.lit("mean"), F.col("mean"), F.lit("sd"), F.col("sd"))).alias("metric", "value"))
    return S.against_baseline(long, "model", "view", ("sd",)).withColumn("delta", F.round("delta", 6))


@query(
    """WITH d AS (SELECT round(max(value) FILTER (WHERE event_type = 'purchase') - max(value) FILTER (WHERE event_type = 'click'), 6) AS delta FROM events)
SELECT delta, CASE WHEN delta > 0.005 THEN 'material' WHEN delta > 0 THEN 'marginal' WHEN delta = 0 THEN 'matched' ELSE 'beaten' END AS verdict FROM d"""
)
def search_verdict(spark, folder):
    """Verdict on two strategies at an equal budget."""
    best = table(spark, folder, "events").select(F.col("event_type").alias("strategy"), F.col("value").alias("fitness"))
    return S.search_verdict(best, "purchase", "click").withColumn("delta", F.round("delta", 6))


@query(f"WITH {_MASS} SELECT topic, round(max(share) FILTER (WHERE win = 2) - max(share) FILTER (WHERE win = 0), 6) AS change FROM shares GROUP BY topic ORDER BY abs(max(share) FILTER (WHERE win = 2) - max(share) FILTER (WHERE win = 0)) DESC, topic LIMIT 3")
def top_changes(spark, folder):
    """The three topics whose share changes most from the first to the third window."""
    return P.top_changes(P.window_shares(*_mass(spark, folder)), 0, 2, 3).withColumn("change", F.round("change", 6))


@query(f"WITH {_MASS} SELECT topic, array_to_string(list(win || '=' || printf('%.4f', share) ORDER BY win), ';') AS shares FROM shares WHERE n >= 30 AND share IS NOT NULL GROUP BY topic")
def shares_by_window(spark, folder):
    """Each topic's shares as a map from window to share, written out."""
    out = P.by_window(P.window_shares(*_mass(spark, folder)))
    entries = F.transform(F.sort_array(F.map_entries("shares")), lambda e: F.format_string("%s=%.4f", e["key"], e["value"]))
    return out.select("topic", F.array_join(entries, ";").alias("shares"))


@query(f'WITH {_MASS} SELECT win AS "window", m AS assigned FROM act')
def assigned_documents(spark, folder):
    """Documents with any topic weight per window."""
    return P.assigned(_mass(spark, folder)[0])


@query(
    """WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY n) AS step FROM o)
SELECT user_id, round(greatest(max(step), 0), 6) AS rise FROM d GROUP BY user_id"""
)
def largest_rise(spark, folder):
    """The largest step up in each user's values: how far a curve is from falling only."""
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    return S.largest_rise(events, ["user_id"], ["ts", "event_id"], "value").withColumn("rise", F.round("rise", 6))


@query(
    """WITH r AS (SELECT user_id AS item, event_type AS rater, max(1 + CAST(floor(value) AS BIGINT) % 5) AS rating FROM events WHERE value IS NOT NULL GROUP BY ALL),
v AS (SELECT user_id AS item, CASE arg_max(event_id, event_id) % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'revise' ELSE 'reject' END AS verdict FROM events GROUP BY user_id)
SELECT p.c_custkey AS item, a.rating AS rating_click, b.rating AS rating_purchase, c.rating AS rating_view, verdict, round((a.rating + b.rating + c.rating) / 3.0::DOUBLE, 6) AS mean
FROM customer p JOIN r a ON a.item = p.c_custkey AND a.rater = 'click' JOIN r b ON b.item = p.c_custkey AND b.rater = 'purchase' JOIN r c ON c.item = p.c_custkey AND c.rater = 'view' JOIN v ON v.item = p.c_custkey"""
)
def rating_panel(spark, folder):
    """Items with the ratings of three raters, their mean and the verdict of the review."""
    one = ratings(spark, folder).groupBy("item", "rater").agg(F.max("rating").alias("rating"))
    last = table(spark, folder, "events").groupBy(F.col("user_id").alias("item")).agg(F.max("event_id").alias("e"))
    verdict = F.when(F.col("e") % 3 == 0, "accept").when(F.col("e") % 3 == 1, "revise").otherwise("reject")
    pack = table(spark, folder, "customer").select(F.col("c_custkey").alias("item"))
    return R.panel(pack, one, last.select("item", verdict.alias("verdict")), ["click", "purchase", "view"]).withColumn("mean", F.round("mean", 6))


@query(
    """WITH r AS (SELECT CAST(user_id % 3 AS BIGINT) AS cell, event_type AS algorithm, floor(value) AS value FROM events WHERE value IS NOT NULL),
s AS (SELECT cell, algorithm, avg(value) AS mean FROM r GROUP BY ALL)
SELECT * FROM (SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY mean, algorithm) AS place, algorithm, round(mean, 6) AS mean FROM s) WHERE place <= 2"""
)
def cell_winners(spark, folder):
    """The algorithm of least mean, and its runner-up, of each cell."""
    out = S.winners(S.run_summary(runs(spark, folder), ["cell", "algorithm"], F.lit(0.0)), ["cell"])
    return out.select("cell", F.col("place").cast("long").alias("place"), "algorithm", F.round("mean", 6).alias("mean"))


@query(
    """WITH r AS (SELECT CAST(user_id % 3 AS BIGINT) AS cell, event_type AS algorithm, floor(value) AS v FROM events WHERE value IS NOT NULL)
SELECT cell, algorithm, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS best, max(v) AS worst, median(v) AS median, round(avg(v - 1), 6) AS mean_error, min(v - 1) AS best_error FROM r GROUP BY ALL"""
)
def run_summary(spark, folder):
    """Mean, deviation, extremes, median and errors against an optimum of 1 for each cell and algorithm."""
    out = S.run_summary(runs(spark, folder), ["cell", "algorithm"], F.lit(1.0))
    return out.select("cell", "algorithm", "n", *(F.round(c, 6).alias(c) if c in ("mean", "sd", "mean_error") else F.col(c) for c in ("mean", "sd", "best", "worst", "median", "mean_error", "best_error")))


@query(
    """WITH a AS (SELECT user_id, avg(value) / 200 AS x FROM events GROUP BY user_id)
SELECT user_id, round(greatest(0, least(1, (coalesce(x, 0) - 0.3) / (0.7 - 0.3))), 6) AS scaled, round(0.6 * coalesce(x, 0) + 0.2 * 0.5 + 0.2 * 0, 6) AS fitness,
  CASE WHEN x IS NULL THEN 'not computable' WHEN x >= 0.8 THEN 'reliable' WHEN x >= 0.667 THEN 'tentative' ELSE 'unreliable' END AS label FROM a"""
)
def scaled_scores(spark, folder):
    """Clamped scores, weighted fitness with an undefined part, and agreement labels."""
    from ..functions import scalar

    x = F.col("x")
    out = table(spark, folder, "events").groupBy("user_id").agg((F.avg("value") / 200).alias("x"))
    return out.select(
        "user_id", F.round(scalar.clamp_normalise(x), 6).alias("scaled"), F.round(scalar.weighted_fitness(x, F.lit(0.5), F.lit(float("nan"))), 6).alias("fitness"), scalar.agreement_label(x).alias("label")
    )


@query(
    """WITH b AS (SELECT user_id // 10 AS batch, list(user_id ORDER BY user_id) AS ids FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1)
SELECT batch, unnest(ids) AS id, CASE WHEN unnest(ids) % 7 = 0 THEN 'repeated key' WHEN unnest(ids) % 5 = 0 THEN 'unknown key' WHEN unnest(ids) % 3 = 0 THEN 'coherence' END AS error FROM b"""
)
def batch_label_validation(spark, folder):
    """Batched label responses, one object per key: keys given twice, keys not expected and bad fields are errors of their rows."""
    i = F.col("user_id")
    item = F.struct(
        F.when((i % 5 == 0) & (i % 7 != 0), F.concat(F.lit("x"), i)).otherwise(i.cast("string")).alias("key"), F.lit("a label").alias("label"), F.lit("why").alias("rationale"),
        F.when(i % 3 == 0, "odd").otherwise("high").alias("coherence"), F.array(F.lit("d")).alias("supporting_doc_ids"),
    )
    users = table(spark, folder, "events").select("user_id").distinct().withColumn("item", item)
    users = users.withColumn("items", F.when(i % 7 == 0, F.array("item", "item")).otherwise(F.array("item")))
    packs = users.groupBy(F.floor(i / 10).cast("long").alias("batch")).agg(F.flatten(F.collect_list("items")).alias("items"), F.collect_list(i.cast("string")).alias("keys"))  # ten ids a batch
    packs = packs.withColumn("response", F.concat(F.lit("```json\n"), T.batch_prompt(F.col("items")), F.lit("\n```")))
    allowed = F.map_from_entries(F.transform("keys", lambda k: F.struct(k.alias("k"), F.array(F.lit("d")).alias("v"))))
    rows = packs.select("batch", F.explode(T.parse_batch(F.col("response"), allowed)).alias("r"))
    return rows.select("batch", F.regexp_replace("r.key", "^x", "").cast("long").alias("id"), F.col("r.error").alias("error")).distinct()


#: Events as reviews of a label a user: what each type stands for.
_KIND = {"signup": "generated", "error": "failed", "click": "accept", "purchase": "revise", "view": "reject"}


def _review_events(spark, folder):
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in _KIND.items()))
    return table(spark, folder, "events").select(
        F.col("user_id").alias("item"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 7 > 0, F.concat(F.lit(" label "), F.col("event_id").cast("string"))).alias("label"),
        F.when(F.col("event_id") % 5 > 0, "reviewer").alias("reviewer"), F.when(F.col("event_id") % 11 > 0, "note").otherwise(" ").alias("note"),
    )


_REVIEW_SQL = f"""WITH e AS (SELECT user_id AS item, ts, event_id AS seq, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KIND.items())} END AS kind,
  CASE WHEN event_id % 7 > 0 THEN ' label ' || event_id END AS label, event_id % 5 > 0 AND event_id % 11 > 0 AS named FROM events),
d AS (SELECT item, ts AS dt, seq AS ds, label AS draft FROM e WHERE kind = 'generated' QUALIFY row_number() OVER (PARTITION BY item ORDER BY ts, seq) = 1),
j AS (SELECT e.*, draft, coalesce((dt, ds) < (ts, seq), false) AS made, CASE WHEN kind = 'accept' THEN coalesce(draft, '') ELSE trim(coalesce(label, '')) END AS own FROM e LEFT JOIN d USING (item)),
o AS (SELECT *, CASE WHEN kind IN ('generated', 'failed') THEN CASE WHEN made THEN 'already generated' ELSE 'taken' END WHEN kind IS NULL THEN 'unknown event' WHEN NOT made THEN 'not generated'
  WHEN NOT named THEN 'no reviewer or note' WHEN kind <> 'reject' AND own = '' THEN 'no label or a long one' ELSE 'taken' END AS outcome FROM j),
log AS (SELECT *, CASE WHEN outcome = 'taken' THEN CASE WHEN kind IN ('accept', 'revise') THEN own WHEN kind = 'generated' THEN label END END AS final_label FROM o)"""


@query(f"{_REVIEW_SQL} SELECT seq, item, outcome, final_label FROM log")
def review_outcomes(spark, folder):
    """Every event taken as a step of a label's review, with what became of it."""
    from ..operators import reviews

    return reviews.outcomes(_review_events(spark, folder)).select("seq", "item", "outcome", "final_label")


@query(
    f"""{_REVIEW_SQL}, r AS (SELECT item, kind AS decision, final_label, count(*) OVER (PARTITION BY item) AS reviews, row_number() OVER (PARTITION BY item ORDER BY ts DESC, seq DESC) AS k FROM log
  WHERE outcome = 'taken' AND kind IN ('accept', 'revise', 'reject')),
s AS (SELECT item, CASE WHEN bool_or(outcome = 'taken' AND kind = 'generated') THEN 'generated' WHEN bool_or(outcome = 'taken' AND kind = 'failed') THEN 'failed' ELSE 'pending' END AS status,
  count(*) FILTER (WHERE outcome <> 'taken') AS refused FROM log GROUP BY item)
SELECT item, status, decision, final_label, coalesce(reviews, 0) AS reviews, refused FROM s LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (item)"""
)
def review_current(spark, folder):
    """Status of every label after all reviews, with the last one and the number of those taken and refused."""
    from ..operators import reviews

    return reviews.current(reviews.outcomes(_review_events(spark, folder))).select("item", "status", "decision", "final_label", "reviews", "refused")
