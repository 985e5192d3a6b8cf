"""Queries on vocabularies, bags of words, phrases, class topics and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import vectors as V
from ..session import cut, spread, table
from ._base import query

#: The tables hold invented words, so the queries take a small stop list of theirs.
STOP = ("the", "and", "for", "with", "that", "les", "des", "der", "die", "que")
_STOP = ", ".join(f"'{w}'" for w in STOP)
TOK = f"""tok AS (SELECT doc_id, lang, source, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+(?:''[a-z]+)?'),
  lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w)) AS tokens FROM documents)"""
TF = TOK + ", words AS (SELECT doc_id, unnest(tokens) AS term FROM tok), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL)"
DF = TF + ", df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term)"


def documents(spark, folder, by_id=False):
    """Documents with their tokens; by_id deals texts by doc_id, for what meets there anyway: a text is shorter than a row per term."""
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return (rows.repartition("doc_id") if by_id else spread(rows)).select("doc_id", "lang", "source", T.tokens(F.col("text"), STOP, ()).alias("tokens"))


@query(f"WITH {DF} SELECT term, df, cf FROM df")
def token_document_frequency(spark, folder):
    """Documents and occurrences of every term."""
    return V.document_frequency(documents(spark, folder))


@query(
    f"""WITH {TOK}, s AS (SELECT list_sort(list(len(tokens))) AS l, count(*) AS n, sum(len(tokens)) AS t, avg(len(tokens)) AS m FROM tok)
SELECT n, CAST(t AS BIGINT) AS tokens, (SELECT count(DISTINCT w) FROM (SELECT unnest(tokens) AS w FROM tok)) AS types, l[1] AS min,
  l[CAST(floor(n * 0.5) AS INT) + 1] AS median, l[n] AS max, round(m, 6) AS mean, (SELECT count(*) FROM tok WHERE len(tokens) = 0) AS empty FROM s"""
)
def vocabulary_stats(spark, folder):
    """Tokens, types and tokens per document."""
    return V.vocabulary_stats(documents(spark, folder))


_DICT = f"""{DF}, dict AS (SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, df, cf FROM
  (SELECT * FROM df WHERE df >= 5 AND df <= 0.5 * (SELECT count(*) FROM documents) ORDER BY df DESC, term LIMIT 50000))"""


def _dictionary(spark, folder):
    docs = documents(spark, folder)
    return V.dictionary(V.document_frequency(docs), table(spark, folder, "documents").count())


@query(f"WITH {_DICT} SELECT term_id, term, df, cf FROM dict")
def dictionary_filter_extremes(spark, folder):
    """Terms in 5 or more documents and at most half of them, with dense ids."""
    return _dictionary(spark, folder)


@query(f"WITH {_DICT} SELECT doc_id, term_id, tf FROM tf JOIN dict USING (term)")
def bow_counts(spark, folder):
    """Bag of words over the dictionary."""
    counts = cut(V.term_counts(documents(spark, folder)))
    return V.bow(counts, V.dictionary(V.frequency(counts), table(spark, folder, "documents").count()))


@query(
    f"""WITH {DF}, w AS (SELECT doc_id, term, tf * log2((SELECT count(*) FROM documents) / df) AS w FROM tf JOIN df USING (term)),
n AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM n)
SELECT doc_id, term, round(weight, 6) AS weight, rank FROM r WHERE rank <= 5"""
)
def tfidf_top_terms(spark, folder):
    """Five heaviest terms of each document."""
    counts = cut(V.term_counts(documents(spark, folder, by_id=True)))
    weights = V.tfidf(counts, cut(V.frequency(counts)), table(spark, folder, "documents").count())
    return V.top_terms(weights, "doc_id", "weight", 5).select("doc_id", "term", F.round("weight", 6).alias("weight"), "rank")


_PAIRS = f"""{TOK}, pos AS (SELECT doc_id, tokens[i] AS a, tokens[i + 1] AS b FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens))) AS i FROM tok)),
c AS (SELECT term, count(*) AS c FROM (SELECT unnest(tokens) AS term FROM tok) GROUP BY term),
ab AS (SELECT a, b, count(*) AS n FROM pos GROUP BY a, b HAVING count(*) > 10)"""


@query(
    f"""WITH {_PAIRS}, s AS (SELECT a, b, n, (n - 10)::DOUBLE * (SELECT count(*) FROM c) / x.c / y.c AS score FROM ab JOIN c x ON x.term = a JOIN c y ON y.term = b)
SELECT a, b, n, round(score, 6) AS score FROM s WHERE score > 20"""
)
def bigram_scores(spark, folder):
    """Scores of frequent adjacent pairs."""
    return V.bigram_scores(documents(spark, folder)).withColumn("score", F.round("score", 6))


def _phrase_pass(k: int, src: str) -> str:
    """One pass of joining phrases from left to right: of a run of overlapping pairs, every other one, from the first."""
    return f"""n{k} AS (SELECT doc_id, i, t AS a, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM {src}), c{k} AS (SELECT t AS term, count(*) AS c FROM {src} GROUP BY t),
ab{k} AS (SELECT a, b, count(*) AS n FROM n{k} WHERE b IS NOT NULL GROUP BY a, b HAVING count(*) > 10),
ph{k} AS (SELECT a, b FROM ab{k} JOIN c{k} x ON x.term = a JOIN c{k} y ON y.term = b WHERE (n - 10)::DOUBLE * (SELECT count(*) FROM c{k}) / x.c / y.c > 20),
m{k} AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n{k} JOIN ph{k} USING (a, b)),
j{k} AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS x FROM m{k}) WHERE x % 2 = 1),
w{k} AS (SELECT n.doc_id, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.i) AS i, CASE WHEN j.i IS NULL THEN a ELSE a || '_' || b END AS t
  FROM n{k} n LEFT JOIN j{k} j USING (doc_id, i) LEFT JOIN j{k} p ON p.doc_id = n.doc_id AND p.i = n.i - 1 WHERE p.i IS NULL)"""


@query(
    f"""WITH {TOK}, w0 AS (SELECT doc_id, i, tokens[i] AS t FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM tok)), {_phrase_pass(1, "w0")}, {_phrase_pass(2, "w1")}
SELECT doc_id, CAST(count(t) AS INTEGER) AS n_tokens, coalesce(string_agg(t, ' ' ORDER BY i) FILTER (WHERE contains(t, '_')), '') AS phrases FROM tok LEFT JOIN w2 USING (doc_id) GROUP BY doc_id"""
)
def phrase_apply(spark, folder):
    """Tokens with bigrams, then phrases of more words, joined."""
    docs = cut(documents(spark, folder).select("doc_id", "tokens"))
    two = cut(V.join_phrases(docs, V.learn_phrases(docs)))
    three = V.join_phrases(two, V.learn_phrases(two))
    return three.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join(F.filter("tokens", lambda t: F.contains(t, F.lit("_"))), " ").alias("phrases"))


_EDGES = f"""{DF}, top AS (SELECT term FROM df ORDER BY df DESC, term LIMIT 35), own AS (SELECT doc_id, term FROM tf JOIN top USING (term)),
edges AS (SELECT x.term AS a, y.term AS b, count(*) AS n FROM own x JOIN own y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL HAVING count(*) >= 25)"""


def _edges(spark, folder):
    docs = documents(spark, folder)
    top = V.document_frequency(docs).orderBy(F.desc("df"), "term").limit(35)
    return V.cooccurrence(docs, top, 25)


@query(f"WITH {_EDGES} SELECT a, b, n FROM edges")
def cooccurrence_edges(spark, folder):
    """Pairs of the 35 commonest terms in 25 or more documents."""
    return _edges(spark, folder)


@query(
    f"""WITH {_EDGES}, ends AS (SELECT a AS term, n FROM edges UNION ALL SELECT b, n FROM edges)
SELECT term, count(*) AS degree, CAST(sum(n) AS BIGINT) AS weight FROM ends GROUP BY term"""
)
def cooccurrence_degree(spark, folder):
    """Degree and weight of each term of the network."""
    return V.degrees(_edges(spark, folder))


_TOPICS = f"""{TOK}, ct AS (SELECT source AS topic, term, count(*) AS tf FROM (SELECT source, unnest(tokens) AS term FROM tok) GROUP BY ALL),
f AS (SELECT term, sum(tf) AS f FROM ct GROUP BY term), m AS (SELECT sum(tf)::DOUBLE / count(DISTINCT topic) AS mean FROM ct),
cw AS (SELECT topic, term, tf * ln(1 + mean / f) AS weight FROM ct JOIN f USING (term), m),
topics AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM cw) WHERE rank <= 10)"""


def topics_of(spark, folder):
    """Class-based topics: ten words per source."""
    return V.class_tfidf(documents(spark, folder).withColumnRenamed("source", "topic"), "topic")


def topic_lists(topics) -> list[list[str]]:
    """Word lists by topic; a topics table is small by nature."""
    rows = topics.select("topic", "rank", "term").orderBy("topic", "rank").collect()
    return [[r["term"] for r in rows if r["topic"] == t] for t in dict.fromkeys(r["topic"] for r in rows)]


@query(f"WITH {_TOPICS} SELECT topic, term, round(weight, 6) AS weight, rank FROM topics")
def class_tfidf_topics(spark, folder):
    """Words of each source by class-based TF-IDF."""
    return topics_of(spark, folder).withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {TOK}, g AS (SELECT source AS topic, unnest(list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))) AS term FROM tok),
ct AS (SELECT topic, term, count(*) AS tf FROM g GROUP BY ALL), f AS (SELECT term, sum(tf) AS f FROM ct GROUP BY term HAVING count(*) >= 2), k AS (SELECT ct.*, f FROM ct JOIN f USING (term)),
m AS (SELECT sum(tf)::DOUBLE / count(DISTINCT topic) AS mean FROM k), w AS (SELECT topic, term, tf * ln(1 + mean / f) AS weight FROM k, m)
SELECT topic, term, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM w) WHERE rank <= 10"""
)
def class_phrase_topics(spark, folder):
    """Words and pairs of words of each source by class-based TF-IDF, of those that two sources have."""
    out = V.class_tfidf(documents(spark, folder).withColumnRenamed("source", "topic"), "topic", longest=2, least=2)
    return out.withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {_DICT} SELECT 'all' AS among, row_number() OVER (ORDER BY df DESC, term) AS rank, term, df, cf FROM df QUALIFY rank <= 25
UNION ALL SELECT 'dictionary', row_number() OVER (ORDER BY df DESC, term) AS rank, term, df, cf FROM dict QUALIFY rank <= 25"""
)
def commonest_terms(spark, folder):
    """The 25 terms in most documents: of all, and of those in the dictionary."""
    df = cut(V.document_frequency(documents(spark, folder)))
    vocab = V.dictionary(df, table(spark, folder, "documents").count())
    return V.commonest(df).withColumn("among", F.lit("all")).unionByName(V.commonest(df, vocabulary=vocab).withColumn("among", F.lit("dictionary")))


@query(f"WITH {_TOPICS} SELECT round(count(DISTINCT term)::DOUBLE / count(*), 6) AS diversity FROM topics")
def topic_diversity(spark, folder):
    """Distinct over all topic words."""
    return E.diversity(topics_of(spark, folder), 10).select(F.round("diversity", 6).alias("diversity"))


_JACCARD = f"""{_TOPICS}, s AS (SELECT topic, list(term) AS l FROM topics GROUP BY topic),
j AS (SELECT x.topic AS topic_a, y.topic AS topic_b, len(list_intersect(x.l, y.l))::DOUBLE / len(list_distinct(list_concat(x.l, y.l))) AS jaccard FROM s x JOIN s y ON x.topic < y.topic)"""


@query(f"WITH {_JACCARD} SELECT topic_a, topic_b, round(jaccard, 6) AS jaccard FROM j")
def pairwise_jaccard(spark, folder):
    """Jaccard similarity of every pair of topics."""
    return E.pairwise_jaccard(topics_of(spark, folder), 10).withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {_JACCARD} SELECT topic_a, topic_b, round(jaccard, 3) AS jaccard FROM j WHERE jaccard > 0.25")
def redundant_topics(spark, folder):
    """Pairs of topics above a similarity."""
    return E.redundant(topics_of(spark, folder), 10, 0.25)


@query(f"WITH {_DICT}, {_TOPICS.removeprefix(TOK + ', ')} SELECT topic, round(avg(CASE WHEN d.term IS NULL THEN 0.0 ELSE 1.0 END), 6) AS overlap FROM topics t LEFT JOIN dict d ON d.term = t.term GROUP BY topic")
def vocabulary_overlap(spark, folder):
    """Share of topic words in the dictionary."""
    return E.vocabulary_overlap(topics_of(spark, folder), _dictionary(spark, folder)).withColumn("overlap", F.round("overlap", 6))


@query(
    f"""WITH {_TOPICS}, own AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) WHERE term IN (SELECT term FROM topics)),
p AS (SELECT x.term AS a, y.term AS b, count(*) AS n FROM own x JOIN own y ON x.doc_id = y.doc_id GROUP BY ALL),
s AS (SELECT i.topic, avg(ln((coalesce(p.n, 0)::DOUBLE / (SELECT count(*) FROM documents) + 1e-12) / (d.n::DOUBLE / (SELECT count(*) FROM documents)))) AS v
  FROM topics i JOIN topics j ON i.topic = j.topic AND j.rank < i.rank LEFT JOIN p ON p.a = i.term AND p.b = j.term JOIN p d ON d.a = j.term AND d.b = j.term GROUP BY i.topic)
SELECT round(avg(v), 6) AS u_mass FROM s"""
)
def coherence_umass(spark, folder):
    """Mean document co-occurrence coherence of the class topics."""
    value, _ = E.coherence(topic_lists(topics_of(spark, folder)), documents(spark, folder), "u_mass")
    return spark.range(1).select(F.round(F.lit(value), 6).alias("u_mass"))


@query(
    f"""WITH {_TOPICS}, occ AS (SELECT doc_id, tokens[i] AS term, i - 1 AS p, greatest(1, len(tokens) - 9) AS n FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM tok) WHERE tokens[i] IN (SELECT term FROM topics)),
own AS (SELECT DISTINCT doc_id, term, unnest(range(greatest(0, p - 9), least(p, n - 1) + 1)) AS start FROM occ),
total AS (SELECT sum(greatest(1, len(tokens) - 9))::DOUBLE AS n FROM tok),
c AS (SELECT x.term AS a, y.term AS b, count(*) / (SELECT n FROM total) AS p FROM own x JOIN own y ON x.doc_id = y.doc_id AND x.start = y.start GROUP BY ALL),
s AS (SELECT i.topic, avg(ln((coalesce(c.p, 0) + 1e-12) / (d.p * e.p)) / -ln(coalesce(c.p, 0) + 1e-12)) AS v FROM topics i JOIN topics j ON i.topic = j.topic AND i.rank < j.rank
  LEFT JOIN c ON c.a = i.term AND c.b = j.term JOIN c d ON d.a = i.term AND d.b = i.term JOIN c e ON e.a = j.term AND e.b = j.term GROUP BY i.topic)
SELECT round(avg(v), 6) AS c_npmi FROM s"""
)
def coherence_npmi(spark, folder):
    """Mean normalised mutual information of topic words in windows of ten tokens."""
    value, _ = E.coherence(topic_lists(topics_of(spark, folder)), documents(spark, folder), "c_npmi")
    return spark.range(1).select(F.round(F.lit(value), 6).alias("c_npmi"))


@query(
    f"""WITH {_TOPICS}, words AS (SELECT DISTINCT term FROM topics), occ AS (SELECT doc_id, tokens[i] AS term, i - 1 AS p, greatest(1, len(tokens) - 109) AS n
  FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM tok) WHERE tokens[i] IN (SELECT term FROM words)),
own AS (SELECT DISTINCT doc_id, term, unnest(range(greatest(0, p - 109), least(p, n - 1) + 1)) AS start FROM occ),
total AS (SELECT sum(greatest(1, len(tokens) - 109))::DOUBLE AS n FROM tok),
c AS (SELECT x.term AS a, y.term AS b, count(*) / (SELECT n FROM total) AS p FROM own x JOIN own y ON x.doc_id = y.doc_id AND x.start = y.start GROUP BY ALL),
v AS (SELECT i.topic, i.term AS i, j.term AS j, ln((coalesce(c.p, 0) + 1e-12) / (d.p * e.p)) / -ln(coalesce(c.p, 0) + 1e-12) AS v FROM topics i JOIN topics j ON i.topic = j.topic
  LEFT JOIN c ON c.a = i.term AND c.b = j.term JOIN c d ON d.a = i.term AND d.b = i.term JOIN c e ON e.a = j.term AND e.b = j.term),
whole AS (SELECT topic, j, sum(v) AS w FROM v GROUP BY ALL), size AS (SELECT topic, sqrt(sum(w * w)) AS w FROM whole GROUP BY topic),
cosines AS (SELECT v.topic, i, sum(v * whole.w) / nullif(sqrt(sum(v * v)) * any_value(size.w), 0) AS c FROM v JOIN whole USING (topic, j) JOIN size ON size.topic = v.topic GROUP BY ALL),
per AS (SELECT topic, avg(coalesce(c, 0)) AS c_v FROM cosines GROUP BY topic)
SELECT CAST(row_number() OVER (ORDER BY topic) - 1 AS INTEGER) AS topic, round(c_v, 6) AS c_v FROM per"""
)
def coherence_cv(spark, folder):
    """Coherence of each topic by context vectors in windows of 110 tokens."""
    topics = topics_of(spark, folder)
    _, values = E.coherence(topic_lists(topics), documents(spark, folder), "c_v")
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, values))).alias("topic", "c_v")).withColumn("c_v", F.round("c_v", 6))


@query(
    f"""WITH {DF}, w AS (SELECT tok.source AS topic, tf.doc_id, CAST(sum(tf) AS BIGINT) AS weight FROM tf JOIN tok USING (doc_id)
  WHERE term IN (SELECT term FROM df ORDER BY df DESC, term LIMIT 35) GROUP BY ALL)
SELECT topic, doc_id, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, doc_id) AS rank FROM w) WHERE rank <= 5"""
)
def representative_documents(spark, folder):
    """The five documents of each source with most of the commonest terms; ties by id."""
    docs = documents(spark, folder)
    top = V.document_frequency(docs).orderBy(F.desc("df"), "term").limit(35)
    words = [r["term"] for r in top.collect()]  # 35
    from .model_queries import representatives

    # a document's own tokens say its weight; rows of a repeated id are added up, and each keeps its source
    own = docs.select("doc_id", F.col("source").alias("topic"), F.size(F.filter("tokens", lambda w: w.isin(*words))).cast("long").alias("own"))
    weights = own.groupBy("doc_id", "topic").agg(F.sum("own").alias("own"), F.count("*").alias("rows"))
    whole = weights.groupBy("doc_id").agg(F.sum("own").alias("weight"))
    return representatives(weights.join(whole, "doc_id").withColumn("weight", F.col("weight") * F.col("rows")), 5)


PROTECTED = ("the", "ing", "tion", "der", "nonesuch")


@query(f"WITH {_DICT} SELECT term FROM dict WHERE term IN ({', '.join(repr(p) for p in PROTECTED)})")
def protected_survival(spark, folder):
    """Protected terms that are in the dictionary."""
    words = spark.range(1).select(F.explode(F.array(*map(F.lit, PROTECTED))).alias("term"))
    return _dictionary(spark, folder).select("term").join(F.broadcast(words), "term", "left_semi")


@query(f"WITH {_JACCARD} SELECT round(avg(jaccard), 6) AS jaccard FROM j")
def mean_jaccard(spark, folder):
    """Mean similarity of all pairs of topics."""
    return E.mean_jaccard(topics_of(spark, folder), 10).withColumn("jaccard", F.round("jaccard", 6))


@query(
    f"""WITH {_DICT}, {_TOPICS.removeprefix(TOK + ", ")}, k AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY t.rank, term) AS rank FROM topics t WHERE term IN (SELECT term FROM dict))
SELECT topic, term, rank FROM (SELECT *, count(*) OVER (PARTITION BY topic) AS n FROM k WHERE rank <= 5) WHERE n >= 2"""
)
def known_topic_words(spark, folder):
    """The first five words of each topic that the dictionary has; topics with fewer than two go."""
    return E.known_topics(topics_of(spark, folder), _dictionary(spark, folder), 5).select("topic", "term", "rank")


_LEMMAS = (("onin", "n", "on"), ("onin", "v", "be"), ("erther", "v", "er"), ("ththes", "n", "thth"))


@query(
    f"""WITH {TF}, l(term, pos, lemma) AS (VALUES {", ".join(str(x) for x in _LEMMAS)}),
n AS (SELECT doc_id, tf, CASE WHEN t.term IN ('des', 'was') THEN t.term WHEN lemma IS NOT NULL THEN lemma
  WHEN t.term LIKE '%ies' AND length(t.term) - 3 + 1 >= 3 THEN t.term[:-4] || 'y' WHEN t.term LIKE '%sses' AND length(t.term) - 2 >= 3 THEN t.term[:-5] || 'ss' WHEN t.term LIKE '%xes' AND length(t.term) - 2 >= 3 THEN t.term[:-4] || 'x'
  WHEN t.term LIKE '%ches' AND length(t.term) - 2 >= 3 THEN t.term[:-5] || 'ch' WHEN t.term LIKE '%shes' AND length(t.term) - 2 >= 3 THEN t.term[:-5] || 'sh' WHEN t.term LIKE '%men' AND length(t.term) >= 3 THEN t.term[:-4] || 'man'
  WHEN t.term LIKE '%s' AND length(t.term) - 1 >= 3 AND NOT regexp_matches(t.term, '(ss|us|is)$') THEN t.term[:-2] ELSE t.term END AS term FROM tf t LEFT JOIN l ON l.term = t.term AND pos = 'n'),
v AS (SELECT doc_id, tf, CASE WHEN t.term IN ('des', 'was') THEN t.term WHEN lemma IS NOT NULL THEN lemma
  WHEN t.term LIKE '%ies' AND length(t.term) - 3 + 1 >= 3 THEN t.term[:-4] || 'y' WHEN t.term LIKE '%ied' AND length(t.term) - 3 + 1 >= 3 THEN t.term[:-4] || 'y' WHEN t.term LIKE '%ing' AND length(t.term) - 3 >= 3 THEN t.term[:-4]
  WHEN t.term LIKE '%ed' AND length(t.term) - 2 >= 3 THEN t.term[:-3] WHEN t.term LIKE '%s' AND length(t.term) - 1 >= 3 AND NOT regexp_matches(t.term, '(ss|us|is)$') THEN t.term[:-2] ELSE t.term END AS term FROM n t LEFT JOIN l ON l.term = t.term AND pos = 'v')
SELECT term, count(DISTINCT doc_id) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM v GROUP BY term"""
)
def lemma_frequency(spark, folder):
    """Documents and occurrences of every lemma: a lemma table joined, regular endings for the rest, protected words kept."""
    counts = V.term_counts(documents(spark, folder))
    lemmas = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(t).alias("term"), F.lit(p).alias("pos"), F.lit(x).alias("lemma")) for t, p, x in _LEMMAS))))
    rows = V.lemmatised(counts, lemmas, ("des", "was")).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _base_sql(table: str, rules, pos: str) -> str:
    """A CTE (term, base) of the terms of a table by checked detachment."""
    values = ", ".join(f"('{a}', '{b}')" for a, b in rules)
    return f"""{table}_forms AS (SELECT DISTINCT term, term AS base FROM {table} UNION SELECT term, left(term, length(term) - length(e)) || r FROM {table}, (VALUES {values}) AS x(e, r)
  WHERE suffix(term, e) AND length(term) > length(e)),
{table}_base AS (SELECT t.term, coalesce(l.lemma, b.base, t.term) AS base FROM (SELECT DISTINCT term FROM {table}) t
  LEFT JOIN (SELECT term, base FROM {table}_forms WHERE base IN (SELECT term FROM known) QUALIFY row_number() OVER (PARTITION BY term ORDER BY length(base), base) = 1) b USING (term)
  LEFT JOIN (SELECT term, min(lemma) AS lemma FROM l WHERE pos = '{pos}' GROUP BY term) l USING (term))"""


@query(
    f"""WITH {DF}, l(term, pos, lemma) AS (VALUES {", ".join(str(x) for x in _LEMMAS)}), known AS (SELECT term FROM df WHERE df >= 2),
{_base_sql("tf", T.fixed.NOUN_DETACHMENTS, "n")}, v AS (SELECT doc_id, tf, CASE WHEN term IN ('des', 'was') THEN term ELSE base END AS term FROM tf JOIN tf_base USING (term)),
{_base_sql("v", T.fixed.VERB_DETACHMENTS, "v")}, w AS (SELECT doc_id, tf, CASE WHEN term IN ('des', 'was') THEN term ELSE base END AS term FROM v JOIN v_base USING (term))
SELECT term, count(DISTINCT doc_id) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM w GROUP BY term"""
)
def base_form_frequency(spark, folder):
    """Documents and occurrences of every base form: exceptions first, else the shortest form that two documents have; others stay as they are."""
    counts = cut(V.term_counts(documents(spark, folder)))
    known = counts.groupBy("term").agg(F.count("*").alias("df")).where("df >= 2")
    lemmas = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(t).alias("term"), F.lit(p).alias("pos"), F.lit(x).alias("base")) for t, p, x in _LEMMAS))))
    rows = V.with_bases(counts, known, {p: lemmas.where(F.col("pos") == p) for p in "nv"}, ("des", "was"))
    return rows.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_FULL_STOP = T.stopwords()
_PROTECTED_WORDS = sorted({*T.fixed.PROTECTED, "er", "on"})


@query(
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+(?:''[a-z]+)?')) AS w FROM documents WHERE lang = 'en'),
p AS (SELECT unnest([{", ".join(repr(x) for x in _PROTECTED_WORDS)}]) AS p), s AS (SELECT unnest([{", ".join("'" + x.replace("'", "''") + "'" for x in _FULL_STOP)}]) AS s),
f AS (SELECT doc_id, CASE WHEN regexp_full_match(w, '[a-z]{{2,6}}s') AND w[:-2] IN (SELECT p FROM p) THEN w[:-2] ELSE w END AS w FROM w)
SELECT w AS term, count(*) AS n FROM f WHERE w IN (SELECT p FROM p) OR (length(w) >= 3 AND w NOT IN (SELECT s FROM s)) GROUP BY w"""
)
def protected_tokens(spark, folder):
    """English tokens with the whole stop list, protected acronyms and their plurals."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "lang", "text")).where("lang = 'en'")
    words = docs.select("doc_id", T.tokens(F.col("text"), _FULL_STOP, _PROTECTED_WORDS).alias("tokens"))
    return V.exploded(words, "tokens").groupBy("term").agg(F.count("*").alias("n"))
