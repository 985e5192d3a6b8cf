"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses.

A text is cut at two line breaks into sections, a section at one into paragraphs;
both cuts can be undone, so the parts and their order are the text. A paragraph's
hash is the SHA-256 of its bytes, a section's that of its paragraphs' hashes, the
root that of the sections' hashes: equal roots mean equal texts, up to collisions of
SHA-256. Below paragraphs are clauses, which cover every character: up to 64
characters with the marks after them, or marks alone.

A fingerprint is ``root/section:paragraph=clause,clause;paragraph=.../section:...``
with hashes cut to SHORT and, for clauses, TINY hex digits. Two fingerprints are
compared from the top: equal branches are skipped, and the first differing section,
paragraph in it and clause in that locate an edit. The share of common clauses is
the likeness.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored

MARKS = ".!?,;:|"
CLAUSE = rf"[^{MARKS}]{{1,64}}[{MARKS}]*|[{MARKS}]+"
#: Hex digits of a section's or paragraph's hash in a fingerprint, and of a clause's.
SHORT, TINY = 16, 8
#: Ids of a range that one task orders; rows of two numbers.
RANGE_IDS = 100_000


def tree(text: Column) -> Column:
    """Array of sections: struct(hash, paragraphs: array of struct(hash, clauses))."""
    clauses = lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"({CLAUSE})")), lambda c: F.substring(F.md5(c.cast("binary")), 1, TINY))
    paragraph = lambda p: F.struct(F.sha2(p, 256).alias("hash"), clauses(p).alias("clauses"))
    parts = F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), paragraph))
    return F.transform(parts, lambda ps: F.struct(F.sha2(F.array_join(ps["hash"], ""), 256).alias("hash"), ps.alias("paragraphs")))


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(sections["hash"], ""), 256)


def fingerprint(sections: Column) -> Column:
    short = lambda h: F.substring(h, 1, SHORT)
    shown = lambda p: F.concat(short(p["hash"]), F.lit("="), F.array_join(p["clauses"], ","))
    branch = lambda s: F.concat(short(s["hash"]), F.lit(":"), F.array_join(F.transform(s["paragraphs"], shown), ";"))
    return F.concat(root(sections), F.lit("/"), F.array_join(F.transform(sections, branch), "/"))


def leaves(sections: Column) -> Column:
    """Distinct clause hashes."""
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.flatten(s["paragraphs"]["clauses"]))))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of leaves; two empty ones are alike."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def _first_difference(a: Column, b: Column) -> Column:
    """Number (from 1) of the first place in which two arrays differ; null if none does."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    return F.array_min(F.transform(pairs, lambda p, i: F.when(~p["x"].eqNullSafe(p["y"]), i + 1)))


def located(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds changed_section, changed_paragraph and changed_clause: where trees a and b first differ, by descending differing branches.

    The paragraph counts within its section, the clause within its paragraph;
    all are null for equal trees. A branch that only one tree has differs.
    """
    at = lambda c, k, part: F.get(F.col(c), F.col(k) - 1)[part]
    empty = F.array().cast("array<struct<hash: string, clauses: array<string>>>")
    none = F.array().cast("array<string>")
    df = df.withColumn("changed_section", _first_difference(F.col(a)["hash"], F.col(b)["hash"]))
    df = df.withColumns({"__a": F.coalesce(at(a, "changed_section", "paragraphs"), empty), "__b": F.coalesce(at(b, "changed_section", "paragraphs"), empty)})
    df = df.withColumn("changed_paragraph", _first_difference(F.col("__a")["hash"], F.col("__b")["hash"]))
    sides = (F.coalesce(at(x, "changed_paragraph", "clauses"), none) for x in ("__a", "__b"))
    return df.withColumn("changed_clause", _first_difference(*sides)).drop("__a", "__b")


def followed(ids: DataFrame) -> DataFrame:
    """(none, id, before_none, before, before_size): the id before each id of (none, id, size), in order; before the first is the last.

    Ids are ordered in ranges of about RANGE_IDS, as many as it takes; a range knows the
    last id of the range before by one row a range.
    """
    count = ids.count()
    ranges = max(1, -(-count // RANGE_IDS))
    placed = stored(ids.repartitionByRange(ranges, F.desc("none"), "id").withColumn("span", F.spark_partition_id()), "ranges")
    order = [F.desc("none"), F.col("id")]
    lasts = placed.groupBy("span").agg(F.max_by(F.struct("none", "id", "size"), F.struct(~F.col("none"), "id")).alias("last"))
    over = Window.partitionBy().orderBy("span")  # a row a range
    lasts = lasts.select("span", F.coalesce(F.lag("last").over(over), F.last("last").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("last"))
    inside = F.lag(F.struct("none", "id", "size")).over(Window.partitionBy("span").orderBy(*order))
    rows = placed.withColumn("inside", inside).join(F.broadcast(lasts), "span").withColumn("b", F.coalesce("inside", "last"))
    return rows.select("none", "id", F.col("b.none").alias("before_none"), F.col("b.id").alias("before"), F.col("b.size").alias("before_size"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of docs (doc_id, text, ...), of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's, by ascending doc_id; after the
    last comes the first, so a single document follows itself. A null text is
    empty; null ids are one id before all others. Rows that repeat a doc_id are
    followed by the same next document, and among texts of one id that of the least
    64-bit hash stands for it as the next. A very long text is one row, never grouped
    with others. An empty table gives no rows; other columns are ignored.

    Ids are ordered without texts; a text goes to the document before it by a join,
    cut to what its edit takes, with its clause hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), "text")
    ids = docs.groupBy("none", "id").agg(F.max(F.char_length("text")).alias("size"), F.min(F.xxhash64("text")).alias("which"))
    ids = stored(ids, "ids")
    before = followed(ids.drop("which")).join(ids.select("none", "id", "which"), ["none", "id"])
    # not written as an equality of two sides, so that this join and the last one read the same exchange of texts
    nexts = docs.join(before, ["none", "id"]).where(F.xxhash64("text").bitwiseXOR(F.col("which")) == 0)
    nexts = nexts.select(
        F.col("before_none").alias("none"), F.col("before").alias("id"),
        F.substring(F.col("text"), F.lit(1), F.floor(F.col("before_size") / 2).cast("int")).alias("head"), leaves(tree(F.col("text"))).alias("next_leaves"),
    ).dropDuplicates(["none", "id"])
    rows = docs.join(nexts, ["none", "id"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("head"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumns({"tree": tree(F.col("text")), "edited_tree": tree(F.col("edited"))})
    rows = located(rows.withColumn("own", leaves(F.col("tree"))), "tree", "edited_tree")
    return rows.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("own"), leaves(F.col("edited_tree"))).alias("near_edited"),
        likeness(F.col("own"), F.col("next_leaves")).alias("near_next"),
        "changed_section",
        "changed_paragraph",
        "changed_clause",
    )


def op3_merkle(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """The same trees by other means: clauses are pieces after runs of marks, cut by length."""
    bar = "chr(63743)"  # a code point of private use between pieces
    pieces = f"list_filter(string_split(regexp_replace(p, '([{MARKS}]+)', '\\1' || {bar}, 'g'), {bar}), lambda x: x <> '')"
    plain = f"rtrim(x, '{MARKS}')"
    cut = f"""list_transform(range(0, greatest(1, CAST(ceil(length({plain}) / 64) AS BIGINT))),
      lambda k: CASE WHEN (k + 1) * 64 >= length({plain}) THEN substr(x, k * 64 + 1) ELSE substr(x, k * 64 + 1, 64) END)"""
    clauses = f"flatten(list_transform({pieces}, lambda x: list_transform({cut}, lambda c: left(md5(c), {TINY}))))"

    def tree(t: str) -> str:
        paragraphs = f"list_transform(string_split(s, chr(10)), lambda p: {{'hash': sha256(p), 'clauses': {clauses}}})"
        return f"list_transform(string_split({t}, chr(10) || chr(10)), lambda s: {paragraphs})"

    section = "sha256(array_to_string(list_transform(s, lambda p: p.hash), ''))"
    shown = lambda t: f"""sha256(array_to_string(list_transform({t}, lambda s: {section}), '')) || '/' || array_to_string(list_transform({t},
      lambda s: left({section}, {SHORT}) || ':' || array_to_string(list_transform(s, lambda p: left(p.hash, {SHORT}) || '=' || array_to_string(p.clauses, ',')), ';')), '/')"""  # noqa: E731
    leaf = lambda t: f"list_distinct(flatten(list_transform(flatten({t}), lambda p: p.clauses)))"
    near = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"
    first = lambda a, b: f"CAST(list_min(list_filter(range(1, greatest(len({a}), len({b})) + 1), lambda i: {a}[i] IS DISTINCT FROM {b}[i])) AS INTEGER)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n_chars, coalesce(lead(t) OVER (ORDER BY doc_id), first(t) OVER (ORDER BY doc_id)) AS f FROM d),
e AS (SELECT *, left(t, n_chars - n_chars // 2) || left(f, n_chars // 2) AS edited FROM n),
trees AS (SELECT *, {tree("t")} AS a, {tree("edited")} AS b, {tree("f")} AS c FROM e),
sets AS (SELECT *, {leaf("a")} AS la, {leaf("b")} AS lb, {leaf("c")} AS lc, {first("a", "b")} AS changed_section FROM trees),
inner_ AS (SELECT *, coalesce(a[changed_section], []) AS pa, coalesce(b[changed_section], []) AS pb FROM sets),
pars AS (SELECT *, {first("pa", "pb")} AS changed_paragraph FROM inner_),
cl AS (SELECT *, coalesce(pa[changed_paragraph].clauses, []) AS ca, coalesce(pb[changed_paragraph].clauses, []) AS cb FROM pars)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {shown("a")} AS fingerprint, {shown("b")} AS edited_fingerprint,
  {near("la", "lb")} AS near_edited, {near("la", "lc")} AS near_next, changed_section, changed_paragraph, {first("ca", "cb")} AS changed_clause
FROM cl
"""


OP3_SQL = _oracle()
