"""Vocabulary, bags of words, TF-IDF, phrases, co-occurrence and class-based TF-IDF as relational algebra."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def exploded(docs: DataFrame, tokens: str, *keys: str) -> DataFrame:
    """(keys, term), a row per token.

    A plain explode makes Catalyst infer a filter on the array's size, which
    computes tokens twice; the outer form with a filter on its result does not.
    """
    return docs.select(*keys, F.explode_outer(tokens).alias("term")).where("term is not null")


def lemmatised(rows: DataFrame, lemmas: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """rows (term, ...) with terms replaced by their lemmas, noun first, then verb.

    lemmas is a table (term, pos, lemma) of any size, joined twice (Catalyst
    broadcasts it where it is small); words that it lacks lose a regular ending.
    Protected words stay.
    """
    from ..functions import text as T

    columns = rows.columns
    for pos, endings in (("n", T.NOUN_ENDINGS), ("v", T.VERB_ENDINGS)):
        known = lemmas.where(F.col("pos") == pos).groupBy("term").agg(F.min("lemma").alias("__lemma"))
        keep = F.col("term").isin(*protected) if protected else F.lit(False)
        rows = rows.join(known, "term", "left").withColumn("term", F.when(keep, F.col("term")).otherwise(F.coalesce("__lemma", T.by_endings(F.col("term"), endings)))).select(*columns)
    return rows


def bases(terms: DataFrame, vocabulary: DataFrame, endings: Sequence[tuple[str, str]], exceptions: DataFrame | None = None, protected: Sequence[str] = ()) -> DataFrame:
    """(term, base) of terms (term), each once: the exception's base if there is one, else the shortest known form.

    Known are the words of vocabulary (term); forms are the term itself and, for each of its endings, what a detachment
    leaves, so nothing is cut to a word that is unknown, and a term without a known form stays. Of forms of one length
    the first in order counts. exceptions is (term, base), the least base of several. Tables may be of any size: each term meets
    its few candidates by joins on the word.
    """
    terms = terms.select("term").distinct()
    w = F.col("term")
    forms = [w, *(F.when(F.endswith(w, F.lit(end)) & (F.length(w) > len(end)), F.concat(F.substring(w, F.lit(1), F.length(w) - len(end)), F.lit(new))) for end, new in endings)]
    candidates = terms.select("term", F.explode(F.array_distinct(F.array(*forms))).alias("base")).where("base <> ''")
    known = candidates.join(vocabulary.select(F.col("term").alias("base")).distinct(), "base", "left_semi")
    shortest = known.groupBy("term").agg(F.min(F.struct(F.length("base").alias("n"), F.col("base").alias("form"))).alias("best"))
    out = terms.join(shortest, "term", "left").withColumn("base", F.coalesce("best.form", "term"))
    if exceptions is not None:
        out = out.join(exceptions.groupBy("term").agg(F.min("base").alias("__fixed")), "term", "left").withColumn("base", F.coalesce("__fixed", "base"))
    keep = w.isin(*protected) if protected else F.lit(False)
    return out.select("term", F.when(keep, w).otherwise(F.col("base")).alias("base"))


def with_bases(rows: DataFrame, vocabulary: DataFrame, exceptions: dict[str, DataFrame] | None = None, protected: Sequence[str] = ()) -> DataFrame:
    """rows (term, ...) with terms replaced by their base forms, as nouns first, then as verbs; exceptions by "n" and "v"."""
    from ..functions import fixed

    # a base is a function of the term, so both steps are taken on distinct terms, and rows meet their base once
    found = cut(rows.select("term").distinct()).withColumn("__term", F.col("term"))
    for pos, endings in (("n", fixed.NOUN_DETACHMENTS), ("v", fixed.VERB_DETACHMENTS)):
        base = bases(found, vocabulary, endings, (exceptions or {}).get(pos), protected)
        found = cut(found.join(base, "term").select(F.col("base").alias("term"), "__term"))
    return rows.withColumnRenamed("term", "__term").join(found, "__term").select(*rows.columns)


def term_counts(docs: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """(key, term, tf); sums are made before the shuffle."""
    return exploded(docs, tokens, key).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, df, cf): documents and occurrences of each term."""
    return frequency(term_counts(docs, tokens))


def row_frequency(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The same where each row is a document of its own: counted in the batches of rows, so only terms are exchanged, no row per document and term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, rows = _rows(batch.column(0))
            coded = values.dictionary_encode()
            size = len(coded.dictionary)
            codes = pc.fill_null(coded.indices, size).to_numpy().astype(np.int64)
            own = np.unique(rows * (size + 1) + codes) % (size + 1)
            df, cf = (np.bincount(x, minlength=size + 1)[:size] for x in (own, codes))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(df, pa.int64()), pa.array(cf, pa.int64())], names=["term", "df", "cf"])

    return docs.select(F.coalesce(tokens, F.array().cast("array<string>"))).mapInArrow(count, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _rows(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lists, and the list of each."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), np.repeat(np.arange(len(lists)), np.diff(offsets))


def apart(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether each row has a key of its own."""
    return docs.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where("n > 1 OR k IS NULL").isEmpty()


def row_bags(docs: DataFrame, vocab: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """(key, terms, counts) of each row: its terms of the dictionary by id and how often it has them; null for a row without any.

    The dictionary (at most keep_n rows) goes to every task; nothing is exchanged.
    """
    held = vocab.select("term", "term_id").toArrow()
    known, ids = held["term"].combine_chunks().cast(pa.string()), held["term_id"].to_numpy().astype(np.int64)
    size = int(ids.max()) + 1 if len(ids) else 1
    schema = pa.schema([("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, rows = _rows(batch.column(1))
            at = pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy()
            codes, counts = np.unique(rows[at >= 0] * size + ids[at[at >= 0]], return_counts=True)
            sizes = np.bincount(codes // size, minlength=batch.num_rows)
            ends, none = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(sizes == 0)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64()), type=f.type, mask=none) for x, f in zip((codes % size, counts), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[key, "terms", "counts"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.coalesce(tokens, F.array().cast("array<string>")).alias("t")).mapInArrow(count, f"{key} {kind}, terms array<long>, counts array<long>")


def frequency(counts: DataFrame) -> DataFrame:
    """The same from counts (doc_id, term, tf), which are worth storing where they are read again: texts are then split once."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def vocabulary_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row: documents, tokens, types, and least, upper-median, greatest and mean tokens per document."""
    from .corpus import nearest_rank

    sizes = docs.select(F.lit(1).alias("g"), F.size(tokens).cast("long").alias("v"))
    stats = nearest_rank(sizes, ["g"], "v", {"median": 0.5})
    empty = sizes.agg(F.count_if(F.col("v") == 0).cast("long").alias("empty"), F.sum("v").alias("tokens"))
    types = exploded(docs, tokens).agg(F.count_distinct("term").alias("types"))
    return stats.crossJoin(empty).crossJoin(types).select("n", "tokens", "types", "min", "median", "max", F.round("mean", 6).alias("mean"), "empty")


def dictionary(df: DataFrame, documents: int | Column, no_below: int = 5, no_above: float = 0.5, keep_n: int = 50_000) -> DataFrame:
    """(term_id, term, df, cf): terms in enough but not too many documents, the keep_n most frequent, ids dense by term.

    The rows that get ids are at most keep_n.
    """
    kept = df.where((F.col("df") >= no_below) & (F.col("df") <= no_above * F.lit(documents))).orderBy(F.desc("df"), "term").limit(keep_n)
    return kept.select((F.row_number().over(Window.orderBy("term")) - 1).cast("long").alias("term_id"), "term", "df", "cf")


def bow(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, term_id, tf) of the terms in the dictionary, which is broadcast: it has at most keep_n rows, so counts stay where they are."""
    return counts.join(F.broadcast(vocab.select("term", "term_id")), "term").select("doc_id", "term_id", "tf")


#: A term in more than one of so many documents is hot: its rows are spread over tasks and its df broadcast.
HOT = 200


def tfidf(counts: DataFrame, df: DataFrame, documents: int | Column) -> DataFrame:
    """(doc_id, term, tf, df, weight): tf * log2(N / df), scaled to unit length per document.

    The df of hot terms, of which a document can hold so many that HOT times its
    length bounds them, are broadcast; the others meet their rows by a shuffle in which
    no term has more than one in HOT of the documents.
    """
    df = df.select("term", "df")
    hot = F.col("df") > F.lit(documents) / HOT
    often = df.where(hot).select("term", F.col("df").alias("often"))
    marked = counts.join(F.broadcast(often), "term", "left")
    rare = marked.where("often IS NULL").drop("often").join(df.where(~hot), "term")
    raw = marked.where("often IS NOT NULL").withColumnRenamed("often", "df").select(*rare.columns).unionByName(rare)
    raw = raw.withColumn("w", F.col("tf") * F.log2(F.lit(documents) / F.col("df")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.withColumn("weight", F.when(norm > 0, F.col("w") / norm).otherwise(0.0)).drop("w")


def top_terms(weights: DataFrame, part: str, weight: str, n: int) -> DataFrame:
    """The n heaviest terms of each part, ranked; ties by term. Weights are compared at nine decimals."""
    order = Window.partitionBy(part).orderBy(F.desc(F.round(weight, 9)), "term")
    return weights.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


#: Pairs that a task counts before it packs them, and words that may go to every task.
PAIRS, WORDS = 4_000_000, 5_000_000


def _following(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): the place in known of each token of the lists, or -1, and the indices of tokens that, with the next of their list, are both known."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    ids = pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy().astype(np.int64)
    both = np.zeros(len(ids), dtype=bool)
    both[:-1] = (ids[:-1] >= 0) & (ids[1:] >= 0)
    ends = offsets[1:] - offsets[0]
    both[ends[ends > 0] - 1] = False
    return ids, np.flatnonzero(both)


def _packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending pairs (first id << 32 | second) and their counts, compressed: steps of the first, then the seconds, byte by byte place."""
    columns = np.stack([np.diff(codes >> 32, prepend=0), codes & 0xFFFFFFFF, counts]).astype("<u4")
    return len(codes).to_bytes(8, "little") + pa.compress(columns.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], decompressed_size=12 * n, codec="zstd", asbytes=True), np.uint8)
    step, second, counts = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(3, n).astype(np.int64)
    return np.cumsum(step) << 32 | second, counts


def _summed(codes: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with the sums of their counts (1 each without any)."""
    joined = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
    if counts is None:
        return np.unique(joined, return_counts=True)
    order = np.argsort(joined, kind="stable")
    joined, weights = joined[order], np.concatenate(counts)[order] if counts else joined
    starts = np.flatnonzero(np.diff(joined, prepend=-1))
    return joined[starts], np.add.reduceat(weights, starts) if len(starts) else weights


def bigram_scores(docs: DataFrame, tokens: str = "tokens", min_count: int = 10, threshold: float = 20.0) -> DataFrame:
    """(a, b, n, score) of adjacent pairs: (n - min_count) * types / (n_a * n_b), above the threshold.

    Only words of more than min_count occurrences can be in such a pair, and only pairs that reach the threshold where
    the rarer word never stands elsewhere. These words go to every task and get numbers; a task counts pairs of numbers and sends
    them sorted and compressed, a few bytes a pair, dealt by the first word. Beyond WORDS such words pairs are joined by the words themselves.
    """
    words = cut(exploded(docs, tokens).groupBy("term").agg(F.count("*").alias("c")))
    types, total = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    often = words.where(F.col("c") > min_count)
    if often.count() > WORDS:
        return _joined_scores(docs, words, types, tokens, min_count, threshold)
    held = often.orderBy(F.desc("c"), "term").toArrow()
    known, c = held["term"].combine_chunks().cast(pa.string()), held["c"].to_numpy().astype(float)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PAIRS))

    def score(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (n - min_count) * float(types) / c[a] / c[b]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, size = [], 0

        def send() -> pa.RecordBatch:
            own, counts = _summed(codes)
            order = np.argsort((own >> 32) % buckets, kind="stable")
            bucket, starts = np.unique((own[order] >> 32) % buckets, return_index=True)
            parts = [_packed(own[x], counts[x]) for x in np.split(order, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "pairs"])

        for batch in batches:
            ids, at = _following(batch.column(0), known)
            a, b = ids[at], ids[at + 1]
            hope = score(np.minimum(c[a], c[b]), a, b) > threshold
            codes.append(a[hope] << 32 | b[hope])
            size += len(codes[-1])
            if size > PAIRS:
                yield send()
                codes, size = [], 0
        if size:
            yield send()

    def count(group: pa.Table) -> pa.Table:
        parts = [_unpacked(p.as_py()) for p in group["pairs"]]
        codes, n = _summed([x for x, _ in parts], [y for _, y in parts])
        a, b = codes >> 32, codes & 0xFFFFFFFF
        kept = n > min_count
        a, b, n = a[kept], b[kept], n[kept]
        value = score(n, a, b)
        kept = value > threshold
        return pa.table({"a": known.take(pa.array(a[kept])), "b": known.take(pa.array(b[kept])), "n": n[kept], "score": value[kept]})

    rows = docs.select(F.coalesce(tokens, F.array().cast("array<string>"))).mapInArrow(pack, "bucket int, pairs binary")
    return rows.groupBy("bucket").applyInArrow(count, "a string, b string, n long, score double")


def _joined_scores(docs: DataFrame, words: DataFrame, types: int, tokens: str, min_count: int, threshold: float) -> DataFrame:
    """The same by joins, whatever the number of words."""
    pairs = docs.select(F.explode_outer(F.arrays_zip(F.col(tokens).alias("a"), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))).alias("b"))).alias("p"))
    pairs = pairs.select("p.a", "p.b").where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") > min_count)
    left, right = words.select(F.col("term").alias("a"), F.col("c").alias("ca")), words.select(F.col("term").alias("b"), F.col("c").alias("cb"))
    score = (F.col("n") - min_count).cast("double") * F.lit(types) / F.col("ca") / F.col("cb")
    return pairs.join(left, "a").join(right, "b").withColumn("score", score).where(F.col("score") > threshold).select("a", "b", "n", "score")


def _fold(row, known):
    if row is None:
        return None
    out, k, row = [], 0, list(row)
    while k < len(row):
        if k + 1 < len(row) and (row[k], row[k + 1]) in known:
            out.append(f"{row[k]}_{row[k + 1]}")
            k += 2
        else:
            out.append(row[k])
            k += 1
    return out


def _with_phrases(lists: pa.Array, known: pa.Array, codes: np.ndarray) -> pa.Array:
    """Lists of tokens with the pairs in codes (ascending, places in known) joined: of a run of overlapping pairs, every other one from the first."""
    ids, at = _following(lists, known)
    wanted = ids[at] << 32 | ids[at + 1]
    if not len(at) or not len(codes):
        return lists
    at = at[codes[np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)] == wanted]
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    run = np.repeat(first, np.diff(first, append=len(at)))
    at = at[(np.arange(len(at)) - run) % 2 == 0]
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    joined = pc.binary_join_element_wise(values.take(pa.array(at)), values.take(pa.array(at + 1)), "_")
    source, stays = np.arange(len(values)), np.ones(len(values), dtype=bool)
    source[at], stays[at + 1] = len(values) + np.arange(len(at)), False
    before = np.append(0, np.cumsum(stays))
    ends = pa.array(before[offsets - offsets[0]].astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.concat_arrays([values, joined]).take(pa.array(source[stays])), type=lists.type, mask=lists.is_null() if lists.null_count else None)


def apply_phrases(tokens: Column, phrases: Iterable[tuple[str, str]]) -> Column:
    """Joins phrase pairs from left to right, each token at most once; the phrase set is a fitted model."""
    known = frozenset(phrases)

    @F.pandas_udf("array<string>")
    def fold(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: _fold(row, known))

    return fold(tokens)


def learn_phrases(docs: DataFrame, tokens: str = "tokens", min_count: int = 10, threshold: float = 20.0) -> DataFrame:
    """The phrase model (a, b): every pair above the thresholds."""
    return bigram_scores(docs, tokens, min_count, threshold).select("a", "b")


def join_phrases(docs: DataFrame, phrases: DataFrame, tokens: str = "tokens", key: str = "doc_id", small: int = 2_000_000) -> DataFrame:
    """docs with phrase pairs (a, b) joined as by apply_phrases, whatever the number of phrases.

    Up to ``small`` phrases go to every task, as their words and a number a pair. More are joined to the
    distinct adjacent pairs of each key, and a row is folded with the phrases of its
    key; those of other rows of a repeated key are phrases too, so they do no harm.
    """
    phrases = phrases.select("a", "b")
    few = phrases.limit(small + 1).toArrow()
    if few.num_rows <= small:
        a, b = (few[x].combine_chunks().cast(pa.string()) for x in ("a", "b"))
        known = pc.unique(pa.concat_arrays([a, b]))
        codes = np.unique(pc.index_in(a, value_set=known).to_numpy().astype(np.int64) << 32 | pc.index_in(b, value_set=known).to_numpy().astype(np.int64))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(tokens)
                yield batch.set_column(at, batch.schema.field(at), _with_phrases(batch.column(at), known, codes))

        return docs.mapInArrow(join, docs.schema)

    @F.pandas_udf("array<string>")
    def fold(rows: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([_fold(row, frozenset() if pairs is None else {tuple(p) for p in pairs}) for row, pairs in zip(rows, own, strict=True)], dtype=object)

    pairs = docs.select(key, F.explode_outer(F.arrays_zip(F.col(tokens).alias("a"), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))).alias("b"))).alias("p"))
    pairs = pairs.select(key, "p.a", "p.b").where("b is not null").distinct().join(phrases, ["a", "b"], "left_semi")
    own = pairs.groupBy(F.col(key).alias("__key")).agg(F.collect_list(F.array("a", "b")).alias("__own"))
    joined = docs.join(own, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.withColumn(tokens, fold(F.col(tokens), F.col("__own"))).select(*docs.columns)


def cooccurrence(docs: DataFrame, terms: DataFrame, least: int, tokens: str = "tokens") -> DataFrame:
    """(a, b, n) of term pairs a < b in at least so many documents; terms (a few rows) bound the pairs of a document."""
    own = docs.select("doc_id", F.explode_outer(F.array_distinct(tokens)).alias("term")).join(F.broadcast(terms.select("term")), "term", "left_semi")
    sets = own.groupBy("doc_id").agg(F.sort_array(F.collect_set("term")).alias("t"))
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def degrees(edges: DataFrame) -> DataFrame:
    """(term, degree, weight) of a weighted undirected graph."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("term"), "n")
    return ends.groupBy("term").agg(F.count("*").alias("degree"), F.sum("n").alias("weight"))


def grams(docs: DataFrame, longest: int, tokens: str = "tokens") -> DataFrame:
    """docs with the runs of 1 to longest of its tokens, joined by blanks; runs stay inside a document."""
    none = F.array().cast("array<string>")
    t = F.coalesce(tokens, none)

    def runs(n: int) -> Column:
        if n == 2:
            return F.filter(F.zip_with(t, F.slice(t, F.lit(2), F.greatest(F.size(t), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(none)

    sized = [t, *([runs(2)] if longest > 1 else []), *(runs(n) for n in range(3, longest + 1))]
    return docs.withColumn(tokens, F.concat(*sized))


def class_tfidf(docs: DataFrame, part: str, n: int = 10, tokens: str = "tokens", longest: int = 1, least: int = 1) -> DataFrame:
    """(part, term, weight, rank): tf in the class * ln(1 + mean tokens per class / occurrences of the term).

    Terms are runs of up to longest tokens, and count if at least so many classes have them.
    """
    docs = docs.where(F.col(part).isNotNull())
    tf = exploded(grams(docs, longest, tokens) if longest > 1 else docs, tokens, part).groupBy(part, "term").agg(F.count("*").alias("tf"))
    # a term's row holds its classes, so the table is made and shuffled by term once, and stored for the mean
    own = tf.groupBy("term").agg(F.sum("tf").alias("f"), F.collect_list(F.struct(part, "tf")).alias("own")).where(F.size("own") >= least)
    tf = cut(own).select("term", "f", F.inline("own"))
    mean = tf.agg((F.sum("tf") / F.count_distinct(part)).alias("mean"))
    weighed = tf.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("tf") * F.log(1 + F.col("mean") / F.col("f")))
    return top_terms(weighed, part, "weight", n).select(part, "term", "weight", "rank")


def commonest(df: DataFrame, n: int = 25, vocabulary: DataFrame | None = None) -> DataFrame:
    """(rank, term, df, cf) of the n terms (of vocabulary, if given) in most documents; ties by term."""
    if vocabulary is not None:
        df = df.join(vocabulary.select("term"), "term", "left_semi")
    first = df.orderBy(F.desc("df"), "term").limit(n)
    return first.select(F.row_number().over(Window.orderBy(F.desc("df"), "term")).cast("long").alias("rank"), "term", "df", "cf")  # n rows
