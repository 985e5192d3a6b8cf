"""Phrase collocation mining with pivot partitioning, as in MG-FSM.

Every phrase belongs to its rarest word, its pivot (of equal ones the leftmost). For
each occurrence of a word, the text around it is rewritten to the fragment in which
it is the rarest: at most three words on either side, ended by a rarer word, by one too
rare for any phrase or by the end of the piece. Fragments of a pivot go to one
place, equal ones of a chunk of text as one with a count; there all phrases that
hold the pivot are counted, so no phrase is counted twice, and each count is whole.

Rarity comes from a table of hashed counts of fixed size, so it takes the same
memory for any vocabulary. Words that share a counter only change which word is the
pivot, never a count. A pivot of very many occurrences goes to several places, whose
counts are added up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from . import arrow_text as at
from .runtime import small_or_shuffled, stored

#: Counters of hashed words; a number of 32 bits each.
COUNTERS = 1 << 21
#: Bytes of text that are taken apart at a time; a piece without a mark is never cut.
CHUNK_BYTES = 1 << 22
#: Occurrences of a pivot that go to one place.
SPLIT = 2_000_000
#: Fragments in a packed row (their words have numbers of 16 bits), and fragments counted at a time.
PACKED, COUNTED = 9_000, 1_000_000
#: Places of the ranking inside a language, each of which keeps its first rows.
PLACES = 64
SIDE = 3
BLANK, BREAK = 0x20, 0xFF  # the second never occurs in UTF-8

_CODE = np.arange(256, dtype=np.uint8)
_CODE[65:91] += 32
_CODE[0x09] = BLANK
_CODE[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK


@dataclass(frozen=True)
class Collocations:
    """least: occurrences of a phrase; longest: its words; percent: a phrase goes if a longer one around it has this share of its occurrences."""

    least: int = 30
    percent: int = 80
    first: int = 2000
    scale: int = 2_000_000


LONGEST = SIDE + 1


@dataclass
class Chunk:
    """Words of some text: codes into vocabulary, and the number of the piece each stands in."""

    codes: np.ndarray
    vocabulary: pa.Array
    piece: np.ndarray


def chunks(texts: pa.Array) -> Iterator[Chunk]:
    data, bounds = at.raw(texts)
    data = _CODE[data]
    ends = np.union1d(np.flatnonzero(data == BREAK) + 1, bounds)
    i = 0
    while i < len(data):
        j = int(ends[min(np.searchsorted(ends, i + CHUNK_BYTES), len(ends) - 1)])
        part, edges = data[i:j], bounds[(bounds > i) & (bounds < j)] - i
        marks = part == BREAK
        flags = np.zeros(len(part) + 2, dtype=bool)
        flags[1:-1] = ~(marks | (part == BLANK))
        edge = np.zeros(len(part) + 1, dtype=bool)
        edge[edges] = True
        start = np.flatnonzero(flags[1:-1] & (~flags[:-2] | edge[:-1]))
        end = np.flatnonzero(flags[1:-1] & (~flags[2:] | edge[1:])) + 1
        offsets = np.zeros(len(start) + 1, dtype=np.int32)
        np.cumsum(end - start, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part[flags[1:-1]]))]).dictionary_encode()
        piece = np.cumsum(marks)[start] + np.searchsorted(edges, start, side="right")
        yield Chunk(words.indices.to_numpy().astype(np.int64), words.dictionary, piece)
        i = j


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts) of a batch."""
    languages, texts = batch.column(0), at.text_column(batch, "text")
    for language in languages.unique().to_pylist():
        yield language, texts.filter(pc.equal(languages, language))


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of docs (lang, text): one row a word and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language, texts in by_language(batch):
                for c in chunks(texts):
                    n = np.bincount(c.codes, minlength=len(c.vocabulary))
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(n), pa.string()), c.vocabulary.cast(pa.string()), pa.array(n)], names=["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def counters(words: DataFrame, least: int) -> np.ndarray:
    """Occurrences by hashed word; counters under least are 0. At most COUNTERS pairs of numbers reach the driver."""
    hashed = F.crc32(F.concat_ws(" ", "lang", "word").cast("binary")).bitwiseAND(COUNTERS - 1)
    sums = words.groupBy(hashed.alias("at")).agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    out = np.zeros(COUNTERS, dtype=np.uint32)
    out[sums["at"].to_numpy()] = np.minimum(sums["n"].to_numpy(), 2**32 - 1)
    return out


def fragments(codes: np.ndarray, key: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Rows of 2 SIDE + 1 codes, -1 where there is none: for each word, which stands in the middle, the neighbours that are less rare.

    A word's key is larger the more frequent it is, and 0 if no phrase can hold it. To the left keys
    must be larger, to the right at least as large. Words without neighbours are left out.
    """
    keys, n = key[codes], len(codes)
    left, right = np.zeros(n, dtype=np.int8), np.zeros(n, dtype=np.int8)
    to_left, to_right = keys > 0, keys > 0
    for d in range(1, SIDE + 1):
        near = piece[:-d] == piece[d:]
        to_left[d:] &= near & (keys[:-d] > keys[d:])
        to_left[:d] = False
        to_right[: max(0, n - d)] &= near & (keys[d:] >= keys[:-d])
        to_right[max(0, n - d) :] = False
        left += to_left
        right += to_right
    places = np.flatnonzero(left + right)
    out = np.full((len(places), 2 * SIDE + 1), -1, dtype=np.int32)
    for d in range(-SIDE, SIDE + 1):
        held = (left if d < 0 else right)[places] >= abs(d)
        out[held, SIDE + d] = codes[places[held] + d]
    return out


_ODD = at.mix(np.arange(2 * SIDE + 1, dtype=np.uint64) + np.uint64(99)) | np.uint64(1)


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, counts, hashes): equal rows as one. Rows are compared whole; should two that differ share a hash, some stay apart, which changes no sum."""
    hashes = at.mix(((rows + 1).astype(np.uint64) * _ODD).sum(axis=1, dtype=np.uint64))
    order = np.argsort(hashes)
    rows = rows[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    return rows[starts], np.diff(np.append(starts, len(rows))), hashes[order][starts]


PACK = {"lang": pa.string(), "route": pa.int32(), "whole": pa.bool_(), "words": pa.binary(), "codes": pa.binary(), "shape": pa.binary(), "counts": pa.binary()}


def packed(language: str, c: Chunk, table: np.ndarray, least: int, routes: int) -> Iterator[dict]:
    """The fragments of a chunk, packed by the place they go to."""
    names = c.vocabulary.to_pylist()
    seed = zlib.crc32(language.encode() + b" ")
    hashed = np.fromiter((zlib.crc32(w, seed) for w in names), dtype=np.uint64, count=len(names))
    often = table[hashed & np.uint64(COUNTERS - 1)].astype(np.uint64)
    key = np.where(often >= least, often << np.uint64(32) | hashed, np.uint64(0))
    rows, counts, hashes = distinct(fragments(c.codes, key, c.piece))
    if not len(rows):
        return
    pivot = rows[:, SIDE]
    places = np.uint64(1) + often[pivot] // np.uint64(SPLIT)
    route = ((hashed[pivot] + hashes % places * np.uint64(0x9E3779B1)) % np.uint64(routes)).astype(np.int64) * 2 + (places == 1)
    order = np.argsort(route, kind="stable")
    rows, counts, route = rows[order], counts[order], route[order]
    held = rows >= 0
    shape = (held[:, :SIDE].sum(axis=1) * (SIDE + 1) + held[:, SIDE + 1 :].sum(axis=1)).astype(np.uint8)
    starts = np.flatnonzero(np.diff(route, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(rows)), strict=True):
        for i in range(a, b, PACKED):
            j = min(b, i + PACKED)
            used, codes = np.unique(rows[i:j][held[i:j]], return_inverse=True)
            yield {
                "lang": language, "route": int(route[i] // 2), "whole": bool(route[i] % 2), "words": b" ".join(names[k] for k in used),
                "codes": codes.astype(np.uint16).tobytes(), "shape": shape[i:j].tobytes(), "counts": counts[i:j].astype(np.uint32).tobytes(),
            }


def _unpacked(blobs: list[dict]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, table of fragments, left, right, counts)."""
    number: dict[bytes, int] = {}
    flat = []
    for b in blobs:
        own = np.fromiter((number.setdefault(w, len(number)) for w in b["words"].split(b" ")), dtype=np.int64)
        flat.append(own[np.frombuffer(b["codes"], dtype=np.uint16)])
    codes = np.concatenate(flat)
    shape = np.frombuffer(b"".join(b["shape"] for b in blobs), dtype=np.uint8).astype(np.int64)
    counts = np.frombuffer(b"".join(b["counts"] for b in blobs), dtype=np.uint32).astype(np.int64)
    left, right = shape // (SIDE + 1), shape % (SIDE + 1)
    middle = np.cumsum(left + right + 1) - right - 1
    table = np.full((len(shape), 2 * SIDE + 1), -1, dtype=np.int64)
    for d in range(-SIDE, SIDE + 1):
        held = (left if d < 0 else right) >= abs(d)
        table[held, SIDE + d] = codes[middle[held] + d]
    return list(number), table, left, right, counts


def numbered(columns: np.ndarray, size: int) -> np.ndarray:
    """A number for each row of numbers below size, equal for equal rows only."""
    out, most = columns[:, 0], size
    for k in range(1, columns.shape[1]):
        if most > 2**62 // size:
            known, out = np.unique(out, return_inverse=True)
            most = len(known)
        out, most = out * size + columns[:, k], most * size
    return out


def mined(blobs: list[dict], least: int) -> Iterator[tuple[str, int, int]]:
    """(phrase, words, occurrences) of the phrases of 2 to LONGEST words that hold the middle of a fragment; those under least are left out."""
    words, table, left, right, counts = _unpacked(blobs)
    for size in range(2, LONGEST + 1):
        rows, weights = [], []
        for before in range(size):
            held = (left >= before) & (right >= size - 1 - before)
            rows.append(table[held, SIDE - before : SIDE - before + size])
            weights.append(counts[held])
        grams, weight = np.concatenate(rows), np.concatenate(weights)
        if not len(grams):
            continue
        number = numbered(grams, len(words))
        order = np.argsort(number, kind="stable")
        starts = np.flatnonzero(np.diff(number[order], prepend=-1))
        sums = np.add.reduceat(weight[order], starts)
        for k in np.flatnonzero(sums >= least):
            yield b" ".join(words[w] for w in grams[order[starts[k]]]).decode(), size, int(sums[k])


def count_phrases(docs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, size, f) of all phrases of 2 to LONGEST words in docs (lang, text) that occur least times or more."""
    spark = docs.sparkSession
    routes = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rarity = spark.sparkContext.broadcast(counters(words, least))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language, texts in by_language(batch):
                for c in chunks(texts):
                    made = list(packed(language, c, rarity.value, least, routes))
                    yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in PACK.items()], names=list(PACK))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, blobs, rows, parted = None, [], 0, False

        def out(lowest: int) -> pa.RecordBatch:
            found = list(mined(blobs, lowest))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array([place[0]] * len(found), pa.string()), *(pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True))],
                names=["lang", "phrase", "size", "f"],
            )

        for batch in batches:
            for b in batch.to_pylist():
                new = b["lang"], b["route"], b["whole"]
                if blobs and (new != place or rows >= COUNTED):  # a place too full for one go is counted in parts, none of which is final
                    parted = new == place or parted
                    yield out(least if place[2] and not parted else 0)
                    parted = parted and new == place
                    blobs, rows = [], 0
                place = new
                blobs.append(b)
                rows += len(b["shape"])
        if blobs:
            yield out(least if place[2] and not parted else 0)

    kinds = ", ".join(f"{k} {'string' if t == pa.string() else 'int' if t == pa.int32() else 'boolean' if t == pa.bool_() else 'binary'}" for k, t in PACK.items())
    routed = docs.mapInArrow(rewrite, kinds).repartition("route").sortWithinPartitions("lang", "route", "whole")
    counted = routed.mapInArrow(mine, "lang string, phrase string, size int, f long").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return counted.where(F.col("f") >= least)


def scored(grams: DataFrame, p: Collocations) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates among grams (lang, phrase, size, f) that no longer one covers."""
    found = grams.where("size > 1")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"x": F.expr("substring_index(phrase, ' ', k)"), "y": F.expr("substring_index(phrase, ' ', k - size)")})
    rows = grams.count()
    part = lambda key, count: small_or_shuffled(grams.select("lang", F.col("phrase").alias(key), F.col("f").alias(count)), rows)
    cuts = cuts.join(part("x", "l"), ["lang", "x"]).join(part("y", "r"), ["lang", "y"])
    score = F.expr(f"CAST(f AS DECIMAL(38, 0)) * {p.scale} div (CAST(l AS DECIMAL(38, 0)) + r)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = found.where("size > 2").withColumn("phrase", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    best = best.join(longer, ["lang", "phrase"], "left")
    covered = F.expr(f"100 * CAST(around AS DECIMAL(38, 0)) >= {p.percent} * CAST(f AS DECIMAL(38, 0))")
    return best.where(F.col("around").isNull() | ~covered).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def first_of_each(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows of each lang with their rank; a lang is ranked in PLACES before it is as a whole, so at most PLACES * n rows of it meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = F.pmod(F.crc32(F.col("phrase").cast("binary")), F.lit(PLACES))
    best = rows.withColumn("place", place).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "place").orderBy(*order))).where(F.col("rank") <= n)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= n).drop("place")


def collocations(docs: DataFrame, p: Collocations = Collocations()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs (lang, text, ...): each language's best phrases of 2 to 4 words.

    A null text is empty, a null language is und. Occurrences count whole, overlaps and repeated
    rows included; of cuts with the same score the first counts; ties rank by occurrences, then
    by the phrase's bytes. That a longer candidate covers a phrase is seen from those with one word
    more: what a still longer one covers, one of these covers. A very long text is taken
    apart at its marks. An empty table, or one without a phrase of enough
    occurrences, gives no rows; other columns are ignored.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = stored(count_words(docs), "words")
    singles = words.where(F.col("n") >= p.least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))
    grams = stored(count_phrases(docs, words, p.least).unionByName(singles), "phrases")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    best = first_of_each(scored(grams, p), p.first).join(small_or_shuffled(totals, totals.count()), "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_P = Collocations()
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_LETTERS.upper()}', '{_LETTERS}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS ({" UNION ALL ".join(f"SELECT lang, {n} AS size, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM words)" for n in range(1, LONGEST + 1))}),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT * FROM f WHERE f >= {_P.least}),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM frequent WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scores AS (SELECT c.lang, c.phrase, c.size, c.a, k, x.f AS l, y.f AS r, CAST({_P.scale}::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ') JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.lang = b.lang AND c.size > b.size AND 100::HUGEINT * c.a >= {_P.percent}::HUGEINT * b.a
  AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {_P.first}
"""
