"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Rolling (prefix-sum) hashes give every line and every n-gram of a batch of
texts at once; a sort per batch finds the repeated ones. A longer n-gram can
only repeat where a shorter one does, so the lengths after the first look at
those places alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread
from . import arrow_text as at
from .runtime import take_over

#: n-gram length in words -> the most hundredths of a text's word characters that may lie in repeated n-grams.
GRAM_LIMITS = {5: 45, 8: 35, 10: 32}
#: The same for characters of lines that equal an earlier line.
LINE_LIMIT = 30
#: Contract of the base rules.
MIN_WORDS, BASE_GRAM, BASE_LIMIT = 20, 8, 30
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), dtype=bool)
    ranked = keys[order]
    same[1:] = ranked[1:] == ranked[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    out, again = np.empty_like(same), np.empty_like(same)
    out[order], again[order] = twice, same
    return out, again


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts and verdicts of each text of a string array."""
    rows: list[dict[str, np.ndarray]] = [_measure(data, offsets) for _, _, data, offsets in at.parts(column)]
    if not rows:
        rows = [_measure(np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64))]
    return {k: np.concatenate([r[k] for r in rows]) for k in rows[0]}


def _measure(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    w = at.words_of(data, bounds)
    prefix = w.prefix()
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(at.code_points(data), out=points[1:])
    chars = points[w.end] - points[w.start]
    owner, texts = w.owner(), w.texts
    salt = at.mix(np.arange(texts, dtype=np.uint64))
    total = at.per_text(chars, w.first)
    out = {"n_words": w.counts().astype(np.int64), "word_chars": total}
    symbols = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_SYMBOLS[data], out=symbols[1:])
    out["n_symbols"] = symbols[bounds[1:]] - symbols[bounds[:-1]]

    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, bounds[1:]]))
    line_owner = np.repeat(np.arange(texts), np.diff(np.searchsorted(breaks, bounds)) + 1)
    word_at = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    full = word_at[1] > word_at[0]
    start, end, line_owner, lo, hi = start[full], end[full], line_owner[full], word_at[0][full], word_at[1][full]
    _, again = _repeated(at.mix(w.span_hash(start, end, prefix) ^ salt[line_owner]))
    done = np.zeros(len(chars) + 1, dtype=np.int64)
    np.cumsum(chars, out=done[1:])
    out["n_dup_lines"] = np.bincount(line_owner[again], minlength=texts).astype(np.int64)
    line_chars = np.bincount(line_owner[again], weights=(done[hi] - done[lo])[again], minlength=texts).astype(np.int64)

    hashes = w.span_hash(w.start, w.end, prefix)
    places, low = None, 100 * line_chars <= LINE_LIMIT * total
    for n, limit in GRAM_LIMITS.items():
        grams = at.ngram_hash(hashes, n)
        if places is None:
            places = np.arange(len(grams))
        places = places[places < len(grams)]
        places = places[owner[places] == owner[places + n - 1]]
        twice, _ = _repeated(at.mix(grams[places] ^ salt[owner[places]]))
        places = places[twice]
        depth = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(depth, places, 1)
        np.add.at(depth, places + n, -1)
        covered = np.cumsum(depth)[:-1] > 0
        if n == BASE_GRAM:
            out["n_repeat_words"] = at.per_text(covered, w.first)
        low &= 100 * at.per_text(np.where(covered, chars, 0), w.first) <= limit * total
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_LIMIT * out["n_words"])
    out["kept"] = ~out["base_failed"] & low
    return out


_KINDS = {"base_failed": "boolean", "kept": "boolean"}
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and the measures of its whole text.

    Null and blank texts have no words and fail. Ties and repeated rows are
    measured alike, row by row; an empty table gives no rows; other columns are
    ignored. A text longer than a chunk is measured alone, whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(at.text_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[f]) for f in FIELDS)], names=["doc_id", *FIELDS])

    schema = "doc_id long, " + ", ".join(f"{f} {_KINDS.get(f, 'long')}" for f in FIELDS)
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, schema)


def keep_passing(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text passes, with all their columns.

    Null, empty and blank texts fail; null ids, repeated rows and very long texts are
    judged like others, by their whole text; shares right at a limit pass; an empty
    table stays empty; columns of any name pass unchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over()
        for batch in batches:
            yield batch.filter(pa.array(measure(at.text_column(batch, "text"))["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op8_repetition(spark, sf_dir: str) -> DataFrame:
    return repetition_rules(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _oracle() -> str:
    grams = "\n".join(
        f"""g{n} AS (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM words)),
t{n} AS (SELECT doc_id, i FROM g{n} JOIN (SELECT doc_id, g FROM g{n} GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
p{n} AS (SELECT DISTINCT doc_id, i + k AS i FROM t{n}, (SELECT unnest(range({n})) AS k)),
c{n} AS (SELECT doc_id, count(*) AS n, sum(length(w[i])) AS c FROM p{n} JOIN words USING (doc_id) GROUP BY doc_id),"""
        for n in GRAM_LIMITS
    )
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in GRAM_LIMITS)
    low = " AND ".join(f"100 * coalesce(c{n}.c, 0) <= {limit} * word_chars" for n, limit in GRAM_LIMITS.items())
    return rf"""
WITH words AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM words),
lines AS (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
dup AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n, sum((n - 1) * length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) AS c FROM lines GROUP BY doc_id),
{grams}
joined AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines, CAST(coalesce(c{BASE_GRAM}.n, 0) AS BIGINT) AS n_repeat_words,
  100 * coalesce(dup.c, 0) <= {LINE_LIMIT} * word_chars AND {low} AS low
  FROM base LEFT JOIN dup USING (doc_id) {joins})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_LIMIT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_LIMIT} * n_words) AND low AS kept
FROM joined
"""


OP8_SQL = _oracle()
