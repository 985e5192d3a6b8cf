"""Document vectors that keep meaning: a truncated singular value decomposition of TF-IDF weights by a randomised range finder.

Every pass multiplies the table of documents by a narrow basis of term space and, where the basis is refined,
back by its transpose. What leaves a task is a matrix of terms times places, summed range by range;
the dictionary bounds it, so the driver holds that matrix whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topic_stack import SLICE


def weighted_bags(docs: DataFrame, weights: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, terms, weights) of docs (doc_id), from weights (doc_id, term, weight) of the dictionary's terms; null for a document without any."""
    rows = weights.join(F.broadcast(vocab.select("term", "term_id")), "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term_id", "weight"))).alias("b"))
    rows = rows.select("doc_id", F.col("b.term_id").cast("array<int>").alias("terms"), F.col("b.weight").alias("weights"))
    return docs.select("doc_id").join(rows, "doc_id", "left")


#: Entries of documents that are multiplied together, so that memory does not follow the size of a batch.
ENTRIES = 32_768


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with at most ENTRIES entries, or a single row with more."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(batch.schema.get_field_index("terms"))), 0).to_numpy().astype(np.int64))
        row = 0
        while row < len(ends):
            done = ends[row - 1] if row else 0
            last = max(row + 1, int(np.searchsorted(ends, done + ENTRIES, side="right")))
            yield batch.slice(row, last - row)
            row = last


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, weight) of every entry of a batch."""
    terms, weights = (batch.column(batch.schema.get_field_index(c)) for c in ("terms", "weights"))
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), terms.flatten().to_numpy(), weights.flatten().to_numpy()


def _summed(keys: np.ndarray, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Adds rows to out at their keys, equal keys first among themselves."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    if len(starts):
        out[keys[order][starts]] += np.add.reduceat(rows[order], starts, axis=0)
    return out


def _projected(batch: pa.RecordBatch, basis: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    doc, term, weight = entries = _flat(batch)
    out = np.zeros((batch.num_rows, basis.shape[1]))
    starts = np.flatnonzero(np.diff(doc, prepend=-1))  # entries are in the order of documents
    if len(starts):
        out[doc[starts]] = np.add.reduceat(weight[:, None] * basis[term], starts, axis=0)
    return out, entries


def _total(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of the matrices that make builds from each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make(batches)
        pieces = [made[s : s + SLICE].tobytes() for s in range(0, len(made), SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["slice", "m"])

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"slice": group["slice"][:1], "m": pa.array([sum(np.frombuffer(m.as_py()) for m in group["m"]).tobytes()], pa.binary())})

    out = rows.mapInArrow(run, "slice int, m binary").groupBy("slice").applyInArrow(add, "slice int, m binary").collect()
    return np.frombuffer(b"".join(r["m"] for r in sorted(out))).reshape(shape) if out else np.zeros(shape)


def latent(rows: DataFrame, terms: int, k: int = 16, more: int = 10, refine: int = 2, seed: int = 42) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(doc_id, embedding) of rows (doc_id, terms, weights), the k greatest singular values, and the terms' directions (terms, k).

    An embedding is the document's row of the left singular vectors times the values, zeros
    for a document without terms; signs are those that make each direction's largest
    component positive. rows are read refine + 2 times, store them before.
    """
    context, width = rows.sparkSession.sparkContext, min(terms, k + more)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    for _ in range(1 + refine):
        shared = context.broadcast(basis)

        def back(batches, shared=shared):
            out = np.zeros((terms, width))
            for batch in _pieces(batches):
                y, (doc, term, weight) = _projected(batch, shared.value)
                _summed(term, weight[:, None] * y[doc], out)
            return out

        basis = np.linalg.qr(_total(rows, back, (terms, width)))[0]
    shared = context.broadcast(basis)

    def gram(batches):
        out = np.zeros((width, width))
        for batch in _pieces(batches):
            y, _ = _projected(batch, shared.value)
            out += y.T @ y
        return out

    values, turn = np.linalg.eigh(_total(rows, gram, (width, width)))
    first = np.argsort(-values)[: min(k, width)]
    directions = basis @ turn[:, first]
    directions *= np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(first))])
    final = context.broadcast(directions)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            y, _ = _projected(batch, final.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "embedding"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "terms", "weights").mapInArrow(embed, f"doc_id {kind}, embedding array<double>"), np.sqrt(np.maximum(values[first], 0)), directions
