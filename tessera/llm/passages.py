"""Quality classifier: attention-based multiple-instance learning over passages.

A text is a bag of passages of 64 words. Each passage is encoded from its words and
its runs of three bytes inside words, both hashed into shares of buckets, and from
counts of word shapes, repeats, symbols and lengths; gated attention (Ilse et al.,
2018) weighs the encoded passages, and a logistic layer scores their weighted mean.
Only documents are labelled: attention learns which passages tell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import arrow_text as at
from . import labelled
from .runtime import stored, take_over

#: At most so many labelled rows, and passages of them, are learned from; a bag for learning has at most so many passages.
TRAIN_ROWS, TRAIN_PASSAGES, BAG_PASSAGES = 6_000, 60_000, 2_048
MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.7
PASSAGE = 64
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 12, 12, 128, 0.005, 1e-3, 20_240_611

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other letters, 1 upper, 2 digit, 3 sentence marks, 4 !?, 5 symbols, 6 other ASCII marks
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[list(b".,;:")] = 3
_CLASS[list(b"!?")] = 4
_CLASS[list(b"#*$%&|<>~^=+_@\\")] = 5
_CLASS[list(b"\"'()[]{}-/`")] = 6
_SHAPES = 16
#: Buckets of hashed words, and of hashed runs of bytes.
WORDS, RUNS = 256, 256
COUNTS = 12 + _SHAPES
FEATURES = COUNTS + WORDS + RUNS


def encode(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages of every text (at least one)."""
    w = at.words_of(data, bounds)
    words = w.counts()
    bags = np.maximum(1, -(-words // PASSAGE))
    first_bag = np.concatenate([[0], np.cumsum(bags)])
    out = np.zeros((first_bag[-1], FEATURES), dtype=np.float32)
    if not len(w.start):
        return out, bags
    owner = w.owner()
    bag = first_bag[owner] + (np.arange(len(owner)) - w.first[owner]) // PASSAGE
    points = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(at.code_points(data), out=points[1:])
    size = points[w.end] - points[w.start]
    kinds = _CLASS[data]
    share = []
    for k in range(1, 7):
        total = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(kinds == k, out=total[1:])
        share.append(total[w.end] - total[w.start])
    upper, digit, mark, shout, symbol, other = share
    hashes = w.span_hash(w.start, w.end)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    count = np.bincount(bag, minlength=len(out)).astype(np.float32)
    # repeats of a word inside its passage, through sorted (passage, word) pairs
    pair = at.mix(hashes ^ at.mix(bag.astype(np.uint64)))
    order = np.argsort(pair, kind="stable")
    again = np.zeros(len(pair), dtype=bool)
    again[order[1:]] = pair[order[1:]] == pair[order[:-1]]
    letters = size - digit - mark - shout - symbol - other
    shape = (upper > 0).astype(np.int64) + 2 * (upper * 2 > letters + upper) + 4 * (symbol + shout > 0) + 8 * (size > 7)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(bag, weights=x, minlength=len(out)) / np.maximum(count, 1)

    length = np.maximum(1, mean(size))
    out[:, 0] = np.log1p(count) / np.log(PASSAGE + 1)
    out[:, 1] = length / 10
    for k, x in enumerate((upper, digit, mark, shout, symbol, other), start=2):
        out[:, k] = mean(x) / length
    out[:, 8] = mean(same)
    out[:, 9] = mean(again)
    out[:, 10] = mean(size == symbol)
    breaks = np.flatnonzero(data == 10)
    lines = np.searchsorted(breaks, np.append(w.start[1:], len(data))) - np.searchsorted(breaks, w.start)
    out[:, 11] = np.minimum(1, mean(lines > 0) * 4)
    table = np.bincount(bag * _SHAPES + shape, minlength=len(out) * _SHAPES).reshape(-1, _SHAPES)
    out[:, 12:COUNTS] = table / np.maximum(count, 1)[:, None]

    low = at.Words(at.lower_ascii(data), bounds, w.start, w.end, w.first)
    _shares(out[:, COUNTS : COUNTS + WORDS], bag, low.span_hash(w.start, w.end))
    # every byte with two more after it in its word
    runs = np.maximum(w.end - w.start - 2, 0)
    word = np.repeat(np.arange(len(runs)), runs)
    at_byte = np.arange(len(word)) - np.repeat(np.cumsum(runs) - runs, runs) + w.start[word]
    d = low.data.astype(np.uint64)
    _shares(out[:, COUNTS + WORDS :], bag[word], at.mix(d[at_byte] << np.uint64(16) | d[at_byte + 1] << np.uint64(8) | d[at_byte + 2]))
    return out, bags


def _shares(out: np.ndarray, bag: np.ndarray, hashes: np.ndarray) -> None:
    """Square roots of the shares of each bag's hashes in buckets, into out."""
    buckets = out.shape[1]
    table = np.bincount(bag * buckets + (hashes % np.uint64(buckets)).astype(np.int64), minlength=out.size).reshape(out.shape)
    np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1), out=out, casting="unsafe")


@dataclass(frozen=True)
class AttentionModel:
    """Weights of the encoder, the two gates, the attention vector and the output layer."""

    scale: tuple[np.ndarray, np.ndarray]
    weights: dict[str, np.ndarray]
    prior: float = 0.5

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        """Probabilities of the label of each bag of consecutive rows of x."""
        if not self.weights:
            return np.full(len(bags), self.prior)
        first = np.concatenate([[0], np.cumsum(bags)[:-1]])
        p = _forward(self.weights, (x - self.scale[0]) / self.scale[1], first, bags)[-1]
        return 1 / (1 + np.exp(-np.clip(p, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, bags: np.ndarray):
    h = np.tanh(x @ w["encode"] + w["encode_b"])
    v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    e = (v * u) @ w["attend"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), bags))
    a = e / np.repeat(np.add.reduceat(e, first), bags)
    z = np.add.reduceat(h * a[:, None], first, axis=0)
    return h, v, u, a, z, z @ w["out"] + w["out_b"]


def gradients(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, bags: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of bags, and its derivative by every weight."""
    h, v, u, a, z, logit = _forward(w, x, first, bags)
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    loss = -np.mean(y * np.log(np.maximum(p, 1e-12)) + (1 - y) * np.log(np.maximum(1 - p, 1e-12)))
    d = (p - y) / len(y)
    g = {"out": z.T @ d, "out_b": np.array(d.sum())}
    dz = np.repeat(d[:, None] * w["out"], bags, axis=0)
    dh = dz * a[:, None]
    da = (dz * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, first), bags))
    g["attend"] = (v * u).T @ de
    dg = de[:, None] * w["attend"]
    dv, du = dg * u * (1 - v**2), dg * v * u * (1 - u)
    g["v"], g["u"] = h.T @ dv, h.T @ du
    dh += dv @ w["v"].T + du @ w["u"].T
    dx = dh * (1 - h**2)
    g["encode"], g["encode_b"] = x.T @ dx, dx.sum(axis=0)
    return float(loss), g


def fit(x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> AttentionModel:
    """Adam on the cross-entropy of bags; the order of rows and a seed fix the result. x may be of half precision: it is scaled a batch at a time."""
    prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        return AttentionModel((np.zeros(1), np.ones(1)), {}, prior)
    rng = np.random.default_rng(SEED)
    total, squares = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(0, len(x), 4096):
        part = x[k : k + 4096].astype(np.float64)
        total += part.sum(axis=0)
        squares += np.square(part).sum(axis=0)
    spread_ = np.sqrt(np.maximum(squares / len(x) - np.square(total / len(x)), 0))
    scale = (total / len(x)).astype(np.float32), spread_.astype(np.float32) + np.float32(0.02)
    w = {
        "encode": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
        "encode_b": np.zeros(HIDDEN),
        "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "attend": rng.normal(0, GATE**-0.5, GATE),
        "out": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "out_b": np.array(np.log(prior / (1 - prior))),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, s, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    start = np.concatenate([[0], np.cumsum(bags)[:-1]])
    epochs = max(EPOCHS, -(-1200 * BATCH // max(1, len(y))))  # small samples get as many steps
    for _ in range(min(epochs, 400)):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            n = bags[part]
            rows = np.repeat(start[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            _, g = gradients(w, (x[rows].astype(np.float32) - scale[0]) / scale[1], first, n, y[part])
            t += 1
            for q in w:
                grad = g[q] + DECAY * w[q]
                m[q] = 0.9 * m[q] + 0.1 * grad
                s[q] = 0.999 * s[q] + 0.001 * grad**2
                w[q] = w[q] - RATE * (m[q] / (1 - 0.9**t)) / (np.sqrt(s[q] / (1 - 0.999**t)) + 1e-8)
    return AttentionModel(scale, {k: v.astype(np.float32) for k, v in w.items()}, prior)


def _bags(bag_passages: int):
    """Features of whole texts, for learning: a row per bag, a long text as several bags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, at_row = batch.column(0).to_pylist(), batch.column(2).to_pylist(), 0
            for _, _, data, offsets in at.parts(at.text_column(batch, "text")):
                rows = []
                x, bags = encode(data, offsets)
                for part in np.split(x, np.cumsum(bags)[:-1]):
                    rows += [(ids[at_row], k, labels[at_row], part[k : k + bag_passages].astype(np.float16).tobytes()) for k in range(0, len(part), bag_passages)]
                    at_row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "part", "label", "x"])

    return run


def learn_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, passages: int = TRAIN_PASSAGES, bag_passages: int = BAG_PASSAGES) -> AttentionModel:
    """A model from at most ``rows`` labelled rows outside the held-out fold and ``passages`` of their passages.

    Rows come in the order of their ids' hashes, whatever their length, until
    the passages are used up. A text of more than ``bag_passages`` makes several bags
    with its label. Labels of one kind, or none, give a model without weights.
    """
    train = labelled.sample(docs, labels, "quality", MODULUS, HELD_OUT, rows)
    found = stored(train.mapInArrow(_bags(bag_passages), "doc_id long, part int, label int, x binary").withColumn("n", F.octet_length("x") / (2 * FEATURES)), "bags")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("part")]
    sizes = found.select("doc_id", "part", "n").orderBy(*order).toPandas()  # at most ``rows`` texts and their parts, as numbers
    fits = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), passages, side="right"))
    if not fits:
        return fit(np.zeros((0, FEATURES), dtype=np.float16), np.zeros(0, dtype=np.int64), np.zeros(0))
    bags = sizes["n"].to_numpy()[:fits].astype(np.int64)
    x, y, done = np.empty((bags.sum(), FEATURES), dtype=np.float16), np.empty(fits, dtype=np.float32), 0
    ends = sizes.iloc[fits - 1]
    place = lambda i, part: F.struct(F.xxhash64(i).alias("h"), i.alias("i"), part.alias("p"))
    last = place(F.lit(int(ends["doc_id"])).cast("long"), F.lit(int(ends["part"])).cast("int"))
    for k, r in enumerate(found.where(place(F.col("doc_id"), F.col("part")) <= last).orderBy(*order).select("label", "x").toLocalIterator()):  # bounded by ``passages``
        x[done : done + bags[k]] = np.frombuffer(r["x"], dtype=np.float16).reshape(-1, FEATURES)
        y[k] = r["label"] > 0
        done += bags[k]
    return fit(x, bags, y)


def scores(column: pa.Array, model: AttentionModel) -> np.ndarray:
    found = [model.score(*encode(data, offsets)) for _, _, data, offsets in at.parts(column)]
    return np.concatenate(found).astype(np.float64) if found else np.zeros(0)


def score_documents(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """Scores of the whole text of every row of docs (doc_id, text, ...).

    A null or blank text is one passage without words; a very long text is scored
    whole, alone in memory. Repeated rows and equal texts get equal scores; an empty
    table gives no rows; other columns are ignored. held_out is false for a null
    doc_id. With labels of one kind only, every score is their (bounded) mean.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = scores(at.text_column(batch, "text"), model)
            held = [i is not None and labelled.fold_of(i, MODULUS) == HELD_OUT for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def keep_good(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns.

    Null ids, repeated rows, empty, null and very long texts are judged like others, by
    their text; an empty table stays empty; columns of any name pass unchanged. A
    model that saw labels of one kind, or none, has no evidence against any document,
    so all stay.
    """
    if not model.weights:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over()
        for batch in batches:
            yield batch.filter(pa.array(scores(at.text_column(batch, "text"), model) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op4_passages(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return score_documents(docs, learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
