"""N-gram Jaccard self-join by parity sketches.

A document is its set of word n-grams (64-bit hashes). A parity sketch flips
bits by n-gram, so n-grams that two sets share cancel, and with one bit per
n-gram the Hamming distance of two sketches never exceeds the size of the
symmetric difference of their sets. If two sets of at most ``hi`` n-grams have
Jaccard similarity t, they differ in at most 2 hi (1-t)/(1+t) n-grams; a sketch
cut into one part more than that agrees in at least one whole part (pigeonhole).
Parts are compared within bands of set size, so the number of parts follows the
size; a document also appears in the next band if a partner there is possible.

What is compared of a part is the XOR of its n-grams' whole hashes, which is
equal whenever the part is. In a band whose linked sets differ in one n-gram at most,
the keys are the XOR of the whole set and those of the set without each one of its
n-grams: two such sets always share one. In the others, parts of very few n-grams say
little (empty ones are equal everywhere), so only parts of at least LEAST n-grams are
keys. Many parts of a linked pair agree, not just one: documents of few parts are
cut several times by independent hashes, so that a linked pair, even one right at the
threshold, has no agreeing key with a probability below MISS.

Hot groups. Equal sets collapse into one node first. A part shared by many
nodes is a bucket; all its nodes are compared with the most central one (the
node whose parts are shared most), which joins groups of near copies in a
number of pairs that is linear in the group. Only buckets that still hold more
than one component are compared in full, in blocks of bounded size, and only
pairs of different components whose sketches allow a link leave the task. Every
candidate is verified on exact sets. Since components are the result, pairs
within one component need no comparison. n-grams are identified by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import arrow_text as at
from .components import components
from .runtime import new_path, release, remove, stored, take_over

#: Least n-grams of a part that is a key (and for sketches of at most FEW parts), and the most that a linked pair may be missed.
LEAST, LEAST_OF_FEW, FEW, MISS = 3, 2, 8, 1e-12
#: Rows of a bucket compared in one piece; larger buckets are compared as pairs of such blocks.
BLOCK = 1024


@dataclass(frozen=True)
class ParityJoin:
    """words: n-gram length; percent: least Jaccard similarity of a link, in hundredths."""

    words: int = 5
    percent: int = 80

    def bounds(self) -> np.ndarray:
        """Least set size of each band; the last is beyond any text."""
        ratio, out = (100 / self.percent) ** 2, [1.0]
        while out[-1] < 2**31:
            out.append(out[-1] * ratio)
        return np.array(out)

    def pieces(self, level: int) -> int:
        """Parts of a sketch in a band: one more than two linked sets can differ in."""
        return int(2 * self.bounds()[level + 1] * (100 - self.percent) / (100 + self.percent) + 1e-6) + 1

    def least(self, level: int) -> int:
        return LEAST_OF_FEW if self.pieces(level) <= FEW else LEAST

    def cuts(self, level: int) -> int:
        """Independent cuts of a sketch, so that enough parts are keys.

        In a part, a linked pair right at the threshold has about x differing and
        2 t x / (1 - t) common n-grams, with x from t squared (the least sets of a
        band) to 1; the part is an agreeing key if none differs and enough are common.
        """
        t, chance = self.percent / 100, 1.0
        for x in (t * t, 1.0):
            rate = 2 * t * x / (1 - t) if t < 1 else 1e3
            few = sum(math.exp(-rate) * rate**k / math.factorial(k) for k in range(LEAST))
            chance = min(chance, math.exp(-x) * (1 - few))
        return math.ceil(math.log(MISS) / math.log1p(-chance) / self.pieces(level))

    def bits(self, level: int) -> int:
        """Width of the folded sketch: four times the allowed distance, as a power of two."""
        return 1 << min(13, max(9, math.ceil(math.log2(4 * self.pieces(level)))))


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text. Fewer words than n: the whole sequence as one; none: empty."""
    for _, _, data, offsets in at.parts(column):
        w = at.words_of(at.lower_ascii(data), offsets)
        h = w.span_hash(w.start, w.end)
        grams, first = at.ngram_hash(h, words), w.first
        for k in range(w.texts):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                yield at.ngram_hash(h[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, dtype=np.uint64)


def _keys(s: np.ndarray, level: int, pieces: int, cuts: int, least: int) -> np.ndarray:
    """A key for each part with enough n-grams, of every cut of a set; where sets differ in one n-gram at most, one for the set and each set of one less."""
    if pieces <= 2:
        whole = np.bitwise_xor.reduce(at.mix(s))
        # a set of one n-gram less is empty only for sets of one, which no other size links with
        keys = np.append(whole ^ at.mix(s), whole) if len(s) > 1 else whole[None]
        return np.unique(at.mix(keys ^ at.mix(np.full(1, level << 40 | 1 << 39, dtype=np.uint64))))
    salt = at.mix(np.arange(cuts, dtype=np.uint64) + np.uint64(level << 20))
    part = ((at.mix(s[None, :] ^ salt[:, None]) >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
    part = (part.astype(np.int64) + (np.arange(cuts) * pieces)[:, None]).ravel()
    out = np.zeros(cuts * pieces, dtype=np.uint64)
    np.bitwise_xor.at(out, part, np.tile(at.mix(s), cuts))
    where = np.flatnonzero(np.bincount(part, minlength=len(out)) >= least)
    return at.mix(out[where] ^ at.mix(where.astype(np.uint64) + np.uint64(level << 40)))


def _folded(s: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits // 64, dtype=np.uint64)
    at_bit = s >> np.uint64(8)
    np.bitwise_xor.at(out, ((at_bit >> np.uint64(6)) & np.uint64(bits // 64 - 1)).astype(np.int64), np.uint64(1) << (at_bit & np.uint64(63)))
    return out.tobytes()


_SKETCHED = "doc_id long, n int, s1 long, s2 long, keys array<long>, sketch binary"


def _sketcher(p: ParityJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over()
        bounds = p.bounds()
        known: dict[int, tuple[int, int, int, int]] = {}
        for batch in at.slices(batches):
            n, s1, s2, keys, folded = [], [], [], [], []
            for s in shingle_sets(at.text_column(batch, "text"), p.words):
                n.append(len(s))
                s1.append(np.bitwise_xor.reduce(at.mix(s)) if len(s) else np.uint64(0))
                s2.append(at.mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64))
                own, sketch = [], b""
                if len(s):
                    level = int(np.searchsorted(bounds, len(s), side="right")) - 1
                    near = len(s) >= bounds[level + 1] * p.percent / 100 * (1 - 1e-9)
                    for x in (level, level + 1)[: 1 + near]:
                        if x not in known:
                            known[x] = p.pieces(x), p.cuts(x), p.least(x), p.bits(x)
                        own.append(_keys(s, x, *known[x][:3]))
                        bits = known[x][3]
                    sketch = _folded(s, bits)
                keys.append(np.concatenate(own).view(np.int64) if own else np.zeros(0, dtype=np.int64))
                folded.append(sketch)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(n, pa.int32()),
                    pa.array(np.array(s1, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(s2, dtype=np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64))),
                    pa.array(folded, pa.binary()),
                ],
                names=["doc_id", "n", "s1", "s2", "keys", "sketch"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over()
        for batch in at.slices(batches):
            sets = list(shingle_sets(at.text_column(batch, "text"), words))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                names=["node", "grams"],
            )

    return run


def _fold_to(rows: list[bytes]) -> np.ndarray:
    """Sketches folded to the narrowest of them."""
    width = min(map(len, rows)) // 8
    out = np.empty((len(rows), width), dtype=np.uint64)
    for k, r in enumerate(rows):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(r, dtype=np.uint64).reshape(-1, width), axis=0)
    return out


def _allowed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of linked sets of these sizes; negative if the sizes alone rule a link out."""
    most = (na + nb) * (100 - percent) // (100 + percent)
    return np.where(np.abs(na - nb) <= most, most, -1)


def _pair_filter(percent: int):
    """Keeps pairs whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in at.slices(batches):
            c = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            most = _allowed(c["na"].to_numpy().astype(np.int64), c["nb"].to_numpy().astype(np.int64), percent)
            keep = np.zeros(len(batch), dtype=bool)
            for k, (x, y) in enumerate(zip(c["sa"].to_pylist(), c["sb"].to_pylist(), strict=True)):
                if most[k] >= 0:
                    u = _fold_to([x, y])
                    keep[k] = int(np.bitwise_count(u[0] ^ u[1]).sum()) <= most[k]
            yield pa.RecordBatch.from_arrays([c["a"], c["b"]], names=["a", "b"]).filter(pa.array(keep))

    return run


def _block_pairs(percent: int):
    """Pairs of different components with possible sketches, from rows sorted by (key, tile).

    A tile holds one or two blocks of a bucket; ``side`` says which, 2 standing for a block compared with itself.
    """

    def pairs(rows: dict[str, list]) -> Iterator[tuple[int, int]]:
        node, comp = np.array(rows["node"]), np.array(rows["component"])
        n, side, sk = np.array(rows["n"], dtype=np.int64), np.array(rows["side"]), _fold_to(rows["sketch"])
        left = np.flatnonzero(side != 1)
        right = np.flatnonzero(side != 0)
        for i in left:
            j = right if side[i] == 0 else right[right > i]
            j = j[comp[j] != comp[i]]
            most = _allowed(n[j], n[i], percent)
            j, most = j[most >= 0], most[most >= 0]
            if len(j):
                near = np.bitwise_count(sk[j] ^ sk[i]).sum(axis=1, dtype=np.int64) <= most
                for k in j[near]:
                    yield (int(node[i]), int(node[k])) if node[i] < node[k] else (int(node[k]), int(node[i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("node", "component", "n", "side", "sketch")
        held: dict[str, list] = {f: [] for f in names}
        at_key, found = None, set()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return batch

        for batch in at.slices(batches):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            cols = {f: batch.column(batch.schema.get_field_index(f)).to_pylist() for f in names}
            for k, key in enumerate(keys):
                if key != at_key:
                    if len(held["node"]) > 1:
                        found.update(pairs(held))
                    held, at_key = {f: [] for f in names}, key
                    if len(found) > 50_000:
                        yield out()
                for f in names:
                    held[f].append(cols[f][k])
        if len(held["node"]) > 1:
            found.update(pairs(held))
        yield out()

    return run


def _verified(pairs: DataFrame, docs: DataFrame, p: ParityJoin) -> DataFrame:
    """Pairs (a, b) whose exact sets reach the threshold; sets are built only for nodes that occur in pairs."""
    pairs = stored(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = stored(
        docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(_sets(p.words), "node long, grams array<long>"), "sets"
    )
    a = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    b = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    return (
        pairs.join(b, "b")
        .join(a, "a")
        .withColumn("both", shared)
        .where(F.expr(f"100L * both >= {p.percent}L * (size(ga) + size(gb) - both)"))
        .select("a", "b")
    )


def link_components(docs: DataFrame, p: ParityJoin = ParityJoin()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text, ...).

    Two documents link when the Jaccard similarity of their n-gram sets is at
    least ``percent`` hundredths; component_id is the least doc_id reachable by
    links, the document itself included. Null or blank texts have an empty set
    and link with nothing. Texts shorter than n words have one n-gram, the whole
    sequence; of a very long text all n-grams count. Rows that repeat a doc_id count
    as one document, which links by any of its texts, and give one row each; a null
    doc_id gets the component of documents with an equal set, else null. Similarities
    right at the threshold link. An empty table gives no rows. Other columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    path = new_path(spark, "sketched")
    docs.mapInArrow(_sketcher(p), _SKETCHED).write.parquet(path)
    sketched = spark.read.schema(_SKETCHED).parquet(path)
    members = stored(sketched.select("doc_id", "n", "s1", "s2"), "members")
    classes = members.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    classes = stored(classes, "classes")
    nodes = sketched.join(classes.select(F.col("rep").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id", "left_semi").where("n > 0")

    keyed = nodes.select(F.explode("keys").alias("key"), F.col("doc_id").alias("node")).repartition("key")
    often = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    shared = stored(keyed.join(often, "key"), "shared")
    weight = shared.groupBy("node").agg(F.sum("held").alias("weight"))
    known = stored(nodes.select(F.col("doc_id").alias("node"), "n", "sketch").join(weight, "node"), "nodes")
    del sketched, nodes, keyed, often, weight
    remove(spark, path)  # the keys are the largest table; no later plan reads them
    release(spark)

    ranked = shared.join(known.select("node", "weight"), "node")
    centre = ranked.groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre"))
    stars = (
        shared.join(centre, "key")
        .where("node <> centre")
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        .distinct()
    )
    side = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    stars = stars.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "sa", "sb")
    links = stored(_verified(stars.mapInArrow(_pair_filter(p.percent), "a long, b long"), docs, p), "links")

    label = stored(components(links), "labels")
    placed = stored(
        known.select("node", "n", "sketch").join(label, "node", "left").select("node", "n", "sketch", F.coalesce("component", "node").alias("component")),
        "placed",
    )
    members_of = shared.join(placed.select("node", "component"), "node")
    open_keys = members_of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held")).where("lo < hi")
    rest = shared.select("key", "node").join(open_keys.select("key", "held"), "key").join(placed, "node")
    blocks = F.ceil(F.col("held") / BLOCK).cast("long")
    rest = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # tile (i, j), i <= j: the rows of blocks i and j
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    where = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    rest = rest.select("key", tile.alias("tile"), "node", "component", "n", where.alias("side"), "sketch")
    crossing = rest.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_block_pairs(p.percent), "a long, b long")
    more = _verified(crossing, docs, p)
    label = components(links.unionByName(more))

    whole = members.join(classes, ["s1", "s2", "n"], "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    return whole.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, p: ParityJoin = ParityJoin()) -> DataFrame:
    """The rows of docs that are the least doc_id of their component, once each, with all their columns.

    Of rows that repeat that doc_id, one whose text has the least 64-bit hash stays
    (of those, any: rows of one id and text are one document). Rows without a doc_id
    stay. Null, empty and blank texts are components of their own. Very long texts
    compare whole; an empty table stays empty; columns of any name pass unchanged.
    """
    kept = link_components(docs, p).where("doc_id = component_id").select("doc_id").distinct()
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    with_id = docs.where("doc_id is not null")
    repeated = stored(with_id.groupBy("doc_id").agg(F.min(text).alias("__least"), F.count("*").alias("__rows")).where("__rows > 1"), "repeated")
    once = with_id.join(kept, "doc_id", "left_semi")
    if not repeated.isEmpty():
        again = once.join(repeated, "doc_id").where(text.bitwiseXOR(F.col("__least")) == 0).dropDuplicates(["doc_id"])
        once = once.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))
    return once.select(*docs.columns).unionByName(docs.where("doc_id is null"))


#: Exact self-join on shared shingles and a recursive closure.
ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) END AS g
  FROM words
), grams AS (SELECT doc_id, unnest(g) AS x FROM sets),
sizes AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM sets),
inter AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM grams p JOIN grams q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM inter JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= {percent} * (s.n + t.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
"""


def op10_parity_join(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return link_components(docs, ParityJoin(words=3, percent=90))


OP10_SQL = ORACLE.format(n=3, percent=90)
