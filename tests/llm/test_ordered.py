"""Manifest, phrases and shards."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations as C
from tessera.llm import jump_shards, manifest
from tessera.llm.ordered import in_order

from .test_filters import HARD, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, leaf2 string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run, at = i - i % 3, i % 3
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        i //= 3
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 200, 729])
def test_paths_of_a_block(n):
    leaves = [H(str(k)) for k in range(n)]
    levels = plain_tree(leaves)
    height = len(levels) - 1
    assert manifest.height_of(n) == height
    assert manifest.block_root(leaves, height) == levels[-1][0]
    assert list(manifest.authentication_paths(leaves, height)) == [plain_path(levels, i) for i in range(n)]


def test_stacks_stay_small_and_are_ready(monkeypatch):
    """By the schedule no stack has work left when its nodes are asked for, and all hold a few nodes a level."""
    late, most, made = [], [0], []
    nodes, init = manifest.Treehash.nodes, manifest.Treehash.__init__

    def asked(self):
        late.append(self.end - self.next)
        return nodes(self)

    def begun(self, leaves, level, run):
        init(self, leaves, level, run)
        made.append(self)

    monkeypatch.setattr(manifest.Treehash, "nodes", asked)
    monkeypatch.setattr(manifest.Treehash, "__init__", begun)
    leaves = [H(str(k)) for k in range(729)]
    paths = manifest.authentication_paths(leaves, 6)
    next(paths)
    del late[:]  # those of the first runs are asked for at once
    for _ in paths:
        alive = made[-40:]
        most[0] = max(most[0], sum(len(x) for s in {id(s): s for s in alive if s.next < s.end}.values() for x in s.open))
    assert not any(late)
    assert most[0] <= 6 * 6


def plain_manifest(rows):
    """(leaf, path, subroot, root) of each row by recursion over sorted rows."""
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    hashed = sorted(((s is not None, s or "", i is not None, i or 0, H(*map(shown, (i, s, lang, n, t)))) for i, t, lang, s, n in rows))
    by_source = {}
    for some, s, _, i, h in hashed:
        by_source.setdefault((some, s), []).append((i, h))
    trees = {k: plain_tree([h for _, h in v]) for k, v in by_source.items()}
    top = plain_tree([t[-1][0] for t in trees.values()])
    out = []
    for n, (k, v) in enumerate(by_source.items()):
        for j, (_, h) in enumerate(v):
            out.append((h, plain_path(trees[k], j) + plain_path(top, n), trees[k][-1][0], top[-1][0]))
    return out


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_against_a_plain_one(spark, height):
    sizes = {None: 1, "": 4, "a": 30, "é": 9, "hot": 120, "漢": 2}
    rows = [(k * 7 % 113, f"text {s} {k}\n", "en" if k % 3 else None, s, k) for s, n in sizes.items() for k in range(n)]
    rows += [(None, None, None, "hot", None), (None, None, None, "hot", None), (3, "", "de", "a", 0), (3, "", "de", "a", 0)]
    docs = spark.createDataFrame([(i, t, lang, s, n, "x", "x", "x") for i, t, lang, s, n in rows], SCHEMA)
    made = manifest.manifest(docs.withColumn("leaf", manifest.leaf(manifest.fields())), height)
    got = [(r.leaf, [tuple(p) for p in r.proof], r.subroot, r.root) for r in made.select("leaf", "proof", "subroot", "root").collect()]
    assert sorted(got) == sorted(plain_manifest(rows))
    assert made.where(manifest.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert made.where(manifest.folded(F.sha2(F.lit("other"), 256), F.col("proof")) == F.col("root")).count() == 0
    assert "leaf2" in made.columns


def test_manifest_of_hard_rows(spark):
    rows = table(spark, HARD)
    made = manifest.manifest(rows.drop("node").withColumn("leaf", manifest.leaf(manifest.fields())))
    assert made.count() == len(HARD)
    assert made.where(manifest.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert manifest.manifest(rows.drop("node").withColumn("leaf", manifest.leaf(manifest.fields())).where("false")).count() == 0
    one = manifest.manifest(rows.drop("node").withColumn("leaf", manifest.leaf(manifest.fields())).where("doc_id = 3")).first()
    assert one.leaf == one.subroot == one.root and one.proof == []


def plain_jump(key, shards):
    """The published loop on plain integers."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_against_the_plain_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    keys[:3] = [0, 1, 2**64 - 1]
    for shards in (1, 2, 16, 17, 1000):
        assert jump_shards.jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]


def test_appended_shards_take_only_their_part(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text", "'x' AS shard")
    gone = jump_shards.moved(docs, 16, 20)
    counts = Counter(r.shard for r in gone.select("shard").collect())
    assert set(counts) == {16, 17, 18, 19}
    assert all(850 < n < 1150 for n in counts.values())
    kept = docs.select("doc_id", jump_shards.shard_of(F.col("doc_id"), 16).alias("a"), jump_shards.shard_of(F.col("doc_id"), 20).alias("b"))
    assert kept.where("a <> b AND b < 16").count() == 0
    with pytest.raises(ValueError):
        jump_shards.moved(docs, 4, 3)


def shards_of(spark, docs, path, **more):
    schema = jump_shards.write_shards(docs, str(path), **more)
    return jump_shards.read_shards(spark, str(path), schema)


def test_shards_hold_all_rows_in_gapless_slots(spark, tmp_path):
    """Hot, null and repeated keys; slots ascend with ids, and whole rows come back."""
    rows = [(k % 300 if k % 3 else None, f"t{k % 7}", "en", "s", k, "x", "x", "x") for k in range(2_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = shards_of(spark, docs, tmp_path / "a", shards=5).collect()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got) == Counter((r[0], r[1], r[4]) for r in rows)
    for shard in range(5):
        mine = sorted((r.slot, -1 if r.doc_id is None else r.doc_id) for r in got if r.shard == shard)
        assert [s for s, _ in mine] == list(range(len(mine)))
        assert [i for _, i in mine] == sorted(i for _, i in mine)
    by_key = {}
    for r in got:
        assert by_key.setdefault(r.doc_id, r.shard) == r.shard
    again = shards_of(spark, docs.repartition(7), tmp_path / "b", shards=5)
    assert {(r.doc_id, r.shard) for r in again.collect()} == set(by_key.items())


def test_shards_of_hard_rows(spark, tmp_path):
    docs = table(spark, HARD)
    got = shards_of(spark, docs, tmp_path / "a").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(HARD)
    assert shards_of(spark, docs.where("false"), tmp_path / "b").count() == 0


def test_positions_are_those_of_a_sort(spark):
    rows = spark.range(1_000).selectExpr("id * 37 % 101 AS a", "CAST(id % 13 AS STRING) AS b")
    got = in_order(rows.repartition(5), [F.col("a").desc(), F.col("b").asc()], "test").orderBy("__at").collect()
    assert [r["__at"] for r in got] == list(range(1_000))
    assert [(r.a, r.b) for r in got] == [(r.a, r.b) for r in rows.orderBy(F.desc("a"), "b").collect()]


def plain_grams(texts):
    """Occurrences of every run of 1 to 4 words within pieces."""
    out = Counter()
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            out.update(tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    return out


def plain_collocations(rows, least, first):
    out = set()
    by_lang = defaultdict(list)
    for t, lang in rows:
        by_lang["und" if lang is None else lang].append(t)
    for lang, texts in by_lang.items():
        f = plain_grams(texts)
        n = sum(c for g, c in f.items() if len(g) == 1)
        some = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        inside = lambda g, h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        best = []
        for g, a in some.items():
            if any(len(h) > len(g) and 100 * c >= 80 * a and inside(g, h) for h, c in some.items()):
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:first], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out


def phrase_texts(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "b", "é", "漢", "É", "x\x00y", "the", "of", "q1", *(f"w{k}" for k in range(30))]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!", " \u00a0 "]
    planted = "the quick of the b. "
    return ["".join(rng.choice(words[: rng.choice([3, 8, 40])]) + rng.choice(marks) for _ in range(rng.randrange(0, 80))) + planted * rng.randrange(3) for _ in range(n)]


@pytest.mark.parametrize("counters, split, routes", [(1 << 12, 2_000_000, 16), (4, 20, 5), (1, 7, 1)])
def test_phrases_of_chunks_are_counted_whole(monkeypatch, counters, split, routes):
    """Also where all words share a few counters, and pivots go to several places; chunks are cut at marks."""
    monkeypatch.setattr(C, "COUNTERS", counters)
    monkeypatch.setattr(C, "SPLIT", split)
    monkeypatch.setattr(C, "CHUNK_BYTES", 200)
    texts = phrase_texts(5)
    made, table = [], np.zeros(counters, dtype=np.uint32)
    parts = list(C.chunks(pa.array(texts)))
    assert len(parts) > 20
    for c in parts:
        for w, n in zip(c.vocabulary.to_pylist(), np.bincount(c.codes).tolist(), strict=True):
            table[C.zlib.crc32(w, C.zlib.crc32(b"en ")) % counters] += n
    for c in parts:
        made += C.packed("en", c, table, 1, routes)
    places = defaultdict(list)
    for b in made:
        places[b["route"], b["whole"]].append(b)
    got, seen = Counter(), Counter()
    for (_, whole), blobs in places.items():
        for phrase, size, f in C.mined(blobs, 0):
            assert size == len(phrase.split(" "))
            got[phrase] += f
            seen[phrase] += whole
    want = {" ".join(g): n for g, n in plain_grams(texts).items() if len(g) > 1}
    assert got == want
    if split > 1000:
        assert set(seen.values()) == {1}  # a phrase is counted in one place


def test_numbers_of_rows_are_exact_beyond_64_bits():
    rows = np.random.default_rng(3).integers(0, 2**21, (400, 4))
    rows = np.concatenate([rows, rows[:150]])
    numbers = C.numbered(rows, 2**21)
    assert len(np.unique(numbers)) == len(np.unique(rows, axis=0))
    assert all(numbers[k] == numbers[400 + k] for k in range(150))


@pytest.mark.parametrize("least, first", [(3, 2000), (8, 5)])
def test_collocations_against_plain_counts(spark, least, first):
    rows = [(t, (None, "en", "de", "und")[k % 4]) for k, t in enumerate(phrase_texts(6))] + [(None, "en"), ("", "fr"), (" . ", None)]
    docs = spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, phrase string, n long").repartition(3)
    got = {tuple(r) for r in C.collocations(docs, C.Collocations(least=least, first=first)).collect()}
    assert got == plain_collocations(rows, least, first)
    assert got


def test_collocations_of_hard_rows(spark):
    docs = table(spark, HARD)
    got = {tuple(r) for r in C.collocations(docs).collect()}
    assert got == plain_collocations([(t, "en") for _, t in HARD], 30, 2000)
    assert C.collocations(docs.where("false")).count() == 0


def test_large_counts_score_exactly(spark):
    rows = [("en", "a", 1, 9 * 10**15), ("en", "b", 1, 8 * 10**15 + 1), ("en", "a b", 2, 7 * 10**15 + 3)]
    got = C.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, f long"), C.Collocations()).first()
    assert got.score == 2_000_000 * (7 * 10**15 + 3) // (17 * 10**15 + 1)
