"""Near duplicates, mixing, fingerprints, tokens, archives, page text and the pipeline."""

import gzip
import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import arrow_text, byte_bpe, merkle, mixing, parity_join, runtime, style_tree, warc
from tessera.llm.components import components

from .test_filters import HARD, WORD, table


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups=12):
    """Groups of edited copies (stars and chains), docs around the threshold, short texts and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(60)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([6, 12, 25, 60, 200, 500]))]
        at = base
        for _ in range(rng.randrange(1, 9)):
            new = list(at if g % 2 else base)
            for _ in range(rng.randrange(0, 1 + max(1, len(base) // 40))):
                new[rng.randrange(len(new))] = word()
            at = new
            out.append(" ".join(new))
    out += [" ".join(shared + [word() for _ in range(rng.choice([3, 8, 40]))]) for _ in range(15)]
    rng.shuffle(out)
    return [(3 * k + 1, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed, words, percent", [(1, 3, 90), (2, 5, 80), (3, 5, 80)])
def test_links_against_brute_force(spark, seed, words, percent):
    rows = near_copies(seed)
    got = parity_join.link_components(table(spark, rows), parity_join.ParityJoin(words, percent))
    assert {tuple(r) for r in got.collect()} == brute_components(rows, words, percent)


def test_keys_never_miss_a_pair_at_the_threshold():
    """Random pairs right at the threshold, of many sizes, share a key; their sketches stay within the allowed distance."""
    rng = np.random.default_rng(4)
    for p in (parity_join.ParityJoin(3, 90), parity_join.ParityJoin(5, 80)):
        bounds = p.bounds()
        for _ in range(300):
            n = int(rng.integers(5, 1500))
            s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            for extra in range(n, -1, -1):  # the most added n-grams that still link
                if 100 * n >= p.percent * (n + extra):
                    break
            t = np.unique(np.concatenate([s, rng.integers(0, 2**63, extra, dtype=np.uint64)]))
            keys = []
            for x in (s, t):
                level = int(np.searchsorted(bounds, len(x), side="right")) - 1
                near = len(x) >= bounds[level + 1] * p.percent / 100 * (1 - 1e-9)
                keys.append(set(np.concatenate([parity_join._keys(x, k, p.pieces(k), p.cuts(k), p.least(k)) for k in (level, level + 1)[: 1 + near]]).tolist()))
            assert extra == 0 or keys[0] & keys[1]
            u = parity_join._fold_to([parity_join._folded(x, 1024) for x in (s, t)])
            assert np.bitwise_count(u[0] ^ u[1]).sum() <= len(t) - len(s)


def test_small_sets_always_share_a_key():
    """Every pair of small sets that the sizes allow to link: one n-gram more, or less, or neither."""
    rng = np.random.default_rng(2)
    for p in (parity_join.ParityJoin(3, 90), parity_join.ParityJoin(5, 80)):
        keys = lambda x, k: set(parity_join._keys(x, k, p.pieces(k), p.cuts(k), p.least(k)).tolist())
        bounds = p.bounds()
        for level in (k for k in range(len(bounds) - 1) if p.pieces(k) <= 2):
            for n in range(max(1, int(bounds[level])), int(bounds[level + 1]) + 1):
                s = np.unique(rng.integers(0, 2**63, n + 1, dtype=np.uint64))
                for less in range(len(s)):
                    t = np.delete(s, less)
                    if 100 * len(t) >= p.percent * len(s) and len(t):
                        assert keys(s, level) & keys(t, level)


def test_recall_against_sql_on_whole_tables(spark):
    """All components of sf0.01, at both settings, against an exact join: whatever planted copies are not linked lie below the threshold."""
    import duckdb

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    db = duckdb.connect()
    db.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    for n, percent in ((3, 90), (5, 80)):
        want = set(db.execute(parity_join.ORACLE.format(n=n, percent=percent)).fetchall())
        assert {tuple(r) for r in parity_join.link_components(docs, parity_join.ParityJoin(n, percent)).collect()} == want


def test_repeated_ids_keep_one_row(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "q r s t u v"), (2, "another text of the same id"), (3, None), (None, "x")]
    kept = [sorted((str(r["doc_id"]), r["text"] or "") for r in parity_join.one_of_each(table(spark, rows).repartition(n)).collect()) for n in (1, 4)]
    assert kept[0] == kept[1] and [i for i, _ in kept[0]] == ["1", "2", "3", "None"]


def test_blocks_cover_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 4)
    rows = near_copies(7, groups=6)
    got = parity_join.link_components(table(spark, rows), parity_join.ParityJoin(3, 90))
    assert {tuple(r) for r in got.collect()} == brute_components(rows, 3, 90)


def test_links_of_hard_rows(spark):
    rows = [*HARD, (11, "one"), (12, "ONE"), (13, "null id")]
    got = sorted(map(tuple, parity_join.link_components(table(spark, rows), parity_join.ParityJoin(3, 90)).collect()), key=str)
    assert len(got) == len(rows)
    found = {(g[0], g[2]) for g in got}
    assert {(0, 0), (1, 1), (3, 3), (11, 3), (12, 3), (13, 13), (None, 13), (4, 4)} <= found
    assert parity_join.link_components(table(spark, [])).count() == 0
    kept = parity_join.one_of_each(table(spark, rows), parity_join.ParityJoin(3, 90))
    assert kept.columns == table(spark, []).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([0, 1, 2, 3, 4, 5, 6, 7, 13, None], key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (5, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target string")


def test_mixing_reaches_targets(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, " ".join("w" * rng.randrange(1, 60)), rng.choice(["a", "b", "c", "c", "c", "é", None]), "x", "x") for k in range(400)]
    out = [r.asDict() for r in mixing.mix(documents(spark, rows)).collect()]
    by = defaultdict(list)
    source = {r[0]: r[2] for r in rows}
    for r in out:
        by[source[r["doc_id"]]].append(r)
    total, free, weights = sum(r["size"] for r in out), {}, dict(zip(["a", "b", "c", "é", None], [5, 2, 1, 5, 2], strict=True))
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    want, left, open_ = {}, 1.5 * total, set(by)
    while open_:  # the plain loop: share by weight, clamp, again
        free = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if free[s] > 2 * sizes[s]}
        if not over:
            want.update(free)
            break
        want.update({s: 2.0 * sizes[s] for s in over})
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    for s, v in by.items():
        assert v[0]["target"] == pytest.approx(want[s]) and v[0]["source_size"] == sizes[s]
        assert sum(r["taken"] for r in v) == int(v[0]["target"]) and all(0 <= r["taken"] <= 2 * r["size"] for r in v)
    monkeypatch.setattr(mixing, "DIGITS", 1)  # other buckets, same mix
    monkeypatch.setattr(mixing, "LEVELS", 3)
    again = [r.asDict() for r in mixing.mix(documents(spark, rows).repartition(7)).collect()]
    key = lambda x: x["doc_id"]
    assert sorted(again, key=key) == sorted(out, key=key)


def test_mixture_has_the_words_taken(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 9 + 1)), "ab"[k % 2], "x", "x") for k in range(60)]
    docs = documents(spark, rows).withColumn("n_chars", F.char_length("text"))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_mixing_of_hard_rows(spark):
    got = mixing.mix(table(spark, HARD)).collect()
    assert len(got) == len(HARD) and {r["size"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert mixing.mix(table(spark, [])).count() == 0 and mixing.mixture(table(spark, [])).count() == 0
    blank = mixing.mix(table(spark, [(1, " "), (2, None)])).collect()
    assert {(r["target"], r["taken"]) for r in blank} == {(0.0, 0)}
    assert mixing.mixture(table(spark, HARD)).columns == table(spark, []).columns


def plain_tree(text):
    """Sections of paragraphs of clauses, by a scan over characters."""
    out = []
    for section in text.split("\n\n"):
        paragraphs = []
        for p in section.split("\n"):
            clauses, at, marks = [], "", True
            for c in p:
                mark = c in merkle.MARKS
                if not mark and at and (marks or len(at) == 64):
                    clauses.append(at)
                    at = ""
                at, marks = at + c, mark
            paragraphs.append((p, clauses + [at] * bool(at)))
        out.append(paragraphs)
    return out


def plain_fingerprint(text):
    sha, md5 = (lambda f: lambda x: f(x.encode()).hexdigest())(hashlib.sha256), (lambda f: lambda x: f(x.encode()).hexdigest())(hashlib.md5)
    parts, hashes = [], []
    for section in plain_tree(text):
        h = sha("".join(sha(p) for p, _ in section))
        hashes.append(h)
        parts.append(h[:16] + ":" + ";".join(sha(p)[:16] + "=" + ",".join(md5(c)[:8] for c in cs) for p, cs in section))
    return sha("".join(hashes)) + "/" + "/".join(parts)


def first_difference(a, b):
    return next((k + 1 for k in range(max(len(a), len(b))) if a[k : k + 1] != b[k : k + 1]), None)


def test_fingerprints(spark):
    """Against a plain tree: texts that differ in blanks, separators and marks alone, orders, hard texts."""
    texts = ["a\n\nb", "a\n \nb", "a\n\n\nb", "a\nb", "a\n\r\nb", "hello there", "...hello there", "...", "???", "", " ", "\n", "\n\n", "\n\n\n", "A b.\nC d, e f.\n\nSection two. Last one!", "漢字😀 x", "y" * 64, "y" * 65, "y" * 64 + ".z", None]
    rng = random.Random(6)
    texts += ["".join(rng.choice("ab .,\n\n!é漢😀") for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [(7 * k % 1009, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in merkle.fingerprints(table(spark, rows)).collect()}
    order = sorted(rows)
    by_print = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == plain_fingerprint(t) and r["edited_fingerprint"] == plain_fingerprint(edited)
        by_print.setdefault(r["fingerprint"][:64], set()).add(t)
        a, b, c = plain_tree(t), plain_tree(edited), plain_tree(after)
        leaf = lambda x: {c for s in x for _, cs in s for c in cs}
        dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
        assert r["near_edited"] == pytest.approx(dice(leaf(a), leaf(b))) and r["near_next"] == pytest.approx(dice(leaf(a), leaf(c)))
        section = first_difference(a, b)
        assert r["changed_section"] == section and (section is None) == (t == edited)
        if section:
            pa, pb = (x[section - 1] if len(x) >= section else [] for x in (a, b))
            paragraph = first_difference(pa, pb)
            ca, cb = (x[paragraph - 1][1] if len(x) >= paragraph else [] for x in (pa, pb))
            assert r["changed_paragraph"] == paragraph and r["changed_clause"] == first_difference(ca, cb)
    assert all(len(x) == 1 for x in by_print.values())  # equal roots, equal texts


def test_every_edit_is_located(spark):
    """One changed character: other roots, and the first differing branch is the one that holds it."""
    rng = random.Random(9)
    text = "".join(rng.choice("abc .,\n") for _ in range(400))
    rows = []
    for k in range(120):
        at = rng.randrange(len(text))
        rows.append((k, text, text[:at] + rng.choice([c for c in "abz.,\n" if c != text[at]]) + text[at + 1 :]))
    df = spark.createDataFrame(rows, "k long, x string, y string").withColumns({"a": merkle.tree(F.col("x")), "b": merkle.tree(F.col("y"))})
    df = merkle.located(df, "a", "b").withColumns({"ra": merkle.root(F.col("a")), "rb": merkle.root(F.col("b"))})
    for r in df.collect():
        a, b = plain_tree(r["x"]), plain_tree(r["y"])
        s = first_difference(a, b)
        assert r["ra"] != r["rb"] and r["changed_section"] == s and r["changed_paragraph"] == first_difference(a[s - 1], b[s - 1]) and r["changed_clause"] is not None


def test_fingerprints_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_IDS", 5)
    rows = [(k * k - 50, f"text {k} " * (k % 7 + 1)) for k in range(120)]
    got = {r["doc_id"]: r["edited_sha256"] for r in merkle.fingerprints(table(spark, rows).repartition(6)).collect()}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()
    hard = merkle.fingerprints(table(spark, [*HARD, (3, "another three"), (3, "one"), (None, "second null")]))
    assert hard.count() == len(HARD) + 3 and hard.where("near_edited is null or near_edited < 0 or near_edited > 1").count() == 0
    assert merkle.fingerprints(table(spark, [])).count() == 0 and merkle.fingerprints(table(spark, [(1, "a b")])).first()["near_next"] == 1.0


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    return byte_bpe.loaded(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(bpe):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_bpe_equals_the_library(bpe, reference):
    rng = random.Random(8)
    letters = "abcdefgh \n\t\x1c\x85  éßñ漢字😀'sre0123!?$%*&́​"
    for _ in range(1500):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        ids = bpe.encode(s)
        assert ids == reference.encode_ordinary(s) and bpe.decode(ids) == s.encode()
    for s in ("a" * 3000, "ab" * 500, "\n" * 300, "the" * 200, "漢字" * 300, "<|endoftext|>"):
        assert bpe.encode(s) == reference.encode_ordinary(s)


def test_the_heap_merges_like_the_matrices(bpe, reference):
    """Pieces of all lengths up to the widest bucket, both ways; and beyond it, against the library."""
    rng = random.Random(5)
    for n in [*range(1, 40), 64, 127, 128, 129, 300, byte_bpe.WIDTHS[-1]]:
        pieces = ["".join(rng.choice(letters) for _ in range(n)).encode()[:n] for letters in ("ab", "the", "etaoinshrdlu", "é漢x")]
        width = min(w for w in byte_bpe.WIDTHS if w >= n)
        assert bpe._matrix(pieces, width) == [bpe._heap(p) for p in pieces]
    for n in (byte_bpe.WIDTHS[-1] + 1, 5000):
        word = "".join(rng.choice("etaoin") for _ in range(n))
        assert list(bpe._heap(word.encode())) == reference.encode_ordinary(word)


def test_bpe_of_rows(spark, reference):
    got = byte_bpe.encode_documents(table(spark, HARD)).collect()
    text = dict((i, t or "") for i, t in HARD)
    for r in got:
        ids = reference.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert len(got) == len(HARD) and byte_bpe.encode_documents(table(spark, [])).count() == 0


def test_pair_table_has_all_pairs(bpe):
    some = [t for t in bpe.ranks if 2 <= len(t) <= 5][:4000]
    pairs = [(bpe.ranks[t[:k]], bpe.ranks[t[k:]], bpe.ranks[t]) for t in some for k in range(1, len(t)) if t[:k] in bpe.ranks and t[k:] in bpe.ranks]
    left, right, rank = (np.array(x, dtype=np.int32) for x in zip(*pairs, strict=True))
    assert np.array_equal(bpe.table.rank(left, right), rank)


def page_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, payload_bytes string")


def test_archives_round_trip(spark, tmp_path):
    big = "".join(f"<p>{k} é漢</p>" for k in range(4000))
    rows = [(1, "http://a/ b\r\n?x", big), (2, "http://a", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (2, "http://a", big), (7, "u", "WARC/1.1\r\n\r\n" * 500)]
    out = warc.archive_round_trip(page_table(spark, rows), segment=5000)
    got = sorted(map(tuple, out.collect()), key=str)
    want = []
    owner = max(r[0] for r in rows if r[2] == big and r[0])
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = html == big and i != owner
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(page_table(spark, [])).count() == 0


def test_written_archives_are_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BUNDLES", 2)
    warc.write_archives(page_table(spark, [(k, f"http://h/{k}", f"page {k} " * 3000) for k in range(5)]), str(tmp_path / "w"), segment=4000)
    kinds = []
    for f in (tmp_path / "w").glob("part-*"):
        body = f.read_bytes()
        plain = gzip.decompress(body)  # any gzip reader takes the files
        assert b"".join(warc.decompressed(body, step=7)) == plain
        found = list(warc.parse_records(plain[k : k + 11] for k in range(0, len(plain), 11)))
        assert found == list(warc.parse_records([plain])) == list(warc.parse_records(warc.decompressed(body)))
        kinds += [(x["warc-type"], x.get("warc-segment-number")) for x, _ in found]
        for cut in (1, 9, 777) if plain else ():  # an empty partition has an empty file
            with pytest.raises(ValueError):
                list(warc.parse_records([plain[:-cut]]))
    assert sum(k == ("response", "1") for k in kinds) == 5 and {k for k, _ in kinds} == {"response", "continuation"}


def test_a_very_long_page(spark, monkeypatch):
    """Many segments, several bundles and files; bundles are bounded by bytes."""
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 50_000)
    monkeypatch.setattr(warc, "FILE_BUNDLES", 1)
    rng = random.Random(1)
    big = "".join(chr(rng.randrange(32, 500)) for _ in range(1_500_000))
    got = warc.archive_round_trip(page_table(spark, [(1, "u", big), (2, "u", big), (3, "u", "x")])).collect()
    body = big.encode()
    assert {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got} == {(1, len(body), "revisit", 2), (2, len(body), "response", None), (3, 1, "response", None)}
    assert {r["payload_digest"] for r in got if r["page_id"] < 3} == {hashlib.sha1(body).hexdigest()}


def test_segments_and_chunks():
    rng = random.Random(2)
    for n in (0, 1, 10, 8192, 30_000):
        body = bytes(rng.randrange(256) for _ in range(n))
        assert warc.unchunked(warc.chunked(body, 777)) == body
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert warc.assemble([(2, b"b"), (1, b"a")], 2) == b"ab"
    for parts, total in (([(1, b"a"), (3, b"b")], 2), ([(1, b"a"), (1, b"a")], 2), ([(1, b"a")], 2), ([(1, b"a")], None)):
        with pytest.raises(ValueError):
            warc.assemble(parts, total)


def blocks(html):
    """Text of a page of which nothing but the page itself is known."""
    return "\n".join(t for _, t, kind in style_tree.parse(html)[0] if kind != style_tree.CLOSED)


def test_page_text():
    page = """<html><head><title>no</title><style>p{}</style></head><body><header>H</header><nav><a>menu</a></nav><div class="ad-box">buy</div>
    <article><header><h1>Ti&amp;tle</h1></header><p>One <b>two</b>\n three<br>four<p>five &lt;6&gt; <span class="share">tweet</span> 7<script>x("</p>")</script>
    <ul><li>a<li>b</ul><!-- c --><form>f</form><div id="newsletterSignup">join</div><table><tr><td>x<td>y</table><aside>side</aside></article>
    <section class="comments"><article>me too</article></section><footer>&copy;</footer></body>"""
    assert blocks(page) == "Ti&tle\nOne two three four\nfive <6> 7\na\nb\nx\ny"
    assert blocks("<p>a<p>b</p></p>c") == "a\nb\nc" and blocks("") == "" and blocks("plain  text") == "plain text"
    assert blocks("<main><p>in</main><p>out") == "in" and blocks("<article><p>cut <b") == "cut" and blocks("<div>x &am") == "x &am"
    assert blocks("<div id='cookiebar'>c</div><div class='commentary'>d</div><p class='mainSidebar'>e</p>") == "d"
    assert blocks("<article>a<article class='x'>b</article>c</article>") == "a\nb\nc" and blocks("<p title='>'>q</p>") == "q"


def brute_texts(rows, tree=True):
    """Texts by plain loops over pages and hosts, from the blocks of parse(); without the tree no node is cut by it."""
    import math
    import re

    S = style_tree
    pages, seen = [], {}
    for _, url, html in rows:
        found = re.search(r"://([^/?#]*)", url or "")
        host = (found[1] if found else "").lower()
        parts, children = S.parse(html or "")
        pages.append((host, parts))
        seen[host, "\n".join(t for _, t, _ in parts)] = (host, parts, children)
    contents, styles = defaultdict(list), defaultdict(list)
    for host, parts, children in seen.values():
        own = defaultdict(list)
        for path, text, kind in parts:
            if kind != S.ARTICLE:
                own[path, kind].append(text)
        for node, texts in own.items():
            contents[host, node].append("\n".join(texts))
            contents[None, node].append("\n".join(texts))
        for path in {x for p, _ in own for x in S.above(p)}:
            labels = children.get(path, [])
            styles[host, path].append([x for k, x in enumerate(labels) if not k or x != labels[k - 1]])

    def even(values):
        counts, m = defaultdict(int), len(values)
        for v in values:
            counts[str(v)] += 1
        return 1.0 if m < 2 else -sum(c / m * math.log(c / m) for c in counts.values()) / math.log(m)

    def importance(host, node):
        a, b = (min(len(contents[h, node]) - 1, S.EVIDENCE) for h in (host, None))
        content = (a * even(contents[host, node]) + b * even(contents[None, node]) + 1) / (a + b + 1)
        around = S.above(node[0])
        style = sum(even(styles[host, x]) for x in around) / len(around) if around else 1.0
        return S.PRESENTATION * style + (1 - S.PRESENTATION) * content

    known, out = {}, []
    for host, parts in pages:
        text = []
        for path, t, kind in parts:
            node = (path, kind)
            if kind != S.ARTICLE and (host, node) not in known:
                value = importance(host, node)
                low = value < (S.LEAST_CLOSED if kind == S.CLOSED else S.LEAST)
                known[host, node] = tree and low or not low and kind == S.CLOSED
            if kind == S.ARTICLE or not known[host, node]:
                text.append(t)
        out.append("\n".join(text))
    return out


def test_the_tree_decides_the_text_of_most_pages(spark):
    """On sf0.1 every text equals the brute-force twin's, and without the tree most pages would keep boilerplate."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.orderBy("page_id").collect()]
    got = [r["text"] for r in style_tree.extract_text(pages).orderBy("page_id").collect()]
    assert got == brute_texts(rows)
    assert sum(a != b for a, b in zip(got, brute_texts(rows, tree=False), strict=True)) > len(rows) / 2


def page_rows():
    """Hosts of many, few, equal and near pages, with and without articles; hard pages."""
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    rows, menu = [], [say(3) for _ in range(3)]
    for k in range(160):
        host = ["a.org", "b.org", "c.org", "d.org", f"lone{k}.org"][min(4, rng.randrange(12) // 2)]
        body = f"<h1>{rng.choice(['Daily', say(2)])}</h1><p>{say(9)}</p><p>{say(4)}<div class='box'><span>{rng.choice(menu)}</span></div>"
        body = f"<article>{body}</article>" if k % 3 == 0 else f"<main>{body}</main>" if k % 3 == 1 else body
        rows.append((k, f"http://{host}/{k}", f"<nav><ul><li>{rng.choice(menu)}<li>x</ul></nav><div class='top'>Hi</div>{body}<div class='comments'><p>{say(5)}</div><footer>{host}</footer>"))
    rows += [(900, None, None), (901, None, ""), (902, "no scheme", "plain"), (903, "http://a.org/", "<p>" + "x" * 400_000), (904, "http://a.org/", "<div>t" * 2000 + "deep"), rows[5], rows[5]]
    return rows


def test_texts_equal_the_twin(spark, monkeypatch):
    rows = page_rows()
    want = sorted(zip([r[0] for r in rows], brute_texts(rows), strict=True))
    key = lambda out: sorted((r["page_id"], r["text"]) for r in out.collect())
    assert key(style_tree.extract_text(page_table(spark, rows))) == want
    monkeypatch.setattr(style_tree, "BROADCAST_BYTES", 0)  # the salted join
    assert key(style_tree.extract_text(page_table(spark, rows).repartition(5))) == want


def test_style_tree_drops_what_a_site_repeats(spark):
    rows = [(k, f"http://s{k % 2}.org/{k}", f"<div class='top'>Welcome to site {k % 2}</div><div class='body'><p>Text number {k}</p><p>and more {k * k}</p></div><div class='end'>All the same</div>") for k in range(40)]
    rows += [(100, "http://lone.org/1", "<div class='top'>Welcome to site 0</div><p>x</p>"), (101, None, None), (102, "http://s0.org/9", "<div class='end'>All the same</div>")]
    rows += [(200 + k, "http://copies.org/", "<div><p>one and the same page</p></div>") for k in range(20)]
    got = {r["page_id"]: r for r in style_tree.extract_text(page_table(spark, rows)).collect()}
    assert all(got[k]["text"] == f"Text number {k}\nand more {k * k}" for k in range(40))
    assert got[100]["text"] == "x" and got[101]["text"] == "" and got[101]["n_chars"] == 0  # the single page of a host goes by what other hosts show
    assert got[102]["text"] == ""  # nothing but template
    assert all(got[200 + k]["text"] == "one and the same page" for k in range(20))  # copies are one page
    assert len(got) == len(rows) and style_tree.extract_text(page_table(spark, [])).count() == 0


def test_declared_articles_stay_whole_on_any_host(spark):
    # one heading on most pages of a host, different bodies: of low importance by its entropy
    page = lambda k: f"<div class='top'>Hello</div><article><h1>{'Daily report' if k < 180 else f'Report {k}'}</h1><p>Body {k}</p></article>"
    rows = [(k, f"http://hot.org/{k}", page(k)) for k in range(200)] + [(500 + k, f"http://hot.org/x{k}", f"<div class='top'>Hello</div><p>Plain {k}</p>") for k in range(20)]
    got = {r["page_id"]: r["text"] for r in style_tree.extract_text(page_table(spark, rows)).collect()}
    assert all(got[k] == f"{'Daily report' if k < 180 else f'Report {k}'}\nBody {k}" for k in range(200))
    assert all(got[500 + k] == f"Plain {k}" for k in range(20))  # where no article is declared, the template still goes


def texts(pages):
    return {r["page_id"]: r["text"] for r in style_tree.extract_text(pages).collect()}


def test_without_the_tree_alone_every_page_keeps_its_advert(spark, monkeypatch):
    """Only the tree is switched off: names, roles and declared articles decide as before."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = texts(pages)
    monkeypatch.setattr(style_tree, "LEAST", -1.0)
    monkeypatch.setattr(style_tree, "LEAST_CLOSED", -1.0)
    without = texts(pages)
    assert len(got) == 250 and all(without[k].endswith(got[k]) and len(without[k]) > len(got[k]) for k in got)


def test_the_tree_overrules_misleading_names(spark):
    """The same texts where nothing declares an article, a menu or a footer, and articles bear the name of an advert."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = F.col("html")
    for tag, name in (("article", "social-story"), ("nav", "menu"), ("footer", "footer")):
        html = F.replace(F.replace(html, F.lit(f"<{tag}>"), F.lit(f'<div class="{name}">')), F.lit(f"</{tag}>"), F.lit("</div>"))
    got, want = texts(pages.withColumn("html", html)), texts(pages)
    assert got == want and all(want.values())


def test_a_story_beside_a_teaser_stays(spark):
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    ads, rows, want = [say(4) for _ in range(60)], [], {}
    for k in range(60):
        story = [say(8) for _ in range(rng.randrange(1, 25))]
        links = "".join(f"<p><a href='/{say(1)}'>{say(3)}</a></p>" for _ in range(rng.randrange(1, 25)))
        replies = "".join(f"<p>{say(5)}</p>" for _ in range(rng.randrange(1, 25)))
        page = f"<div class='banner'>{rng.choice(ads)}</div><div class='related'>{links}</div><article><p>Read us every day</p></article>"
        page += f"<div class='story'>{''.join(f'<p>{t}</p>' for t in story)}<div class='ad'>{rng.choice(ads)}</div></div>"
        rows.append((k, f"http://s{k % 2}.org/{k}", page + f"<div class='comments'>{replies}</div><div id='responses'>{replies}</div>"))
        want[k] = "\n".join(["Read us every day", *story])
    assert texts(page_table(spark, rows)) == want
    # of a site of one page nothing is known: what lies beside a declared article goes
    assert texts(page_table(spark, rows[:1])) == {0: "Read us every day"}


def test_branches_of_blocks():
    found = lambda html: [(b.text, b.prose, b.branches) for b in style_tree.read(html)[0] if b.kind == style_tree.CLOSED]
    assert found("<article>a</article><div><p>b <a>c</a><div class='ad'>d</div></div>") == [("b c", "b", (">div",)), ("d", "d", (">div", ">div>divclass=ad"))]
    assert found("<div class='ad'><div><p class='promo'>e</div><div class='comments'>f</div></div>") == [("e", "e", (">divclass=ad", ">divclass=ad>div>pclass=promo")), ("f", "", ())]
    assert found("<article>a</article><div class='responses'>g</div><nav>h</nav>") == [("g", "", ()), ("h", "", ())]
    assert found("i<button class='ad'><p>j</p></button>") == [("i", "i", ("",))]


def test_branches_equal_a_twin_over_pairs_of_pages(spark):
    rng = random.Random(3)
    rows = []
    for k in range(70):
        host = ["a.org", "a.org", "b.org", f"lone{k}.org"][rng.randrange(4)]
        box = "".join(f"<p>{rng.randrange(4)} <a>link {k}</a>" for _ in range(rng.randrange(1, 4)))
        rows.append((k, f"http://{host}/{k}", f"<div class='promo'>{box}<div class='ad'>{rng.randrange(3)}</div></div><article>{k % 50}</article><p>beside {k % 9}"))
    seen = {}
    for _, url, html in rows:
        parts, host = style_tree.read(html)[0], url.split("/")[2]
        found = defaultdict(list)
        for b in parts:
            for p in b.branches:
                found[p].append(b)
        seen[host, "\n".join(b.text for b in parts)] = (host, {p: ("\n".join(b.prose for b in of if b.prose), [b.path for b in of]) for p, of in found.items()})
    at = defaultdict(lambda: defaultdict(list))
    for host, found in seen.values():
        for p, pair in found.items():
            at[p][host].append(pair)

    def differ(values):
        pairs = [(x, y) for i, x in enumerate(values) for j, y in enumerate(values) if i != j]
        return sum(x != y for x, y in pairs) / len(pairs) if pairs else 0.0

    want, limit = {}, 2 * style_tree.EVIDENCE
    for p, hosts in at.items():
        beyond = sum(len(v) - 1 for v in hosts.values())
        for host, pairs in hosts.items():
            mine = min(len(pairs) - 1, limit)
            every, worth = min(beyond, limit - mine), []
            for i in (0, 1):
                pooled = sum((len(v) - 1) * differ([x[i] for x in v]) for v in hosts.values()) / beyond if beyond else 0.0
                worth.append((mine * differ([x[i] for x in pairs]) + every * pooled) / (mine + every + 1))
            want[host, style_tree._number(f"{p}#1")] = sum(worth) / 2
    got = {(r["host"], r["path"]): r["importance"] for r in style_tree.branch_importance(style_tree.parsed_pages(page_table(spark, rows))).collect()}
    assert set(got) == set(want) and len({p for _, p in want}) == 3
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_intermediates_are_deleted(spark):
    from pathlib import Path

    from tessera.llm import runtime

    df = runtime.stored(spark.range(3), "some")
    assert df.count() == 3 and list(Path(runtime.own_dir(spark)).glob("some-*"))
    runtime.clear(spark)
    assert not Path(runtime.own_dir(spark)).exists()


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tessera.llm import runtime

    conf = SimpleNamespace(get=lambda k, d=None: None)
    with pytest.raises(RuntimeError):
        runtime.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://x:7077")))


@pytest.mark.parametrize("number", range(5))
def test_stages_of_hard_rows(spark, folder, number):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, an empty table: each stage alone."""
    _, stage = corpus_pipeline.STAGES[number]
    good = " ".join(f"word{k} of a good text." for k in range(60))
    plain = [(i, t, None, None, None) for i, t in HARD] + [(50, good, "en", "a", len(good)), (50, good, "en", "a", len(good)), (51, good + " more", None, None, None), (None, good, "en", "a", 1), (52, good * 300, "en", "b", 1)]
    docs = spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("component_id", "bucket", "node", "keys", "size", "target", "n", "score", "label", "path", "least", "__rows_"):
        docs = docs.withColumn(name, F.lit("x"))
    out = stage(spark, docs, folder)
    rows = out.collect()
    empty = stage(spark, docs.where("false"), folder)
    assert empty.count() == 0
    if number < 4:
        assert out.columns == empty.columns == docs.columns and {r["bucket"] for r in rows} <= {"x"}
    if number == 0:
        assert {r["doc_id"] for r in rows} == {50, 51, None} or {r["doc_id"] for r in rows} == {50, 51, 52, None}
    if number == 2:
        assert sum(r["doc_id"] == 50 for r in rows) == 1 and not any(r["doc_id"] == 51 for r in rows) and sum(r["doc_id"] is None for r in rows) == 2
    if number == 4:
        assert len(rows) == len(plain) and all(r["n_tokens"] is not None for r in rows)


def test_pipeline(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], folder).persist())
    assert all(s.columns == docs.columns for s in steps[:-1])
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) > 50
    rows = [(r["doc_id"], r["text"]) for r in steps[2].collect()]
    keep = {c for _, _, c in brute_components(rows, 5, 80)}
    assert ids[3] == keep
    words = lambda df: sum(len(WORD.findall(r["text"])) for r in df.collect())
    assert words(steps[4]) == pytest.approx(1.5 * words(steps[3]), rel=0.01)
    assert steps[5].count() == steps[4].count() and corpus_pipeline.run(spark, folder).count() == steps[5].count()


def test_join_tasks_free_what_the_encoder_kept_and_hold_few_rows_at_once():
    """Worker processes are reused: the join's memory came on top of the encoder's tables, and its results of 10,000 rows were one batch."""
    made = runtime.kept_in_worker(("encoder",), object)
    assert runtime.kept_in_worker(("encoder",), object) is made
    n = 2 * arrow_text.ROWS + 1
    texts = [None, "", *(f"a b c d e f{k}" for k in range(n - 2))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    for run in (parity_join._sketcher(parity_join.ParityJoin()), parity_join._sets(5)):
        made = runtime.kept_in_worker(("encoder",), object)
        out = list(run(iter([batch])))
        assert runtime.kept_in_worker(("encoder",), object) is not made
        assert [len(b) for b in out] == [arrow_text.ROWS, arrow_text.ROWS, 1]
        assert pa.Table.from_batches(out).column(0).to_pylist() == list(range(n))
        runtime.take_over()


def test_encoder_remembers_one_string_a_piece_and_goes_when_another_takes_over(bpe):
    """A worker's table of 200,000 pieces had a tuple, a string and bytes for each."""
    import public_tokenizers

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array(["Ünïcode wörds, again wörds", "", None])], names=["doc_id", "text"])
    out = pa.Table.from_batches(byte_bpe._digests(None, None)(iter([batch]))).to_pylist()
    own = byte_bpe.loaded(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert own.known and all(type(x) is str for x in own.known.values())
    ids = own.encode("Ünïcode wörds, again wörds")
    assert [r["n_tokens"] for r in out] == [len(ids), 0, 0]
    assert out[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert out[0]["decoded_sha256"] == hashlib.sha256("Ünïcode wörds, again wörds".encode()).hexdigest()
    assert out[1]["decoded_sha256"] == out[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    runtime.take_over()
    assert byte_bpe.loaded(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN) is not own
