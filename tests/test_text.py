import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, column, *values):
    names = "abcdef"[: len(values)]
    row = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return row.select(column(*map(F.col, names))).first()[0]


@pytest.mark.parametrize(
    "title, abstract, want",
    [
        ("Deep learning in schools", "We train a CNN.", "Deep learning in schools. We train a CNN."),
        ("Is AI useful?", "Yes.", "Is AI useful? Yes."),
        ("Only a title", "", "Only a title"),
        ("", "b", "b"),
    ],
)
def test_compose(spark, title, abstract, want):
    assert one(spark, T.compose, title, abstract) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Abstract: We train a CNN.", "We train a CNN."),
        ("ABSTRACT We train.", "We train."),
        ("We present an abstract representation of graphs.", "We present an abstract representation of graphs."),
        ("We train a model. Copyright 2023 Elsevier Ltd.", "We train a model."),
        ("See https://example.com/x and doi:10.1234/abc or a@b.com now", "See and or now"),
        ("Background: AI is growing. Methods: We used a CNN.", "AI is growing. We used a CNN."),
        ("We apply artificial intelligence (AI) to imaging.", "We apply artificial intelligence to imaging."),
        ("grew (from 80% to 92%), (which we describe later)", "grew (from 80% to 92%), (which we describe later)"),
        ("don’t 2015–2025 café", "don't 2015-2025 café"),
        (None, ""),
        ("", ""),
    ],
)
def test_clean(spark, text, want):
    assert one(spark, T.clean, text) == want


def test_copyright_needs_the_end_of_the_text(spark):
    assert "All rights reserved" in one(spark, T.strip_copyright, "All rights reserved.\nMore")


def test_nfkc_of_documents(spark, folder):
    from tessera import catalog

    got = {r["doc_id"]: r["text"] for r in catalog.QUERIES["clean_text_nfkc"](spark, folder).collect()}
    raw = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(raw)
    for r in raw:
        if unicodedata.normalize("NFKC", r["text"]) != r["text"]:
            assert unicodedata.is_normalized("NFKC", got[r["doc_id"]])


def tokens(spark, text, **more):
    return one(spark, lambda c: T.tokens(c, T.stopwords(), ("ai", "ml", "cv", "cnn", "gan"), **more), text)


def test_tokens(spark):
    assert tokens(spark, "AI and ML transform CV research") == ["ai", "ml", "transform", "cv"]
    assert tokens(spark, "we go to it") == []
    assert tokens(spark, "Several CNNs and GANs were trained") == ["cnn", "gan", "trained"]
    assert tokens(spark, "deep-learning models", lemmas={"learning": "learn", "models": "model"}) == ["deep", "learn", "model"]
    assert tokens(spark, None) == []


def test_keys(spark):
    assert one(spark, T.title_key, "GA-Optimized LDA: A Study!") == one(spark, T.title_key, "ga optimized lda a study")
    assert one(spark, T.title_key, "naïve é_x!") == "naïve é_x"
    assert one(spark, T.doi_key, "https://doi.org/10.1/ABC") == "10.1/abc"
    assert one(spark, T.doi_key, "") is None
    assert [one(spark, T.coerce_year, v) for v in ("2022-05-01", "2019", "n.d.")] == [2022, 2019, None]
    assert one(spark, T.raw_token_count, " a b  c ") == 3


def test_relevance(spark):
    yes = ["BERT for named entity recognition", "An AI-based diagnostic system", "a neural network", "language models", "yolov5"]
    no = ["neural networks", "random forests", "VGG16", "GPT-4o", "Strong motion observations"]
    assert [one(spark, T.is_relevant, t, "") for t in yes + no] == [True] * 5 + [False] * 5
    assert one(spark, T.is_relevant, "AI here", "") and not one(spark, T.is_relevant, "x", "AI here")


def test_affiliations(spark):
    df = spark.createDataFrame([(["Institute of Engineering", "Arya Institute, Jaipur"],), (["Institute of Engineering", "Pulchowk Campus, Lalitpur, Nepal"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(T.is_home(F.col("a"))).collect()] == [False, True, False]
    people = spark.createDataFrame([([("x", [], ["NP"])],), ([("x", ["Oxford"], ["NP"])],), ([("x", [], [])],), (None,)], "p array<struct<name:string,affiliations:array<string>,country_codes:array<string>>>")
    got = people.select(T.any_author_home(F.col("p")).alias("h"), T.any_author_foreign(F.col("p")).alias("f")).collect()
    assert [(r["h"], r["f"]) for r in got] == [(True, False), (False, True), (False, False), (False, False)]
    assert one(spark, T.mentions_home_institution, "A study at Tribhuvan University") and not one(spark, T.mentions_home_institution, "Earthquakes in Nepal")


def test_label_validation(spark):
    good = '```json\n{"label": "a", "rationale": "b", "coherence": "high", "supporting_doc_ids": ["1"]}\n```'
    rows = [(good,), ('{"label": "a"}',), (good.replace('"1"', '"9"'),), (good.replace("high", "odd"),), ("nonsense",)]
    df = spark.createDataFrame(rows, "r string").select(T.parse_label(F.col("r"), F.array(F.lit("1"))).alias("p"))
    assert [r["p"]["error"] for r in df.collect()] == [None, "shape", "supporting_doc_ids", "coherence", "shape"]


def test_phrases(spark):
    from tessera.operators import vectors as V

    df = spark.createDataFrame([(["x", "deep", "learn", "net", "deep"],), ([],), (None,)], "t array<string>")
    got = [r[0] for r in df.select(V.apply_phrases(F.col("t"), [("deep", "learn"), ("learn", "net")])).collect()]
    assert got == [["x", "deep_learn", "net", "deep"], [], None]


def test_no_phrase_is_left_out(spark):
    import random

    from tessera.operators import vectors as V

    rng = random.Random(5)
    rows = [(k // 2, [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]) for k in range(200)] + [(None, ["a", "b", "c", "d"]), (900, None), (901, [])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    phrases = V.learn_phrases(docs, min_count=10, threshold=0.002)
    known = {(r["a"], r["b"]) for r in phrases.collect()}
    assert 5 < len(known) < 64

    def fold(row):
        out, k = [], 0
        while k < len(row or ()):
            n = 2 if tuple(row[k : k + 2]) in known else 1
            out.append("_".join(row[k : k + n]))
            k += n
        return None if row is None else out

    want = sorted((repr(i), repr(fold(t))) for i, t in rows)
    for small in (0, len(known) - 1, len(known)):  # beyond the bound all phrases are joined, too
        got = V.join_phrases(docs, phrases, small=small)
        assert got.columns == docs.columns and sorted((repr(r["doc_id"]), repr(r["tokens"])) for r in got.collect()) == want


def test_method_pattern_is_python_compatible():
    assert re.search(T.METHOD.replace("(?i)", ""), "deep learning")


def plain_clean(t):
    """The cleaner as plain Python."""
    import re
    import unicodedata

    from tessera.functions import fixed

    t = unicodedata.normalize("NFKC", t or "")
    for old, new in (*zip("‘’‚“”„‐‑‒–—−", "\'\'\'\"\"\"------", strict=True), ("…", "..."), ("\xa0", " "), ("\u200b", ""), ("\ufeff", "")):
        t = t.replace(old, new)
    t = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ", t)
    t = re.sub(fixed.COPYRIGHT.replace("$", r"\Z"), " ", t)
    for pattern in (fixed.URL, fixed.DOI, fixed.EMAIL):
        t = re.sub(pattern, " ", t, flags=re.A)
    t = re.sub(fixed.LEADING, "", t)
    t = re.sub(rf"(?i)\b({'|'.join(fixed.SECTION_HEADERS)})\s*:\s*", "", t)
    return re.sub(r"[ \t\n\r\x0b\x0c]+", " ", re.sub(fixed.ACRONYM, " ", t)).strip(" ")


def test_clean_text_equals_plain_python(spark, folder):
    from tessera import catalog

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: r["text"] for r in catalog.QUERIES["clean_text_nfkc"](spark, folder).collect()}
    assert got == {k: plain_clean(t) for k, t in docs.items()}
    hard = ["ﬁne “x” … ½ （ab）", "Abstract: – Methods: a (AI) b (ANNs) © 2020 tail", "see https://x.y/z doi:10.1234/ab and a.b@c.de", "\x01\x1f\x7f", "ａｂｃ\u3000d", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(hard)], "k int, t string").select("k", T.clean(F.col("t")).alias("t"))
    assert [r["t"] for r in df.orderBy("k").collect()] == [plain_clean(t) for t in hard]


def test_endings_and_hints(spark):
    words = ["studies", "classes", "boxes", "glass", "virus", "cats", "cat", "churches", "women", "basis"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.by_endings(F.col("w"), T.NOUN_ENDINGS).alias("x"))
    assert dict(map(tuple, df.collect())) == {"studies": "study", "classes": "class", "boxes": "box", "glass": "glass", "virus": "virus", "cats": "cat", "cat": "cat", "churches": "church", "women": "woman", "basis": "basis"}
    got = spark.createDataFrame([(["Inst A, X", "b", None, "Inst A, X", "inst c"],)], "a array<string>").select(T.hinted_affiliations(F.col("a"), ["INST"])).first()[0]
    assert got == ["Inst A, X", "inst c"]
