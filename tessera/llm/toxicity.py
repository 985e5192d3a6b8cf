"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters and digit substitutions to plain
letters and punctuation to blanks, and removes invisible characters. The lexicon
has whole words, from a table or a short default list, and stems (matched at the
start of a word) learned from labelled rows: a stem is judged by the documents that
hold it once, twice or three times at least, and a hit weighs the log-odds of the best
of these, shared out. Hits inside an exception phrase do not count; phrases come from
a table or a default list, and are learned from labelled rows as well: two words, one
of them a hit, that occur in clean documents though such hits are toxic. The summed
weight and the weight per hundred words, through a logistic curve fitted on the same
rows, give the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import labelled
from .runtime import stored

#: At most so many labelled rows are learned from.
TRAIN_ROWS = 20_000
MODULUS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Lengths of stems, and the numbers of occurrences in a document at which a stem is judged.
STEM_LENGTHS = range(4, 11)
OCCURRENCES = (1, 2, 3)
#: Words and phrases that tables may hold: they are part of every task's automaton.
MOST_ENTRIES = 100_000
DEFAULT_WORDS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting")
DEFAULT_WEIGHT = 3.0
EXCEPTIONS = ("stupid question", "trash can", "trash bin", "class clown", "clown fish", "sore loser", "pond scum", "disgusting taste")

_LOOKALIKES = {
    **dict(zip("аеорсхуікмнтвѕјԁ", "aeopcxyikmhtbsjd", strict=True)),  # Cyrillic
    **dict(zip("αορτυινκ", "aoptuivk", strict=True)),  # Greek
    **{chr(0xFF41 + k): chr(97 + k) for k in range(26)},  # full width
}
_SUBSTITUTES = dict(zip("0134578@$!", "oieastbasi", strict=True))
_INVISIBLE = "­​‌‍⁠﻿"
_TABLE = {ord(k): v for k, v in _LOOKALIKES.items()}
_TABLE |= {ord(c): None for c in _INVISIBLE}
_TABLE |= {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in "@$!"}
_DIGITS = str.maketrans(_SUBSTITUTES)
_RUN = re.compile(r"[0-9@$!]+")


class _Bases(dict):
    """Code point to that of the letter without accents and styles, itself where that is no single letter."""

    def __missing__(self, code: int) -> int:
        letters = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        out = self[code] = ord(letters[0].lower()) if len(letters) == 1 and len(letters[0].lower()) == 1 else code
        return out


_BASES = _Bases({0x131: ord("i")})


def _plain(text: str) -> str:
    """Lower case, look-alikes as plain letters, other marks as blanks; digits and @ $ ! as they are."""
    return f" {unicodedata.normalize('NFC', text).lower().translate(_TABLE)} "


def _resolved(text: str) -> tuple[str, set[tuple[int, int]]]:
    """A plain text with digits and marks read as letters, but ``!`` only between letters, and the spans of words that begin or end with some."""
    edges: set[tuple[int, int]] = set()

    def read(m: re.Match) -> str:
        a, b = m.span()
        before, after = text[a - 1].isalpha(), text[b].isalpha()  # blanks stand at both ends
        if before and after:
            return m[0].translate(_DIGITS)
        if before or after:
            edges.add((text.rfind(" ", 0, a) + 1, text.find(" ", b)))
        return m[0].replace("!", " ").translate(_DIGITS)

    return _RUN.sub(read, text), edges


def folded(text: str) -> str:
    """Folded text between blanks."""
    return _resolved(_plain(text))[0]


def _readings(word: str) -> set[str]:
    """A word with digits or marks at its edges, without them at one end or both, and with all as letters."""
    first = _RUN.match(word)
    last = word.rstrip("0123456789@$!")
    begin = first.end() if first else 0
    return {x.translate(_DIGITS) for x in (word, last, word[begin:], last[begin:])}


@dataclass(frozen=True)
class Lexicon:
    stems: tuple[tuple[str, float], ...]
    words: tuple[tuple[str, float], ...] = tuple((w, DEFAULT_WEIGHT) for w in DEFAULT_WORDS)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 1.5, 1.0)

    @cached_property
    def listed(self) -> frozenset[str]:
        """The words that the entries of the list are made of."""
        return frozenset(part for w, _ in self.words for part in w.split())

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        entries = {f" {w} ": (len(w), x) for w, x in self.words}
        entries |= {f" {s}": (len(s), x) for s, x in self.stems}
        for phrase in self.exceptions:
            entries[f" {phrase} "] = (len(phrase), 0.0)
        for key, (_, weight) in entries.items():
            out.add_word(key, (len(key), weight))
        if entries:
            out.make_automaton()
        return out

    @staticmethod
    def _best(body: str, automaton, words_only: bool = False) -> dict[int, float]:
        """Weight of the heaviest match (of a whole word, if asked for) at each place of a folded text, those inside exceptions left out."""
        found = [(end - size + 1, end, weight) for end, (size, weight) in automaton.iter(body)]
        cover = [(a, b) for a, b, weight in found if not weight]
        best: dict[int, float] = {}
        for a, b, weight in found:
            if weight and (not words_only or body[b] == " ") and not any(x <= a and b <= y + 1 for x, y in cover):
                best[a] = max(best.get(a, 0.0), weight)
        return best

    def weight(self, text: str, automaton) -> tuple[float, int, int]:
        """Summed weight, hits and words of a text."""
        plain = _plain(text)
        body, edges = _resolved(plain)
        split = body.split()
        words = len(split)
        if not len(automaton):
            return 0.0, 0, words
        best = self._best(body, automaton)
        for a, b in edges:  # "idiot5" and "@idiot" as well as "$cum" and "1diot"; a word counts once
            at = b - len(body[a:b].lstrip()) - 1
            if at in best:
                continue
            before, after = body[max(0, a - 200) : a].split()[-1:], body[b : b + 200].split()[:1]
            place = len(" ".join(before)) + bool(before)
            read = (self._best(f" {' '.join([*before, r, *after])} ", automaton).get(place, 0.0) for r in _readings(plain[a:b]))
            if other := max(read, default=0.0):
                best[at] = other
        # accents tell words of other languages apart, so only whole words of the list are looked for without them
        if not body.isascii() and not self.listed.isdisjoint(w.translate(_BASES) for w in set(split) if not w.isascii()):
            for place, weight in self._best(body.translate(_BASES), automaton, words_only=True).items():
                best.setdefault(place, weight)
        return sum(best.values()), len(best), words

    def score(self, weight: float, words: int) -> float:
        a, b, c = self.curve
        z = a + b * math.log1p(weight) + c * math.log1p(100 * weight / max(words, 1))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _counted(batches: Iterator[pa.RecordBatch], keys: Callable[[str], Iterable[str]], name: str) -> Iterator[pa.RecordBatch]:
    """(name, clean, toxic): documents of either label that have each key, summed within a partition piece by piece."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        found = list(counts[0].keys() | counts[1].keys())
        made = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([c[s] for s in found], pa.int64()) for c in counts)], names=[name, "clean", "toxic"])
        for c in counts:
            c.clear()
        return made

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counts[1 if label else 0].update(keys(folded(text.as_py() or "")))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield out()
    yield out()


def _stems(body: str) -> Iterator[str]:
    """Stems of a folded text, each with a digit for every number of occurrences that it reaches."""
    times: Counter = Counter()
    for word, c in Counter(body.split()).items():
        for n in STEM_LENGTHS:
            if len(word) >= n:
                times[word[:n]] += c
    for stem, c in times.items():
        for k in OCCURRENCES:
            if c >= k:
                yield f"{k}{stem}"


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted(batches, _stems, "stem")


def _phrase_counts(lexicon: Lexicon):
    """Counts of pairs of words of which one is a hit; the empty phrase counts documents with any hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()

        def phrases(body: str) -> set[str]:
            found = {end - size + 2 for end, (size, weight) in automaton.iter(body) if weight} if len(automaton) else ()
            out = set()
            for start in found:
                end = body.find(" ", start)
                before = body[:start].rstrip().rpartition(" ")[2] if start < 200 else body[start - 200 : start].rstrip().rpartition(" ")[2]
                after = body[end : end + 200].split(maxsplit=1)
                out.add("")
                if before:
                    out.add(f"{before} {body[start:end]}")
                if after:
                    out.add(f"{body[start:end]} {after[0]}")
            return out

        yield from _counted(batches, phrases, "phrase")

    return run


def _g2(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Log-likelihood ratio of a key's documents against the base rate."""
    n, total = toxic + clean, all_toxic + all_clean
    terms = ((toxic, n * all_toxic / total), (clean, n * all_clean / total), (all_toxic - toxic, (total - n) * all_toxic / total), (all_clean - clean, (total - n) * all_clean / total))
    return 2 * sum(x * math.log(x / e) for x, e in terms if x > 0 and e > 0)


def least_g2(tested: int) -> float:
    """What chance alone exceeds once in some twenty tables of so many keys."""
    return 2 * math.log(max(tested, 1)) + 2.5


def choose_stems(counts: Iterable[tuple[str, int, int]], all_toxic: int, all_clean: int) -> tuple[tuple[str, float], ...]:
    """Stems far likelier in toxic documents, none a prefix of another; counts are (occurrences and stem, toxic, clean). Ties go by length, then code points."""
    rows = list(counts)
    ranked = sorted(((_g2(t, c, all_toxic, all_clean), len(s), s, t, c) for s, t, c in rows), reverse=True)
    least = least_g2(len(rows))
    kept: dict[str, float] = {}
    used: set[str] = set()
    for g2, _, key, toxic, clean in ranked:
        if g2 < least:
            break
        stem = key[1:]
        if stem in used or any(stem[:n] in kept for n in STEM_LENGTHS if n <= len(stem)):
            continue
        odds = math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))
        kept[stem] = round(odds / int(key[0]), 6)
        used.update(stem[:n] for n in STEM_LENGTHS if n <= len(stem))
    return tuple(sorted(kept.items()))


def choose_exceptions(counts: Iterable[tuple[str, int, int]]) -> tuple[str, ...]:
    """Phrases far likelier in clean documents than hits are; counts are (phrase, toxic, clean), the empty phrase standing for all documents with a hit."""
    rows = {p: (t, c) for p, t, c in counts}
    all_toxic, all_clean = rows.pop("", (0, 0))
    least = least_g2(len(rows))
    return tuple(sorted(p for p, (t, c) in rows.items() if c >= 3 and c * all_toxic > 4 * t * all_clean and _g2(t, c, all_toxic, all_clean) >= least))


def fit_curve(rows: list[tuple[float, int, int]]) -> tuple[float, float, float]:
    """Ridge logistic regression on (weight, words, label) by Newton steps."""
    if len({bool(r[2]) for r in rows}) < 2:
        return Lexicon.curve
    x = np.array([(1.0, math.log1p(w), math.log1p(100 * w / max(n, 1))) for w, n, _ in rows])
    y = np.array([float(bool(r[2])) for r in rows])
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(round(float(b), 6) for b in beta)


_SCORED = "doc_id long, held_out boolean, score double, predicted int, weight double, n_hits int, n_words int"


def _scorer(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [lexicon.weight(t.as_py() or "", automaton) for t in batch.column(1)]
            scores = [lexicon.score(w, n) for w, _, n in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([i is not None and labelled.fold_of(i, MODULUS) == HELD_OUT for i in ids]),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                    pa.array([w for w, _, _ in found], pa.float64()),
                    pa.array([h for _, h, _ in found], pa.int32()),
                    pa.array([n for _, _, n in found], pa.int32()),
                ],
                names=["doc_id", "held_out", "score", "predicted", "weight", "n_hits", "n_words"],
            )

    return run


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Scores of every row of docs (doc_id, text, ...).

    Null and empty texts have no hits and get the least score. A very long text is
    matched whole; repeated rows and equal texts get equal scores; an empty table gives
    no rows; other columns are ignored. held_out is false for a null doc_id.
    """
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(_scorer(lexicon), _SCORED)


def _entries(df: DataFrame | None, *columns: str) -> list[tuple] | None:
    """Rows of a table of words or phrases; a table beyond MOST_ENTRIES is an error, as every task holds it."""
    if df is None:
        return None
    rows = df.select(*columns).where(" AND ".join(f"{c} IS NOT NULL" for c in columns)).distinct().limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries")
    return sorted((" ".join(folded(r[0]).split()), *r[1:]) for r in rows if folded(r[0]).split())


def learn_lexicon(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, words: DataFrame | None = None, exceptions: DataFrame | None = None) -> Lexicon:
    """Stems, exceptions, weights and curve from at most ``rows`` labelled rows outside the held-out fold.

    words (word, weight) and exceptions (phrase) are tables that stand in for the
    default lists; they are folded like texts. Labels of one kind, or none, leave these
    lists and the default curve.
    """
    named, phrases = _entries(words, "word", "weight"), _entries(exceptions, "phrase")
    base = Lexicon((), Lexicon.words if named is None else tuple((w, float(x)) for w, x in named), EXCEPTIONS if phrases is None else tuple(p for (p,) in phrases))
    train = stored(labelled.sample(docs, labels, "toxic", MODULUS, HELD_OUT, rows).select("text", "label", "doc_id"), "train")
    totals = dict(train.groupBy((F.col("label") > 0).alias("toxic")).count().collect())
    toxic, clean = totals.get(True, 0), totals.get(False, 0)
    if not toxic or not clean:
        return base
    summed = lambda run, key: train.mapInArrow(run, f"{key} string, clean long, toxic long").groupBy(key).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = summed(_stem_counts, "stem").where((F.col("toxic") * clean > 4 * F.col("clean") * toxic) & (F.col("toxic") >= 3))
    # each document has a bounded share of such stems; the rows of the sample bound them all
    lexicon = replace(base, stems=choose_stems(((r["stem"], r["toxic"], r["clean"]) for r in counts.toLocalIterator()), toxic, clean))
    near = summed(_phrase_counts(lexicon), "phrase").where("clean >= 3 OR phrase = ''")
    learned = choose_exceptions((r["phrase"], r["toxic"], r["clean"]) for r in near.toLocalIterator())
    lexicon = replace(lexicon, exceptions=tuple(sorted({*lexicon.exceptions, *learned})))
    measured = score_documents(train, lexicon).alias("s").join(train.select("doc_id", "label"), "doc_id").select("weight", "n_words", "label").collect()
    return replace(lexicon, curve=fit_curve([tuple(r) for r in measured]))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return score_documents(docs, learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def words_of(text: str) -> list[str]:
    """Folded words, for reports and tests."""
    return re.findall(r"\S+", folded(text))
