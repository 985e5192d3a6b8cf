"""Text cleaning, keys, tokens and predicates as Column -> Column functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed
from .fixed import ABBREVIATION, ACRONYM, COPYRIGHT, DOI, EMAIL, LEADING, URL

#: Literal replacements after NFKC: curly quotes, dashes and minus, ellipsis; blanks and marks without width.
_STRAIGHT = {
    "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "…": "...",
    " ": " ", "​": "", "﻿": "",
}
_ASCII = r"^[\x00-\x7F]*$"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalise_unicode(c: Column, nfkc: bool = True) -> Column:
    """NFKC (Python only for texts that are not ASCII) and plain punctuation."""
    if nfkc:
        c = F.when(c.rlike(_ASCII), c).otherwise(_nfkc(F.when(~c.rlike(_ASCII), c)))
    c = F.replace(c, F.lit("…"), F.lit("..."))
    single = {k: v for k, v in _STRAIGHT.items() if len(v) == 1}
    return F.regexp_replace(F.translate(c, "".join(single), "".join(single.values())), "[​﻿]", "")


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")


HEADERS = rf"(?i)\b({'|'.join(fixed.SECTION_HEADERS)})\s*:\s*"


def strip_copyright(c: Column) -> Column:
    return F.regexp_replace(c, COPYRIGHT.replace("$", r"\z"), " ")


def strip_addresses(c: Column) -> Column:
    for pattern in (URL, DOI, EMAIL):
        c = F.regexp_replace(c, pattern, " ")
    return c


def strip_leading(c: Column) -> Column:
    return F.regexp_replace(c, LEADING, "")


def strip_headers(c: Column) -> Column:
    return F.regexp_replace(c, HEADERS, "")


def strip_acronyms(c: Column) -> Column:
    return F.regexp_replace(c, ACRONYM, " ")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean(c: Column, nfkc: bool = True, leading: bool = True, copyright_tail: bool = True, headers: bool = True, acronyms: bool = True) -> Column:
    """All cleaning steps in order, as one expression; null becomes empty."""
    c = strip_controls(normalise_unicode(F.coalesce(c, F.lit("")), nfkc))
    if copyright_tail:
        c = strip_copyright(c)
    c = strip_addresses(c)
    if leading:
        c = strip_leading(c)
    if headers:
        c = strip_headers(c)
    if acronyms:
        c = strip_acronyms(c)
    return collapse(c)


def compose(title: Column, abstract: Column) -> Column:
    """Title and abstract, parted by a full stop unless the title ends in one, or in a question or exclamation mark."""
    title, abstract = (F.trim(F.coalesce(x, F.lit(""))) for x in (title, abstract))
    joined = F.concat(title, F.when(title.rlike(r"[.?!]$"), " ").otherwise(". "), abstract)
    return F.when(title == "", abstract).when(abstract == "", title).otherwise(joined)


def raw_token_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+")).cast("long")


def doi_key(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.trim(c), r"(?i)^https?://(dx\.)?doi\.org/", "")), F.lit(""))


def coerce_year(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^\d{4}"), F.substring(text, 1, 4).cast("int"))


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def unicode_title_key(c: Column) -> Column:
    return title_key(normalise_unicode(c))


def _any(words: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in words)


METHOD = rf"(?i)\b(?:{'|'.join(fixed.METHOD_TERMS)})\b|\b(?:{'|'.join(fixed.METHOD_PREFIXES)})\b"


def is_relevant(title: Column, abstract: Column) -> Column:
    """Method vocabulary in title or abstract, or a bare AI / ML in the title."""
    title, abstract = (F.coalesce(x, F.lit("")) for x in (title, abstract))
    return F.concat_ws(" ", title, abstract).rlike(METHOD) | title.rlike(ABBREVIATION)


def home_affiliations(affiliations: Column, words: Sequence[str] = (*fixed.HOME_KEYWORDS, *fixed.HOME_CITIES)) -> Column:
    """Affiliations that name the home country or one of its institutions, once each, in order."""
    return F.array_distinct(F.filter(affiliations, lambda a: F.lower(a).rlike(_any(words))))


def is_home(affiliations: Column) -> Column:
    """A keyword in any affiliation, or a generic name together with a context word in all of them."""
    affiliations = F.coalesce(affiliations, F.array().cast("array<string>"))
    joined = F.lower(F.array_join(affiliations, " "))
    return (F.size(home_affiliations(affiliations)) > 0) | (joined.rlike(_any(fixed.HOME_GENERIC)) & joined.rlike(_any(fixed.HOME_CONTEXT)))


def author_is_home(author: Column) -> Column:
    """By text; the country code counts only where there is no affiliation text."""
    affiliations = F.coalesce(author["affiliations"], F.array().cast("array<string>"))
    codes = F.transform(F.coalesce(author["country_codes"], F.array().cast("array<string>")), F.upper)
    return is_home(affiliations) | ((F.size(affiliations) == 0) & F.array_contains(codes, fixed.HOME_CODE))


def any_author_home(authors: Column) -> Column:
    return F.coalesce(F.exists(authors, author_is_home), F.lit(False))


def any_author_foreign(authors: Column) -> Column:
    """An author with known affiliation or country that is not home; unknown ones do not count."""

    def known(a: Column) -> Column:
        return (F.size(F.coalesce(a["affiliations"], F.array().cast("array<string>"))) > 0) | (
            F.size(F.coalesce(a["country_codes"], F.array().cast("array<string>"))) > 0
        )

    return F.coalesce(F.exists(authors, lambda a: known(a) & ~author_is_home(a)), F.lit(False))


def mentions_home_institution(c: Column) -> Column:
    """An institution by name; the bare country and its cities do not count."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike(_any([w for w in fixed.HOME_KEYWORDS if w != fixed.HOME_CONTEXT[0]]))


WORD = r"[a-z]+(?:'[a-z]+)?"


def raw_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"))


def stopwords(english: Sequence[str] = fixed.ENGLISH_STOPWORDS, domain: Sequence[str] = fixed.DOMAIN_STOPWORDS, protected: Sequence[str] = fixed.PROTECTED) -> list[str]:
    return sorted((set(english) | set(domain)) - set(protected))


def tokens(
    c: Column, stop: Sequence[str] = (), protected: Sequence[str] = fixed.PROTECTED, lemmas: Mapping[str, str] | None = None, min_length: int = 3
) -> Column:
    """Tokens in order: plural acronyms fold, protected ones pass, short words and stop words go, lemmas replace words and are checked again."""
    known = lambda w: w.isin(*protected) if protected else F.lit(False)  # noqa: E731  # a hash set, whatever the list's length
    dropped = lambda w: w.isin(*stop) if stop else F.lit(False)
    words = raw_words(c)

    def folded(w: Column) -> Column:
        stem = F.regexp_extract(w, "^([a-z]{2,6})s$", 1)
        return F.when((stem != "") & known(stem), stem).otherwise(w)

    def fits(w: Column) -> Column:
        return known(w) | ((F.length(w) >= min_length) & ~dropped(w))

    out = F.filter(F.transform(words, folded) if protected else words, fits)
    if lemmas:
        table = F.create_map(*(F.lit(x) for pair in sorted(lemmas.items()) for x in pair))
        out = F.filter(F.transform(out, lambda w: F.when(known(w), w).otherwise(F.coalesce(table[w], w))), fits)
    return out


#: Endings and what replaces them, tried in order, for words that a lemma table lacks; nouns, then verbs.
NOUN_ENDINGS = (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("s", ""))
VERB_ENDINGS = (("ies", "y"), ("ied", "y"), ("ing", ""), ("ed", ""), ("s", ""))


def by_endings(w: Column, endings: Sequence[tuple[str, str]], least: int = 3) -> Column:
    """A word with its first fitting ending replaced, if at least ``least`` letters stay; words in ss, us and is keep theirs."""
    out = w
    for end, new in reversed(endings):
        fits = F.endswith(w, F.lit(end)) & (F.length(w) - len(end) + len(new) >= least)
        if end == "s":
            fits = fits & ~w.rlike("(ss|us|is)$")
        out = F.when(fits, F.concat(F.substring(w, F.lit(1), F.length(w) - len(end)), F.lit(new))).otherwise(out)
    return out


def hinted_affiliations(affiliations: Column, hints: Sequence[str]) -> Column:
    """Affiliations that contain one of the hints in any case, once each, in order."""
    return F.array_distinct(F.filter(affiliations, lambda a: F.coalesce(F.lower(a).rlike(_any([h.lower() for h in hints])), F.lit(False))))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def label_prompt(words: Column, titles: Column) -> Column:
    """Canonical evidence for a topic label: words and titles, as JSON."""
    return F.to_json(F.struct(words.alias("top_words"), titles.alias("titles")))


def batch_prompt(entries: Column) -> Column:
    """Canonical evidence of several topics for one request: the JSON of an array of structs with a key each."""
    return F.to_json(entries)


LABEL = "label string, rationale string, coherence string, supporting_doc_ids array<string>"


def parse_label(response: Column, allowed: Column) -> Column:
    """struct(label, valid, error) of a JSON label response, with any code fence stripped; errors are values."""
    body = F.regexp_replace(F.trim(response), r"^```(?:json)?\s*|\s*```$", "")
    got = F.from_json(body, LABEL)
    error = (
        F.when(got.isNull() | got["label"].isNull() | got["rationale"].isNull(), "shape")
        .when((F.length(F.trim(got["label"])) == 0) | (F.length(got["label"]) > 120), "label")
        .when(F.length(got["rationale"]) > 1500, "rationale")
        .when(~got["coherence"].isin("high", "medium", "low") | got["coherence"].isNull(), "coherence")
        .when(F.size(F.array_except(F.coalesce(got["supporting_doc_ids"], F.array().cast("array<string>")), allowed)) > 0, "supporting_doc_ids")
    )
    return F.struct(got["label"].alias("label"), error.isNull().alias("valid"), error.alias("error"))


def parse_batch(response: Column, allowed: Column) -> Column:
    """Array of struct(key, label, valid, error) of a batched response: a JSON array, or an object that holds it as ``labels``, in a code fence or not.

    allowed maps each expected key to its allowed document ids. Null if the response
    is no such JSON; keys not expected, and all rows of a key given twice, are errors of
    their rows; keys that are missing are the caller's (labels.batch_errors).
    """
    body = F.regexp_replace(F.trim(response), r"^```(?:json)?\s*|\s*```$", "")
    fields = "key string, " + LABEL
    kind = "array<struct<" + fields.replace(" string", ":string").replace(" array<", ":array<") + ">>"
    items = F.coalesce(F.from_json(body, kind), F.from_json(body, f"labels {kind}")["labels"])
    keys = lambda k: F.size(F.filter(items, lambda x: x["key"] == k))

    def judged(x: Column) -> Column:
        own = parse_label(F.to_json(x.dropFields("key")), F.coalesce(F.element_at(allowed, x["key"]), F.array().cast("array<string>")))
        unknown = x["key"].isNull() | ~F.map_contains_key(allowed, F.coalesce(x["key"], F.lit("")))
        error = F.when(unknown, "unknown key").when(keys(x["key"]) > 1, "repeated key").otherwise(own["error"])
        return F.struct(x["key"].alias("key"), own["label"].alias("label"), error.isNull().alias("valid"), error.alias("error"))

    return F.transform(items, judged)
