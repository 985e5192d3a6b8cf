"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. A node is the path of an element
(names, classes and ids, digits alike); an element node has presentations, the
sequences of its children, and a leaf has contents, its own text. Over the
distinct pages of the host, the entropy of a leaf's contents and the mean entropy
of the presentations above it, each divided by the logarithm of the pages that
have the node, make its importance: 0 the same everywhere, 1 different on each page.

A host says little about a node that few of its pages have, so importance is a
weighted mean of the host's own (weight: pages beyond the first, at most EVIDENCE),
that of the same path with the pages of all hosts pooled (the same weight) and 1
(weight 1: what nothing is known of is important). A node below LEAST is cut from
every page of the host.

Branches that name themselves boilerplate by a class or id, or lie outside the element
that names itself the article, are presumed to go, and the tree decides whether they
do. Adverts rotate among dozens of texts in one shape, so two things have to vary: the
branch's shape (the sequence of its blocks) and its text outside links. The worth of
each is the share of pairs of the host's pages that differ (weight: pages beyond the
first, at most 2 * EVIDENCE), that within all hosts (weight: what is left of 2 * EVIDENCE,
if there are as many pages) and 0 (weight 1: what nothing is known of goes). A branch
whose mean worth is below LEAST_CLOSED is cut whole; a story beside a teaser that calls
itself the article, or in an element of a misleading name, stays. A block is part of the
highest such branch around it and of the nearest one that names itself, and goes with either.

Names alone decide only what variety cannot tell from an article:
* markup and controls are never text (_DROPPED);
* what HTML's own elements and roles declare to be a menu, sidebar, header or footer
  (_TAGS, _ROLES), and reader comments (_COMMENTS), go;
* a declared article (else main element) is no branch of the site's tree, so it stays whole
  on any host, whatever its pages share; inside it only elements that name themselves boilerplate go.
"""

from __future__ import annotations

import functools
import hashlib
import html as html_lib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .runtime import BROADCAST_BYTES, stored

#: The share of presentations in importance, and the most weight of own and of pooled evidence.
PRESENTATION, EVIDENCE = 0.1, 8
#: Least importance of a node that stays, and of a branch that names itself boilerplate or lies outside the article.
LEAST, LEAST_CLOSED = 0.35, 0.85
#: Elements nested deeper are nodes of the element at this depth; their text stays.
DEPTH = 512
#: Copies of the list of cut nodes when it is too large to broadcast, so that no host's pages meet in one task.
SALTS = 32

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_DROPPED = frozenset("head script style noscript template svg math iframe object canvas audio video select option button textarea input form title".split())
#: Elements that declare themselves boilerplate; a header does outside articles only.
_TAGS = frozenset("nav aside menu footer dialog".split())
_RAW = frozenset("script style textarea title noscript iframe template svg".split())
#: Words of classes and ids, between hyphens, underscores, blanks and case changes, that name boilerplate.
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer "
    "form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related "
    "replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Beginnings of such words, for names written as one word.
_STEMS = ("advert", "breadcrumb", "cookie", "navbar", "newsletter", "sidebar", "sponsor")
#: Words of classes and ids that name reader comments anywhere, and beginnings of such words beside a declared article.
_COMMENTS = frozenset("comment comments discussion disqus replies reply respond".split())
_RESPONSES = ("coment", "comment", "discussion", "disqus", "feedback", "guestbook", "komment", "reaction", "replies", "reply", "response", "review", "thread")
_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert".split())
_CLOSES = {  # a start tag closes an open one of these, up to a container
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_CLOSES |= {t: ("p",) for t in _BLOCK if t not in _CLOSES and t not in ("html", "body", "head", "tbody", "thead", "tfoot", "caption")}
_CONTAINERS = frozenset("article aside blockquote body div dl fieldset figure footer form header html main nav ol section table td th ul details".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: What an element says of itself: nothing, a name of boilerplate, a declaration that it is no part of an article.
_SILENT, _NAMED, _DECLARED = 0, 1, 2


def _named(name: str, attributes: str, in_article: bool) -> tuple[int, str]:
    """What an element says of itself, and its label in a path."""
    found = {m[1].lower(): next(x for x in m.groups()[1:] if x is not None) for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    label = name + "".join(f"{k}={re.sub(r'[0-9]+', '0', v)}" for k, v in sorted(found.items()))
    if name in _TAGS or name == "header" and not in_article or found.get("role", "").lower() in _ROLES:
        return _DECLARED, label
    if name in ("html", "body", "article", "main") and not in_article or not found:
        return _SILENT, label
    words = {w.lower() for k in ("class", "id") for w in _PARTS.findall(found.get(k, ""))}
    if words & _COMMENTS:
        return _DECLARED, label
    if not in_article and "header" in words:
        return _NAMED, label
    return _NAMED if words & _NOISE or any(w.startswith(_STEMS) for w in words) else _SILENT, label


#: Kinds of blocks: of a declared article, of the site's tree, and of the branches that are presumed to go.
ARTICLE, OPEN, CLOSED = 0, 1, 2


class Block(NamedTuple):
    path: str
    text: str
    kind: int
    #: Of a closed block: the text outside links, as it stands in the page, and the paths of its branches; none if names alone decide that it goes.
    prose: str
    branches: tuple[str, ...]


def read(page: str) -> tuple[list[Block], dict[str, list[str]]]:
    """Blocks in page order, and the children's labels of each path outside articles.

    Elements that nothing closes end with their container; markup that is cut off
    is dropped. A path is the labels of block elements, each after a ``>``.
    """
    # (name, not text, what it or an element around it says, inside an article, inside main, path, paths of the highest and the nearest named element, inside a link)
    stack: list[tuple[str, bool, int, bool, bool, str, tuple[str, ...], bool]] = [("", False, _SILENT, False, False, "", (), False)]
    blocks: list[tuple[str, str, int, bool, bool, tuple[str, ...], str]] = []
    children: dict[str, list[str]] = {}
    held: list[str] = []
    prose: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            if text:
                _, _, said, article, main, path, named, _ = stack[-1]
                blocks.append((path, text, said, article, main, named, "" if article else " ".join("".join(prose).split())))
            held.clear()
            prose.clear()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        start = m.start() if m else size
        if start > at and not stack[-1][1]:
            held.append(page[at:start])
            if not stack[-1][7]:
                prose.append(page[at:start])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if name in _BLOCK:
                        flush()
                    del stack[k:]
                    break
                if stack[k][0] in _CONTAINERS and name not in _CONTAINERS:
                    break
            continue
        if name == "br":
            held.append(" ")
            prose.append(" ")
            continue
        if name in _BLOCK:
            flush()
            closes = _CLOSES.get(name, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] in _CONTAINERS:
                    break
        if name in _VOID or (m[3] or "").endswith("/"):
            continue
        _, dropped, said, article, main, path, named, link = stack[-1]
        own, label = (said, name) if dropped else _named(name, m[3] or "", article)
        if name in _RAW:  # its content is not markup
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        dropped = dropped or name in _DROPPED or bool(own) and article  # an inline element may be boilerplate inside a block of an article
        said = max(said, own)
        article = article or name == "article" and not said and not dropped
        if name in _BLOCK:
            if not article:
                children.setdefault(path, []).append(label)
            if len(stack) <= DEPTH:
                path = f"{path}>{label}"
        if own == _NAMED:
            named = (*named[:1], path)
        stack.append((name, dropped, said, article, main or name == "main", path, named, link or name == "a"))
    if not stack[-1][1]:
        flush()
    part = next((k for k in (3, 4) if any(b[k] for b in blocks)), None)  # the page declares an article, or else a main element
    kinds = [ARTICLE if b[3] else CLOSED if b[2] or part is not None and not b[part] else OPEN for b in blocks]
    kept: set[str] = set()
    for path in {b[0] for b, k in zip(blocks, kinds, strict=True) if k != CLOSED}:
        kept.update(above(path), (path,))
    out = []
    for (path, text, said, article, main, named, outside), kind in zip(blocks, kinds, strict=True):
        if kind != CLOSED or said == _DECLARED:
            out.append(Block(path, text, kind, "", ()))
            continue
        if part is not None and not (article, main)[part - 3]:
            highest = next((p for p in above(path) if p not in kept), path)
            if any(w.lower().startswith(_RESPONSES) for w in _PARTS.findall(path[highest.rfind(">") + 1 :])):
                out.append(Block(path, text, kind, "", ()))
                continue
        else:
            highest = named[0]
        out.append(Block(path, text, kind, outside, tuple(dict.fromkeys((highest, *named[-1:])))))
    return out, children


def parse(page: str) -> tuple[list[tuple[str, str, int]], dict[str, list[str]]]:
    """Blocks as (path, text, kind), and the children's labels of each path outside articles."""
    blocks, children = read(page)
    return [(b.path, b.text, b.kind) for b in blocks], children


def above(path: str) -> list[str]:
    """The paths of the elements around a path."""
    cut = [k for k, c in enumerate(path) if c == ">"]
    return [path[:k] for k in cut]


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_LEAF = pa.list_(pa.struct([("path", pa.int64()), ("content", pa.int64()), ("shape", pa.int64()), ("above", pa.list_(pa.int64()))]))
_STYLE = pa.list_(pa.struct([("path", pa.int64()), ("style", pa.int64())]))
_TEXT = pa.list_(pa.struct([("nodes", pa.list_(pa.int64())), ("text", pa.string())]))
_PARSED = (
    "page_id long, url string, host string, page long, leaves array<struct<path: bigint, content: bigint, shape: bigint, above: array<bigint>>>, "
    "styles array<struct<path: bigint, style: bigint>>, blocks array<struct<nodes: array<bigint>, text: string>>"
)


def _runs(labels: list[str]) -> str:
    """Runs of like siblings count once: a presentation does not depend on the number of paragraphs."""
    return "|".join(s for k, s in enumerate(labels) if not k or s != labels[k - 1])


def merged(page: str) -> tuple[int, list[dict], list[dict], list[dict]]:
    """What a page adds to its site's tree: the page's number, leaves and branches, presentations, and the blocks that the tree may keep.

    Branches have a shape, leaves have none and another number than a branch of the same path.
    """
    blocks, children = read(page)
    number = functools.cache(_number)
    own: dict[str, list[str]] = {}
    branches: dict[str, list[Block]] = {}
    rows = []
    for b in blocks:
        if b.kind == OPEN:
            own.setdefault(b.path, []).append(b.text)
            rows.append({"nodes": [number(f"{b.path}#0")], "text": b.text})
        elif b.kind == ARTICLE or b.branches:
            for p in b.branches:
                branches.setdefault(p, []).append(b)
            rows.append({"nodes": [number(f"{p}#1") for p in b.branches], "text": b.text})
    around = {p for path in {b.path for b in blocks if b.kind != ARTICLE} for p in above(path)}
    leaves = [{"path": number(f"{p}#0"), "content": _number("\n".join(t)), "shape": None, "above": [number(x) for x in above(p)]} for p, t in own.items()]
    for p, parts in branches.items():
        shape = "|".join(str(number(b.path)) for b in parts)
        leaves.append({"path": number(f"{p}#1"), "content": _number("\n".join(b.prose for b in parts if b.prose)), "shape": _number(shape), "above": []})
    styles = [{"path": number(p), "style": _number(_runs(children.get(p, [])))} for p in sorted(around)]
    return _number("\n".join(b.text for b in blocks)), leaves, styles, rows


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 64):  # a few pages at a time, so that a batch of long pages stays bounded
            part = batch.slice(k, 64)
            found = [merged(value.as_py() or "") for value in part.column(3)]
            arrays = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), _LEAF, _STYLE, _TEXT))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *arrays], names=["page_id", "url", "host", "page", "leaves", "styles", "blocks"])


def _evenness(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, m, e): pages of each node by its counts (keys, value, c), and the entropy of its values over them, divided by the logarithm of m; 1 for a single page."""
    sums = counts.groupBy(*keys).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
    return sums.select(*keys, "m", F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0).alias("e"))


def _counts(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, value, c): distinct pages of each value of each node."""
    return df.select("page", *keys, "value").distinct().groupBy(*keys, "value").agg(F.count("*").alias("c"))


def leaf_importance(parsed: DataFrame) -> DataFrame:
    """(host, path, importance) of the leaves of each site's tree, as the module states.

    Counts have a row per host, node and distinct content; everything after them
    a row per host and node of its template, not per page.
    """
    leaves = parsed.select("host", "page", F.explode("leaves").alias("n")).where("n.shape IS NULL")
    contents = stored(_counts(leaves.select("host", "page", "n.path", F.col("n.content").alias("value")), "host", "path"), "site-contents")
    styles = parsed.select("host", "page", F.explode("styles").alias("n"))
    styles = _evenness(_counts(styles.select("host", "page", "n.path", F.col("n.style").alias("value")), "host", "path"), "host", "path")
    styles = styles.select("host", F.col("path").alias("node"), F.when(F.col("m") > 1, F.col("e")).otherwise(1.0).alias("style"))
    # the elements around a path are a function of the path
    chains = leaves.groupBy("host", "n.path").agg(F.first("n.above").alias("above"))
    shapes = chains.select("host", "path", F.explode_outer("above").alias("node")).join(styles, ["host", "node"], "left")
    shapes = shapes.groupBy("host", "path").agg(F.avg(F.coalesce("style", F.lit(1.0))).alias("style"))
    own = _evenness(contents, "host", "path").join(shapes, ["host", "path"])
    pooled = _evenness(contents.groupBy("path", "value").agg(F.sum("c").alias("c")), "path").select("path", F.col("m").alias("pages"), F.col("e").alias("all"))
    mine, every = F.least(F.col("m") - 1, F.lit(EVIDENCE)), F.least(F.col("pages") - 1, F.lit(EVIDENCE))
    content = (mine * F.col("e") + every * F.col("all") + 1) / (mine + every + 1)
    return own.join(pooled, "path").select("host", "path", (PRESENTATION * F.col("style") + (1 - PRESENTATION) * content).alias("importance"))


def branch_importance(parsed: DataFrame) -> DataFrame:
    """(host, path, importance) of the branches that are presumed to go: the mean worth of shape and text."""
    parts = parsed.select("host", "page", F.explode("leaves").alias("n")).where("n.shape IS NOT NULL")
    parts = parts.select("host", "page", "n.path", F.posexplode(F.array("n.content", "n.shape")).alias("what", "value"))
    c, m = F.col("c").cast("double"), F.col("m")
    own = _counts(parts, "host", "path", "what").groupBy("host", "path", "what").agg(F.sum(c).alias("m"), (F.sum(c * (c - 1)) / F.sum(c)).alias("same"))
    own = stored(own, "site-branches")
    pooled = own.groupBy("path", "what").agg(F.sum(m - 1).alias("beyond"), F.sum("same").alias("all_same"))
    differ = lambda same, others: F.when(F.col(others) > 0, 1 - F.col(same) / F.col(others)).otherwise(0.0)
    mine = F.least("others", F.lit(2 * EVIDENCE))
    every = F.least("beyond", 2 * EVIDENCE - mine)
    worth = (mine * differ("same", "others") + every * differ("all_same", "beyond")) / (mine + every + 1)
    own = own.withColumn("others", m - 1)
    return own.join(pooled, ["path", "what"]).groupBy("host", "path").agg(F.avg(worth).alias("importance"))


def cut_nodes(leaves: DataFrame, branches: DataFrame) -> DataFrame:
    """(host, path): leaves and branches that leave every page of their host."""
    low = leaves.where(F.col("importance") < LEAST).select("host", "path")
    return low.unionByName(branches.where(F.col("importance") < LEAST_CLOSED).select("host", "path"))


def without(parsed: DataFrame, cut: DataFrame) -> DataFrame:
    """(page_id, url, text) of parsed pages without the cut nodes (host, path) of their host."""
    lists = stored(cut.groupBy("host").agg(F.collect_list("path").alias("cut")), "cut")  # a row per host, with the few noise nodes of its template
    bytes_ = lists.agg(F.sum(F.octet_length("host") + 8 * F.size("cut") + 32)).first()[0] or 0
    rows = parsed.select("page_id", "url", "host", "blocks")
    if bytes_ <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(lists), "host", "left")
    else:
        salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kept = F.filter("blocks", lambda b: ~F.arrays_overlap(F.coalesce("cut", F.array().cast("array<long>")), b["nodes"]))
    return joined.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Parsed pages in the shared store; ones without a host form one site."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return stored(rows.select("page_id", "url", host.alias("host"), "html").mapInArrow(_parsed, _PARSED), "parsed")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html, ...).

    Blocks are joined by newlines in page order; character references are
    decoded and white space in a block becomes one blank. A null, empty or
    text-free page, and one of which every block is cut, has an empty text. A very
    long page is parsed whole, alone in memory with at most 63 others. Pages without
    a host form one site. Repeated rows give repeated rows and count as one page
    of the site; ties cannot occur, as nodes are judged each by itself; an empty
    table gives no rows; other columns, whatever their names, are ignored.
    """
    parsed = parsed_pages(pages)
    text = without(parsed, cut_nodes(leaf_importance(parsed), branch_importance(parsed)))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_style_tree(spark, sf_dir: str) -> DataFrame:
    return extract_text(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))
