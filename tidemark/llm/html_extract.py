"""HTML extraction: the maximum-scoring subsequence of words and tags is the page's main region.

A page becomes blocks of text (runs between block-level tags), each with its number of
words, the tags before it and its innermost open container. Text inside page furniture is left out as it is read:
elements and roles for menus, headers, footers, sidebars, dialogs, forms, scripts and styles,
hidden elements, and whole class or id names that mean nothing else (menus, sidebars, adverts, notices,
reader comments), in the middle of a paragraph as well. Where only a part of a name says so ("modal-logic", "header", "alert"), the
element is furniture if it has links or buttons and its words and tags sum to less than
nothing, or if two or more such elements are its children (a list of comments or teasers). Headings are
never judged by their names. A word scores positive, a tag
negative; the weights are log odds learnt from labelled pages, the pages that mark their
own main text with exactly one ``article`` element, on a sample of at most ``max_labelled``
of them (chosen by hash of the page). One linear scan finds the contiguous
run of blocks with the largest sum; furniture has no words, its tags score as others.
The run is then completed to its container (the enclosing article or main element, else the
innermost section, div or cell that holds all of it, else the page's body), so that short
blocks at its ends, and beyond furniture, are not lost.

Every step is linear in the page: a tag ends at the first ``>`` outside closed quotes (a quote opens a value only
right after ``=``), what can't end is text; blocks point to their container instead of holding
a path; end tags without an open element are known from counts.

Scale: one pass over the pages without a shuffle; the tag counts of the sample
are aggregated before they reach the driver (one row per known tag name).

Defined results: a null or empty page, and one without words outside furniture, gives an
empty text; unclosed and misnested tags close with their container; an unended comment,
script or style runs to the end of the page; pages are taken whole at any length; an empty table gives no
rows; other columns are not read; rows repeat as given.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import hash_sample, ship

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+" + _VALUE + ")?+|=)*+)>")
#: One attribute: its name, then its value if it has one. Read in order, so that no value is taken for a name.
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(" + _VALUE + "))?+")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Elements without an end tag, and those whose start ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure "
                    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
                    "summary table tbody td tfoot th thead title tr ul").split())
#: Text inside is never read as markup.
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript template svg annotation annotation-xml".split())
CONTAINERS = frozenset("article body div main section td".split())
#: Elements that no start or end tag inside reaches beyond, but for a block's own end tag.
SCOPES = CONTAINERS | frozenset("dl ol select table ul".split())
ITEMS = frozenset("dd dt li option td th tr".split())
FURNITURE = frozenset(("aside button dialog datalist footer form head header iframe input label menu nav noembed noframes "
                       "noscript object optgroup option script search select style svg template textarea title xmp").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Whole class and id names that mark furniture, and ids of elements that carry no generated slugs.
NAMES = frozenset("ad ads adv advert adverts advertisement advertisements adsbygoogle breadcrumb breadcrumbs comments comment-form comment-list comments-area "
                  "comments-list comments-section comment-section commentlist cookie-banner cookie-bar cookie-consent cookie-notice disqus disqus-thread "
                  "masthead menubar nav navbar navigation newsletter newsletter-signup notice notices outbrain pagination promo promos promoted "
                  "promoted-content reader-comments related-articles related-posts share-buttons sharing-buttons sidebar site-notice skip-link "
                  "social-links social-share sponsored sponsored-content sponsored-post taboola user-comments".split()) | {
    f"{a}-{b}" for a in ("ad", "ads", "advert", "advertisement")
    for b in "area banner block box container holder label placeholder slot space unit wrap wrapper zone".split()}
WITH_IDS = frozenset("div section ul ol dl table td".split())
#: Parts of class and id names (split at non-letters) that mark furniture where links and tags outweigh the words.
PARTS = frozenset(("ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent "
                   "contentinfo cookie cookies dialog disclaimer discussion disqus footer gdpr header "
                   "masthead menu menubar menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pagination paywall "
                   "popup promo promotion promoted recommended related replies respond responses search share sharing sidebar signup skip social "
                   "sponsor sponsored sponsors subscribe subscription taboola teaser toolbar warning widget widgets").split())
LINKS = frozenset("a button input option select".split())
#: Weights used until pages with a label have been seen, and the limits of learnt ones.
WORD_WEIGHT, TAG_WEIGHT, LINK_WEIGHT = 1.0, -0.3, -3.0
LINKISH = frozenset("a li ul nav footer header aside form option select button".split())


class Container:
    """An open element that can hold the main text; the blocks from ``first`` to before ``last`` are in it."""
    __slots__ = ("name", "up", "depth", "first", "last")

    def __init__(self, name, up, first):
        self.name, self.up, self.depth, self.first, self.last = name, up, up.depth + 1 if up else 0, first, first


class Span:
    """An element that may be furniture: the places of its tags in the page's, its words, its children of that kind."""
    __slots__ = ("up", "first", "last", "words", "children", "out")

    def __init__(self, up, first):
        self.up, self.first, self.last, self.words, self.children, self.out = up, first, first, 0, 0, False


class Block:
    """Pieces of text with the innermost span round each; ``low`` is the least depth of containers since the block before."""
    __slots__ = ("pieces", "text", "words", "tags", "at", "low", "article")

    def __init__(self, pieces, tags, at, low, article):
        self.pieces, self.tags, self.at, self.low, self.article = pieces, tags, at, low, article
        self.read()

    def read(self):
        words = "".join(p for p, span in self.pieces if not (span and span.out)).split()
        self.text, self.words = " ".join(words), len(words)


class Page:
    __slots__ = ("blocks", "spans", "tags")

    def __init__(self):
        self.blocks, self.spans, self.tags = [], [], []  # tags: without those of headings, whose links lead to themselves


def _furniture(tag: str, attributes: str) -> bool | None:
    """True: furniture; None: furniture if its links and tags outweigh its words."""
    if tag in FURNITURE:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    read: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        read.setdefault(name.lower(), value.strip("\"'"))
    if "hidden" in read or read.get("aria-hidden", "").lower() == "true" or UNSEEN.search(read.get("style", "")):
        return True
    if tag in HEADINGS:
        return False
    if any(r in ROLES for r in read.get("role", "").lower().split()):
        return True
    classes = _tokens(read.get("class", ""))
    names = classes + (_tokens(read.get("id", "")) if tag in WITH_IDS and "section" not in classes else [])
    if any(n in NAMES for n in names):
        return True
    return None if any(w in PARTS for n in names for w in re.split(r"[^a-z]+", n)) else False


def _tokens(value: str) -> list[str]:
    return re.sub(r"[-_]+", "-", re.sub(r"([a-z])([A-Z])", r"\1-\2", value)).lower().split()


def read_page(page: str) -> Page:
    """The page's text blocks in order; ``tags`` of a block are the names of the tags since the last one."""
    found = Page()
    root = Container("", None, 0)
    stack: list[tuple[str, bool, Container | None, Span | None]] = []  # open elements: name, furniture, container, what may be furniture
    inside, span, low = root, None, 0
    n_open: Counter[str] = Counter()
    scopes: list[Counter[str]] = [Counter()]  # open elements by name, inside each open scope
    n_out = n_articles = n_math = n_headings = 0
    pieces: list[tuple[str, Span | None]] = []
    tags: list[str] = []

    def add_tag(tag):
        if not n_math:  # a formula's inner tags stand for no layout
            tags.append(tag)
            if not n_headings and tag not in HEADINGS:
                found.tags.append(tag)

    def text(raw):
        if raw and not n_out:
            piece = html.unescape(raw) if "&" in raw else raw
            pieces.append((piece, span))
            if span:
                span.words += len(piece.split())

    def end_block():
        nonlocal pieces, tags, low
        if pieces:
            block = Block(pieces, tags, inside, low, n_articles)
            pieces = []
            if block.words:
                found.blocks.append(block)
                tags, low = [], inside.depth

    def pop_to(depth):
        nonlocal n_out, n_articles, n_math, n_headings, inside, span, low
        while len(stack) > depth:
            name, furniture, container, own = stack.pop()
            n_open[name] -= 1
            if name in SCOPES:
                scopes.pop()
            scopes[-1][name] -= 1
            n_out -= furniture
            n_articles -= name == "article"
            n_math -= name == "math"
            n_headings -= name in HEADINGS
            if container:
                container.last = len(found.blocks)
                inside = container.up
                low = min(low, inside.depth)
            if own:
                own.last = len(found.tags)
                if own.up:
                    own.up.words += own.words
                span = own.up

    def pop_nearest(names):
        depth = len(stack) - 1
        while stack[depth][0] not in names:
            depth -= 1
        pop_to(depth)

    at, end, last_end = 0, len(page), page.rfind(">")
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            text(page[at:lt])
            close = page.find("-->", lt + 4)
            at = close + 3 if close >= 0 else end
            continue
        if lt > last_end:
            break
        if page[lt + 1:lt + 2] in ("!", "?"):  # doctype, processing instruction
            text(page[at:lt])
            at = page.find(">", lt) + 1
            continue
        m = TAG.match(page, lt)
        if not m:
            if page[lt + 1:lt + 3].lstrip("/")[:1].isalpha():  # a tag that never ends, nor does any behind it
                break
            text(page[at:lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                end_block()
            add_tag(tag)
            if n_open[tag] if tag in BLOCKS or tag in SCOPES else scopes[-1][tag]:  # an inline end tag doesn't close what holds it
                pop_nearest((tag,))
            continue
        if tag in BLOCKS:
            end_block()
            # a block ends an open paragraph, an item the item before
            ends = ([] if tag == "br" or not scopes[-1]["p"] else ["p"]) + ([tag] if tag in ITEMS and scopes[-1][tag] else [])
            if ends:
                pop_nearest(ends)
        add_tag(tag)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            add_tag(tag)
        elif tag not in VOID and not _closed(m[3]):
            furniture = _furniture(tag, m[3])
            own = None
            if furniture is None:
                if stack and stack[-1][3]:
                    stack[-1][3].children += 1
                own = span = Span(span, len(found.tags) - 1)
                found.spans.append(own)
            container = None
            if tag in CONTAINERS:
                container = inside = Container(tag, inside, len(found.blocks))
            stack.append((tag, bool(furniture), container, own))
            n_open[tag] += 1
            scopes[-1][tag] += 1
            if tag in SCOPES:
                scopes.append(Counter())
            n_out += bool(furniture)
            n_articles += tag == "article"
            n_math += tag == "math"
            n_headings += tag in HEADINGS
    text(page[at:])
    end_block()
    pop_to(0)
    return found


def _closed(attributes: str) -> bool:
    """Whether a start tag ends with a slash that is no part of a value."""
    if not attributes.endswith("/"):
        return False
    last = attributes.rsplit(None, 1)[-1]
    return "=" not in last or last[-2] in "\"'"


def _judge(found: Page, weights: dict[str, float]) -> None:
    """Spans with links whose words and tags sum to less than nothing, and those with such children, are furniture."""
    if not found.spans:
        return
    sums = list(accumulate((weights.get(t, weights["*"]) for t in found.tags), initial=0.0))
    links = list(accumulate((t in LINKS for t in found.tags), initial=0))
    for s in found.spans:  # the outer ones come first
        poor = links[s.last] > links[s.first] and s.words * weights[""] + sums[s.last] - sums[s.first] < 0
        s.out = poor or s.children > 1 or bool(s.up and s.up.out)
    for b in found.blocks:
        if any(span and span.out for _, span in b.pieces):
            b.read()


def best_run(scores: list[float], between: list[float]) -> tuple[int, int] | None:
    """First and last place of the contiguous run with the largest sum above zero of its scores and of what lies between them."""
    best, run, start, chosen = 0.0, 0.0, 0, None
    for i, score in enumerate(scores):
        if run + between[i] <= 0:
            run, start = score, i
        else:
            run += between[i] + score
        if run > best:
            best, chosen = run, (start, i)
    return chosen


def region(found: Page, weights: dict[str, float]) -> list[Block]:
    """The blocks of the main text."""
    _judge(found, weights)
    blocks = found.blocks
    chosen = best_run([b.words * weights[""] for b in blocks], [sum(weights.get(t, weights["*"]) for t in b.tags) for b in blocks])
    if chosen is None:
        return []
    i, j = chosen
    while not blocks[i].words:
        i += 1
    while not blocks[j].words:
        j -= 1
    # blocks are met on a walk over the tree: what holds all of them is as deep as the walk's highest point
    common, depth = blocks[i].at, min([blocks[i].at.depth, *(x for b in blocks[i + 1:j + 1] for x in (b.low, b.at.depth))])
    while common.depth > depth:
        common = common.up
    main: dict[str, Container] = {}
    at = common
    while at.up:
        main[at.name] = at  # the outermost stays
        at = at.up
    common = main.get("article") or main.get("main") or common
    if common.up and common.name != "body":
        blocks = blocks[common.first:common.last]
    return [b for b in blocks if b.words]


def main_text(page: str | None, weights: dict[str, float]) -> str:
    return " ".join(b.text for b in region(read_page(page or ""), weights))


def weights_from(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights per tag ("" is a word, "*" any other tag) from (inside, outside) counts of labelled pages."""
    weights = {"": WORD_WEIGHT, "*": TAG_WEIGHT} | {t: LINK_WEIGHT for t in LINKISH}
    inside, outside = (sum(c[k] for t, c in counts.items() if t) for k in (0, 1))
    if not inside or not outside:
        return weights
    for tag, (a, b) in counts.items():
        odds = math.log((a + 1) / (inside + 1)) - math.log((b + 1) / (outside + 1))
        if tag:
            weights[tag] = min(-0.05, max(-5.0, odds - 0.5))
    a, b = counts.get("", (0, 0))
    weights[""] = min(3.0, max(0.2, math.log((a + 1) / (b + 1))))
    return weights


_KNOWN = BLOCKS | VOID | RAW | FURNITURE | frozenset("a b i u math em strong span small font code abbr cite q sub sup img".split())


def _count_tags(batches):
    for batch in batches:
        total: dict[str, list[int]] = {}
        for page in batch.column("html").to_pylist():
            for b in read_page(page or "").blocks:
                k = 0 if b.article else 1
                total.setdefault("", [0, 0])[k] += b.words
                for t in b.tags:
                    total.setdefault(t if t in _KNOWN else "*", [0, 0])[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([c[0] for c in total.values()], pa.int64()),
                                          pa.array([c[1] for c in total.values()], pa.int64())], ["tag", "inside", "outside"])


def learn(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", max_labelled: int = 2000) -> dict[str, float]:
    """Weights from up to ``max_labelled`` pages that have exactly one article element."""
    ship(pages.sparkSession)
    marked = F.regexp_count(F.lower(F.col(html_col)), F.lit("<article[\\s>]")) == 1
    sample = hash_sample(pages.where(marked).select(F.col(id_col).alias("id"), F.col(html_col).alias("html")), max_labelled, "id", "html")
    sample = sample.select("html")
    counted = sample.mapInArrow(_count_tags, "tag string, inside long, outside long").groupBy("tag").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return weights_from({r["tag"]: (r["inside"], r["outside"]) for r in counted.collect()})


def _extract(weights):
    def run(batches):
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])
    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            weights: dict[str, float] | None = None, max_labelled: int = 2000) -> DataFrame:
    """(page_id, url, text) for every page; weights are learnt from the pages unless given."""
    ship(pages.sparkSession)
    weights = weights or learn(pages, html_col, id_col, max_labelled)
    thin = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType([*thin.schema.fields[:2], T.StructField("text", T.StringType())])
    return thin.mapInArrow(_extract(weights), schema)
