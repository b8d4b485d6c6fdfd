"""Main text of web pages by consensus of the pages of a host.

1. Each page is read once.  Its containers (article, main, section, div, table cells, body)
   are scored by the text of the blocks under them: characters outside links, halved with
   each container in between, more for elements that announce content.
2. A container votes for its generalised path, the tags and classes from the body down with
   digits as ``#``, with its share of the page's best score.  Spark adds the votes per host.
3. Each page is read again with the host's paths in order of votes; all elements on the
   first path that has text there are the article.  A page on which none has text uses its
   own best path.

Elements that are not article text are left out wherever they are: menus, headers, footers,
sidebars, notices, adverts, forms, reader comments (by tag, role, or a word of class or id; ``read`` says when an element left out for a
word of its name is taken back), scripts, styles and hidden elements.

Text is decoded, white space in a block becomes one space, blocks are joined by a line feed.
Null or empty html gives an empty text; a null or unreadable url belongs to the host ``''``.
Repeated rows give repeated results (they also vote once each).
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import by_value, text_of
from dqspark.operators.lookup import look_up

by_value(__name__)

# Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
DROPPED = frozenset("nav footer header aside form button select dialog menu object audio video canvas head label fieldset".split())
CONTAINERS = frozenset("article main section div td body center figure blockquote".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre table thead tbody tfoot tr th caption figcaption address details summary hr "
    "html header footer nav aside form fieldset hgroup menu dialog".split()
)
#: A start tag of these ends an open element of the listed kinds.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
#: Where the search for an element to end stops.
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
#: Words of a class, id or role that mark text beside the article.
BESIDE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer colophon contentinfo sidebar aside "
    "complementary cookie cookies consent gdpr notice notices notification alert popup modal overlay toast ad ads advert adverts "
    "advertisement advertising adsense sponsor sponsored promo promotion comment comments commentlist disqus respond replies "
    "discussion form search login signin signup newsletter subscribe subscription share sharing social related recommended "
    "pagination pager toolbar widget widgets hidden skip copyright".split()
)
#: Words that make a name a state of an element: ``no-sidebar``, ``has-comments``, ``comments-open`` name no part of a page.
STATES = frozenset("no not has have with without open closed is".split())
#: Words that mark the article.
CONTENT = frozenset("article content main post entry story body text page".split())
DECAY = 0.6
STEPS = 12
MAX_PATHS = 16
#: Winning paths are broadcast only up to so many hosts, of a kilobyte or so each.
BROADCAST_HOSTS = 20_000

_TAG = re.compile(r"<(?:!--(.*?)(?:-->|--!>|\Z)|([!?])[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I)
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"[0-9]+")


@dataclass
class Page:
    """Blocks (container, text, characters in links) and containers (parent, path, weight) in page order."""

    parents: list[int] = field(default_factory=lambda: [-1])
    paths: list[str] = field(default_factory=lambda: ["body"])
    weights: list[float] = field(default_factory=lambda: [0.7])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    #: Characters outside links in elements left out for a name, by their place in the page:
    #: those that also have a name of their own that marks the article, and the others.
    doubtful: dict[int, int] = field(default_factory=dict)
    beside: dict[int, int] = field(default_factory=dict)


def marks(attributes: str) -> tuple[list[str], list[set[str]], set[str], bool]:
    """Generalised classes, the words of each class and of the id, those of the role, and whether the element is hidden."""
    classes, names, role, hidden = [], [], set(), False
    if "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m.group(1).lower(), entities.unescape((m.group(2) or "").strip("\"'"))
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            elif name != "aria-hidden":
                words = [{t.lower() for t in _SPLIT.split(v) if t} for v in value.split()]
                if name == "role":
                    role.update(*words)
                else:
                    names += [w for w in words if w.isdisjoint(STATES)]
                if name == "class":
                    classes = sorted({_DIGITS.sub("#", c.lower()) for c in value.split()})
    return classes, names, role, hidden


def read(text: str) -> Page:
    """The page; an element left out for a name is taken back in two cases.

    One that also has a name for the article comes back if it holds most of the text outside
    links, any such element if nothing else on the page has text.
    """
    back: set[int] = set()
    while True:
        page = scan(text, back)
        rest = sum(len(block) - linked for _, block, linked in page.blocks)
        whole = rest + sum(page.doubtful.values())
        more = {at for at, size in page.doubtful.items() if 2 * size > whole}
        if not more and not page.blocks:
            sizes = page.doubtful | page.beside
            more = {max(sizes, key=lambda at: (sizes[at], -at))} if any(sizes.values()) else set()
        if not more:
            return page
        back |= more


def scan(text: str, back: set[int]) -> Page:
    """One pass over the tags of a page; elements that begin at the places ``back`` are not left out for a name."""
    page = Page()
    # tag, container outside it, what was left out there: None nothing, -1 for good, else where an element for a name began
    stack: list[tuple[str, int, int | None]] = []
    opened: Counter = Counter()
    container, dropped, links = 0, None, 0
    parts: list[str] = []
    linked, at, end = 0, 0, len(text)

    def flush():
        nonlocal linked
        block = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if block:
            page.blocks.append((container, block, min(linked, len(block))))
        parts.clear()
        linked = 0

    def pop():
        nonlocal container, dropped, links
        tag, container, dropped = stack.pop()
        opened[tag] -= 1
        links -= tag == "a"

    while at < end:
        m = _TAG.search(text, at)
        start = m.start() if m else end
        if start > at and dropped is None:
            parts.append(text[at:start])
            linked += (start - at) * (links > 0)
        elif start > at and dropped >= 0 and not links:
            (page.doubtful if dropped in page.doubtful else page.beside)[dropped] += len(text[at:start].strip())
        if not m:
            break
        at = m.end()
        tag = m.group(4)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(3):
            if tag in BLOCKS and dropped is None:
                flush()
            if tag == "br" and dropped is None:
                parts.append(" ")
            if opened[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            if dropped is None:
                flush() if tag == "hr" else parts.append(" " if tag == "br" else "")
            continue
        if tag in RAW:
            if tag in ("svg", "math") and m.group(5).endswith("/"):
                continue
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(text, at)
            at = close.end() if close else end
            continue
        if tag in BLOCKS:
            if dropped is None:
                flush()
            if opened["p"] > 0:
                end_open(stack, opened, ("p",), ("td", "th", "button"), pop)
        if tag in ENDS:
            end_open(stack, opened, ENDS[tag], SCOPES.get(tag, ()), pop)
        if tag in ("html", "body"):
            continue
        stack.append((tag, container, dropped))
        opened[tag] += 1
        links += tag == "a"
        if dropped == -1:
            continue
        if dropped is not None:
            dropped = -1 if tag in DROPPED else dropped
            continue
        classes, names, role, hidden = marks(m.group(5)) if m.group(5) else ([], [], set(), False)
        content = any(not w.isdisjoint(CONTENT) for w in names) or not role.isdisjoint(CONTENT)
        beside = any(not w.isdisjoint(BESIDE) for w in names) and not (tag in ("article", "main") and content)
        if tag in DROPPED or hidden or not role.isdisjoint(BESIDE):
            dropped = -1
        elif beside and start not in back:
            apart = any(not w.isdisjoint(CONTENT) and w.isdisjoint(BESIDE) for w in names)
            (page.doubtful if apart else page.beside)[start] = 0
            dropped = start
        elif tag in CONTAINERS:
            steps = page.paths[container].split(">")[-STEPS + 1 :]
            page.parents.append(container)
            page.paths.append(">".join([*steps, ".".join([tag, *classes])]))
            page.weights.append(1.5 if tag in ("article", "main") else 1.25 if content else 1.0)
            container = len(page.paths) - 1
    flush()
    return page


def end_open(stack, opened, kinds, scope, pop) -> None:
    """End the innermost open element of these kinds that lies inside the scope."""
    if not any(opened[k] > 0 for k in kinds):
        return
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in kinds:
            while len(stack) > i:
                pop()
            return
        if stack[i][0] in scope:
            return


def scores(page: Page) -> dict[str, float]:
    """Best score of each path of the page."""
    total = [0.0] * len(page.paths)
    for container, block, linked in page.blocks:
        mass, node, left = len(block) * (1 - linked / len(block)) ** 2, container, STEPS
        while node >= 0 and left:
            total[node] += mass
            mass, node, left = mass * DECAY, page.parents[node], left - 1
    out: dict[str, float] = {}
    for path, mass, weight in zip(page.paths, total, page.weights, strict=True):
        if mass > 0:
            out[path] = max(out.get(path, 0.0), mass * weight)
    return out


def extract(page: Page, paths: list[str]) -> str:
    """Blocks under all elements on the first of the paths that has text."""
    known = set(page.paths)
    for path in paths:
        if path in known:
            inside = [False] * len(page.paths)
            for i, own in enumerate(page.paths):
                inside[i] = own == path or page.parents[i] >= 0 and inside[page.parents[i]]
            blocks = [b for c, b, _ in page.blocks if inside[c]]
            if blocks:
                return "\n".join(blocks)
    return ""


def votes_of(text: str) -> list[tuple[str, float]]:
    found = scores(read(text))
    best = max(found.values(), default=0.0)
    return [(p, s / best) for p, s in sorted(found.items()) if s >= 0.1 * best]


def _votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([[{"path": p, "score": s} for p, s in votes_of(t)] if t else [] for t in batch])


def _texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, winners in batches:
        out = []
        for text, paths in zip(pages, winners, strict=True):
            page = read(text or "")
            own = scores(page)
            best = sorted(own, key=lambda p: (-own[p], p))[:1]
            out.append(extract(page, [*(paths if paths is not None else []), *best]))
        yield pd.Series(out, dtype="object")


def host(url: Column) -> Column:
    """Lower-case host name of an address, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, paths): the paths of a host by votes, at least a twentieth of the first one's."""
    ballots = pages.select(host(F.col(url)).alias("host"), F.explode(
        F.pandas_udf(_votes, "array<struct<path:string,score:double>>")(text_of(html))).alias("v"))
    # votes are added as whole thousandths, so that the order of addition changes nothing
    counted = ballots.groupBy("host", F.col("v.path").alias("path")).agg(
        F.sum(F.round(F.col("v.score") * 1000).cast("long")).alias("votes")
    )
    top = counted.groupBy("host").agg(F.max("votes").alias("top"))
    best = counted.join(top, "host").filter(F.col("votes") * 20 >= F.col("top"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return best.groupBy("host").agg(F.transform(F.slice(ranked, 1, MAX_PATHS), lambda s: s["path"]).alias("paths"))


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    named = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_of(html).alias("html"), host(F.col(url)).alias("host")
    )
    # few hosts: pages stay where they are; many: a host's pages are spread, however many it has
    joined = look_up(named, winning_paths(pages, url, html), "host", limit=BROADCAST_HOSTS)
    return joined.select(
        "page_id", "url", F.pandas_udf(_texts, "string")("html", F.coalesce("paths", F.array().cast("array<string>"))).alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))
