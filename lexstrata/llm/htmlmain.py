"""Main text of web pages by consensus host paths.

Each page is parsed into containers, which are scored by the text they hold
and by how little of it is links.  The best containers vote with
their generalised path (tags and classes, numbers masked) for the page's host;
votes are summed in Spark, and every page is extracted again from the
containers on its host's winning path together with its own best container.

Parsing takes time and memory in proportion to the page, however deep its
elements are nested: a container knows its parent and its own step, and equal
paths share a number within the page.  A tag ends at the first ``>`` outside
quotes; in a page with a quote that never closes, at the first ``>`` from there on.

Boilerplate goes by elements, roles and whole names of classes and ids, but not
what holds the page's article (``_judge``).

Cases: a null or empty html, or one without text, gives an empty text; a null
url is a host of its own; repeated rows are extracted each; unclosed and
misnested tags are closed as browsers do for paragraphs, list items and cells;
ties between paths go to the path that sorts first; extra columns are ignored;
the empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.memory import tidy
from lexstrata.llm.shared import stored

# The HTML elements of each kind, and words that name boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp"
    " math mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mstyle mpadded mphantom mtable mtr mtd semantics".split()
)
CONTAINERS = frozenset("body main article section div td".split())
CLOSES_P = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: Elements that end an open one of the same group, and those that such groups don't reach across.
GROUPS = {"p": "p", "li": "li", "dt": "d", "dd": "d", "tr": "tr", "td": "cell", "th": "cell", "option": "option"}
SCOPES = frozenset("table ul ol dl select body html div article section main".split())
DROPPED = frozenset("head nav footer aside form script style title textarea xmp iframe noembed noframes noscript template svg annotation annotation-xml button select object audio video canvas dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay"
    " newsletter subscribe subscription signup sidebar rail aside nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer comment comments commentlist disqus"
    " reply replies respond discussion share sharing social related recommended recommendations widget widgets pagination pager toolbar skip alert paywall legal copyright login search".split()
)
#: Of these, the names that no layout has around its article: what they name goes even if it is most of a page.
ADDED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter comment comments commentlist disqus reply replies respond discussion".split()
)
#: Words that leave a name what it is: ``comment-list``, ``share-buttons``.  ``sidebar-right`` or ``search-page`` name a layout.
PARTS = frozenset("list links link buttons button icons box posts articles stories items slot unit area form thread bar".split())
OUTER = frozenset("site-header site-footer site-nav main-nav main-menu page-footer global-header global-footer top-nav bottom-nav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ANCHORED = HEADINGS | {"p", "section"}
CONTENT = frozenset("article content post entry story main text body articlebody".split())

_QUOTED = re.compile(r"<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
_UNQUOTED = re.compile(r"<(/?)([a-z][^\s/>]*+)([^>]*+)>", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?![^\s/>])[^>]*+>", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NUMBER = re.compile(r"\d+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)")

#: Best containers of a page that vote for the host's path.
VOTES = 3
LARGE_HOSTS = 512
#: Text beside the best container is main text too from this share of it on, if little of it is links.
BESIDE = 0.2
PLAIN_TEXT = 0.75


# How doubtful a node is by names of classes and ids, its own and its parents'.
CLEAN, IN_HEADER, NAMED, FOREIGN = 0, 1, 2, 3


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    path: int  # number of the path in the page
    step: str
    drop: bool  # by its own tag or role
    named: int  # doubt by its own names: 0, NAMED or, for ADDED ones, FOREIGN
    dropped: bool  # by its tag or role, or a parent's
    doubt: int
    link: bool
    in_article: bool
    owner: int  # the node that owns text directly inside
    near: dict[str, int]  # depth of the open element of each group that a new one ends
    content: int = 0
    total: int = 0
    bonus: float = 1.0


class Page:
    def __init__(self) -> None:
        root = Node("html", -1, 0, "", False, CLEAN, False, CLEAN, False, False, 0, {})
        self.nodes: list[Node] = [root]
        self.blocks: list[tuple[int, str, int, bool]] = []  # owner, text, link characters, kept
        self.paths: dict[tuple[int, str], int] = {}  # (parent's path, step) to the path's number

    def path(self, i: int) -> str:
        """The steps from the top, each after a ``>``."""
        steps = []
        while i > 0:
            steps.append(self.nodes[i].step)
            i = self.nodes[i].parent
        return "".join(">" + x for x in reversed(steps))

    def number(self, path: str | None) -> int:
        """The number of a path in this page, or -1."""
        at = 0 if path is not None else -1
        for step in (path or "").split(">")[1:]:
            at = self.paths.get((at, step), -1)
        return at


def _names(text: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(text)} | set(re.split(r"[^a-z]+", text.lower()))


def doubt_by(named: str) -> int:
    """What classes and ids say: a name counts as a whole, if all its words name boilerplate or a part of it."""
    worst = CLEAN
    for name in named.split():
        words = [w.lower() for w in _WORD.findall(name) if len(w) > 1]
        if name.lower() in OUTER or words and BOILERPLATE.issuperset(set(words) - PARTS) and not PARTS.issuperset(words):
            worst = max(worst, NAMED if ADDED.isdisjoint(words) else FOREIGN)
    return worst


def _node(tag: str, rest: str, parent: int, depth: int, page: Page) -> Node:
    up = page.nodes[parent]
    classes, named, role = "", "", ""
    anchored = up.in_article and tag in ANCHORED  # ids are the names of the article's own parts
    if "=" in rest:
        for m in _ATTRIBUTE.finditer(rest):
            value = unescape(m[2] or m[3] or m[4] or "")
            kind = m[1].lower()
            if kind == "class":
                classes = value
            if kind == "role":
                role = value.lower()
            elif kind != "id" or not anchored:
                named += " " + value
    in_article = up.in_article or tag in ("article", "main")
    bonus = {"article": 1.5, "main": 1.4, "body": 0.8}.get(tag, 1.0)
    own, drop = CLEAN, tag in DROPPED or role in ROLES
    if tag == "header":
        drop = drop or not in_article
    elif named and tag not in ("html", "body", "main"):
        own = doubt_by(named)
        if tag == "article":
            own = own if own == FOREIGN or "related" in named.lower().split() else CLEAN
        elif own == CLEAN and not CONTENT.isdisjoint(_names(named)):
            bonus = 1.3
    dropped = up.dropped or drop
    doubt = max(own, IN_HEADER if tag == "header" else CLEAN, up.doubt)
    if tag in HEADINGS and doubt == IN_HEADER:
        doubt = CLEAN  # an article's headings are its own, the rest of its header isn't
    step = tag + "".join(sorted("." + _NUMBER.sub("#", c.replace(">", "")) for c in set(classes.split())))
    path = page.paths.setdefault((up.path, step), len(page.paths) + 1)
    owner = up.owner if tag in INLINE and not dropped and doubt == CLEAN else len(page.nodes)
    near = up.near
    if tag in SCOPES:
        near = {}
    if tag in GROUPS:
        near = {**near, GROUPS[tag]: depth}
    return Node(tag, parent, path, step, drop, own, dropped, doubt, up.link or tag == "a", in_article, owner, near, bonus=bonus)


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, rest) of texts, start and end tags; comments, declarations and the content of raw elements are left out.

    A text is (``text``, itself, empty).
    """
    at, size, closed, tags = 0, len(html), html.rfind(">") + 1, _QUOTED
    while at < size:
        lt = html.find("<", at, closed)
        if lt < 0:
            break
        mark = html[lt + 1 : lt + 2]
        if mark.isascii() and mark.isalpha() or mark == "/" and (after := html[lt + 2 : lt + 3]).isascii() and after.isalpha():
            if lt > at:
                yield "text", html[at:lt], ""
            m = tags.match(html, lt)
            if m is None:  # a quote that never closes: quotes don't count from here on
                tags = _UNQUOTED
                m = tags.match(html, lt)
            end, tag = m[1], m[2].lower()
            at = m.end()
            if not end and tag in RAW:
                close = _RAW_END[tag].search(html, at)
                at = close.end() if close else size
                yield "raw", tag, ""
            else:
                yield "end" if end else "start", tag, m[3]
        elif mark in ("!", "?", "/"):
            if lt > at:
                yield "text", html[at:lt], ""
            if html.startswith("<!--", lt):
                close = html.find("-->", lt + 4)
                at = close + 3 if close >= 0 else size
            else:
                at = html.find(">", lt) + 1
        else:
            yield "text", html[at : lt + 1], ""
            at = lt + 1
    if at < size:
        yield "text", html[at:], ""


def parsed(html: str) -> Page:
    """The page's containers with their sums, and its text blocks in order."""
    page = Page()
    nodes, blocks = page.nodes, page.blocks
    stack, pieces, links, owner = [0], [], 0, 0
    open_tags: Counter[str] = Counter()
    inline_tags: list[dict[str, int] | None] = [None]  # how many inline elements of each kind are open inside each open block element

    def close_block() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append((owner, text, min(links, len(text)), True))
            pieces.clear()
            links = 0

    def cut(depth: int) -> None:
        """Close the open elements from this depth on."""
        for i in reversed(stack[depth:]):
            tag = nodes[i].tag
            open_tags[tag] -= 1
            if tag in INLINE:
                inline_tags[-1][tag] -= 1
            else:
                inline_tags.pop()
        del stack[depth:]

    def look(i: int) -> tuple[bool, int]:
        return nodes[i].dropped, nodes[i].doubt

    for kind, tag, rest in events(html):
        if kind == "text":
            text = unescape(tag) if "&" in tag else tag
            if pieces or text.strip():
                node = nodes[stack[-1]]
                owner = owner if pieces else node.owner
                pieces.append(text)
                if node.link:
                    links += len(text)
            continue
        inline = tag in INLINE
        if tag == "br":
            pieces and pieces.append(" ")
            continue
        if not inline:
            close_block()
        if kind == "raw":
            continue
        if kind == "end":
            if not ((inline_tags[-1] or {}).get(tag) if inline else open_tags[tag]):
                continue
            depth = len(stack) - 1
            while nodes[stack[depth]].tag != tag:
                depth -= 1
            if inline and look(stack[depth]) != look(stack[depth - 1]):
                close_block()
            cut(depth)
            continue
        ends = [GROUPS[tag]] if tag in GROUPS and tag != "p" else []
        for group in (["p", *ends] if tag in CLOSES_P else ends):
            depth = nodes[stack[-1]].near.get(group, 0)
            if depth:
                cut(depth)
        if tag in VOID or rest.endswith("/") and tag not in CONTAINERS and tag != "p" and not inline:
            continue
        node = _node(tag, rest, stack[-1], len(stack), page)
        if inline and (node.dropped, node.doubt) != look(stack[-1]):
            close_block()
        nodes.append(node)
        stack.append(len(nodes) - 1)
        open_tags[tag] += 1
        if not inline:
            inline_tags.append(None)
        elif (inside := inline_tags[-1]) is None:
            inline_tags[-1] = {tag: 1}
        else:
            inside[tag] = inside.get(tag, 0) + 1
    close_block()
    _sum(page)
    return page


def _sizes(page: Page, counts: list[bool]) -> list[int]:
    """Characters below each node, of blocks whose owner counts."""
    size = [0] * len(page.nodes)
    for owner, text, _, _ in page.blocks:
        size[owner] += len(text) if counts[owner] else 0
    for i in range(len(size) - 1, 0, -1):
        size[page.nodes[i].parent] += size[i]
    return size


def _below(page: Page, own: list[bool]) -> list[bool]:
    """Whether a node or one above it is marked."""
    out = list(own)
    for i, node in enumerate(page.nodes[1:], 1):
        out[i] = out[i] or out[node.parent]
    return out


def _above(page: Page, marked: list[int]) -> list[bool]:
    """Whether a node is one of these or stands above one."""
    out = [False] * len(page.nodes)
    for i in marked:
        while i >= 0 and not out[i]:
            out[i] = True
            i = page.nodes[i].parent
    return out


def _judge(page: Page) -> None:
    """Set what is dropped and doubtful; nothing that holds the page's article is.

    The article is the page's ``main``, or else its largest ``article`` without
    a doubtful name.  Without either, what a layout's name stands on, and a form
    with containers in it, isn't dropped if it holds over half of the text.
    """
    nodes = page.nodes
    everything = _sizes(page, [True] * len(nodes))
    holds_main = _above(page, [i for i, x in enumerate(nodes) if x.tag == "main" and everything[i] * 20 >= everything[0] > 0])
    inner = _above(page, [i for i, x in enumerate(nodes) if x.tag in CONTAINERS])
    form = [x.drop and x.tag == "form" and inner[i] for i, x in enumerate(nodes)]
    gone = _below(page, [x.drop and not form[i] and not (x.tag != "main" and holds_main[i]) for i, x in enumerate(nodes)])
    live = _sizes(page, [not g for g in gone])
    holds = holds_main
    if not holds[0]:
        foreign = _below(page, [x.named == FOREIGN or x.tag == "article" and x.named > CLEAN for x in nodes])
        articles = [i for i, x in enumerate(nodes) if x.tag == "article" and not gone[i] and not foreign[i] and live[i] * 20 >= live[0] > 0]
        holds = _above(page, sorted(articles, key=lambda i: -live[i])[:1])
    for i, x in enumerate(nodes[1:], 1):
        up = nodes[x.parent]
        most = not holds[0] and 2 * live[i] > live[0]
        x.dropped = up.dropped or x.drop and not ((holds_main if not form[i] else holds)[i] or form[i] and most)
        own = CLEAN if holds[i] or x.named == NAMED and most else x.named
        x.doubt = max(own, IN_HEADER if x.tag == "header" else CLEAN, up.doubt)
        if x.tag in HEADINGS and x.doubt == IN_HEADER:
            x.doubt = CLEAN


def _sum(page: Page) -> None:
    _judge(page)
    nodes = page.nodes
    clean = any(not (nodes[o].dropped or nodes[o].doubt) for o, *_ in page.blocks)
    for k, (owner, text, links, _) in enumerate(page.blocks):
        kept = not nodes[owner].dropped and not (clean and nodes[owner].doubt)
        page.blocks[k] = (owner, text, links, kept)
        if kept:
            nodes[owner].total += len(text)
            nodes[owner].content += max(0, len(text) - 2 * links) + 1
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.total += node.total
        up.content += node.content


def scored(page: Page) -> list[tuple[float, int]]:
    """(score, node) of the containers, best first; of equal ones the inner first."""
    out = []
    for i, node in enumerate(page.nodes):
        if node.content and (node.tag in CONTAINERS or i == 0):
            out.append((node.bonus * (0.5 if i == 0 else 1.0) * node.content * node.content / (node.total + 1), i))
    return sorted(out, key=lambda x: (-x[0], -x[1]))


def _text(page: Page, roots: set[int]) -> str:
    inside = [False] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        inside[i] = i in roots or node.parent >= 0 and inside[node.parent]
    return "\n\n".join(text for owner, text, _, kept in page.blocks if kept and inside[owner])


def _beside(page: Page, best: int) -> set[int]:
    """Nodes beside the best container, or beside one above it, whose text is like it; what is outside of ``main`` isn't."""
    nodes, found, at = page.nodes, set(), best
    children: dict[int, list[int]] = {}
    chain = set()
    while at > 0:
        chain.add(at)
        if nodes[at].tag == "main":
            break
        at = nodes[at].parent
        children[at] = []
    for i, node in enumerate(nodes[1:], 1):
        if node.parent in children and i not in chain and node.content:
            children[node.parent].append(i)
    for members in children.values():
        inner = [i for i in members if nodes[i].tag in CONTAINERS]
        loose = [i for i in members if nodes[i].tag not in CONTAINERS]
        for some in [*([i] for i in inner), loose]:
            content, total = sum(nodes[i].content for i in some), sum(nodes[i].total for i in some)
            if content >= BESIDE * nodes[best].content and content >= PLAIN_TEXT * total:
                found.update(some)
    return found


def _common(page: Page, some: set[int]) -> int:
    """The smallest node around all of these."""
    count: Counter[int] = Counter()
    for i in some:
        while i >= 0:
            count[i] += 1
            i = page.nodes[i].parent
    return max(i for i, c in count.items() if c == len(some))


def extracted(html: str | None, winner: str | None) -> str:
    """The main text: what the containers on the winning path and the page's own best container hold, and text like it beside that.

    Where both stand in one container inside the body, all that holds.
    """
    if not html:
        return ""
    page = parsed(html)
    best = scored(page)
    if not best:
        return ""
    number, own = page.number(winner), best[0][1]
    roots = {own} | {i for _, i in best if page.nodes[i].path == number}
    around = _common(page, roots)
    if page.nodes[around].tag in CONTAINERS - {"body"}:
        roots = {around}
    return _text(page, roots | _beside(page, own))


def votes(html: str | None) -> list[tuple[str, int]]:
    """(path, votes) of the page's best containers; the best has 1000."""
    if not html:
        return []
    page = parsed(html)
    out: dict[str, int] = {}
    best = scored(page)
    for score, i in best[:VOTES]:
        out.setdefault(page.path(i), round(1000 * score / best[0][0]))
    return list(out.items())


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, winner (the path with the most votes) and n_pages.  Votes are summed within tasks first."""

    def vote(batches):
        for b in batches:
            hosts, paths, counts, firsts = [], [], [], []
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                for k, (path, n) in enumerate(votes(html)):
                    hosts.append(host(url))
                    paths.append(path)
                    counts.append(n)
                    firsts.append(int(k == 0))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64())], names=["host", "path", "votes", "n_pages"])

    rows = pages.select("url", "html").mapInArrow(tidy(vote), "host string, path string, votes long, n_pages long")
    counted = rows.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("n_pages").alias("n_pages"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("winner"), F.sum("n_pages").alias("n_pages"))


def with_winners(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows with their host's winner.

    Hosts of more than 1 / LARGE_HOSTS of the pages are less than LARGE_HOSTS,
    so their winners are broadcast.  Their rows pass the join of the others
    under keys that match nothing, and so are spread over all tasks.
    """
    total = winners.agg(F.sum("n_pages")).first()[0] or 0
    large = winners.where(F.col("n_pages") * LARGE_HOSTS > total).select("host", F.col("winner").alias("large_winner"))
    rows = rows.join(F.broadcast(large), "host", "left")
    spread = F.concat(F.lit("/"), F.xxhash64("page_id", "url", "html").cast("string"))
    rows = rows.withColumn("key", F.when(F.col("large_winner").isNull(), F.col("host")).otherwise(spread))
    rest = winners.select(F.col("host").alias("key"), "winner")
    return rows.join(rest, "key", "left").withColumn("winner", F.coalesce("large_winner", "winner"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    name = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    joined = with_winners(rows.withColumn("host", name), stored(winning_paths(rows), "winners"))

    def extract(batches):
        for b in batches:
            texts = [extracted(h, w) for h, w in zip(b.column("html").to_pylist(), b.column("winner").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "winner").mapInArrow(tidy(extract), "page_id long, url string, text string, n_chars long")
