"""Main text of HTML pages by consensus of each host's pages on where the text is.

A page's text falls into blocks, and each block belongs to its nearest container. A container's
place is its generalised path: the tags and classes of containers from the body down, with runs of
digits as ``#`` and equal neighbours as one. Every page deals one vote among the paths of its
containers by the text of their own blocks, less what is in links; Spark adds the votes by host
and path. Paths with a good share of their host's votes win, and each page is read again: blocks
at the winning paths and inside of them stay, in page order, and so do those beside a winning path
where the container around both has text of its own. The page's first-level headings stay as well.
A page where no winning path has text goes by its own votes.

Menus, headers, footers, sidebars, forms, scripts and styles that the markup names are left out by
their tag or role. A container whose class or id names such a thing is only suspected: its votes
count for little, and what is in it stays out unless the host's votes confirm that the text is
there after all.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch

if TYPE_CHECKING:
    import pyarrow as pa

#: A path with this share of its host's votes or more is a winning one, so there are at most ten.
WINNING_SHARE = 0.1
#: A vote of text in a suspected container, for each one around it.
SUSPECTED = 0.02
#: Winning paths up to this many rows are broadcast (a host and a path each, so some tens of MB).
BROADCAST_PATHS = 200_000
#: A form with so many paragraphs, and nothing outside of it, is the page.
WRAPPED_PARAGRAPHS = 2
VOTE = 1_000_000  # a page's vote, in whole numbers so that sums do not depend on their order

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body blockquote center div main section table tbody tr td ul ol dl".split())
#: Containers of text that go along with text beside them, even at the top of the page.
TEXT_CONTAINERS = frozenset("blockquote center table tbody tr td ul ol dl".split())
#: A start tag on the left ends an open element on the right, up to the element that holds both.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

DROP_TAGS = frozenset(
    "head script style noscript template iframe nav footer aside form button select textarea input label fieldset menu "
    "dialog title xmp noembed noframes".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Names of what is no main text; a name is suspect if it has one of these and else only words of LAYOUT_WORDS.
DROP_WORDS = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer foot "
    "masthead banner banners ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored "
    "sponsors promo promos promotion cookie cookies consent gdpr notice notices notification notifications alert popup modal "
    "overlay newsletter subscribe subscription signup social share sharing sharebar related recommended recommendations "
    "comment comments commentlist disqus reply replies respond pagination pager toolbar login searchbox searchform skip".split()
)
#: Words that are boilerplate at a page's top, but name the title's place inside an article.
HEADER_WORDS = frozenset("header topbar".split())
LAYOUT_WORDS = frozenset(
    "area bar block body bottom box btn button buttons col column container content desktop fixed form global group holder icon "
    "icons inner item items label left link links list main mobile module outer page panel post primary right row secondary "
    "section site sticky text title to top unit user view wrap wrapper".split()
)
#: Class names such as "no-sidebar" tell of the layout, not of the element.
LAYOUT = ("no", "has", "with", "without", "hide", "show", "is", "single")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"  # quotes that do not pair
    r"|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")


MARKUP = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ/!?")


class Node:
    """An open element; what is asked of its ancestors is handed down, so that depth costs nothing."""

    __slots__ = ("tag", "drop", "in_article", "in_link", "block", "path", "suspects")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str], dropped: frozenset[str]):
        self.tag = tag
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.drop = (parent is not None and parent.drop) or _dropped(tag, attrs, self.in_article, dropped)
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        #: The nearest block element, the path of the nearest container, and those of suspected containers.
        self.block = tag if tag in BLOCKS or parent is None else parent.block
        self.path = "" if parent is None else parent.path
        self.suspects: tuple[str, ...] = () if parent is None else parent.suspects
        if tag in CONTAINERS and tag != "body":
            classes = sorted(set(DIGITS.sub("#", attrs.get("class", "").replace(">", " ")).split()))
            suspected = tag not in ("main", "article") and _suspected(attrs, self.in_article)
            step = ".".join([tag, *classes]) + "!" * suspected  # a place of its own, whatever names it
            if self.path.rpartition(">")[2] != step:
                self.path = f"{self.path}>{step}" if self.path else step
            if suspected and self.path not in self.suspects:
                self.suspects = (*self.suspects, self.path)


def _dropped(tag: str, attrs: dict[str, str], in_article: bool, dropped: frozenset[str]) -> bool:
    if tag in dropped or (tag == "header" and not in_article):
        return True
    return tag not in ("html", "body", "main", "article") and attrs.get("role", "").lower() in DROP_ROLES


def _suspected(attrs: dict[str, str], in_article: bool) -> bool:
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in NAME_WORDS.findall(name)]
        if len(words) > 1 and words[0] in LAYOUT:
            continue
        named = DROP_WORDS if in_article else DROP_WORDS | HEADER_WORDS
        if not named.isdisjoint(words) and all(w in named or w in LAYOUT_WORDS or len(w) == 1 for w in words):
            return True
    return False


class Block:
    """A block's text: whether it is a first-level heading, its container's path, suspected containers, its worth."""

    __slots__ = ("text", "heading", "paragraph", "path", "suspects", "worth")

    def __init__(self, text: str, node: Node, in_links: int):
        self.text, self.heading, self.paragraph, self.path, self.suspects = text, node.block == "h1", node.block == "p", node.path, node.suspects
        worth = (len(text) - 2 * in_links) * SUSPECTED ** len(node.suspects)
        self.worth = 2 * worth if node.in_article else worth


class Page:
    """The blocks of a page that are not dropped, in order."""

    def __init__(self, source: str):
        self._read(source, DROP_TAGS)
        if not self.blocks and "<form" in source.lower():
            # a form around the whole page is no form of the page's
            self._read(source, DROP_TAGS - {"form"})
            if sum(b.paragraph for b in self.blocks) < WRAPPED_PARAGRAPHS:
                self.blocks = []

    def _read(self, source: str, dropped: frozenset[str]) -> None:
        self.blocks: list[Block] = []
        self.dropped = dropped
        self.open: list[Node] = [Node("", None, {}, dropped)]
        self._count: dict[str, int] = {}  # open elements by tag
        self._text: list[str] = []
        self._link = 0
        self._parse(source)
        self._end_block()

    def _end_block(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append(Block(text, self._at, self._link))
            self._text, self._link = [], 0

    def _add(self, raw: str) -> None:
        here = self.open[-1]
        if here.drop:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if not self._text:
            self._at = here
        self._text.append(text)
        if here.in_link:
            self._link += len(text.strip())

    def _close(self, tags: set[str] | frozenset[str], within: set[str] | frozenset[str] = frozenset()) -> bool:
        """Close the innermost open element of ``tags``, unless one of ``within`` holds it."""
        if not any(self._count.get(t) for t in tags):
            return False
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                if any(n.tag in BLOCKS for n in self.open[k:]):
                    self._end_block()
                for n in self.open[k:]:
                    self._count[n.tag] -= 1
                del self.open[k:]
                return True
            if self.open[k].tag in within:
                return False
        return False

    def _parse(self, source: str) -> None:
        at, end, last = 0, len(source), source.rfind(">")
        while at < end:
            if at > last and source[at] == "<" and source[at + 1 : at + 2] in MARKUP:
                break  # a tag that the page's end cuts off
            m = TOKEN.match(source, at)
            at = m.end()
            if m["text"] is not None:
                self._add(m["text"])
                continue
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                continue
            attrs = m["attrs"] if m["tag"] else m["attrs2"]
            if m["close"] or m["close2"]:
                self._close({tag})
                if tag == "p":
                    self._end_block()
                continue
            if tag == "br":
                self._add(" ")
                continue
            if tag in BLOCKS:
                self._end_block()
                self._close({"p"}, {"button", "table", "td", "th"})
                if tag in CLOSES:
                    while self._close(*CLOSES[tag]):
                        pass
            if tag in VOID:
                continue
            if tag in RAW:  # no markup inside
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                tail = source.find(">", close.start()) if close else -1
                at = tail + 1 if tail >= 0 else end
                continue
            found = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attrs)} if "=" in attrs else {}
            self.open.append(Node(tag, self.open[-1], found, self.dropped))
            self._count[tag] = self._count.get(tag, 0) + 1

    def scores(self) -> dict[str, float]:
        """By path, the worth of the containers' own blocks."""
        found: dict[str, float] = {}
        for b in self.blocks:
            found[b.path] = found.get(b.path, 0.0) + b.worth
        return {p: s for p, s in found.items() if s > 0}

    def votes(self) -> dict[str, int]:
        """The page's vote, dealt among the paths."""
        scores = self.scores()
        total = sum(scores.values())
        return {p: round(VOTE * s / total) for p, s in scores.items()}

    def text_at(self, winning: list[str], around: list[str]) -> str | None:
        """Blocks at the winning paths and at those around them, and headings; None where there are but headings."""
        # what stands beside a winning path in the page's article goes along: a lead, a byline
        places = {*winning, *around, *(a for w in winning if (a := article_path(w)))}
        confirmed = lambda s: any(_inside(w, s) for w in winning)
        out, found = [], False
        for b in self.blocks:
            if not all(map(confirmed, b.suspects)):
                continue
            here = b.path in places or any(_inside(b.path, p) for p in places)
            found |= here
            if here or b.heading:
                out.append(b.text)
        return "\n".join(out) if found else None

    def unsuspected(self) -> str:
        return "\n".join(b.text for b in self.blocks if not b.suspects)


def _inside(path: str, outer: str) -> bool:
    """Whether a container at ``path`` is, or lies in, one at ``outer``; of the body's, only containers of text do."""
    if not outer:
        return all(step.partition(".")[0] in TEXT_CONTAINERS for step in path.split(">")) if path else True
    return path == outer or path.startswith(outer + ">")


def article_path(path: str) -> str | None:
    """The path of the nearest article or main around a container, or its own."""
    steps = path.split(">")
    for k in range(len(steps), 0, -1):
        if steps[k - 1].partition(".")[0] in ("article", "main"):
            return ">".join(steps[:k])
    return None


def parent_path(path: str) -> str | None:
    return path.rpartition(">")[0] if path else None


def winners(votes: dict[str, int]) -> tuple[list[str], list[str]]:
    """Winning paths of these votes, and the paths around them that have votes of their own."""
    least = WINNING_SHARE * sum(votes.values())
    winning = sorted(p for p, v in votes.items() if v >= least)
    return winning, sorted({q for p in winning if (q := parent_path(p)) is not None and votes.get(q, 0) > 0})


def extract(source: str, winning: list[str], around: list[str] = []) -> str:  # noqa: B006
    """The page's text at its host's ``winning`` paths and ``around`` them, else by its own votes."""
    page = Page(source)
    text = page.text_at(winning, around) if winning else None
    if text is None:
        text = page.text_at(*winners(page.votes()))
    return page.unsuspected() if text is None else text


def host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty for what has none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, winning, around): see ``winners``, of the votes of all the host's pages.

    Sums by host are joined back to the paths, so that a host with very many paths is no group of one task.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            tally: dict[tuple[str, str], int] = {}
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for path, n in Page(source.as_py() or "").votes().items():
                    tally[name, path] = tally.get((name, path), 0) + n
            columns = {"host": pa.array([h for h, _ in tally], pa.string()), "path": pa.array([p for _, p in tally], pa.string())}
            yield pa.RecordBatch.from_pydict(columns | {"votes": pa.array(list(tally.values()), pa.int64())})

    votes = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, votes long")
    scratch = Scratch(pages.sparkSession, "votes")
    by_path = scratch.table(votes.groupBy("host", "path").agg(F.sum("votes").alias("votes")), "votes")
    totals = by_path.groupBy("host").agg(F.sum("votes").alias("total"))
    winning = by_path.join(totals, "host").filter(F.col("votes") >= WINNING_SHARE * F.col("total")).select("host", "path")
    winning = scratch.table(winning, "winning")
    outer = winning.filter("path <> ''").select("host", F.regexp_replace("path", ">?[^>]*$", "").alias("path")).distinct()
    around = outer.join(by_path.filter("votes > 0").select("host", "path"), ["host", "path"])
    both = winning.select("host", "path", F.lit(True).alias("wins")).unionByName(around.select("host", "path", F.lit(False).alias("wins")))
    listed = lambda wins: F.sort_array(F.collect_list(F.when(F.col("wins") == wins, F.col("path"))))
    return both.groupBy("host").agg(listed(True).alias("winning"), listed(False).alias("around"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages`` (page_id, url, html).

    A null html gives an empty text, and so does a page without text outside of boilerplate. Pages
    without a host share the empty one. Repeated rows get equal texts; other columns are left out;
    an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.select("page_id", "url", "html")
    paths = scratch.table(host_paths(rows), "paths")
    near = F.broadcast if paths.count() <= BROADCAST_PATHS else (lambda df: df)
    placed = rows.withColumn("host", host(F.col("url"))).join(near(paths), "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            columns = (batch.column(k) for k in (2, 3, 4))
            texts = [extract(s.as_py() or "", w.as_py() or [], a.as_py() or []) for s, w, a in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    typed = placed.select(F.col("page_id").cast("long"), "url", "html", "winning", "around")
    return typed.mapInArrow(read, "page_id long, url string, text string, n_chars long")
