"""Main text of web pages by paths that the pages of a host agree on.

1. Every page scores its containers: the score is the share of the page's content characters (text outside menus,
   footers, adverts and the like, link text not counted) that lies in the container. The page's own choice is the
   deepest container that still holds most of them, or what that is a part of: the outermost article or main around
   it, and any container around it that holds content directly, such as a headline or lead above the body. Containers
   are known by a *generalised path*: tags with their classes from the root, digits replaced by ``#``.
2. Spark counts the choices per host; every path that several pages chose is kept, ranked by its votes.
3. Every page is extracted again: from the containers on the path of most votes that hold all of its own choice. Where
   none does, its own choice stands if other pages of the host made it too. A choice that no other page made is no
   template: such a page follows the path of most votes that has text on it, or its own choice if there is none.

Content in other containers beside the choice, outside any article or main, is left out.

Defined cases: null or empty html gives an empty text; so does a page whose only text is boilerplate. A null url and
one without a host share the empty host. Ties between paths of equal votes go to the larger score, then to the path
that sorts first. Repeated rows stay rows. Unclosed and misnested tags, unclosed comments and bare ``<`` are read as
browsers roughly do. Other columns are kept; one named like the added column is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut
from .arrow import added, bounded, own_names, with_added

#: A container must hold this share of the page's content to be the page's choice.
MOST = 0.8

# Elements by their part in HTML pages.
UNREAD = frozenset("head title script style noscript template iframe object svg canvas audio video map select textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset("nav aside footer header form dialog menu fieldset".split())
CONTAINERS = frozenset("html body main article section div td center table tbody tr".split())
ENDS_PARAGRAPH = CONTAINERS | BOILERPLATE | frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote hr address figure".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())
# Words in classes and ids that mark what is not the article.
HINTS = frozenset(
    "ad ads adbox advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments commentlist consent "
    "cookie cookies copyright disqus discussion disclaimer footer form gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notification pager pagination paywall popup promo promotion recommended related replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar "
    "toc widget widgets".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Page:
    """Containers and text blocks of one page."""

    def __init__(self, html: str):
        #: Per element that is neither inline nor void: parent, name (tag and classes), container or not, boilerplate mark.
        self.parents, self.names, self.holds, self.marked, self.main = [-1], ["#"], [True], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of link text
        self._read(html)

    def _read(self, html: str) -> None:
        stack = [(0, "#")]  # open elements, inline ones with their holder
        words: list[str] = []
        linked, links, skipped = 0, 0, 0  # link characters of the block, open links, open unread elements

        def end_block() -> None:
            nonlocal linked
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                self.blocks.append((stack[-1][0], text, min(linked, len(text))))
            words.clear()
            linked = 0

        def close(to: int) -> None:
            """Close the open elements from the given place in the stack on."""
            nonlocal links, skipped
            if any(tag not in INLINE for _, tag in stack[to:]):
                end_block()
            for _, tag in stack[to:]:
                links -= tag == "a"
                skipped -= tag in UNREAD
            del stack[to:]

        def opened(tag: str, until: frozenset[str]) -> int | None:
            """Where in the stack ``tag`` is open, looking up to the nearest of ``until``."""
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][1] == tag:
                    return at
                if stack[at][1] in until:
                    return None
            return None

        for match in _TOKEN.finditer(html):
            text = match["text"]
            if text is not None:
                if not skipped:
                    words.append(text)
                    linked += links > 0 and len(text)
                continue
            tag = (match["tag"] or match["tag2"] or "").lower()
            if not tag:
                continue
            if match["end"] or match["end2"]:
                at = opened(tag, frozenset() if tag not in INLINE else ENDS_PARAGRAPH)
                if at is not None:
                    close(at)
                elif tag == "p":
                    end_block()
                continue
            if tag in ENDS_PARAGRAPH and (at := opened("p", CONTAINERS)) is not None:
                close(at)
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                same = {"dd": "dt", "dt": "dd", "td": "th", "th": "td"}.get(tag, tag)
                for name in (tag, same):
                    if (at := opened(name, frozenset(("ul", "ol", "dl", "table", "select")))) is not None:
                        close(at)
            if tag in ("br", "hr"):
                end_block()
            if tag in VOID:
                continue
            holder = stack[-1][0]
            if tag in INLINE:
                links += tag == "a"
            else:
                end_block()
                skipped += tag in UNREAD
                holder = self._add(holder, tag, match["attrs"] if match["tag"] else match["attrs2"])
            stack.append((holder, tag))
        close(1)
        end_block()

    def _add(self, parent: int, tag: str, attrs: str | None) -> int:
        found = {}
        for name, *values in _ATTR.findall(attrs) if attrs else ():
            found.setdefault(name.lower(), next((v for v in values if v), ""))
        classes = entities.unescape(found.get("class", "")).lower().split()
        words = set(re.split(r"[^a-z]+", " ".join([*classes, found.get("id", "").lower()])))
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        article = tag in ("article", "main", "body", "html")
        marked = tag in BOILERPLATE or hidden or found.get("role", "").lower() in ROLES or (not article and not HINTS.isdisjoint(words))
        if article and tag not in ("body", "html"):  # what holds the article is no boilerplate, whatever its classes say
            up = parent
            while up > 0:
                self.main[up] = True
                up = self.parents[up]
        self.parents.append(parent)
        self.names.append(re.sub(r"\d+", "#", ".".join([tag, *sorted(classes)])))
        self.holds.append(tag in CONTAINERS)
        self.marked.append(marked)
        self.main.append(False)
        return len(self.names) - 1

    def content(self) -> list[tuple[int, str, int]]:
        """The blocks outside boilerplate."""
        bad = [False]
        for at in range(1, len(self.parents)):
            bad.append(bad[self.parents[at]] or (self.marked[at] and not self.main[at]))
        return [b for b in self.blocks if not bad[b[0]]]

    def path(self, at: int) -> str:
        names = []
        while at > 0:
            names.append(self.names[at])
            at = self.parents[at]
        return "/".join(reversed(names))

    def choice(self) -> tuple[int, float] | None:
        """The deepest container with most of the content, or what it is a part of, and its share of the content's characters."""
        mass, direct = [0] * len(self.parents), [0] * len(self.parents)
        for at, text, linked in self.content():
            mass[at] += len(text) - linked
            while not self.holds[at]:
                at = self.parents[at]
            direct[at] += len(text) - linked
        for at in range(len(mass) - 1, 0, -1):
            mass[self.parents[at]] += mass[at]
        if not mass[0]:
            return None
        best = max((at for at in range(len(mass)) if self.holds[at] and mass[at] >= MOST * mass[0]), key=lambda at: (self._depth(at), -at))
        at = best
        while at > 0:
            at = self.parents[at]
            if direct[at] or self.names[at].partition(".")[0] in ("article", "main"):
                best = at
        return best, mass[best] / mass[0]

    def _depth(self, at: int) -> int:
        depth = 0
        while at > 0:
            at, depth = self.parents[at], depth + 1
        return depth

    def text(self, votes: dict[str, float]) -> str:
        """The text in the containers on the path with most votes that hold the page's own choice; see the module for other pages."""
        content = self.content()
        if not content:
            return ""
        inside: dict[str, set[int]] = {}
        for at in range(1, len(self.parents)):
            if self.holds[at] and (path := self.path(at)) in votes:
                inside.setdefault(path, set()).add(at)
        own = self.choice()
        top = own[0] if own else 0
        mine = self._within(content, {top})
        told = [self._within(content, inside[path]) for path in sorted(inside, key=lambda p: (-votes[p], p))]
        found = next((blocks for blocks in told if set(mine) <= set(blocks)), None)
        if found is None and self.path(top) not in votes:
            found = next((blocks for blocks in told if blocks), None)
        return "\n".join(content[i][1] for i in (mine if found is None else found))

    def _within(self, content: list[tuple[int, str, int]], tops: set[int]) -> list[int]:
        """Numbers of the blocks in the given containers."""
        found = []
        for i, (at, _, _) in enumerate(content):
            while at not in tops and at > 0:
                at = self.parents[at]
            if at in tops:
                found.append(i)
        return found


def host(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per host: the paths that several of its pages chose, ranked by their votes; the best has the largest number."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html"):
            rows = []
            for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = Page(text or "")
                if (own := page.choice()) is not None:
                    rows.append((host, page.path(own[0]), own[1]))
            frame = pd.DataFrame(rows, columns=["host", "path", "score"])
            yield pa.RecordBatch.from_pandas(frame, schema=chosen, preserve_index=False)

    chosen = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64())])
    counted = (
        pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html"))
        .mapInArrow(choose, "host string, path string, score double")
        .groupBy("host", "path")
        .agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))
        .where("n > 1")
    )
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path")
    return (
        counted.withColumn("place", F.row_number().over(order))
        .groupBy("host")
        .agg(F.map_from_entries(F.collect_list(F.struct("path", (-F.col("place")).alias("votes")))).alias("votes"))
    )


def extract(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of every page; other columns are kept, whatever their names."""
    of_page, of_votes, won_votes = own_names("host", "host", "votes")
    won = cut(votes(pages, url, html).withColumnsRenamed({"host": of_votes, "votes": won_votes}))
    joined = pages.withColumn(of_page, host(F.col(url))).join(won, F.col(of_page) == F.col(of_votes), "left")
    wanted = added(pages, **{text: T.StringType()})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, html):
            found = []
            for source, paths in zip(batch.column(html).to_pylist(), batch.column(won_votes).to_pylist()):
                found.append(Page(source or "").text(dict(paths or ())))
            yield with_added(batch, {text: pa.array(found, pa.string())}).select(wanted.names)

    return joined.drop(of_page, of_votes).mapInArrow(read, wanted)
