"""Main text of web pages by consensus host paths.

Each page is read once into blocks; every block knows the path of the containers around it, generalised: tag names with
their classes, digits taken out. A container's score is the text it holds outside links, less what stands in
containers that are never main text. Each page votes for the deepest path that holds all of this text; votes are summed
in Spark by host. A page is then extracted by the path with the most votes among those of its own containers that hold
all of its main text: so a host's usual container outvotes a narrower one of an odd page and brings back what that would
have left out (lists of links within the article), and no vote ever loses main text. What the walk found is written, each
block with the depth to which it lies within the page's path, so the second extraction is a filter. Only paths and votes
are joined with each other, summed before their shuffle, so a host with a third of all pages costs one row for each of
its paths and tasks.

Never main text: nav, header (but that of an article), footer, aside, menu, and what is hidden. Forms, dialogs, some
roles and some class or id names set a container apart unless that holds an article or main and none stands outside, or
most of the text while there is no article or main elsewhere: a form around the page is no form. Reader comments go
whenever there is other text.

Defined cases: null and empty pages have no text; pages without a host (or a null address) vote together under the
empty name; tags, attributes and comments end as HTML says, but a quote without an end closes at the tag's end, and a tag
at the next "<"; repeated rows and ids stay apart; ties between paths go to more text, then to the deeper one; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import pieces, written

#: A tag's parts are never tried twice: a page is read in one walk. A quote counts only behind "=", where an attribute's value begins.
PIECE = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[A-Za-z][^\s/><]*+(?:[\s/]++|=?[^\s/>=<]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+|=)*+(?:>|(?=<)|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
ATTRIBUTE = re.compile(r"([^\s/>=<]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))?)?")
#: Fixed values of HTML: elements without content, with raw text, that part blocks, that hold blocks, that an open one of the same kind ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
RAW_ENDS = {tag: re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I) for tag in RAW}
#: Elements whose content is never text of the page; one without an end tag ends with its parent, svg and math also at a block.
UNREAD = frozenset("template noscript svg math iframe object select optgroup option button canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDER = frozenset("article aside body center dialog div details fieldset footer form header html main menu nav section table td".split())
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "select": ("select",), "button": ("button",)}
#: What is never main text: elements, elements unless they hold the page, roles, and words of class or id names, those of comments among them.
APART = frozenset("nav header footer aside menu head".split())
LOOSE = frozenset("form dialog".split())
COMMENTS = re.compile(r"comments?|disqus|replies|reply|respond", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
NAMES = re.compile(r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|post|entry|article|blog|content|user|wp|cookie|js|the)[_-])*(ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|footer|header|masthead|cookies?|consent|gdpr|notice\w*|alert\w*|popup|modal|newsletter|subscribe\w*|share|sharing|social|related|recommend\w*|comments?|disqus|replies|reply|respond|login|signup|search|toolbar|widgets?|pagination|pager|copyright|legal|skip)(?:[_-](?:container|wrapper|wrap|inner|outer|box|area|bar|banner|block|slot|unit|list|links?|buttons?|icons?|form|menu|nav|navigation|header|footer|sidebar|widgets?|thread|section|posts?|articles?|stories|items?|notice|message|overlay|popup|left|right|top|bottom|main|primary|secondary|\d+))*", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")


PRIME = (1 << 61) - 1


def bytes_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def number_of(data: bytes) -> int:
    """Bytes as a number modulo a prime, which grows by what is put behind them."""
    return int.from_bytes(data, "big") % PRIME


class Page:
    """A page's blocks and containers.

    ``blocks`` are ``(text, container, apart, share of text in links)``; a container is a number, its path the containers
    from the outermost to it. Equal paths are one container. Paths are kept as parents and names, so that a page costs
    its length however deep it is.
    """

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, bool, float]] = []
        self.parents: list[int] = [-1]  # container 0 is the page
        self.names: list[str] = [""]
        self.known: dict[tuple[int, str], int] = {}

    def inside(self, parent: int, name: str) -> int:
        """The container of a name in another."""
        own = self.known.get((parent, name))
        if own is None:
            own = self.known[parent, name] = len(self.names)
            self.parents.append(parent)
            self.names.append(name)
        return own

    def path(self, container: int) -> str:
        out = []
        while container:
            out.append(self.names[container])
            container = self.parents[container]
        return "".join(f"/{name}" for name in reversed(out))

    def hashes(self) -> list[int]:
        """A number for each container, that of its path."""
        out = [0]
        for parent, name in zip(self.parents[1:], self.names[1:], strict=True):
            more = bytes_of(f"/{name}")
            out.append((out[parent] * pow(256, len(more), PRIME) + number_of(more)) % PRIME)
        return out

    def scores(self) -> list[float]:
        """The main text that each container holds, outside links; the first is that of the page."""
        out = [0.0] * len(self.names)
        for text, container, apart, linked in self.blocks:
            if not apart:
                out[container] += len(text) * (1 - linked)
        for i in range(len(out) - 1, 0, -1):  # children have greater numbers
            out[self.parents[i]] += out[i]
        return out

    def innermost(self, scores: list[float]) -> int:
        """The innermost container that holds all main text; 0 if there is none. Those that do lie within each other."""
        full = [i for i, s in enumerate(scores) if s >= scores[0] - 1e-6] if scores[0] > 0 else []
        return max(full, default=0)


class Reader:
    """Reads a page by its tags. Counts of open elements stand for walks over the stack."""

    def __init__(self) -> None:
        self.page = Page()
        self.marks: list[int] = []  # of each block: the innermost element apart by its name alone; 0 if there is none
        self.outer: list[int] = [-1]  # of each mark: the one around it
        self.chat: list[bool] = [False]  # of each mark: whether it is comments, or within them
        self.content_in: list[int] = []  # of each article and main: the mark around it
        self.stack: list[tuple[str, int, bool, int]] = []  # element, container, apart, mark around its content
        self.places: dict[str, list[int]] = defaultdict(list)  # of each open element's name: its places in the stack
        self.holders: list[int] = []  # places of open elements that hold blocks
        self.n_apart = self.n_unread = 0
        self.buffer: list[str] = []
        self.linked = 0

    def close(self) -> None:
        """Ends a block."""
        text = SPACE.sub(" ", html.unescape("".join(self.buffer))).strip() if self.buffer else ""
        if text:
            container, mark = (self.stack[-1][1], self.stack[-1][3]) if self.stack else (0, 0)
            self.page.blocks.append((text, container, self.n_apart > 0, min(1.0, self.linked / len(text))))
            self.marks.append(mark)
        self.buffer.clear()
        self.linked = 0

    def drop(self, at: int) -> None:
        """Closes the open elements from a place on."""
        while len(self.stack) > at:
            tag, _, apart, _ = self.stack.pop()
            self.places[tag].pop()
            self.n_apart -= apart
            self.n_unread -= tag in UNREAD
            if tag in HOLDER:
                self.holders.pop()

    def last(self, tag: str) -> int:
        own = self.places.get(tag)
        return own[-1] if own else -1

    def said(self, piece: str) -> None:
        if self.n_unread:
            return
        self.buffer.append(piece)
        if self.places.get("a"):
            self.linked += len(piece)

    def ended(self, tag: str) -> None:
        at = self.last(tag)
        if at >= 0:
            self.drop(at)

    def begun(self, tag: str, attributes: str) -> None:
        for other in ENDS.get(tag, ()):
            at = self.last(other)
            if at >= 0:
                between = next((h for h in reversed(self.holders) if self.stack[h][0] != other), -1)
                if between < at:
                    self.drop(at)
        if tag in BLOCK and (drawn := [x[0] for x in (self.places.get("svg"), self.places.get("math")) if x]):
            if self.last("foreignobject") < min(drawn):
                self.drop(min(drawn))
        around = self.stack[-1] if self.stack else ("", 0, False, 0)
        container, apart, mark = around[1], tag in APART, around[3]
        if tag in HOLDER or tag in BLOCK:
            found = {k.lower(): a or b or c for k, a, b, c in reversed(ATTRIBUTE.findall(attributes))} if attributes else {}  # the first of a name counts
            headed = bool(self.places.get("article"))  # the header of an article is part of it
            names = f"{found.get('class', '')} {found.get('id', '')}".split() if found else []
            words = [m[1] for m in map(NAMES.fullmatch, names) if m and not (headed and m[1].lower() == "header")]
            chat = any(map(COMMENTS.fullmatch, words)) and tag not in ("main", "body", "html")
            apart = (apart and not (tag == "header" and headed)) or "hidden" in found or (found.get("aria-hidden") or "").lower() == "true" or bool(HIDDEN.search(found.get("style") or ""))
            marked = bool(words) or tag in LOOSE or (found.get("role") or "").lower() in ROLES
            if not apart and (chat or marked and tag not in ("article", "main", "body", "html")):
                self.outer.append(mark)
                self.chat.append(chat or self.chat[mark])
                mark = len(self.outer) - 1
            if tag in ("article", "main") and not self.chat[mark]:
                self.content_in.append(mark)
            if tag in HOLDER:
                container = self.page.inside(container, ".".join([tag, *sorted(set(DIGITS.sub("", found.get("class", "")).lower().split()))]) if found else tag)
        at = len(self.stack)
        self.stack.append((tag, container, apart, mark))
        self.places[tag].append(at)
        self.n_apart += apart
        self.n_unread += tag in UNREAD
        if tag in HOLDER:
            self.holders.append(at)

    def read(self, source: str) -> Page:
        at = 0
        while m := PIECE.match(source, at):
            at, piece = m.end(), m[0]
            if piece[0] != "<" or piece == "<":
                self.said(piece)
                continue
            named = NAME.match(piece)
            if not named:
                continue
            tag = named[1].lower()
            if tag in BLOCK:
                self.close()
            if piece[1] == "/":
                self.ended(tag)
            elif tag in RAW:
                if not piece.endswith("/>"):
                    end = RAW_ENDS[tag].search(source, at)
                    at = end.end() if end else len(source)
            elif tag not in VOID and not piece.endswith("/>"):
                self.begun(tag, piece[named.end() :])
        self.close()
        self.settle()
        return self.page

    def settle(self) -> None:
        """Sets blocks apart by their marks: those within a marked element, unless it holds an article or main while none
        stands outside marks, or most of the text while there is none at all; comments unless there is nothing else."""
        if not any(self.marks):
            return
        held, void = [0.0] * len(self.outer), [False] * len(self.outer)
        for (text, _, apart, share), mark in zip(self.page.blocks, self.marks, strict=True):
            held[mark] += 0.0 if apart or self.chat[mark] else len(text) * (1 - share)
        if all(self.content_in):
            for mark in self.content_in:
                void[mark] = True
        for i in range(len(held) - 1, 0, -1):  # inner ones have greater numbers
            held[self.outer[i]] += held[i]
            void[self.outer[i]] |= void[i]
        away = [False] * len(held)
        for i in range(1, len(held)):
            most = not self.content_in and 2 * held[i] > held[0]
            away[i] = away[self.outer[i]] or not (self.chat[i] or void[i] or most)
        blocks = list(zip(self.page.blocks, self.marks, strict=True))
        other = any(not (b[2] or away[mark] or self.chat[mark]) and b[3] < 1 for b, mark in blocks)
        self.page.blocks = [(text, c, apart or away[mark] or other and self.chat[mark], share) for (text, c, apart, share), mark in blocks]


def read_page(source: str | None) -> Page:
    return Reader().read(source or "")


class Extract(NamedTuple):
    """A page's main text by depth: the containers that hold all of it, outermost first, and of each block how many of them it lies in."""

    path: str | None
    chain: list[int]
    weight: float
    texts: list[str]
    depths: list[int]

    def text(self, depth: int) -> str:
        return "\n\n".join(t for t, d in zip(self.texts, self.depths, strict=True) if d >= depth)


def extract_of(page: Page) -> Extract:
    scores = page.scores()
    best, hashes = page.innermost(scores), page.hashes()
    chain = []
    at = best
    while at:
        chain.append(at)
        at = page.parents[at]
    chain.reverse()
    depth, place = [0] * len(page.names), {c: k + 1 for k, c in enumerate(chain)}
    for i in range(1, len(depth)):  # parents come first
        depth[i] = place.get(i, depth[page.parents[i]])
    kept = [(text, depth[c]) for text, c, apart, _ in page.blocks if not apart]
    return Extract(page.path(best) if best else None, [hashes[c] for c in chain], scores[0], [t for t, _ in kept], [d for _, d in kept])


def own_text(page: Page) -> str:
    """The text within the page's own path, without a host's votes."""
    found = extract_of(page)
    return found.text(len(found.chain))


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


READ = "path string, chain array<long>, weight double, texts array<string>, depths array<int>"


def read_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page_id, url, host, own`` (the number of the page's path) and what its walk found."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32()))
        for whole in batches:
            for b in pieces(whole, "__page"):
                found = [extract_of(read_page(source)) for source in b["__page"].to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], b["host"], *columns], names=["page_id", "url", "host", *Extract._fields])

    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("__page"))
    kind = dict(own.dtypes)
    return own.mapInArrow(read, f"page_id {kind['page_id']}, url {kind['url']}, host string, {READ}").withColumn("own", F.try_element_at("chain", F.lit(-1)))


def host_paths(read: DataFrame) -> DataFrame:
    """``host, own, path, depth``: for each path that pages of a host have, the one of its containers with the most votes there."""
    voted = read.where("own is not null").groupBy("host", "own").agg(F.count(F.lit(1)).alias("votes"), F.round(F.sum("weight"), 3).alias("weight"), F.min("path").alias("path"), F.first("chain").alias("chain"))
    votes = written(voted, "votes")
    around = votes.select("host", "own", F.posexplode("chain").alias("at", "number"))
    both = around.join(votes.select("host", F.col("own").alias("number"), "votes", "weight", "path"), ["host", "number"])
    best = F.max_by(F.struct("path", "at"), F.struct("votes", "weight", "at")).alias("best")
    return both.groupBy("host", "own").agg(best).select("host", "own", "best.path", (F.col("best.at") + 1).alias("depth"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_broadcast: int = 20_000) -> DataFrame:
    """``page_id, url, text, n_chars, path``: one row for each input row; ``path`` is the one it was extracted by."""
    read = written(read_pages(pages, id_col, url_col, html_col), "pages")
    paths = written(host_paths(read), "paths")
    few = paths.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("path") + F.length("host")).alias("size")).first()
    small = few["n"] <= max_broadcast and (few["size"] or 0) <= 4_000_000
    rows = read.drop("path", "chain", "weight").join(F.broadcast(paths) if small else paths, ["host", "own"], "left")
    blocks = F.filter(F.arrays_zip("texts", "depths"), lambda x: x["depths"] >= F.coalesce("depth", F.lit(0)))
    text = F.array_join(F.transform(blocks, lambda x: x["texts"]), "\n\n")
    return rows.select("page_id", "url", text.alias("text"), "path").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
