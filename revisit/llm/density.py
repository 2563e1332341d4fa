"""Main text of web pages by composite text density."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.llm.words import text_slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Never text of a page.
HIDDEN = frozenset("head title script style noscript template iframe svg canvas object audio video".split())
# Text, but not of the article.
ASIDES = frozenset("nav header footer aside menu button select textarea dialog fieldset".split())
CONTROLS = frozenset("button input select textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section"
    " summary table tbody tfoot thead tr ul caption".split()
)
LISTS = frozenset("div dl ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STRUCTURE = frozenset("article body center div main section td".split())
# Elements that a class or id may mark as not the article; headings, paragraphs and spans it cannot.
CONTAINERS = frozenset("center div dl ol section table td ul".split())
# Words of class and id that mark what is not the article, if all other words of the name only say
# where or what kind of box: "top-nav" does, "related-work" and "social-policy" do not.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs"
    " comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar"
    " navigation newsletter notice notices notification overlay pagination popup promo promoted"
    " promotion related reply replies share sharing sidebar signup social sponsor sponsored"
    " subscribe subscription toolbar widget".split()
)
# Of these, names that may also be around a whole page; the others never hold the article.
FRAME_WORDS = frozenset(
    "banner breadcrumb breadcrumbs footer masthead menu modal nav navbar navigation overlay pagination popup"
    " related share sharing sidebar social toolbar widget".split()
)
# Names that mark paragraphs and spans too.
AD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising promo promoted promotion sponsor sponsored".split()
)
PLACE_WORDS = frozenset(
    "area bar block bottom box col column container content global group head inner item items left list"
    " main outer page primary right row secondary section site slot sub top unit wrap wrapper".split()
)
ASIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split()
)
# A form or a box with a frame's name is the page itself if it holds this share of the text.
MOST = 0.8
CONTROL_CHARS = 40  # a form has that much text for each of its controls, or it is one to fill in
BARE_WORDS = 10  # of a block of bare text around the subtree
_ENDS_BEFORE = {
    "li": ("li", {"ul", "ol", "menu"}),
    "dt": ("dt dd", {"dl"}),
    "dd": ("dt dd", {"dl"}),
    "tr": ("tr td th", {"table"}),
    "td": ("td th", {"table", "tr"}),
    "th": ("td th", {"table", "tr"}),
    "option": ("option", {"select"}),
}
_P_SCOPE = frozenset("button caption html object table td template th".split())
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_OPEN_TAG_AT_END = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")


def _named_aside(name: str, words: frozenset = ASIDE_WORDS) -> bool:
    parts = {p.lower() for p in _NAME_PARTS.findall(name)}
    return not parts.isdisjoint(words) and parts <= words | PLACE_WORDS


def _aside_names(tag: str, attrs: list[tuple[str, str | None]]) -> list[str]:
    """Classes and ids that name something beside the article."""
    words = ASIDE_WORDS if tag in CONTAINERS else AD_WORDS if tag in ("p", "span") else frozenset()
    names = [w for name, value in attrs if value and name in ("class", "id") for w in value.split()]
    return [w for w in names if words and _named_aside(w, words)]


def _is_aside(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    if tag in ASIDES and not (tag == "header" and in_article):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if not value:
            continue
        if name == "role" and value.strip().lower() in ASIDE_ROLES:
            return True
        elif name in ("hidden", "aria-hidden") and value != "false":
            return True
    return False


class _Page(HTMLParser):
    """Nodes of a page in document order, and its text as (node, text), None at block borders."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent = ["html"], [0]
        self.aside, self.hidden, self.link = [False], [False], [False]
        self.frame = [False]  # forms and boxes that are aside unless they hold nearly all text
        self.controls = [0]
        self.tags, self.link_tags = [0], [0]
        self.text: list[tuple[int, str] | None] = []
        self.open = [0]
        self.in_article = [False]
        self.in_text = [False]  # of an article element
        self.doubtful = [False]  # sections of an article that are named like what is beside it
        self.times = Counter()  # of open tags

    def _close_to(self, depth: int) -> None:
        ended = [self.tag[node] for node in self.open[depth:]]
        if not BLOCKS.isdisjoint(ended):
            self.text.append(None)
        self.times.subtract(ended)
        del self.open[depth:]

    def _close(self, tags: str, stop: frozenset | set) -> None:
        if not any(self.times[tag] for tag in tags.split()):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in tags.split():
                self._close_to(depth)
                return
            if tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and self.times[tag]:
            return
        if tag in BLOCKS:
            self._close("p", _P_SCOPE)
            self.text.append(None)
        if tag in _ENDS_BEFORE:
            self._close(*_ENDS_BEFORE[tag])
        if tag in ("article", "main", "body"):  # never inside a menu or head that was left open
            for depth, node in enumerate(self.open):
                if depth and self.tag[node] in ("nav", "header", "head", "ul", "ol"):
                    self._close_to(depth)
                    break
        up = self.open[-1]
        self.tags[up] += 1
        self.controls[up] += tag in CONTROLS
        if tag in VOID:
            self.text.append((up, " "))
            return
        node = len(self.tag)
        in_article = self.in_article[up]
        self.in_article.append(in_article or tag in ("article", "main"))
        self.tag.append(tag)
        self.parent.append(up)
        self.hidden.append(self.hidden[up] or tag in HIDDEN)
        self.in_text.append(self.in_text[up] or tag == "article")
        names = _aside_names(tag, attrs)
        self.doubtful.append(bool(names) and tag == "section" and self.in_text[up])
        beside = bool(names) and not self.doubtful[node]
        frame = tag == "form" or (beside and all(_named_aside(w, FRAME_WORDS) for w in names))
        self.frame.append(frame)
        self.controls.append(0)
        self.aside.append(self.aside[up] or (beside and not frame) or _is_aside(tag, attrs, in_article))
        self.link.append(self.link[up] or tag == "a")
        self.tags.append(0)
        self.link_tags.append(0)
        if tag == "a":
            self.link_tags[up] += 1
        self.open.append(node)
        self.times[tag] += 1
        if tag in ("td", "th"):
            self.text.append((node, " "))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # "/" ends nothing but void tags

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or not self.times[tag]:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[depth]]
            if name == tag:
                self._close_to(depth)
                return
            if name in BLOCKS and tag not in BLOCKS:
                return  # an inline end tag closes no block

    def handle_data(self, data: str) -> None:
        if not self.hidden[self.open[-1]]:
            self.text.append((self.open[-1], data))


def _densities(page: _Page) -> tuple[list[float], list[float], list[int], list[int], list[int]]:
    """By node: composite density, sum of the children's, characters, those in links, links."""
    n = len(page.tag)
    chars, links = [0] * n, [0] * n
    tags, link_tags = page.tags[:], page.link_tags[:]
    for piece in page.text:
        if piece is not None and piece[1] != " ":
            node, text = piece
            size = sum(map(len, text.split()))
            chars[node] += size
            links[node] += size * page.link[node]
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        for column in (chars, links, tags, link_tags):
            column[up] += column[node]
    body = page.tag.index("body") if "body" in page.tag else 0
    ratio = links[body] / max(chars[body], 1)
    density, sums = [0.0] * n, [0.0] * n
    for node in range(n - 1, -1, -1):
        c, t, lc, lt = chars[node], max(tags[node], 1), links[node], max(link_tags[node], 1)
        if c:
            base = log(c / max(c - lc, 1) * lc + ratio * c + e)
            # Without a link on the page the base is 1: there is nothing to adjust for.
            scale = log(c / max(lc, 1) * t / lt) / log(base) if base > 1.0001 else 1.0
            density[node] = c / t * max(scale, 0.0)
        if node:
            sums[page.parent[node]] += density[node]
    return density, sums, chars, links, link_tags


def _asides(page: _Page, chars: list[int], links: list[int]) -> list[bool]:
    """By node, whether it is beside the article by element, role or name."""
    n = len(page.tag)
    if not any(page.frame):
        return page.aside
    text, controls = chars[:], page.controls[:]
    for i in range(n - 1, 0, -1):  # characters of the node alone, then of its subtree without asides
        text[page.parent[i]] -= chars[i]
    text = [0 if page.aside[i] else text[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        text[page.parent[i]] += text[i]
        controls[page.parent[i]] += controls[i]
    aside = page.aside[:]
    for i in range(1, n):
        around = text[i] >= MOST * text[0] and text[i] >= CONTROL_CHARS * controls[i] and 2 * links[i] < chars[i]
        aside[i] = aside[i] or aside[page.parent[i]] or (page.frame[i] and not around)
    return aside


def _title(page: _Page, root: int, usable: list[bool], chars: list[int], links: list[int]) -> set[int]:
    """The nodes of the heading that the subtree at ``root`` lacks: the last one before it.

    That is an h1, unless the subtree has its own or all of it is one link; else another heading that
    has no text between itself and the subtree.
    """
    n = len(page.tag)
    inside = [False] * n
    inside[root] = True
    for i in range(root + 1, n):
        inside[i] = inside[page.parent[i]]
    if any(inside[i] and page.tag[i] == "h1" and chars[i] for i in range(root, n)):
        return set()
    heads = [
        i for i in range(1, root) if page.tag[i] in HEADINGS and usable[i] and chars[i] and links[i] < chars[i]
    ]
    first = [i for i in heads if page.tag[i] == "h1"]
    if not first and heads:
        nodes = _subtree(page, heads[-1])
        place = [k for k, piece in enumerate(page.text) if piece and piece[0] in nodes]
        for piece in page.text[place[-1] + 1 :]:
            if piece is None or not piece[1].strip() or not usable[piece[0]]:
                continue
            if inside[piece[0]]:
                first = heads
            break
    return _subtree(page, first[-1]) if first else set()


def _subtree(page: _Page, top: int) -> set[int]:
    """Nodes are numbered as they begin, so a subtree has consecutive numbers."""
    nodes = {top}
    for i in range(top + 1, len(page.tag)):
        if page.parent[i] not in nodes:
            break
        nodes.add(i)
    return nodes


def _content(page: _Page) -> tuple[list[bool], list[int | None]]:
    """By node, whether its own text belongs to the article; and the path node that it is bare text of."""
    n = len(page.tag)
    density, sums, chars, links, link_tags = _densities(page)
    aside = _asides(page, chars, links)
    usable = [
        not (aside[i] or page.hidden[i] or (page.doubtful[i] and 2 * links[i] > chars[i])) for i in range(n)
    ]
    candidates = [i for i in range(n) if usable[i] and chars[i]]
    best = max(candidates, key=lambda i: (sums[i], density[i], -i), default=0)
    path = [best]
    while path[-1]:
        path.append(page.parent[path[-1]])
    # The subtree: of the outermost article or main element around it, else of the next structural one.
    marked = [i for i in path if page.tag[i] in ("article", "main")]
    root = marked[-1] if marked else next((i for i in path if page.tag[i] in STRUCTURE), 0)
    to_body = path[path.index(root) :]
    threshold = min((density[i] for i in to_body if page.tag[i] != "html"), default=0.0)
    above = set(to_body[1:])
    title = _title(page, root, usable, chars, links)
    keep = [False] * n
    in_header = [False] * n
    bare: list[int | None] = [0 if 0 in above else None] + [None] * (n - 1)
    keep[root] = True
    for i in range(1, n):
        up = page.parent[i]
        in_header[i] = (page.tag[i] == "header" or in_header[up]) and page.tag[i] not in HEADINGS
        if i in above:
            bare[i] = i
        elif i != root and page.tag[i] not in BLOCKS and usable[i]:
            bare[i] = bare[up]
        if i == root:
            continue
        if up in above:
            # Beside the path to the body: what is as dense as the path and mostly not links.
            dense = density[i] >= threshold and 2 * links[i] < chars[i]
            keep[i] = usable[i] and dense and i not in above
            continue
        if page.in_article[i]:
            # Only what can but be a menu: short labels, all of them links.
            menu = page.tag[i] == "ul" and link_tags[i] >= 3 and links[i] == chars[i] < 8 * link_tags[i]
        else:
            menu = page.tag[i] in LISTS and link_tags[i] >= 3 and 10 * links[i] >= 6 * chars[i]
        keep[i] = keep[up] and usable[i] and not menu
    kept = [i in title or (k and not h) for i, (k, h) in enumerate(zip(keep, in_header))]
    return kept, bare


def _bare_text(page: _Page, block: list[tuple[int, str]], bare: list[int | None]) -> bool:
    """Whether a block is long text, not mostly links, that lies in an element around the subtree itself."""
    hosts = {bare[node] for node, text in block if text.strip()}
    if len(hosts) != 1 or None in hosts:
        return False
    linked = sum(len(text) for node, text in block if page.link[node])
    text = "".join(text for _, text in block)
    return len(text.split()) >= BARE_WORDS and 2 * linked < len(text)


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in order, joined by an empty line.

    Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
    comments are left out by element, role, class or id; a form or a box with such a name that is
    around nearly all of the page's text is the page. Of the rest, the subtree with the largest sum
    of its children's densities is taken, with what beside its path to the body is as dense, long
    bare text of the elements on that path, and the heading before it if it has none.
    Null and pages without text give an empty text; unclosed and cut-off tags are tolerated.
    """
    if not html:
        return ""
    page = _Page()
    page.feed(_OPEN_TAG_AT_END.sub("", html))
    page.close()
    keep, bare = _content(page)
    blocks: list[str] = []
    now: list[tuple[int, str]] = []
    for piece in [*page.text, None]:
        if piece is not None:
            now.append(piece)
            continue
        whole = _bare_text(page, now, bare)
        block = " ".join("".join(text for node, text in now if whole or keep[node]).split())
        if block:
            blocks.append(block)
        now = []
    return "\n\n".join(blocks)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, text, n_chars): one row per row of ``pages``.

    Null and empty pages have an empty text; repeated rows and null keys are rows like any other;
    columns that are not named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, html):
            texts = [main_text(h) for h in part.column(part.num_columns - 1).to_pylist()]
            made = pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*names, "text", "n_chars"])

    names = [key, *carry]
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names]
    rows = pages.select(*names, F.col(html).cast("string"))
    return rows.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars bigint"]))
