"""Main text of web pages by composite text density.

Every element gets its link-adjusted characters per tag (composite text density) and the sum of
its children's densities.  The subtree with the largest sum is content; the smallest density on
its path to the body is the threshold from which other subtrees count as content too, within the
nearest ancestor that adds a tenth of text or the page's heading.

Density is blind to what a dense text is for.  So elements that are named as something else (tags
such as nav and footer, roles, words of classes and ids) take no part, but only where the text
agrees: an element that holds the article, the heading or most of the text that is left is content
whatever it is called.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, slices, tidy

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
_NEVER = frozenset("script style noscript template head title iframe object svg canvas math audio video select option textarea button datalist".split())
_STRUCTURE = frozenset("nav footer aside form menu dialog search".split())
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar toolbar comment comments commentlist disqus respond social share sharing related recommended newsletter subscribe signup login widget pagination pager skip".split()
)
#: Parts of a class that leave its meaning as it is ("comment-list").
_PLAIN = frozenset("list box area section wrapper wrap container bar block item items inner outer top bottom left right group panel row text link links".split())
_STRONG, _NO, _HEADER, _WEAK = 1, 2, 3, 4
#: An element with a telling name is content after all if it holds most of the text, and so many times what lies outside such elements.
_SPARED = {_STRONG: 20, _WEAK: 1, _HEADER: 4}
#: Share of an ancestor's text outside the best subtree from which content may lie there too.
_MORE = 0.1
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_TOKENS = re.compile(r"[^a-z0-9]+")


class _Tree(HTMLParser):
    """Elements in page order, with their own characters; texts and block borders as they come."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.chars, self.mark = ["html"], [-1], [0], [0]
        self.open = [0]
        #: Depths of the open elements of each tag, so that the nearest one is found at once.
        self.depths: dict[str, list[int]] = {}
        self.stream: list[tuple[int, str | None]] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections are comments up to the next >, as in browsers."""
        return self.rawdata.find(">", i) + 1 or -1

    def _close_to(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.depths[self.tag[node]].pop()
            if self.tag[node] in _BLOCK:
                self.stream.append((node, None))
        del self.open[depth:]

    def _nearest(self, names: Iterable[str]) -> int:
        return max((self.depths[t][-1] for t in names if self.depths.get(t)), default=0)

    def _inside(self, names: Iterable[str], stop: Iterable[str] = ()) -> int:
        """Depth of the nearest open element of those names, 0 if none is nearer than ``stop``."""
        at = self._nearest(names)
        return at if at and at > self._nearest(stop) else 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body") and self._inside((tag,)):
            return
        if tag in _BLOCK and (at := self._inside(("p",), ("table", "button", "object"))):
            self._close_to(at)
        if tag in _CLOSES:
            names, stop = _CLOSES[tag]
            while at := self._inside(names, stop):
                self._close_to(at)
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.chars.append(0)
        self.mark.append(_mark(tag, attrs))
        if tag in _BLOCK:
            self.stream.append((node, None))
        elif tag in ("br", "td", "th"):
            self.stream.append((node, " "))
        if tag not in _VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style"):
            self.clear_cdata_mode()
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in ("html", "body") and (at := self._inside((tag,))):
            self._close_to(at)

    def handle_data(self, data: str) -> None:
        node = self.open[-1]
        self.stream.append((node, data))
        self.chars[node] += sum(map(len, data.split()))


def _mark(tag: str, attrs: list) -> int:
    """What an element's name says: never content, a header, something else for sure or perhaps; 0: nothing."""
    if tag in _NEVER:
        return _NO
    if tag == "header":
        return _HEADER
    if tag in _STRUCTURE:
        return _STRONG
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0
    found = 0
    for name, value in attrs:
        if name == "hidden" or name == "role" and value in _ROLES:
            return _STRONG
        if name in ("class", "id") and value:
            for one in value.lower().split():
                parts = set(_TOKENS.split(one)) - {""}
                if parts & _WORDS:
                    if parts <= _WORDS | _PLAIN:
                        return _STRONG
                    found = _WEAK
    return found


def _density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite text density: characters per tag, lowered where they are links."""
    if not chars:
        return 0.0
    tags, link_chars, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = log(chars / max(chars - link_chars, 1) * link_chars + ratio * chars + e)
    x = chars / link_chars * tags / link_tags
    return chars / tags * (log(max(x, 1.0)) / log(base) if base > 1 else 0.0)


def _gone(tree: _Tree) -> tuple[list[bool], list[bool]]:
    """Elements that take no part; elements in a header that takes none, by its being one alone."""
    tag, parent, n = tree.tag, tree.parent, len(tree.tag)
    holds, holds_h1, text = [False] * n, [False] * n, [0] * n
    link, under = [False] * n, [False] * n
    for k in range(1, n):
        p = parent[k]
        link[k] = link[p] or tag[k] == "a" or tree.mark[k] == _NO
        under[k] = under[p] or tree.mark[k] > 0
    for k in range(n - 1, 0, -1):
        p = parent[k]
        text[k] += 0 if link[k] else tree.chars[k]
        text[p] += text[k]
        holds[p] = holds[p] or holds[k] or tag[k] in ("article", "main")
        holds_h1[p] = holds_h1[p] or holds_h1[k] or tag[k] == "h1"
    rest = sum(tree.chars[k] for k in range(n) if not under[k] and not link[k])
    gone, header, article = [False] * n, [False] * n, [False] * n
    spared = lambda k: text[k] > _SPARED[tree.mark[k]] * rest and 2 * text[k] > text[0]
    rest += max((text[k] for k in range(1, n) if tree.mark[k] == _WEAK and spared(k)), default=0)
    weak = {k for k in range(1, n) if tree.mark[k] == _WEAK and 2 * text[k] > rest and 2 * text[k] > text[0]}
    for k in range(1, n):
        p, mark = parent[k], tree.mark[k]
        article[k] = article[p] or tag[k] in ("article", "main")
        header[k] = header[p]
        if gone[p] or mark == _NO:
            gone[k] = True
        elif mark and not holds[k] and k not in weak and not (mark != _WEAK and spared(k)) and not (mark == _HEADER and article[p] and 2 * text[k] > text[p]):
            if mark == _HEADER:
                header[k] = True
            else:
                gone[k] = article[k] or not holds_h1[k] or tag[k] in ("nav", "footer", "aside")
    return gone, header


def extract(page: str) -> str:
    """Blocks of the page's main text, in page order, two line feeds between them."""
    tree = _Tree()
    try:
        tree.feed(page)
        tree.close()
    except AssertionError:  # the parser gives up on some malformed declarations; what came before stands
        pass
    tag, parent, n = tree.tag, tree.parent, len(tree.tag)
    dropped, header = _gone(tree)
    gone = [a or b for a, b in zip(dropped, header, strict=True)]

    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    blocks_in, h1 = [False] * n, [0] * n
    for k in range(n - 1, -1, -1):
        if gone[k]:
            continue
        chars[k] += tree.chars[k]
        if tag[k] == "a":
            link_chars[k] = chars[k]
        if k:
            p, link = parent[k], tag[k] == "a"
            chars[p] += chars[k]
            tags[p] += tags[k] + 1
            link_chars[p] += link_chars[k]
            link_tags[p] += link_tags[k] + link
            blocks_in[p] = blocks_in[p] or blocks_in[k] or tag[k] in _BLOCK and chars[k] > 0
            h1[p] += h1[k] + (tag[k] == "h1")
    if not chars[0]:
        return ""
    ratio = link_chars[0] / chars[0]
    density = [0.0 if gone[k] else _density(chars[k], tags[k], link_chars[k], link_tags[k], ratio) for k in range(n)]
    # Text outside any block of its own (bare in the body, say) counts as one more child; a block without blocks is a leaf.
    total = [_density(c, 1, 0, 0, ratio) if c and not g else 0.0 for c, g in zip(tree.chars, gone, strict=True)]
    for k in range(n - 1, 0, -1):
        total[parent[k]] += density[k]
    total = [t if b else d for t, d, b in zip(total, density, blocks_in, strict=True)]

    best = max((k for k in range(n) if chars[k] and (tag[k] in _BLOCK or not k)), key=lambda k: (total[k], -k))
    path = [best]
    while path[-1]:
        path.append(parent[path[-1]])
    threshold = min(density[k] for k in path)
    # The ancestors that add text to what lies on the path below them; the highest is where content may be.
    text = lambda k: chars[k] - link_chars[k]
    root = best
    for below, k in zip(path[:-1], path[1:], strict=True):
        if text(k) - text(below) >= _MORE * text(k) or h1[k] > h1[below] + (tag[below] == "h1") and tag[k] not in ("body", "html"):
            root = k
    on_path = set(path[: path.index(root) + 1])

    # A header is the page's, not the article's, if the whole body is content, or if it is made of links.
    heads = lambda k: tag[root] not in ("body", "html") and not _linked(k, tree)
    inside, whole, near = [False] * n, [False] * n, [False] * n
    for k in range(n):
        p = parent[k]
        if k in on_path and k != best:
            inside[k] = near[k] = True
        elif k == best or whole[p] and not (header[k] and not header[p] and not heads(k)):
            inside[k] = whole[k] = True
        elif k and near[p] and not whole[p]:
            near[k] = True
            named = p in on_path and (tag[k] not in _BLOCK or len(tag[k]) == 2 and tag[k][0] == "h" or header[k] and heads(k))
            inside[k] = whole[k] = named or tag[k] in _BLOCK and not gone[k] and density[k] >= threshold
    gone = dropped

    blocks: list[str] = []
    now: list[str] = []
    for node, data in tree.stream:
        if data is None:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        elif inside[node] and not gone[node]:
            now.append(data)
    blocks.append(" ".join("".join(now).split()))
    return "\n\n".join(filter(None, blocks))


def _linked(k: int, tree: _Tree) -> bool:
    """Whether most of an element's text is links."""
    end, links, every = {k}, {k} if tree.tag[k] == "a" else set(), [0, 0]
    for x in range(k, len(tree.tag)):
        p = tree.parent[x]
        if x != k and p not in end:
            break
        end.add(x)
        if tree.tag[x] == "a" or p in links:
            links.add(x)
        every[x in links] += tree.chars[x]
    return every[1] > every[0]


def main_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` (code points) for each row of ``pages``.

    A null or empty page, or one without content, has an empty text.  Repeated rows and null ids
    give rows alike; an empty table gives none; other columns are not looked at.  Bytes that are
    no UTF-8 are read as U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2):
                texts = [extract(x.decode(errors="replace")) if x else "" for x in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body(html)).mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
