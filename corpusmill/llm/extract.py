"""Main text of web pages by tag-path ratios.

1. A tolerant reader turns a page into blocks: text between the borders of block elements, with its root-to-leaf tag path
   (element names with their classes, digits left out; inline elements are no part of a path) and what of it is links.
   Omitted and crossed end tags are mended, raw elements and comments skipped, character references decoded.
2. Elements that are no article by name, role or class (menus, headers and footers of the page, sidebars, notices, adverts,
   forms, comments, hidden ones) are set aside; one that holds the title or article and most of the page's text is not,
   such as a form around a whole page.
3. Per tag path: text outside links a block (text ratio) and punctuation a block.  Both are smoothed over the blocks in page
   order, Gaussian weights times how much of the two paths is the same, and averaged again by path.
4. The two are fused, ``text * (1 + punctuation)``; paths reach the threshold (the standard deviation over blocks, a share
   of the greatest at most) or not.
5. Where the blocks of these paths lie in the page's articles (or else its main element, or else the deepest element that
   holds most of them), all blocks there are content, but for paths that are links nearly throughout and, without an
   article, paths far below the threshold.

Text: blocks in page order, white space of a block to one space each, joined by one space.  A row is a page: nothing is
shuffled and equal pages have equal texts.  Null and empty pages, and pages without text, give the empty text; a page of
text alone is one block.  A page must fit in a worker.  An empty table gives no rows.  The columns named by ``keep`` and
``html`` alone are read; the new columns get underscores where a kept one has their name.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .kernels import lean
from .shared import fresh

# Names of HTML elements.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table ul".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: An opening element ends these, unless one of the others stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# Elements, roles and words of class and id that are no article.
ASIDE = frozenset("aside button canvas datalist dialog footer form map menu nav object select svg template".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOTED = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentary commentlist "
    "consent cookie cookies copyright discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification outbrain pager pagination paywall popup promo promoted promotion recommended recommendations related replies reply respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_END = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[.,;:!?¡¿…。，、；：！？]")

RADIUS, SIGMA = 2, 1.0
SHARE_OF_GREATEST, FAR_BELOW = 0.3, 1 / 8
ARTICLE_SHARE, ROOT_SHARE, MOST, LINKS_THROUGHOUT = 0.2, 0.8, 0.5, 0.9
ROWS_BYTES = 8 << 20


class Block(NamedTuple):
    node: int
    path: int
    text: str
    links: int  # code points in links


class Page:
    """Elements that shape paths, in page order, and the blocks of text."""

    def __init__(self, source: str):
        self.name, self.parent, self.path_of, self.noted, self.titled = ["#page"], [-1], [0], [False], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.path_label, self.path_parent, self.path_depth = [""], [-1], [0]
        self._stack: list[tuple[str, int]] = [("#page", 0)]
        self._open: Counter[str] = Counter()
        self._link = 0  # height of the stack where a link is open
        self._pieces: list[tuple[int, str, bool]] = []
        self._found: list[tuple[int, list[tuple[int, str, bool]]]] = []
        self._read(source)
        self._border()

    # -- reading

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            start = s.find("<", at)
            if start < 0:
                self._text(s[at:])
                return
            if start > at:
                self._text(s[at:start])
            follows = s[start + 1 : start + 2]
            if follows.isalpha() and follows.isascii():
                tag = _TAG.match(s, start)
                if tag is None:  # an open quote
                    close = s.find(">", start)
                    if close < 0:
                        return
                    name, attributes, at = re.match(r"[^\s/>]*", s[start + 1 : close])[0], "", close + 1
                else:
                    name, attributes, at = tag[1], tag[2], tag.end()
                name = name.lower()
                self._start(name, attributes)
                if name in RAW:
                    end = _RAW_END[name].search(s, at)
                    at = end.end() if end else n
                    self._end(name)
                elif name == "plaintext":
                    return
            elif follows == "/":
                end = _END.match(s, start)
                if end is not None:
                    self._end(end[1].lower())
                    at = end.end()
                else:  # a comment of a kind
                    close = s.find(">", start)
                    at = close + 1 if close >= 0 else n
            elif s.startswith("<!--", start):
                if s.startswith((">", "->"), start + 4):
                    at = s.index(">", start) + 1
                else:
                    close = re.compile(r"--!?>").search(s, start + 4)
                    at = close.end() if close else n
            elif follows in ("!", "?"):
                close = s.find(">", start)
                at = close + 1 if close >= 0 else n
            else:
                self._text("<")
                at = start + 1

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self._pieces.append((self._stack[-1][1], text, self._link > 0))

    def _border(self) -> None:
        if self._pieces:
            if any(not t.isspace() for _, t, _ in self._pieces):
                self._found.append((self._block_node(), self._pieces))
            self._pieces = []

    def _block_node(self) -> int:
        node = self._pieces[0][0]
        while self.name[node] in INLINE:
            node = self.parent[node]
        return node

    def _pop(self, height: int) -> None:
        for name, _ in self._stack[height:]:
            self._open[name] -= 1
        if any(name not in INLINE for name, _ in self._stack[height:]):
            self._border()
        del self._stack[height:]
        if self._link > height:
            self._link = 0

    def _close_one(self, names: set[str], barrier: set[str]) -> None:
        """Close the outermost of ``names`` that is open above the last of ``barrier``."""
        left, height = sum(self._open[n] for n in names), len(self._stack)
        for i in range(len(self._stack) - 1, 0, -1):
            name = self._stack[i][0]
            if not left or name in barrier:
                break
            if name in names:
                left, height = left - 1, i
        if height < len(self._stack):
            self._pop(height)

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._pieces.append((self._stack[-1][1], " ", self._link > 0))
            return
        if name in ("html", "body") and self._open["body"]:
            return
        if self._open["head"] and name not in IN_HEAD:
            self._close_one({"head"}, set())
        if name in CLOSES_P:
            self._close_one({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if name in IMPLIED:
            self._close_one(*IMPLIED[name])
        if name == "a" and self._link:
            self._end("a")
        inline = name in INLINE
        if not inline:
            self._border()
        if name in VOID:
            return
        classes, noted = self._marks(name, attributes) if attributes or name in ASIDE or name == "header" else ("", False)
        node = self._stack[-1][1]
        if not inline or noted:
            node = self._node(name, classes, noted, inline)
        self._stack.append((name, node))
        self._open[name] += 1
        if name == "a":
            self._link = len(self._stack)

    def _marks(self, name: str, attributes: str) -> tuple[str, bool]:
        """The class as a part of the path, and whether the element is no article."""
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        role = found.get("role", "").lower()
        noted = name in ASIDE or role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", "")))
        noted |= name == "header" and not (self._open["article"] or self._open["main"])
        if name not in ("html", "body", "main"):
            noted |= any(w.lower() in NOTED for w in _WORDS.findall(found.get("class", "") + " " + found.get("id", "")))
        main = role == "main" or found.get("itemprop") == "articleBody"
        return re.sub(r"\d+", "", found.get("class", "")) + ("@main" if main else ""), noted

    def _node(self, name: str, classes: str, noted: bool, inline: bool) -> int:
        parent, node = self._stack[-1][1], len(self.name)
        self.name.append("main" if classes.endswith("@main") else name)
        self.parent.append(parent)
        self.noted.append(noted)
        self.titled.append(False)
        above = self.path_of[parent]
        if inline:
            self.path_of.append(above)
            return node
        label = f"{name}.{'.'.join(sorted(classes.removesuffix('@main').split()))}" if classes else name
        path = self.paths.setdefault((above, label), len(self.path_label))
        if path == len(self.path_label):
            self.path_label.append(label)
            self.path_parent.append(above)
            self.path_depth.append(self.path_depth[above] + 1)
        self.path_of.append(path)
        if self.name[node] in ("h1", "article", "main") and not noted:
            while parent > 0 and not self.titled[parent]:
                self.titled[parent] = True
                parent = self.parent[parent]
        return node

    def _end(self, name: str) -> None:
        if name == "br":
            self._start("br", "")
        if not self._open[name] or name in ("html", "body"):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == name:
                self._pop(i)
                return
            if name in INLINE and self._stack[i][0] not in INLINE:
                return  # an inline end tag closes no block

    # -- choosing

    def blocks(self) -> list[Block]:
        """The blocks that are not set aside."""
        n = len(self.name)
        size = [0] * n
        for _, pieces in self._found:
            for node, text, _ in pieces:
                size[node] += len(text)
        for node in range(n - 1, 0, -1):
            size[self.parent[node]] += size[node]
        out, gone = [], [False] * n
        for node in range(1, n):
            spared = self.titled[node] and size[node] > MOST * size[0]
            gone[node] = gone[self.parent[node]] or self.name[node] == "head" or self.noted[node] and not spared
        for node, pieces in self._found:
            kept = [(t, link) for at, t, link in pieces if not gone[at]]
            text = " ".join("".join(t for t, _ in kept).split())
            if text:
                links = " ".join("".join(t for t, link in kept if link).split())
                out.append(Block(node, self.path_of[node], text, len(links)))
        return out

    def alike(self, a: int, b: int) -> float:
        """How much of two paths is the same from the root on."""
        longest = max(self.path_depth[a], self.path_depth[b])
        while self.path_depth[a] > self.path_depth[b]:
            a = self.path_parent[a]
        while self.path_depth[b] > self.path_depth[a]:
            b = self.path_parent[b]
        while a != b:
            a, b = self.path_parent[a], self.path_parent[b]
        return (self.path_depth[a] + 1) / (longest + 1)

    def inside(self, node: int, name: str) -> bool:
        while node > 0 and self.name[node] != name:
            node = self.parent[node]
        return node > 0


def path_scores(page: Page, blocks: list[Block]) -> dict[int, tuple[float, float]]:
    """Of each path, the smoothed and fused ratio, and the share of its text that is links."""
    count: Counter[int] = Counter(b.path for b in blocks)
    chars, marks, links, whole = Counter(), Counter(), Counter(), Counter()
    for b in blocks:
        own = max(0, len(b.text) - b.links)
        chars[b.path] += own
        marks[b.path] += len(PUNCTUATION.findall(b.text)) if own else 0
        links[b.path] += b.links
        whole[b.path] += len(b.text)
    like: dict[tuple[int, int], float] = {}
    text, point = Counter(), Counter()
    for i, b in enumerate(blocks):
        total = t = p = 0.0
        for j in range(max(0, i - RADIUS), min(len(blocks), i + RADIUS + 1)):
            other = blocks[j].path
            if (b.path, other) not in like:
                like[b.path, other] = page.alike(b.path, other)
            weight = math.exp(-((i - j) ** 2) / (2 * SIGMA * SIGMA)) * like[b.path, other]
            total += weight
            t += weight * chars[other] / count[other]
            p += weight * marks[other] / count[other]
        text[b.path] += t / total / count[b.path]
        point[b.path] += p / total / count[b.path]
    return {path: (text[path] * (1 + point[path]), links[path] / whole[path]) for path in count}


def chosen(page: Page, blocks: list[Block]) -> list[Block]:
    """The blocks that are the page's main text."""
    if not blocks:
        return []
    scores = path_scores(page, blocks)
    each = [scores[b.path][0] for b in blocks]
    mean = sum(each) / len(each)
    limit = min(math.sqrt(sum((x - mean) ** 2 for x in each) / len(each)), SHARE_OF_GREATEST * max(each))
    seeds = [b for b in blocks if scores[b.path][0] >= limit]
    weight = sum(len(b.text) for b in seeds)

    def worth(b: Block) -> bool:
        return scores[b.path][1] < LINKS_THROUGHOUT or page.name[b.node] in HEADINGS or page.name[b.node] == "p"

    for region in ("article", "main"):
        within = {b.node for b in blocks if page.inside(b.node, region)}
        if within and sum(len(b.text) for b in seeds if b.node in within) >= ARTICLE_SHARE * weight:
            return [b for b in blocks if b.node in within and worth(b)]
    held: Counter[int] = Counter()
    for b in seeds:
        node = b.node
        while node >= 0:
            held[node] += len(b.text)
            node = page.parent[node]
    root = max(node for node, size in held.items() if size >= ROOT_SHARE * weight)  # elements are numbered parents first

    def under(node: int) -> bool:
        while node > root:
            node = page.parent[node]
        return node == root

    return [b for b in blocks if under(b.node) and worth(b) and scores[b.path][0] >= FAR_BELOW * limit]


def main_text_of(source: str | None) -> str:
    page = Page(source or "")
    return " ".join(b.text for b in chosen(page, page.blocks()))


def _rowwise(make: Callable[[str | None], dict[str, object]], types: dict[str, pa.DataType], names: list[str], out: list[str]):
    """Rows with the kept columns and what ``make`` gives of the last one, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            since, weight, rows = 0, 0, []
            for i in range(len(batch)):
                source = batch.column(len(names))[i].as_py()
                rows.append(make(source))
                weight += len(source or "")
                if weight > ROWS_BYTES or i == len(batch) - 1:
                    kept = [batch.column(k).slice(since, i + 1 - since) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*kept, *[pa.array([r[c] for r in rows], t) for c, t in types.items()]], [*names, *out])
                    since, weight, rows = i + 1, 0, []

    return lean(run)


def _apply(pages: DataFrame, make, types: dict[str, pa.DataType], ddl: dict[str, str], keep: tuple[str, ...], html: str) -> DataFrame:
    out = []
    for c in types:
        out.append(fresh(c, [*keep, *out]))
    kept = pages.select(*keep)
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(", ".join(f"`{n}` {ddl[c]}" for n, c in zip(out, types))).fields])
    source = pages.select(*keep, F.col(html).alias(fresh("source", list(keep))))
    return source.mapInArrow(_rowwise(make, types, list(keep), out), schema)


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The kept columns and text."""
    return _apply(pages, lambda s: {"text": main_text_of(s)}, {"text": pa.string()}, {"text": "string"}, keep, html)


def path_ratios(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), html: str = "html") -> DataFrame:
    """The kept columns and paths: of each tag path its blocks, fused ratio, share of links, and how many of its blocks are
    content."""

    def make(source: str | None) -> dict[str, object]:
        page = Page(source or "")
        blocks = page.blocks()
        count, kept = Counter(b.path for b in blocks), Counter(b.path for b in chosen(page, blocks))
        out = []
        for path, (score, links) in path_scores(page, blocks).items():
            labels, at = [], path
            while at > 0:
                labels.append(page.path_label[at])
                at = page.path_parent[at]
            out.append({"path": "/".join(reversed(labels)), "blocks": count[path], "score": score, "links": links, "content": kept[path]})
        return {"paths": out}

    one = pa.struct([("path", pa.string()), ("blocks", pa.int64()), ("score", pa.float64()), ("links", pa.float64()), ("content", pa.int64())])
    return _apply(pages, make, {"paths": pa.list_(one)}, {"paths": "array<struct<path:string,blocks:long,score:double,links:double,content:long>>"}, keep, html)


def extract_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
