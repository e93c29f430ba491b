"""HTML trees as rows, and Markdown sections, tables and citations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements without an end tag, and those whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = ("script", "style")
NODE = "page_id long, node_id int, last_id int, parent_id int, depth int, tag string, elem_id string, classes array<string>, attrs map<string,string>, text string"


class _Rows(HTMLParser):
    """Elements in preorder; an element's descendants are the numbers after its own up to its last."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        parent = self.open[-1] if self.open else None
        depth = self.rows[parent][3] + 1 if parent is not None else 0
        own = {k: v or "" for k, v in attrs}
        self.rows.append([len(self.rows), len(self.rows), parent, depth, tag, own.get("id"), own.get("class", "").split(), own, []])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]][4] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.rows[self.open[-1]][8].append(data)


def tree_rows(html: str | None) -> list[list]:
    parser = _Rows()
    parser.feed(html or "")
    parser.close()
    for row in reversed(parser.rows):  # parents come before their children
        if row[2] is not None:
            up = parser.rows[row[2]]
            up[1] = max(up[1], row[1])
    return [[*r[:8], " ".join("".join(r[8]).split())] for r in parser.rows]


def html_nodes(pages: DataFrame) -> DataFrame:
    """A row for each element of each page, numbered in preorder, with the number of its last descendant: 'inside' is a
    test of intervals, whatever the depth."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [[p, *r] for p, h in zip(part["page_id"], part["html"]) for r in tree_rows(h)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])
            out["parent_id"] = out["parent_id"].astype("Int32")
            yield out

    return pages.select("page_id", "html").mapInPandas(run, NODE)


def _by_page(nodes: DataFrame) -> DataFrame:
    """The side of a join that both sides are sorted for.  Elements lie packed in files that are far smaller than their
    rows; by the files' size Spark takes millions of them for few and sends them through the driver."""
    return nodes.hint("merge")


def inside(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Nodes of a page that stand inside one of the given nodes.

    One pass over each page in preorder: intervals nest or lie apart, so a node is inside one of the given nodes before it
    if the greatest of their last numbers is not below its own.  Neither depth nor nesting makes it dearer."""
    tops = ancestors.select("page_id", "node_id", F.col("last_id").alias("top_"), F.lit(True).alias("is_top_"))
    both = nodes.withColumn("is_top_", F.lit(False)).unionByName(tops, allowMissingColumns=True)
    before = Window.partitionBy("page_id").orderBy("node_id", "is_top_").rowsBetween(Window.unboundedPreceding, -1)
    marked = both.withColumn("reach_", F.max("top_").over(before))
    return marked.where(~F.col("is_top_") & (F.col("reach_") >= F.col("node_id"))).select(*nodes.columns)


def holders(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """page_id, node_id, holder: of each inner node that stands in one of the outer nodes (of which none holds another) the
    number of that one, by the same pass."""
    both = outer.select("page_id", "node_id", F.struct("node_id", "last_id").alias("o"), F.lit(False).alias("asks"))
    both = both.unionByName(inner.select("page_id", "node_id", F.lit(True).alias("asks")), allowMissingColumns=True)
    upto = Window.partitionBy("page_id").orderBy("node_id", F.desc("asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("o", F.last("o", ignorenulls=True).over(upto))
    return both.where(F.col("asks") & (F.col("o.node_id") < F.col("node_id")) & (F.col("o.last_id") >= F.col("node_id"))).select("page_id", "node_id", F.col("o.node_id").alias("holder"))


def text_of(nodes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """page_id, node_id and all text shown inside each node (or each of ``asked``) that has any, in document order; scripts
    and styles are not shown.

    A page's text is put together once; what a node holds is the stretch of it from the node's own number to its last."""
    shown = F.when((F.col("text") != "") & ~F.col("tag").isin(*HIDDEN), F.col("text"))
    size = F.coalesce(F.length(shown) + 1, F.lit(0))
    upto = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = nodes.select("page_id", "node_id", "last_id", size.alias("size"), F.sum(size).over(upto).alias("end"))
    page = nodes.where(shown.isNotNull()).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), " ").alias("all"))
    starts = places.select("page_id", "node_id", "last_id", (F.col("end") - F.col("size")).alias("begin"))
    if asked is not None:
        starts = starts.join(_by_page(asked.select("page_id", "node_id")), ["page_id", "node_id"], "left_semi")
    whole = starts.join(_by_page(places.select("page_id", F.col("node_id").alias("last_id"), "end")), ["page_id", "last_id"]).where(F.col("end") > F.col("begin"))
    return whole.join(_by_page(page), "page_id").select("page_id", "node_id", F.substr("all", F.col("begin").cast("int") + 1, (F.col("end") - F.col("begin") - 1).cast("int")).alias("whole"))


def step(nodes: DataFrame, simple: str) -> DataFrame:
    """Nodes of a simple selector: tag, #id and .class in one word, * for any."""
    tag, marks = re.match(r"[^#.]*", simple)[0], re.findall(r"([#.])([^#.]+)", simple)
    if tag not in ("", "*"):
        nodes = nodes.where(F.col("tag") == tag)
    for kind, name in marks:
        nodes = nodes.where(F.col("elem_id") == name) if kind == "#" else with_class(nodes, name)
    return nodes


def select(nodes: DataFrame, chain: str) -> DataFrame:
    """Nodes of a chain of simple selectors: 'a b' for b inside a, 'a > b' for b as a child of a.  Each link is one join or
    one pass over the pages."""
    found, child = None, False
    for word in chain.split():
        if word == ">":
            child = True
            continue
        if found is None:
            found = step(nodes, word)
        elif child:
            found = step(nodes, word).join(_by_page(found.select("page_id", F.col("node_id").alias("parent_id"))), ["page_id", "parent_id"], "left_semi").select(*nodes.columns)
        else:
            found = step(inside(nodes, found), word)
        child = False
    return found


def is_external(url: Column) -> Column:
    return url.rlike(r"^(?i)(https?:)?//")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def resources(html: Column) -> Column:
    """Sources that a page loads: src attributes and CSS url(...)."""
    return F.concat(F.regexp_extract_all(html, F.lit(r'src="([^"]*)"'), F.lit(1)), F.regexp_extract_all(html, F.lit(r"url\(['\"]?([^'\")]+)"), F.lit(1)))


def elements(html: Column) -> Column:
    """How many elements begin in a piece of HTML."""
    return F.regexp_count(html, F.lit("<[a-zA-Z]"))


def plain_text(html: Column) -> Column:
    """A piece of HTML with a space for each tag, white space collapsed, and quotes and ampersands put in for their references.
    A reference to a quote that has no semicolon, as where a text was cut, stays as it is."""
    out = F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[\\t\\n\\f\\r ]+", " ")
    out = F.regexp_replace(out, r"\A\p{Zs}+|\p{Zs}+\z", "")
    return F.regexp_replace(F.replace(out, F.lit("&quot;"), F.lit('"')), "&amp;?", "&")


def sections(text: Column, marker: str = r"\n(?=## )") -> Column:
    """Parts of a text that begin with a heading."""
    return F.split(text, marker)


def table_rows(text: Column) -> Column:
    """Cells of the pipe table lines of a text, separator lines left out: array of arrays."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^[\s|:\-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda y: F.trim(y)))


def strip_markdown(text: Column) -> Column:
    out = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(out, r"[*_`#]+", ""))


def strip_marks(text: Column) -> Column:
    """Bold marks and backticks off, words and underscores kept."""
    return F.trim(F.replace(F.replace(text, F.lit("**"), F.lit("")), F.lit("`"), F.lit("")))


def section(text: Column, heading: str, level: str = "## ") -> Column:
    """What stands under the first heading that begins so, up to the next one of its level; null if there is none."""
    found = F.try_element_at(F.filter(sections(text, rf"(?m)^(?={level})"), lambda x: x.startswith(level + heading)), F.lit(1))
    return F.regexp_replace(found, r"^[^\n]*\n?", "")


def labelled_line(text: Column, label: str) -> Column:
    """The text after '**label:**' on its line, or ''."""
    return F.coalesce(strip_marks(F.regexp_extract(text, rf"(?m)^\*\*{label}:\*\*\s*(.+)$", 1)), F.lit(""))


def bullets(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*[-*] (.+)$"), F.lit(1)), strip_marks)


def table_records(text: Column, first_header: str) -> Column:
    """Rows, as maps by header, of the pipe table whose header begins with a cell; empty if there is none."""
    # The lines from the header on, as long as they are rows.
    body = F.regexp_extract(F.concat(text, F.lit("\n")), rf"(?m)^(\| *{first_header} *\|[^\n]*\n(?:\|[^\n]*\n)*)", 1)
    rows = F.transform(table_rows(body), lambda r: F.transform(r, strip_marks))
    head = F.try_element_at(rows, F.lit(1))
    return F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.map_from_arrays(head, r))


def named_cell(cell: Column) -> Column:
    """struct(name, key) of 'Name (key)'; both the cell where it has no key."""
    shape = r"^(.*) \(([a-z0-9_]+)\)$"
    keyed = cell.rlike(shape)
    return F.struct(F.when(keyed, F.regexp_extract(cell, shape, 1)).otherwise(cell).alias("name"), F.when(keyed, F.regexp_extract(cell, shape, 2)).otherwise(cell).alias("key"))


def interval_cell(cell: Column) -> Column:
    """struct(low, high) of 'low-high'."""
    return F.struct(F.split_part(cell, F.lit("-"), F.lit(1)).try_cast("double").alias("low"), F.split_part(cell, F.lit("-"), F.lit(2)).try_cast("double").alias("high"))


def count_cell(cell: Column) -> Column:
    """A whole number with thousands separators."""
    return F.replace(cell, F.lit(","), F.lit("")).try_cast("long")


def numbered(mentions: DataFrame, doc: str, position: str, key: str) -> DataFrame:
    """Numbers of keys by first mention: doc, key, first position, number."""
    first = mentions.groupBy(doc, key).agg(F.min(position).alias("first"), F.count("*").alias("mentions"))
    return first.withColumn("number", F.dense_rank().over(Window.partitionBy(doc).orderBy("first", key)))


def with_class(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.array_contains("classes", name))


def by_id(nodes: DataFrame, elem_id: str) -> DataFrame:
    """The first element of each page with that id."""
    return nodes.where(F.col("elem_id") == elem_id).groupBy("page_id").agg(F.min_by(F.struct(*nodes.columns), "node_id").alias("n")).select("n.*")


def cite_links(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, cited (has class cite), number of each link to #ref-N."""
    href = F.trim(F.element_at("attrs", F.lit("href")))
    links = nodes.where((F.col("tag") == "a") & href.rlike(r"^#ref-\d+$"))
    return links.select("page_id", "node_id", F.array_contains("classes", "cite").alias("cited"), F.regexp_extract(href, r"^#ref-(\d+)$", 1).cast("int").alias("number"))


def expected_link(kind: Column, ref_id: Column) -> Column:
    """Where a reference of a kind should link to."""
    doi = F.concat(F.lit("https://doi.org/"), F.lower(ref_id))
    arxiv = F.concat(F.lit("https://arxiv.org/abs/"), F.lower(F.regexp_replace(ref_id, r"(?i)^arxiv:|v\d+$", "")))
    return F.when(kind == "doi", doi).when(kind == "arxiv", arxiv).otherwise(ref_id)


def reference_items(nodes: DataFrame) -> DataFrame:
    """page_id, position, elem_id, number, kind, ref_id, title of the items of the first references list in #references."""
    section = by_id(nodes, "references")
    lists = inside(with_class(nodes.where("tag = 'ol'"), "references"), section)
    first = lists.groupBy("page_id").agg(F.min("node_id").alias("list"))
    items = nodes.where("tag = 'li'").join(_by_page(first), "page_id").where(F.col("parent_id") == F.col("list"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("node_id"))
    at = lambda name: F.trim(F.coalesce(F.element_at("attrs", F.lit(name)), F.lit("")))
    items = items.select("page_id", "node_id", place.alias("position"), "elem_id", F.regexp_extract(F.coalesce("elem_id", F.lit("")), r"^ref-(\d+)$", 1).try_cast("int").alias("number"), F.lower(at("data-kind")).alias("kind"), at("data-id").alias("ref_id"))
    spans = with_class(nodes.where("tag = 'span'"), "ref-title")
    own = holders(spans, nodes.join(_by_page(items.select("page_id", "node_id")), ["page_id", "node_id"], "left_semi"))
    title = own.groupBy("page_id", F.col("holder").alias("node_id")).agg(F.min("node_id").alias("span"))
    title = title.join(_by_page(text_of(nodes, spans).withColumnRenamed("node_id", "span")), ["page_id", "span"], "left")
    return items.join(_by_page(title.select("page_id", "node_id", F.col("whole").alias("title"))), ["page_id", "node_id"], "left")


def list_position_problems(items: DataFrame) -> DataFrame:
    """Items whose id is not ref-N for their place N."""
    wrong = ~F.coalesce(F.col("number") == F.col("position"), F.lit(False))
    return items.where(wrong).select("page_id", "position", "elem_id")


def citation_closure(items: DataFrame, links: DataFrame, section_nodes: DataFrame) -> DataFrame:
    """page_id, number, problem: items that are never cited outside the list (uncited), and numbers that are linked to
    but not listed (dangling)."""
    outside = links.where("cited").join(_by_page(section_nodes.select("page_id", "node_id")), ["page_id", "node_id"], "left_anti")
    listed = items.select("page_id", "number")
    uncited = listed.where("number IS NOT NULL").join(_by_page(outside.select("page_id", "number")), ["page_id", "number"], "left_anti").withColumn("problem", F.lit("uncited"))
    dangling = links.select("page_id", "number").distinct().join(_by_page(listed), ["page_id", "number"], "left_anti").withColumn("problem", F.lit("dangling"))
    return uncited.unionByName(dangling)


def item_links(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """page_id, node_id, links (in order) of list items."""
    href = F.element_at("attrs", F.lit("href"))
    links = nodes.where((F.col("tag") == "a") & href.isNotNull())
    at = holders(links, nodes.join(_by_page(items.select("page_id", "node_id")), ["page_id", "node_id"], "left_semi"))
    own = at.join(_by_page(links.select("page_id", "node_id", href.alias("href"))), ["page_id", "node_id"]).select("page_id", F.col("holder").alias("node_id"), F.col("node_id").alias("at"), "href")
    return own.groupBy("page_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "href"))), lambda x: x["href"]).alias("links"))


def reference_problem(kind: Column, ref_id: Column, title: Column, links: Column) -> Column:
    """The first thing that is wrong with a reference, or ''."""
    shape = F.when(kind == "doi", ref_id.rlike(r"^10\.\d{1,9}/\S+$")).when(kind == "arxiv", ref_id.rlike(r"(?i)^(arxiv:)?\d{4}\.\d{4,5}(v\d+)?$")).otherwise(ref_id.rlike(r"^https?://\S+$"))
    target = F.lower(expected_link(kind, ref_id))
    linked = F.exists(F.coalesce(links, F.array().cast("array<string>")), lambda x: F.lower(F.trim(F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))))) == target)
    return (
        F.when(~kind.isin("doi", "arxiv", "url"), "kind")
        .when(~F.coalesce(shape, F.lit(False)), "id")
        .when(F.coalesce(title, F.lit("")) == "", "title")
        .when(~linked, F.concat(F.lit("no link to "), target))
        .otherwise("")
    )
