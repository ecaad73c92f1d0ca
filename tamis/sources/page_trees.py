"""Pages as tables of nodes, selectors as tables of steps, and search engines' results as joins of the two.

A node has its place `pre` in the page, the place `last` of its last descendant and the range of the page's text that it
holds. So "is within" is a comparison of places in one page, and a node's text is a part of the page's. Selectors match by
joins: each step by an equality on one of its marks (a tag, class or attribute), steps of a chain by ranges of places within
the page. Nothing but the markup itself is read in Python, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import urls as U
from tamis.functions.text import normalize_space

NODES = "page_id long, pre long, last long, tag string, marks array<string>, href string, start long, stop long, text string"
#: Elements without content, those whose text isn't shown, and the open ones that a tag closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in ("p", "div", "ul", "ol", "table", "section", "article", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "footer", "header", "nav")}
SCOPES = {"ul", "ol", "table", "dl", "select", "html", "body", "div", "article", "section"}


class _Tree(HTMLParser):
    """Nodes as lists [pre, last, tag, marks, href, start, stop] and the text of a page; `xml` has no elements without content."""

    def __init__(self, xml: bool):
        super().__init__(convert_charrefs=True)
        self.xml, self.nodes, self.open, self.text, self.size, self.silent = xml, [], [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if not self.xml:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][2] in CLOSES.get(tag, ()):
                    self._close(at)
                    break
                if self.open[at][2] in SCOPES:
                    break
        a = {k: v or "" for k, v in reversed(attrs)}
        marks = [tag, *("." + c for c in dict.fromkeys(a.get("class", "").split())), *(f"[{k}]" for k in a), *(["#" + a["id"]] if a.get("id") else [])]
        node = [len(self.nodes), len(self.nodes), tag, marks, a.get("href"), self.size, self.size]
        self.nodes.append(node)
        if self.xml or tag not in VOID:
            self.open.append(node)
            self.silent += tag in SILENT and not self.xml

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.xml:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][2] == tag:
                self._close(at)
                return

    def _close(self, at: int) -> None:
        """Closes the open element at that depth and all within it."""
        while len(self.open) > at:
            node = self.open.pop()
            node[1], node[6] = len(self.nodes) - 1, self.size
            self.silent -= node[2] in SILENT and not self.xml

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            self.size += len(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def _parse(batches, references: list[str] | None):
    names = [c.split()[0] for c in NODES.replace("array<string>", "a").split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.string()]
    # An ampersand that begins no wanted reference is written as one; sections of plain characters have none.
    other = references is not None and re.compile(rf"<!\[CDATA\[.*?\]\]>|&(?!(?:{'|'.join(map(re.escape, references)) or '(?!)'});)", re.S)
    for batch in batches:
        # A page at a time: a batch's pages aren't held as Python's texts at once.
        for page_id, html in zip(*batch.columns):
            page_id, html = page_id.as_py(), html.as_py() or ""
            if other:
                html = other.sub(lambda m: "&amp;" if m[0] == "&" else m[0], html)
            tree = _Tree(html.lstrip()[:100].lower().startswith(("<?xml", "<rss", "<feed")))
            tree.handle_starttag("#page", [])
            tree.feed(html)
            tree.close()
            tree._close(0)
            rows = [(page_id, *n, "".join(tree.text) if n[0] == 0 else None) for n in tree.nodes]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def page_nodes(pages: DataFrame, references: Iterable[str] | None = None) -> DataFrame:
    """EXT-5 to EXT-7: (page_id, html) -> NODES. A page's first node holds all of it, and its text; other nodes' texts are
    ranges of that. Marks are the tag, classes with a dot, attributes in brackets and the id with a hash. Elements that
    are left open end with the one around them; text of scripts and styles is left out. Character references are decoded as
    browsers do, also those without a semicolon; with `references`, only those named, such as "amp" or "#39", in full."""
    wanted = None if references is None else list(references)
    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(lambda batches: _parse(batches, wanted), NODES)


def _steps(selector: str) -> list[list[str]]:
    """Marks of each step of a chain such as "li.result a[href]"."""
    return [[m for m in step.replace(".", " .").replace("[", " [").replace("#", " #").split() if m] for step in selector.split()]


def matched(nodes: DataFrame, selectors: dict[str, list[str]]) -> DataFrame:
    """(name, and the nodes' columns but the text): nodes that one of a name's selectors matches, each once. A selector is a
    chain of steps, each within the one before."""
    spark: SparkSession = nodes.sparkSession
    steps = [(name, f"{name}/{i}", k, marks[-1], marks) for name, ways in selectors.items() for i, way in enumerate(ways) for k, marks in enumerate(_steps(way))]
    # As many rows as there are steps in the selectors given.
    table = spark.createDataFrame(steps, "name string, way string, step int, mark string, marks array<string>")
    bare = nodes.drop("text")
    hits = bare.withColumn("mark", F.explode("marks")).join(F.broadcast(table.withColumnRenamed("marks", "_all")), "mark").filter(F.size(F.array_except("_all", "marks")) == 0).drop("mark", "_all")
    length = table.groupBy("way").agg(F.max("step").alias("_end"))
    now = hits.filter("step = 0")
    done = []
    for k in range(max((s[2] for s in steps), default=0) + 1):
        if k:
            up, down = now.select("page_id", "way", F.col("pre").alias("_pre"), F.col("last").alias("_last")), hits.filter(F.col("step") == k)
            now = down.join(up, ["page_id", "way"]).filter((F.col("pre") > F.col("_pre")) & (F.col("pre") <= F.col("_last"))).drop("_pre", "_last").dropDuplicates(["page_id", "way", "pre"])
        done.append(now.join(F.broadcast(length), "way").filter(F.col("_end") == k).drop("_end"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["name", "page_id", "pre"]).select("name", *bare.columns)


def with_text(found: DataFrame, nodes: DataFrame, name: str = "text") -> DataFrame:
    """The text within each node, blanks made single."""
    whole = nodes.filter("pre = 0").select("page_id", F.col("text").alias("_page"))
    return found.join(whole, "page_id").withColumn(name, normalize_space(F.substr("_page", (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")))).drop("_page")


@dataclass(frozen=True)
class Engine:
    """Selectors of a result, and within it of its link, title (else the link's text) and text (else the result's); the address
    is the link's, or its text."""

    result: tuple[str, ...]
    link: tuple[str, ...]
    title: tuple[str, ...] = ()
    snippet: tuple[str, ...] = ()
    address_in_text: bool = False


# Where engines put their results.
ENGINES = {
    "duckduckgo": Engine((".result", ".web-result", ".result__body"), ("a.result__a", ".result__title a", "a"), (), (".result__snippet", ".result__extras__url")),
    "bing": Engine(("li.b_algo",), ("h2 a",), (), (".b_caption p",)),
    "bing-rss": Engine(("item",), ("link",), ("title",), ("description",), True),
}


def search_results(pages: DataFrame, engines: dict[str, Engine] = ENGINES) -> DataFrame:
    """SRC-6: (page_id, engine, rank, url, title, snippet): the results of captured search pages (page_id, engine, html), each
    address once, where it comes first; redirects are unwrapped, and results without an address are left out."""
    given = pages.filter(F.col("engine").isin(list(engines)))
    nodes = page_nodes(given)
    selectors = {f"{e}:{part}": list(getattr(rule, part)) for e, rule in engines.items() for part in ("result", "link", "title", "snippet") if getattr(rule, part)}
    own = given.select(F.col("page_id").cast("long").alias("page_id"), "engine")
    name = F.split("name", ":")
    found = matched(nodes, selectors).withColumns({"part": name[1], "of": name[0]}).join(own, "page_id").filter("of = engine")
    boxes = found.filter("part = 'result'").select("page_id", "engine", F.col("pre").alias("rank"), F.col("last").alias("_last"), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    inside = found.filter("part != 'result'").join(boxes, ["page_id", "engine"]).filter((F.col("pre") > F.col("rank")) & (F.col("pre") <= F.col("_last")))
    # The first node of each part in a result.
    first = lambda part: F.min_by(F.struct("href", "start", "stop"), F.when(F.col("part") == part, F.col("pre"))).alias(part)
    parts = inside.groupBy("page_id", "engine", "rank", "_start", "_stop").agg(*map(first, ("link", "title", "snippet")))
    whole = nodes.filter("pre = 0").select("page_id", F.col("text").alias("_page"))
    text = lambda a, b: normalize_space(F.substr("_page", (a + 1).cast("int"), (b - a).cast("int")))
    of = lambda part: F.when(F.col(part).isNotNull(), text(F.col(f"{part}.start"), F.col(f"{part}.stop")))
    by_text = F.col("engine").isin([e for e, rule in engines.items() if rule.address_in_text])
    rows = parts.join(whole, "page_id").select(
        "page_id", "engine", "rank", U.unwrap_redirect(F.coalesce(F.when(by_text, of("link")).otherwise(F.col("link.href")), F.lit(""))).alias("url"),
        F.coalesce(of("title"), of("link"), F.lit("")).alias("title"), F.coalesce(F.nullif(of("snippet"), F.lit("")), F.when(by_text, F.lit("")).otherwise(text(F.col("_start"), F.col("_stop")))).alias("snippet"),
    ).filter("url is not null and url != ''")
    once = rows.groupBy("page_id", "engine", "url").agg(F.min("rank").alias("rank"), *(F.min_by(c, "rank").alias(c) for c in ("title", "snippet")))
    return once.select("page_id", "engine", "rank", "url", "title", "snippet")
