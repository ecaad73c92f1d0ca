"""Captured pages to structured extracts: title, description, text, links, forms, contacts.

Spark has no HTML parser, so the pages' markup goes through the standard library's in Arrow batches; what follows from
the text and links is built from expressions.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import contacts as C
from tamis.functions import urls as U
from tamis.functions.text import normalize_space

EXTRACT = (
    "page_id long, url string, title string, description string, body string, links array<string>, anchors array<string>, "
    "forms array<struct<page_url:string,action:string,method:string,fields:array<string>,label:string>>"
)
_SILENT = {"script", "style", "noscript", "template"}


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.title, self.meta, self.text, self.links, self.anchors, self.forms = url, [], {}, [], [], [], []
        self.silent, self.in_title, self.anchor = 0, False, None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _SILENT:
            self.silent += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta":
            self.meta.setdefault((a.get("name") or a.get("property") or "").lower(), a.get("content", ""))
        elif tag == "a" and a.get("href"):
            self.links.append(_joined(self.url, a["href"]))
            self.anchor = []
        elif tag == "form":
            self.forms.append({"page_url": self.url, "action": _joined(self.url, a.get("action", "")), "method": a.get("method", "get").lower(), "fields": [], "label": ""})
        elif tag in ("input", "textarea", "select") and self.forms and (a.get("name") or a.get("id")):
            self.forms[-1]["fields"].append(a.get("name") or a["id"])
        self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.anchor is not None:
            self.anchors.append(" ".join("".join(self.anchor).split()))
            self.anchor = None
        self.text.append(" ")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.text.append(data)
            if self.anchor is not None:
                self.anchor.append(data)


def _joined(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return ""


_FORM = pa.struct([("page_url", pa.string()), ("action", pa.string()), ("method", pa.string()), ("fields", pa.list_(pa.string())), ("label", pa.string())])
_SCHEMA = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("url", "title", "description", "body")), ("links", pa.list_(pa.string())), ("anchors", pa.list_(pa.string())), ("forms", pa.list_(_FORM))])
#: Pages, and characters of their markup, that are held as Python's objects at a time; the batch itself stays in Arrow.
AT_ONCE, CHARACTERS = 64, 1 << 20


def _extract(batches):
    for pages in batches:
        rows, size = [], 0
        for page_id, url, html in zip(*pages.columns):
            page_id, url, html = page_id.as_py(), url.as_py(), html.as_py() or ""
            page = _Page(url or "")
            page.feed(html)
            page.close()
            words = lambda parts: " ".join("".join(parts).split())
            about = page.meta.get("description") or page.meta.get("og:description") or page.meta.get("twitter:description") or ""
            rows.append((page_id, url, words(page.title), " ".join(about.split()), words(page.text), page.links, page.anchors, page.forms))
            size += len(html)
            if len(rows) == AT_ONCE or size >= CHARACTERS:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def extract_pages(pages: DataFrame) -> DataFrame:
    """EXT-1, EXT-5, EXT-6: (page_id, url, html) -> EXTRACT, a few pages at a time, however many a batch has."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, EXTRACT)


def with_contacts(extracts: DataFrame) -> DataFrame:
    """EXT-2..4, EXT-6: e-mails, phone numbers and links by kind, cleaned."""
    links = F.col("clean_links")
    return extracts.withColumn("clean_links", C.clean_links("links")).withColumns(
        {
            "emails": C.clean_emails(C.extract_all(F.concat_ws(" ", "body", F.array_join("links", " ")), C.EMAIL)),
            "phones": C.clean_phones(C.extract_all("body", C.PHONE)),
            "direct_links": F.slice(F.filter(links, lambda u: C.is_direct_contact(u)), 1, 20),
            "website_links": F.slice(F.filter(links, lambda u: U.platform_of(u) == "Web"), 1, 20),
            "contact_forms": C.clean_forms("forms"),
        }
    )


def result_anchors(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """SRC-6: a search page's outgoing links as result rows: distinct, unwrapped, in order, none to the page's own host; `limit`: the first of each page only."""
    e = extract_pages(pages)
    both = F.arrays_zip(F.col("links").alias("u"), F.col("anchors").alias("t"))
    rows = e.select("page_id", U.domain_of("url").alias("own"), F.posexplode(both).alias("rank", "r"))
    rows = rows.select("page_id", "own", "rank", U.unwrap_redirect("r.u").alias("url"), normalize_space("r.t").alias("title"))
    rows = rows.filter("url is not null").filter(U.domain_of("url") != F.col("own"))
    first = rows.groupBy("page_id", "url").agg(F.min("rank").alias("rank"), F.min_by("title", "rank").alias("title"))
    if limit is None:
        return first
    from tamis.operators.core import newest

    return newest(first, ["page_id"], [F.asc("rank")], limit)


def crawl(seeds: DataFrame, captured: DataFrame, per_site: int = 6) -> DataFrame:
    """EXT-8: addresses that seeds lead to, joined to the captured pages; a budget of pages for each site. No fetching."""
    from tamis.operators.core import newest

    wanted = seeds.select("site", F.posexplode("urls").alias("rank", "u")).select("site", "rank", U.safe_url("u").alias("u")).filter("u is not null")
    have = captured.select("page_id", U.safe_url("url").alias("u"))
    return newest(wanted.join(have, "u"), ["site"], [F.asc("rank"), F.asc("page_id")], per_site)
