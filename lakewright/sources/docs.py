"""Reference pages in HTML to class and object rows, offline.

Pages are rows (page_id, title, html). A malformed page gives what could be read.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMBERS = "page_id string, class_name string, member string, kind string, signature string"
OBJECT_FIELDS = "page_id string, object string, field string, field_type string"


class _Outline(HTMLParser):
    """Headings with the text below them, table rows and code."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[str, str]] = []
        self.row: list[str] | None = None
        self.open: str | None = None
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        if tag in ("h1", "h2", "h3", "h4", "code", "pre", "td", "th"):
            self.open, self.text = tag, ""

    def handle_endtag(self, tag):
        if tag == self.open:
            body = " ".join(self.text.split())
            if tag in ("td", "th") and self.row is not None:
                self.row.append(body)
            else:
                self.items.append((tag, body))
            self.open = None
        if tag == "tr" and self.row is not None:
            self.items.append(("tr", "\t".join(self.row)))
            self.row = None

    def handle_data(self, data):
        if self.open:
            self.text += data


def outline(html: str | None) -> list[tuple[str, str]]:
    p = _Outline()
    p.feed(html or "")
    p.close()
    return p.items


def _rows(pages: DataFrame, schema: str, f) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([r for i, t, h in zip(frame["page_id"], frame["title"], frame["html"], strict=True) for r in f(i, t or "", h)], columns=names)

    return pages.select(F.col("page_id").cast("string"), "title", "html").mapInPandas(run, schema)


def class_members(pages: DataFrame) -> DataFrame:
    """Methods and properties under the headings of a class page."""

    def read(page: str, title: str, html: str) -> list[tuple]:
        name, out, section, member = title.removesuffix(" Class").strip(), [], "", None
        for tag, text in outline(html):
            low = text.lower()
            if tag in ("h2", "h3") and low.endswith(("methods", "properties", "constructors")):
                section, member = low.split()[-1], None
            elif tag in ("h3", "h4") and section:
                member = text.split("(")[0].strip()
            elif tag in ("code", "pre") and member:
                out.append((page, name, member, {"methods": "method", "properties": "property", "constructors": "constructor"}[section], text))
                member = None
        return out

    return _rows(pages, MEMBERS, read)


def object_fields(pages: DataFrame) -> DataFrame:
    """(object, field, type) from the tables of an object page."""

    def read(page: str, title: str, html: str) -> list[tuple]:
        out = []
        for tag, text in outline(html):
            cells = text.split("\t")
            if tag == "tr" and len(cells) >= 2 and cells[0] and cells[0].lower() != "field":
                out.append((page, title.strip(), cells[0], cells[1]))
        return out

    return _rows(pages, OBJECT_FIELDS, read)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, slug, url): links of a page, one per slug over all pages."""
    raw = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)href\s*=\s*[\"']([^\"'#?]+)"), F.lit(1))).alias("url"))
    slug = F.regexp_extract("url", r"([^/]+?)(?:\.html?)?/?$", 1)
    one = raw.withColumn("slug", F.lower(slug)).where("slug <> ''").groupBy("slug").agg(F.min(F.struct("page_id", "url")).alias("m"))
    return one.select(F.col("m.page_id").alias("page_id"), "slug", F.col("m.url").alias("url"))


def reattach(members: DataFrame, parents: DataFrame, classes: DataFrame) -> DataFrame:
    """Members whose own page is no class get the nearest class page above it.
    parents is (child, parent) of pages, classes is (page_id, class_name)."""
    from ..operators.relations import closure

    up = closure(parents, "child", "parent").join(classes.select(F.col("page_id").alias("parent"), F.col("class_name").alias("__c")), "parent")
    nearest = up.groupBy("child").agg(F.min_by("__c", "depth").alias("__c")).withColumnRenamed("child", "page_id")
    own = classes.select("page_id", F.lit(True).alias("__own"))
    out = members.join(own, "page_id", "left").join(nearest, "page_id", "left")
    return out.withColumn("class_name", F.when(F.col("__own"), F.col("class_name")).otherwise(F.coalesce("__c", "class_name"))).select(*members.columns)
