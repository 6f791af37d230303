"""Fields and links of stored HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylamp.functions.text import collapse_space, is_blank, strip_space
from quarrylamp.functions.urls import normalize_url, resolve_link

HTML_TYPES = ("text/html", "application/xhtml+xml")

#: Characters of HTML that are parsed before their fields are handed on.
HTML_AT_ONCE = 1 << 20

# Elements that leave an unopened body unopened.
_HEAD_ONLY = frozenset(
    "html head title meta link base style script noscript template".split()
)


class _PageFields(HTMLParser):
    """Collects title, description, body text and links while reading a page once."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.titles: list[str] = []
        self.description: str | None = None
        self.body: list[str] = []
        self.links: list[str | None] = []
        self.in_title = self.in_head = self.in_body = False

    def handle_starttag(self, tag, attrs):
        values = dict(reversed(attrs))  # the first of repeated attributes counts
        if tag == "head":
            self.in_head = True
        elif tag == "body" or (tag not in _HEAD_ONLY and not self.in_body):
            self.in_body, self.in_head = True, False
        if tag == "title":
            self.in_title = True
            self.titles.append("")
        elif tag == "meta" and values.get("name") == "description" and self.description is None:
            self.description = values.get("content") or ""
        elif tag == "a":
            self.links.append((values.get("href") or "") if "href" in values else None)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag == "head":
            self.in_head = False

    def handle_data(self, data):
        if self.in_title:
            self.titles[-1] += data
        if self.in_body:
            self.body.append(data)
        elif not self.in_head and not self.in_title and self.lasttag not in _HEAD_ONLY - {"head"}:
            if data.strip():
                self.in_body = True
                self.body.append(data)


def _fields(html: str) -> tuple:
    page = _PageFields()
    page.feed(html or "")
    page.close()
    return page.titles, page.description or "", "".join(page.body), page.links


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about HTML_AT_ONCE characters in all; one row may have more."""
    first, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > HTML_AT_ONCE:
            yield first, at
            first, held = at, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def _read_pages(kept: list[str]):
    """Task body over (kept columns, html): some pages at a time, however large a batch is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html")
            sizes = pc.fill_null(pc.utf8_length(html), 0).to_pylist()
            for first, last in _runs(sizes):
                rows = batch.slice(first, last - first)
                titles, descriptions, bodies, found = zip(*(_fields(page.as_py()) for page in rows.column("html")))
                texts = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c) for c in kept), pa.array(titles, texts), pa.array(descriptions, pa.string()),
                        pa.array(bodies, pa.string()), pa.array(found, texts),
                    ],
                    [*kept, "titles", "description", "body", "links"],
                )

    return run


def html_pages(pages: DataFrame, raw: bool = False) -> DataFrame:
    """Pages of an HTML content type (raw: plain HTML only); all when the type was not stored."""
    if "content_type" not in pages.columns:
        return pages
    kind = F.lower("content_type")
    plain = kind.startswith(HTML_TYPES[0])
    return pages.filter(plain if raw else plain | kind.startswith(HTML_TYPES[1]))


def extract_pages(pages: DataFrame, raw: bool = False, keep: list[str] | None = None) -> DataFrame:
    """`(keep..., url, title, body, description, references)` of pages with `url` and `html`.

    Text is trimmed, body white space collapsed, pages without body text dropped.  The raw
    variant leaves everything as found: all titles in a row, every link (missing target as
    ''), only successful responses when a `status` column exists.
    """
    keep = keep or []
    source = html_pages(pages, raw)
    if raw and "status" in source.columns:
        source = source.filter(F.col("status").between(200, 299))
    kept = source.select(*keep, "url", "html")
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "html"]
        + ["titles array<string>", "description string", "body string", "links array<string>"]
    )
    found = kept.mapInArrow(_read_pages([c for c in kept.columns if c != "html"]), schema)
    if raw:
        return found.select(
            *keep, "url",
            F.array_join("titles", "").alias("title"),
            "body", "description",
            F.transform("links", lambda x: F.coalesce(x, F.lit(""))).alias("references"),
        )
    first_title = F.coalesce(F.get("titles", F.lit(0)), F.lit(""))
    return found.select(
        *keep,
        normalize_url(F.col("url")).alias("url"),
        strip_space(first_title).alias("title"),
        collapse_space(F.col("body")).alias("body"),
        strip_space(F.col("description")).alias("description"),
        F.filter("links", lambda x: x.isNotNull()).alias("references"),
    ).filter("body <> ''")


def page_links(extracted: DataFrame) -> DataFrame:
    """`(src_url, dst_url)` per followable reference, resolved against its page."""
    links = extracted.select(
        F.col("url").alias("src_url"), F.explode("references").alias("href")
    ).filter(~is_blank(F.col("href")))
    target = resolve_link(F.col("src_url"), F.col("href"))
    return links.select("src_url", normalize_url(target).alias("dst_url")).filter(
        F.col("dst_url").isNotNull()
    )


def ingest_messages(extracted: DataFrame, seq: str) -> DataFrame:
    """Extracted pages as ingest messages in arrival order `seq`."""
    return extracted.select(
        "url", "title", F.col("body").alias("content"), "description",
        F.col(seq).cast("long").alias("seq"),
    )
