"""HTML pages to structured pages, with the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIP = {"script", "style", "nav", "header", "footer", "noscript"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4}
SCHEMA = "page_id long, title string, canonical string, sections array<struct<heading:string,level:int,content:string,ord:int>>, tables array<array<array<string>>>, faq array<struct<question:string,answer:string,ord:int>>, links array<string>"


class Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.title, self.h1, self.canonical = 0, [], [], None
        self.sections, self.links, self.tables, self.faq = [["", 0, []]], [], [], []
        self.into, self.cell, self.question = None, None, None

    def close_cell(self):
        if self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "link" and "canonical" in (a.get("rel") or ""):
            self.canonical = a.get("href")
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in SKIP:
            self.skip += 1
        elif self.skip:
            return
        elif tag in HEADINGS:
            self.sections.append(["", HEADINGS[tag], []])
            self.into = "heading"
        elif tag == "title":
            self.into = "title"
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.close_cell()
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.close_cell()
            self.cell = []
        elif tag == "summary":
            self.question = []
        elif tag == "details":
            self.faq.append(["", []])

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in HEADINGS or tag == "title":
            self.into = None
        elif tag in ("td", "th", "tr", "table"):
            self.close_cell()
        elif tag == "summary" and self.question is not None:
            if self.faq:
                self.faq[-1][0] = " ".join("".join(self.question).split())
            self.question = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.into == "title":
            self.title.append(data)
        elif self.cell is not None:
            self.cell.append(data)
        elif self.question is not None:
            self.question.append(data)
        elif self.into == "heading":
            self.sections[-1][0] += data
        else:
            self.sections[-1][2].append(data)
            if self.faq:
                self.faq[-1][1].append(data)


def parse(html: str | None) -> dict:
    p = Page()
    p.feed(html or "")
    p.close()
    squash = lambda s: " ".join(s.split())
    sections = [(squash(h), n, squash(" ".join(c))) for h, n, c in p.sections]
    sections = [s for s in sections if s[0] or s[2]]
    h1 = next((h for h, n, _ in sections if n == 1), "")
    wide = lambda t: [r + [""] * (max(map(len, t)) - len(r)) for r in t]
    return {
        "title": h1 or squash("".join(p.title)),
        "canonical": p.canonical,
        "sections": [{"heading": h, "level": n, "content": c, "ord": i} for i, (h, n, c) in enumerate(sections)],
        "tables": [wide([r for r in t if r]) for t in p.tables if any(t)],
        "faq": [{"question": q, "answer": squash(" ".join(a)), "ord": i} for i, (q, a) in enumerate(p.faq) if q],
        "links": list(dict.fromkeys(p.links)),
    }


def structured_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, canonical, sections, tables (padded; the first row is the header), faq and distinct links."""
    names = ["title", "canonical", "sections", "tables", "faq", "links"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sec = pa.list_(pa.struct([("heading", pa.string()), ("level", pa.int32()), ("content", pa.string()), ("ord", pa.int32())]))
        faq = pa.list_(pa.struct([("question", pa.string()), ("answer", pa.string()), ("ord", pa.int32())]))
        kinds = [pa.string(), pa.string(), sec, pa.list_(pa.list_(pa.list_(pa.string()))), faq, pa.list_(pa.string())]
        for b in batches:
            got = [parse(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[n] for g in got], k) for n, k in zip(names, kinds, strict=True))], names=["page_id", *names])

    return pages.select("page_id", "html").mapInArrow(run, SCHEMA)


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))
