"""Crawled pages, links to documents and site maps, on files of their own."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from marlstone.plans import registry
from marlstone.sources import html, pages

DATA = "/root/testdata/sf0.001"

TABLE = "| Položka | Cena |\n| --- | --- |\n| Vedení účtu | 99 Kč |\n| Poznámka | dle dohody |\n| Výběr z bankomatu | zdarma |"
FULL = {
    "url": "https://ex.org/a", "title": "Účty", "sections": [{"heading": "První", "content": "Slovo. " * 300}, {"heading": "", "content": "krátká"}, {"heading": "prázdná", "content": " "}],
    "faq": [{"question": "Jak na to?", "answer": "Takhle a takhle, prosím."}, {"question": "x", "answer": ""}], "tables": [{"caption": "Ceny", "markdown": TABLE}, {"markdown": "a|b"}],
    "cards": [{"title": "Karta", "content": "Dostatečně dlouhý obsah karty, který se počítá jako text."}, {"content": "málo"}], "metadata": {"category": "retail"},
}


def write(folder):
    (folder / "1.json").write_text(json.dumps(FULL), encoding="utf-8")
    (folder / "2.json").write_text(json.dumps({"url": "https://ex.org/b", "content": "Jen obsah stránky bez oddílů."}), encoding="utf-8")
    (folder / "3.json").write_text("{broken", encoding="utf-8")
    (folder / "4.json").write_text(json.dumps({"url": "https://ex.org/big", "content": "x" * (6 << 20)}), encoding="utf-8")
    (folder / "5.json").write_text(json.dumps({"url": "https://ex.org/none"}), encoding="utf-8")
    return str(folder / "*.json")


def test_pages_become_chunks(spark, tmp_path):
    p = pages.json_pages(spark, write(tmp_path))
    assert sorted(r.file_name for r in p.collect()) == ["1.json", "2.json", "5.json"]
    got = sorted(pages.page_chunks(p).collect(), key=lambda r: (r.file_name, r.chunk_index))
    one = [r for r in got if r.file_name == "1.json"]
    n = sum(r.section_title == "První" for r in one)
    assert n == 3 and all(len(r.content) <= 1100 for r in one[:n])
    assert [(r.chunk_type, r.section_title, r.document_type) for r in one[n:]] == [
        ("section_text", "Účty", "product_page"), ("faq", "Účty", "faq"), ("pricing_row", "Ceny", "pricing"), ("pricing_row", "Ceny", "pricing"), ("table", "Ceny", "product_page"), ("section_text", "Karta", "product_page"),
    ]
    assert [r.chunk_index for r in one] == list(range(len(one))) and {r.category for r in one} == {"retail"}
    faq = one[n + 1]
    assert faq.content == "FAQ: Jak na to?\n\nOdpověď:\nTakhle a takhle, prosím."
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()[:16]
    assert faq.chunk_id == h(f"https://ex.org/a|None|faq|Účty|{n + 1}|{h(faq.content)}")
    assert "99 Kč" in one[n + 2].content and "zdarma" in one[n + 3].content and one[n + 4].content == TABLE
    two = [r for r in got if r.file_name == "2.json"]
    assert [(r.section_title, r.content, r.title, r.category) for r in two] == [("https://ex.org/b", "Jen obsah stránky bez oddílů.", "https://ex.org/b", "unknown")]
    assert len(got) == len(one) + 1


def test_links_to_documents(spark):
    html = """<a href="/f/Price-List.pdf?v=2"><b>Price</b>
      list</a><a class=x href='b.PDF'></a><a href="/no.html">no</a><div data-file="../d/terms-2024.pdf" data-url="/f/price-list.pdf"></div>
      <script>open("https://other.org/x.pdf"); var y = 'mailto:a.pdf';</script><a href="/f/Price-List.pdf">Again</a>"""
    df = spark.createDataFrame([("https://Ex.org/a/b/c", html), ("https://ex.org/", None)], "url string, html string")
    got = {r.url: (r.title, r.source_page) for r in pages.document_links(df).collect()}
    page = "https://Ex.org/a/b/c"
    assert got == {
        "https://ex.org/f/Price-List.pdf": ("Price list", page), "https://ex.org/a/b/b.PDF": ("b", page), "https://ex.org/a/d/terms-2024.pdf": ("terms 2024", page),
        "https://ex.org/f/price-list.pdf": ("price list", page), "https://other.org/x.pdf": ("x", page),
    }
    kept = pages.document_links(df, F.col("seen").contains("terms")).collect()
    assert [r.url for r in kept] == ["https://ex.org/a/d/terms-2024.pdf"]


def test_site_maps(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><urlset><url><loc> https://Ex.org/a/ </loc><lastmod>2024-01-01</lastmod><priority>0.8</priority></url><url><loc>https://ex.org/ceniky/b?x=1</loc></url><url><lastmod>2024</lastmod></url></urlset>')
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc>https://ex.org/s.xml</loc></sitemap><sitemap><loc>https://ex.org/t.xml</loc></sitemap></sitemapindex>")
    rule = F.when(F.col("url").contains("ceniky"), "ceniky").otherwise("general")
    got = sorted(map(tuple, pages.sitemap(spark, str(tmp_path / "s.xml"), rule).collect()))
    assert got == [("https://ex.org/a", "2024-01-01", "0.8", "general"), ("https://ex.org/ceniky/b", None, None, "ceniky")]
    assert sorted(r.url for r in pages.sitemaps_of(spark, str(tmp_path / "i.xml")).collect()) == ["https://ex.org/s.xml", "https://ex.org/t.xml"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_registered_pages_hold_their_sections(spark):
    """Numbered without gaps, and together they hold every word of the pages' sections."""
    got = registry.QUERIES["page_chunks"](spark, DATA).collect()
    of = {}
    for r in got:
        of.setdefault(r.page_id, []).append(r)
    assert all(sorted(r.chunk_index for r in some) == list(range(len(some))) and all(0 < r.n_chars <= 1100 for r in some) for some in of.values())
    sections = html.structured_pages(spark.read.parquet(f"{DATA}/pages.parquet")).collect()
    assert set(of) == {r.page_id for r in sections if any(x.content for x in r.sections)}
    for r in sections[:20]:
        assert sum(x.n_chars for x in of.get(r.page_id, [])) >= sum(len("".join(x.content.split())) for x in r.sections)
