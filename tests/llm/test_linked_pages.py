"""Articles that are mostly links keep their text."""

import pytest

from tessel.llm import html_extraction


@pytest.mark.parametrize("n", [1, 2, 4])
def test_link_heavy_articles(spark, n):
    page = '<html><body><nav><a href="/">Home of all</a></nav><article><h1>List {0}</h1><p>See:</p><ul><li><a href=a>Source number one of page {0}</a></li><li><a href=b>Source number two of page {0}</a></li></ul></article><noscript>Turn scripts on</noscript><footer>Foot</footer></body></html>'
    rows = [(i, "http://h.example/" + str(i), page.format(i)) for i in range(n)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"List {i}\nSee:\nSource number one of page {i}\nSource number two of page {i}" for i in range(n)}


def test_linked_headline(spark):
    page = "<html><body><article><h1><a href=x>A long linked headline of this page</a></h1><p>By A. B.</p></article></body></html>"
    got = html_extraction.extract(spark.createDataFrame([(1, "http://i.example/1", page)], "page_id long, url string, html string")).first()
    assert got["text"] == "A long linked headline of this page\nBy A. B."
