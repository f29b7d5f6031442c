from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from millrace.operators import outline, ratchet
from millrace.operators.outline import texts


class Parsed(HTMLParser):
    """The same rules over the events of Python's own parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.skip = [], [], False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        outline.opened(self.stack, tag)

    def handle_startendtag(self, tag, attrs):
        outline.opened(self.stack, tag)

    def handle_endtag(self, tag):
        outline.closed(self.stack, tag)

    def handle_data(self, data):
        if (text := " ".join(data.split())) and not {"script", "style"} & set(self.stack):
            self.out.append(("/".join(self.stack), text))


def test_like_the_parser_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {}
    for r in sorted(outline.outline(pages).collect(), key=lambda r: r.place):
        found.setdefault(r.page_id, []).append((r.path, r.text))
    for r in pages.collect():
        assert found.get(r.page_id, []) == Parsed(r.html or "").out, r.page_id
    assert len(found) == pages.where("html != ''").count() > 40


@pytest.mark.parametrize("page,want", [
    ("<p>a<b>b<p>c</b>d", [("p", "a"), ("p/b", "b"), ("p", "c"), ("p", "d")]),
    ("<ul><li>1<li>2<ul><li>3</ul></ul>x", [("ul/li", "1"), ("ul/li", "2"), ("ul/li/ul/li", "3"), ("", "x")]),
    ('<script>var t="</p><b>";</script><p title="a > b">t &amp; u<!-- no --><br/>v', [("p", "t & u"), ("p", "v")]),
    ("<div><h1>H</h1></section> t", [("div/h1", "H"), ("div", "t")]), ("", []), (" \n", []), ("<style>x", []), ("plain", [("", "plain")]),
])
def test_rules(page, want):
    assert list(texts(page)) == want


def test_a_loss_is_told_and_a_gain_moves_the_baseline(spark, tmp_path):
    path = str(tmp_path / "r")
    counts = lambda **n: spark.createDataFrame(list(n.items()), "rule string, n long")
    told = lambda now: {r.rule: (r.before, r.now, r.status) for r in ratchet.compared(ratchet.baseline(spark, path), now).collect()}
    assert told(counts(a=3)) == {"a": (None, 3, "new")}
    assert ratchet.advance(ratchet.compared(ratchet.baseline(spark, path), counts(a=3, b=1)), path) == 1
    assert told(counts(a=4, c=1)) == {"a": (3, 4, "worse"), "b": (1, 0, "better"), "c": (None, 1, "new")}
    assert ratchet.advance(ratchet.compared(ratchet.baseline(spark, path), counts(a=4)), path) == 2
    assert told(counts(a=3)) == {"a": (3, 3, "same"), "b": (0, 0, "same")}  # the lower counts stay
    fresh = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, None)], "d long, k int, raw string")
    kept = fresh.where("k = 0").unionByName(spark.createDataFrame([(3, 0, "z")], fresh.schema)).withColumn("raw", F.when(F.col("d") == 1, "other").otherwise(F.col("raw")))
    assert {tuple(r) for r in ratchet.reextracted(kept, fresh, ["d", "k"], "raw").collect()} == {("missing", 1, 1), ("stale", 3, 0), ("differs", 1, 0)}
