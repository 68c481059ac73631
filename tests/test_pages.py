import html
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from lectern.functions import html as H
from lectern.functions import text as X
from lectern.functions.urls import resolve_url
from lectern.operators import pages as P
from lectern.sources.tables import drop_null_content, page_source, page_status_counts


def one(spark, values, schema, expression):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expression).collect()]


def test_resolve_url_equals_the_standard_library(spark):
    bases = [
        "https://h/a/b", "https://h", "http://h/a/b/", "https://h/a/b?x=1#y", "https://h/a//b/c.html",
        "http://h/../a/b", "https://h/a/./b/../c",
    ]
    links = [
        "/c", "c", "//x/y", "https://z/", "", "#f", "?q=1", "../c", "../../../c", "./", "..", ".", "c/../d",
        "mailto:a@b", "javascript:void(0)", "/a/../b//c", "a//b", "/../x", "http://k/a/../b", "https:foo",
        "/", "c?x=/../y", "d;p", "//x", "c#", "/a/b/.", "  /lead", "a b",
    ]
    rows = [(b, h) for b in bases for h in links]
    df = spark.createDataFrame(rows, "b string, h string")
    for r in df.select("b", "h", resolve_url(F.col("b"), F.col("h")).alias("u")).collect():
        assert r.u == urljoin(r.b, r.h), (r.b, r.h)


def test_resolving_twice_changes_nothing(spark):
    df = spark.createDataFrame([("https://h/a/b", "../c?x#y")], "b string, h string")
    once = resolve_url(F.col("b"), F.col("h"))
    r = df.select(once.alias("once"), resolve_url(F.lit("https://other/x/"), once).alias("twice")).first()
    assert r.once == r.twice == "https://h/c?x#y"


def test_unescape_equals_the_standard_library(spark):
    texts = [
        "a &amp; b", "&amp;lt;", "&copy; &middot; &quot;x&quot;", "&#233;&#x1F600;", "&nope; &", "&;", "x&#0;y",
        "&#xD800;", "no", "&eacute", "&NotEqualTilde; &nbsp;.", "AT&T;", "&#128;", "&amp;&amp;", "&#99999999;",
        "&euro;5 &lt;p&gt;",
    ]
    assert one(spark, texts, "t string", H.unescape(F.col("t"))) == [html.unescape(t) for t in texts]


NESTED = [
    '<div class="toc-tree x"><a href="/1">1</a><div class="y toc-tree"><a class="q" href=\'/2\'>2</a></div>'
    '<a href=/3>3</a></div><div class="other"><a href="/4">4</a></div>',
    '<DIV CLASS=toc-tree><div>deep<a href="/d?x=1&amp;y=2">d</a></div><a data-href="no" href="">e</a></DIV>'
    '<a href="/out">o</a>',
    '<div class="not-toc-tree"><a href="/n">n</a></div><!-- <div class="toc-tree"><a href="/c">c</a></div> -->',
    "<p>nothing</p>",
    '<div class="toc-tree"><a href="/u">u</a> unclosed',
]


class Links(HTMLParser):
    """Links per enclosing toc-tree div, written by hand as the expected result."""

    def __init__(self):
        super().__init__()
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "div":
            hit = "toc-tree" in (attrs.get("class") or "").split()
            links = [] if hit else None
            self.open.append(links)
            if hit:
                self.found.append(links)
        if tag == "a" and "href" in attrs:
            for links in self.open:
                if links is not None:
                    links.append(attrs["href"])

    def handle_endtag(self, tag):
        if tag == "div" and self.open:
            self.open.pop()


def test_links_of_nested_scopes(spark):
    df = spark.createDataFrame([(i, "https://h/toc", p) for i, p in enumerate(NESTED)], "page_id long, url string, html string")
    got = {}
    for r in P.extract_links(df).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.href)
    for i, page in enumerate(NESTED):
        parser = Links()
        parser.feed(page)
        assert got.get(i, []) == [h for links in parser.found for h in links]


def test_frontier(spark):
    df = spark.createDataFrame([(i, "https://h/toc", p) for i, p in enumerate(NESTED)], "page_id long, url string, html string")
    frontier = P.toc_urls(df, base="https://h/base/")
    assert frontier.where("url = 'https://h/2'").count() == 2
    distinct = P.frontier_distinct(frontier)
    assert distinct.count() == frontier.select("url").distinct().count()
    assert [r.url for r in P.frontier_limit(frontier, 2).collect()] == ["https://h/1", "https://h/2"]


class Text(HTMLParser):
    """Text nodes inside the first element of a tag."""

    def __init__(self, tag):
        super().__init__()
        self.tag, self.depth, self.done, self.hidden, self.nodes = tag, 0, False, False, []

    def handle_starttag(self, tag, attrs):
        if tag == self.tag and not self.done:
            self.depth += 1
        self.hidden = tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden = False
        if tag == self.tag and self.depth:
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data):
        if self.depth and not self.hidden:
            self.nodes.append(data)


def test_content_equals_a_parser_on_all_pages(spark, folder):
    import re

    df = spark.read.parquet(f"{folder}/pages.parquet")
    rows = df.select("html", P.extract_content(F.col("html"), "article").alias("c"), P.extract_title(F.col("html"), "h1").alias("t"))
    for r in rows.collect():
        parser = Text("article")
        parser.feed(r.html)
        assert r.c == re.sub(r"\n{2,}", "\n", "\n".join(parser.nodes)).strip(" \n\t\r")
        parser = Text("h1")
        parser.feed(r.html)
        assert r.t == "".join(parser.nodes)


def test_documents_from_pages(spark):
    rows = [
        (1, "u1", '<h1 class="page-title big">T <b>x</b>&amp;</h1><section id="nav">n</section>'
         '<section id="book-content"><h2>A</h2><section>in<script>var t="</section>"</script></section> tail'
         "</section><section>z</section>", 200),
        (2, "u2", '<h2 class="page-title"></h2><section id="other">n</section>', 200),
        (3, "u3", '<section id="book-content">c</section>', 200),
        (4, "u4", '<section id="book-content">never</section>', 404),
    ]
    fetched = spark.createDataFrame(rows, "page_id long, url string, html string, status int")
    docs = P.documents_from_pages(page_source(fetched, "status"))
    got = {r.url: (r.page_title, r.content) for r in docs.collect()}
    assert got == {"u1": ("T x&", "A\nin\n tail"), "u2": ("", None), "u3": (None, "c")}
    assert {r.url for r in drop_null_content(docs).collect()} == {"u1", "u3"}
    assert P.content_counts(docs).first().asDict() == {"n_kept": 2, "n_missing": 1}
    assert {(r.status, r.n_pages) for r in page_status_counts(fetched, "status").collect()} == {(200, 3), (404, 1)}


def test_newlines_and_blanks(spark):
    assert one(spark, ["a\n\n\nb", "a\n \nb"], "t string", X.collapse_newlines(F.col("t"))) == ["a\nb", "a\n \nb"]
    assert one(spark, [" \n\ta b\r\n "], "t string", X.strip_ws(F.col("t"))) == ["a b"]


def test_hidden_markup_in_a_title(spark):
    html = "<h1>Fee<!-- c --> table<script>x()</script> 2</h1><article>a<!-- c -->b</article>"
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    row = P.documents_from_pages(df, "h1", "article").first()
    assert (row.page_title, row.content) == ("Fee table 2", "a\nb")


def test_blanks_of_unicode(spark):
    from lectern.functions.text import BLANKS, strip_ws

    assert all(c.isspace() for c in BLANKS) and len(BLANKS) == sum(chr(i).isspace() for i in range(0x110000))
    df = spark.createDataFrame([(" x y　",)], "t string")
    assert df.select(strip_ws(df.t)).first()[0] == " x y　".strip()


def test_missing_column_is_an_error(spark, tmp_path):
    import pytest

    from lectern.schemas import PAGES
    from lectern.sources import tables

    spark.createDataFrame([(1, "u")], "page_id long, url string").write.parquet(str(tmp_path / "t"))
    with pytest.raises(TypeError, match="html"):
        tables.read_table(spark, str(tmp_path / "t"), PAGES)


def test_stored_pages_are_the_returned_ones(spark, tmp_path):
    from lectern.plans import ingest
    from lectern.schemas import DOCUMENTS
    from lectern.sources import tables

    rows = [(1, "u", "<h1>T</h1><article>x</article>"), (2, "v", "<h1>T</h1>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    target = str(tmp_path / "docs")
    assert ingest.load_pages(spark, df, target, title="h1", content="article").count() == 1
    assert spark.read.parquet(target).count() == 1
    tables.write_table(spark.createDataFrame([("u", None, "x"), ("v", "t", None)], DOCUMENTS), target)
    tables.delete_null_content(spark, target, DOCUMENTS)
    assert [r.url for r in spark.read.parquet(target).collect()] == ["u"]
