"""Pages as tokens: the split is whole and linear, links and tables come from what a browser shows."""

import html
import random
import time

from pyspark.sql import functions as F

from marketfeat.functions import markup
from marketfeat.sources import bars as bar_io
from marketfeat.sources import news as news_io


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


def test_tokens_joined_are_the_page(spark):
    rng = random.Random(1)
    parts = ["<a href='x>y'>", "</a>", "<!-- <a> -->", "<script>if (a<b) '</p>'</script>", "<", ">", "a=\"b", "'", "text ", "<td", "<!doctype html>", "</SCRIPT >", "<b x=\"<\">", "é\n", "<title>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]
    rows = spark.createDataFrame([(p,) for p in pages], "t string").select("t", F.array_join(markup.tokens(F.col("t")), "").alias("again")).collect()
    assert all(r["t"] == r["again"] for r in rows)


def test_links_of_what_a_browser_shows(spark):
    page = """<!-- <a href="/n/1">in a comment, hidden</a> --><script>var s='<a href="/n/2">in a script, hidden</a>'; if (1<2) {}</script>
        <a title="a > b" data-x='href="/n/98"' href="/n/3">greater sign in quotes</a><a title="see href=/n/97 here" HREF = '/n/4'>href in a quoted value</a>
        <a href=/n/5>caf&eacute; &#8364;&#x20AC; &amp;lt; &unknown; 1 < 2</a><style>a > b {}</style><A class=a/b href="/n/6?a=1&amp;b=2"><b title="</a>">an end in quotes</b></A>
        <a name=n>no target</a><a data-href="/n/7">another name, no target</a><a href="/n/8">cut off by the end</a><a href="/n/9">never <!-- closed </a>"""
    pages = spark.createDataFrame([("https://a.example/", page), ("https://a.example/", None), ("https://a.example/", "")], "url string, html string")
    got = {(r["url"], r["title"]) for r in news_io.extract_links(pages, r"/n/(\d+)").collect()}
    assert got == {
        ("https://a.example/n/3", "greater sign in quotes"), ("https://a.example/n/4", "href in a quoted value"),
        ("https://a.example/n/5", "café €€ &lt; &unknown; 1 < 2"), ("https://a.example/n/6", "an end in quotes"), ("https://a.example/n/8", "cut off by the end"),
    }


def test_tables_of_what_a_browser_shows(spark):
    row = "<tr x='>'><td>2024-01-05</td><!-- <td>9</td> --><td title='>'>1</td><td>2</td><td><b>3</b></td><td>4&nbsp;</td><td>5</td></tr>"
    page = f"""<!-- <table id="historicalTable"><tbody>{row}</tbody></table> --><table data-id="historicalTable"><tbody></tbody></table>
        <TABLE title="a > b" ID='historicalTable'><tbody>{row}</tbody></table>"""
    got = [tuple(r) for r in bar_io.parse_html_table(spark.createDataFrame([("A", page)], "symbol string, html string")).collect()]
    assert [g[1:] for g in got] == [("A", 1.0, 2.0, 3.0, 4.0, 5.0)]


def test_entities(spark):
    texts = ["&copy;&middot;&hellip;&quot;&apos;", "&#65;&#x41;&#X1F600;&#128;&#153;&#0;&#xD800;&#1114112;&#99999999999999;", "&amp;amp; &amp;#65; a&b;&;&&lt;", "&NotEqualTilde; &nosuchname; &#; &#x;", "no reference", ""]
    for text in texts:
        assert one(spark, text, markup.decode_entities) == html.unescape(text), text
    assert one(spark, "a&nbsp;b&#160;c", markup.decode_entities) == "a b c"
    assert one(spark, None, markup.decode_entities) is None


def test_long_and_broken_pages_take_linear_time(spark):
    one(spark, "<a href=x>", lambda c: markup.normal_form(c, {"a": "href"}))
    n = 300_000
    for page in ("<" * n, "<a " * n, "<a href=\"" * n, "<!-- " * n, "<script>" * n, "x" * n, "<a x='" + "y" * n, "<a" + " k=v" * n + " href=z>", "&" * n, "<a href='" + ">" * n + "'>"):
        start = time.time()
        one(spark, page, lambda c: markup.decode_entities(markup.normal_form(c, {"a": "href"})))
        assert time.time() - start < 10, page[:20]
