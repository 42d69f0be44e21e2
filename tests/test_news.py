"""Sentiment, joins of prices and news, parsers, work lists."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from marketfeat.functions import fixed_values
from marketfeat.operators import joins, sentiment
from marketfeat.plans import pipeline
from marketfeat.sources import bars as bar_io
from marketfeat.sources import news as news_io
from marketfeat.sources import worklists


def day(n):
    return dt.date(2024, 1, n)


@pytest.mark.parametrize("logits,label,sign", [
    ([2.0, 1.0, 0.0], "positive", 1), ([0.0, 3.0, 1.0], "negative", -1), ([0.0, 0.0, 9.0], "neutral", 0), ([1.0, 1.0, 1.0], "positive", 1),
])
def test_logits(spark, logits, label, sign):
    row = sentiment.with_sentiment(spark.createDataFrame([(logits,)], "logits array<double>")).first()
    p = round(math.exp(max(logits)) / sum(math.exp(x) for x in logits), 6)
    assert (row["sentiment_label"], row["sentiment_score"], row["sentiment_compound"]) == (label, p, sign * p)


def test_model_scorer_equals_the_word_counts(spark):
    df = spark.createDataFrame([(1, "good good bad"), (2, "BAD"), (3, None), (4, "goodness")], "id int, title string")

    def factory():
        return lambda texts: [[t.lower().split().count("good"), t.lower().split().count("bad"), 0.5] for t in texts]

    key = lambda d: sorted((r["id"], r["sentiment_label"], r["sentiment_compound"]) for r in d.collect())
    assert key(sentiment.score_text(df, model_factory=factory, batch=2)) == key(
        sentiment.score_text(df, positive=["good"], negative=["bad"]))


ARTICLES = [
    (day(1), "macro", "b title", 0.5), (day(1), "macro", "A title", 0.25), (day(1), "energy", None, -0.5),
    (day(3), "macro", "c", 1.0), (day(6), "macro", "d", -1.0), (day(7), "energy", "e", 0.75),
]
DDL = "date date, category string, title string, sentiment_compound double"


def test_links_in_any_quotes(spark):
    html = """<a class=x href='/n/1'>single quoted one</a><a href=/n/2>a bare target too</a>
        <A HREF="/n/3" id='b'>double quoted one</A><a href="">no target at all</a>"""
    pages = spark.createDataFrame([("https://a.example/", html)], "url string, html string")
    got = {(r["url"], r["title"]) for r in news_io.extract_links(pages, r"/n/(\d+)").collect()}
    assert got == {
        ("https://a.example/n/1", "single quoted one"), ("https://a.example/n/2", "a bare target too"),
        ("https://a.example/n/3", "double quoted one"),
    }


def test_daily_sentiment(spark):
    articles = spark.createDataFrame(ARTICLES, DDL)
    rows = {(r["date"], r["category"]): r for r in sentiment.daily_scores(articles).collect()}
    assert rows[(day(1), "macro")]["sentiment_macro"] == 0.375 and rows[(day(1), "macro")]["sentiment_energy"] == 0.0
    assert rows[(day(1), "energy")]["sentiment_energy"] == -0.5
    assert len(rows) == 5
    titles = sentiment.daily_titles(articles)
    first = [(r["rank"], r["title"]) for r in titles.filter("category = 'macro'").orderBy("date", "rank").collect()]
    assert first == [(1, "A title"), (2, "b title"), (1, "c"), (1, "d")]
    cells = {(r["date"], r["category"]): r["title"] for r in sentiment.title_cells(titles, 10).collect()}
    assert cells[(day(1), "macro")] == "A title | b title" and (day(1), "energy") not in cells


def test_daily_titles_have_one_shape_and_the_whole_order_at_every_size(spark):
    few = sentiment.daily_titles(spark.createDataFrame([(day(1), "macro", f"t{i}", 0.5) for i in range(10)], DDL))
    ids = spark.range(200_000).select(
        F.lit(day(1)).alias("date"), F.lit("macro").alias("category"), F.lit(0.5).alias("sentiment_compound"),
        F.concat(F.lit("x" * 130), F.lpad((F.col("id") * 7919 % 200_000).cast("string"), 6, "0")).alias("title"),
    )
    many = sentiment.daily_titles(ids)
    assert few.dtypes == many.dtypes and few.count() == 10
    wrong = many.filter(F.col("rank") - 1 != F.substring("title", 131, 6).cast("long")).count()
    assert many.count() == 200_000 and wrong == 0
    assert sentiment.daily_scores(ids).count() == 1
    cells = sentiment.title_cells(few, 4).orderBy("part").collect()
    assert [r["title"] for r in cells] == ["t0 | t1 | t2 | t3", "t4 | t5 | t6 | t7", "t8 | t9"]


def test_price_join_lags_fills_and_ignores_days_without_prices(spark):
    prices = spark.createDataFrame(
        [(t, day(n)) for n in (2, 3, 4, 6, 8) for t in ("A", "B")] + [("Z", day(6))], "ticker string, date date")
    merged = pipeline.merge_prices(prices, spark.createDataFrame(ARTICLES, DDL), {"A": "macro", "B": "energy", "C": "forex"})
    got = {(r["ticker"], r["date"].day): r["sentiment"] for r in merged.collect()}
    # macro news on days 1, 3, 6: day 3 gets day 1's value, day 6 gets day 3's. energy: day 7 is no price date.
    assert {k[1]: v for k, v in got.items() if k[0] == "A"} == {2: 0.0, 3: 0.375, 4: 0.375, 6: 1.0, 8: 1.0}
    assert {k[1]: v for k, v in got.items() if k[0] == "B"} == {2: 0.0, 3: 0.0, 4: 0.0, 6: 0.0, 8: 0.0}
    assert len(got) == 10
    assert joins.require_consistent(merged) is merged
    with pytest.raises(ValueError):
        joins.require_consistent(merged, by=["date"])
    assert "sentiment_macro" in joins.category_view(merged, "macro").columns


def test_news_flags_and_decay(spark):
    articles = spark.createDataFrame(
        [(1, day(1), "macro", "Lucky wins; LUCKY again", 1.0), (2, day(1), "macro", "cement", 0.0), (3, day(4), "energy", "unlucky lucky", -0.5)],
        "id int, date date, category string, title string, sentiment_compound double")
    prices = spark.createDataFrame([("LUCK", day(n)) for n in (1, 2, 4, 5)], "ticker string, date date")
    dim = {"LUCK": "macro"}
    words = {"lucky": "LUCK", "cement": "LUCK"}
    rows = {r["date"].day: tuple(r)[2:] for r in joins.join_news_flags(prices, articles, dim, words).collect()}
    assert rows == {1: (0.5, 0.5, 2), 2: (0.0, 0.0, 0), 4: (0.0, -0.5, 0), 5: (0.0, 0.0, 0)}
    table = spark.createDataFrame(list(words.items()), "word string, ticker string")
    again = joins.join_news_flags(prices, articles, dim, table)
    assert {r["date"].day: tuple(r)[2:] for r in again.collect()} == rows
    decay = {r["date"].day: r for r in joins.join_news_decay(prices, articles, dim, words, half_life=1.0).collect()}
    assert [round(decay[n]["sentiment_relevant"], 9) for n in (1, 2, 4, 5)] == [0.5, 0.25, 0.0625, 0.03125]
    assert [round(decay[n]["sentiment_ticker"], 9) for n in (1, 2, 4, 5)] == [0.5, 0.25, -0.5, -0.25]


def test_ticker_lookup_by_dictionary_and_table(spark):
    dim = joins.ticker_dimension(fixed_values.CATEGORY_TICKERS)
    assert len(dim) == 30
    df = spark.createDataFrame([("hbl",), ("XYZ",)], "ticker string")
    want = {"hbl": "banking", "XYZ": "unassigned"}
    assert {r[0]: r[1] for r in joins.ticker_category(df, dim).collect()} == want
    table = spark.createDataFrame(list(dim.items()), "ticker string, category string")
    assert {r["ticker"]: r["category"] for r in joins.ticker_category(df, table).collect()} == want
    assert [r[0] for r in joins.unassigned(df, table).collect()] == ["XYZ"]


# -- parsers ------------------------------------------------------------------------

def test_html_table(spark):
    cells = lambda *c: "<tr>" + "".join(f"<td class='x'>{v}</td>" for v in c) + "</tr>"
    body = "\n".join([
        cells("Jan 5, 2024", " 1,234.50 ", "1,300", "<b>1,200</b>", "1,250.25", "10,000"),
        cells("2024-01-04", "1", "n/a", "3", "4", "5"), cells("someday", "1", "2", "3", "4", "5"),
        cells("Jan 6, 2024", "1", "2", "3", "-", "5"), cells("Jan 7, 2024", "1", "2"),
    ])
    page = f'<p><table id="other"><tbody>{cells(*"abcdef")}</tbody></table><TABLE class="t" id="historicalTable"><thead></thead><TBODY>{body}</TBODY></TABLE>'
    df = spark.createDataFrame([("A", page), ("B", "<p>no table</p>")], "symbol string, html string")
    got = [tuple(r) for r in bar_io.parse_html_table(df).orderBy("date").collect()]
    assert got == [(day(4), "A", 1.0, None, 3.0, 4.0, 5.0), (day(5), "A", 1234.5, 1300.0, 1200.0, 1250.25, 10000.0)]


def test_links(spark):
    html = ('<a class="c" href="/news/11?x=1">First <b>article</b> &amp; more</a><a href="https://site.com/news/12/">Second article</a>'
            '<a href="//site.com/news/13">Third article</a><a href="14">Fourth article</a><a href="/news/15">short</a>'
            '<a href="/sport/16">Sixth article here</a><a href="/news/99">Pinned article</a><a\nhref="/news/17#c">\n Seventh article</a>')
    df = spark.createDataFrame([("https://site.com/news/", html)], "url string, html string")
    got = {tuple(r) for r in news_io.extract_links(df, r"site\.com/news/(\d+)", exclude_ids=["99"]).collect()}
    assert got == {("https://site.com/news/11", "First article & more"), ("https://site.com/news/12", "Second article"),
                   ("https://site.com/news/13", "Third article"), ("https://site.com/news/14", "Fourth article"),
                   ("https://site.com/news/17#c", "Seventh article")}


def test_json_feed(spark):
    payload = json.dumps([
        {"NewsID": 1, "Link": "a-1", "CategoryName": "Eco", "ModifyDateTime": "2024-01-05T10:00:00",
         "Headings": {"Heading": ["H1", "x"]}, "Descriptions": {"Description": ["d" * 400]}},
        {"newsId": "2", "publishedTime": "2024-01-06", "headings": {"heading": "H2"}, "descriptions": {"description": "plain"}},
        {"newsID": 3, "Headings": {"Heading": []}}, {"Headings": {"Heading": ["no id"]}}, {"NewsId": 5, "NewsID": "", "Headings": {"heading": ["H5"]}},
    ])
    df = spark.createDataFrame([(payload,), ("{}",), ("nonsense",), (None,)], "payload string")
    got = {r["id"]: r for r in news_io.parse_json_items(df, base_url="u/").collect()}
    assert set(got) == {"1", "2", "5"}
    assert (got["1"]["title"], got["1"]["date"], got["1"]["url"], len(got["1"]["description"])) == ("H1", "2024-01-05", "u/a-1", 300)
    assert (got["2"]["title"], got["2"]["date"], got["2"]["url"], got["2"]["description"]) == ("H2", "2024-01-06", "u/-2", "plain")
    assert (got["5"]["title"], got["5"]["description"]) == ("H5", "")


def test_announcement_rows(spark):
    rows = [
        (1, ["10:30 AM", "Jan 05, 2024", "Habib Bank Limited", "Board Meeting in progress", "View PDF"]),
        (2, ["Jan 05, 2024", "Habib Bank Limited", "View PDF"]), (3, ["Jan 05, 1999", "Board meeting"]),
        (4, ["Jan 05, 2028", "Board meeting"]), (5, ["no date", "Board meeting"]), (6, ["Jan 05, 2024"]),
        (7, ["Jan 05, 2024", "aaaaaaa", "bbbbbbb"]), (8, ["Feb 5, 2024", "short", "Notice View PDF"]),
    ]
    df = spark.createDataFrame(rows, "id int, cells array<string>")
    got = {r["id"]: (r["date"], r["title"]) for r in news_io.parse_announcement_rows(df, fixed_values.ANNOUNCEMENT_RULES, keep=["id"]).collect()}
    assert got == {1: ("Jan 05, 2024", "Board Meeting in progress"), 7: ("Jan 05, 2024", "aaaaaaa"), 8: ("Feb 05, 2024", "Notice")}


# -- files and work lists -----------------------------------------------------------

def test_read_bars(spark, tmp_path):
    good = str(tmp_path / "good.csv")
    with open(good, "w") as f:
        f.write("date,ticker,open,high,low,close,volume,extra\n2024-01-05,A,1,2,0.5,x,10,?\n")
    row = bar_io.read_bars(spark, good).first()
    assert row["date"] == day(5) and row["close"] is None and row["open"] == 1.0
    for name, body in (("short.csv", "date,ticker\n2024-01-05,A\n"), ("empty.csv", "date,ticker,open,high,low,close,volume\n")):
        path = str(tmp_path / name)
        with open(path, "w") as f:
            f.write(body)
        with pytest.raises(ValueError):
            bar_io.read_bars(spark, path)


def test_read_articles(spark, tmp_path):
    with open(tmp_path / "a.csv", "w") as f:
        f.write('id,date,title\n007,2024-01-05,"A, ""quoted""\ntitle"\n')
    spark.createDataFrame([(8, "T")], "id int, title string").write.parquet(str(tmp_path / "b"))
    got = news_io.read_articles(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b"), "c": str(tmp_path / "c")})
    assert {(r["id"], r["source"], r["title"], r["date"]) for r in got.collect()} == {
        ("007", "a", 'A, "quoted"\ntitle', "2024-01-05"), ("8", "b", "T", None)}
    with pytest.raises(FileNotFoundError):
        news_io.read_articles(spark, {"c": str(tmp_path / "c")})


def test_write_partitioned_and_scaler(spark, tmp_path):
    df = spark.createDataFrame([("A", day(1), "macro"), ("B", day(2), "energy")], "ticker string, date date, category string")
    bar_io.write_partitioned(df, str(tmp_path / "p"))
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == ["category=energy", "category=macro"]
    state = spark.createDataFrame([("A", "x", 1.0, 2.0)], "ticker string, feature string, mean double, scale double")
    bar_io.write_scaler(state, str(tmp_path / "s"))
    assert bar_io.read_scaler(spark, str(tmp_path / "s"), ["A"]).count() == 1
    with pytest.raises(ValueError):
        bar_io.read_scaler(spark, str(tmp_path / "s"), ["A", "B"])


def test_worklists(spark):
    symbols = spark.createDataFrame([("A",), ("B",)], "symbol string")
    months = worklists.month_worklist(symbols, "2023-11-30", "2024-01-01")
    assert sorted(tuple(r) for r in months.collect()) == [(s, y, m) for s in "AB" for y, m in ((2023, 11), (2023, 12), (2024, 1))]
    work = worklists.date_worklist(symbols, "2024-02-28", "2024-03-01")
    assert work.count() == 6
    kinds = worklists.type_worklist(symbols, list(fixed_values.ANNOUNCEMENT_TYPES), fixed_values.MARKET_TYPE)
    assert kinds.count() == 13
    have = work.filter("symbol = 'A' or date = '2024-02-29'")
    gaps = worklists.coverage_gaps(work, have, ["symbol", "date"]).collect()
    assert {(r["symbol"], str(r["date"])) for r in gaps} == {("B", "2024-02-28"), ("B", "2024-03-01")}


def test_merged_news(spark):
    from marketfeat.functions.rules import RelevanceRules

    a = spark.createDataFrame([("2024-01-02", "equities|macro", "Index up"), ("bad", "macro", "No date"), ("2024-01-02", "sport", "x")],
                              "date string, category string, title string")
    b = spark.createDataFrame([("2024-01-01", "economy", None, "index UP!"), ("2024-01-03", "economy", "forex", "Asia falls"),
                               ("2024-01-03", "economy", "banking", "Deposits rise")],
                              "date string, category string, subcategory string, title string")
    got = pipeline.merged_news({"dawn": a, "mettis": b}, fixed_values.CATEGORY_MAP, fixed_values.SOURCE_PRIORITY,
                               RelevanceRules(foreign=("^asia",)), fixed_values.CATEGORY_COLUMNS)
    assert {tuple(r) for r in got.collect()} == {(day(1), "mettis", "macro", "index UP!"), (day(3), "mettis", "banking", "Deposits rise")}
    assert F is not None
