"""One query per operator. Every query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.functions import numeric, text
from marketfeat.operators import (
    dataset, dedup, features, gates, indicators, joins, ledger, metrics, models, reports, rule_index, scans, sentiment, series,
)
from marketfeat.plans import pipeline
from marketfeat.session import checkpointed, durable_path
from marketfeat.sources import bars as bar_io
from marketfeat.sources import news as news_io
from marketfeat.sources import worklists
from marketfeat.streaming import corrections, streams
from registry import roles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r(name: str, digits: int = 6, alias: str | None = None) -> Column:
    """Rounded column; adding 0.0 turns -0.0 into 0.0."""
    return (F.round(F.col(f"`{name}`"), digits) + F.lit(0.0)).alias(alias or name)


# Prices are cents over a quantity up to 50 and may end in a 5 at the 7th digit.
EXACT = {"open", "high", "low", "close", "ldcp", "true_range", "lowest", "highest"}


def rounded(df: DataFrame, keys: list[str], cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[r(c, 8 if c in EXACT else digits) for c in cols])


TD = ["ticker", "date"]
OHLC = ["open", "high", "low", "close", "volume"]


# -- sources and sinks --------------------------------------------------------------

@query
def read_bars(spark, sf):
    path = durable_path(spark, "bars") + "_csv"
    roles.bars(spark, sf).write.option("header", True).csv(path)
    return rounded(bar_io.read_bars(spark, path), TD, OHLC)


def stored_sources(spark, sf, root: str) -> list[str]:
    """Articles stored by source; the names of the sources, one row each."""
    a = roles.articles(spark, sf).filter("source IS NOT NULL")
    a.write.partitionBy("source").parquet(root)
    return sorted(x[0] for x in roles.table(spark, sf, "documents").select("source").distinct().collect() if x[0] is not None)


@query
def read_articles(spark, sf):
    root = durable_path(spark, "articles")
    names = stored_sources(spark, sf, root)
    found = news_io.read_articles(spark, {**{s: f"{root}/source={s}" for s in names}, "none": f"{root}/none"})
    return found.select("id", "source", "date", "title")


@query
def extract_links(spark, sf):
    pages = roles.table(spark, sf, "pages")
    return news_io.extract_links(
        pages, r"example\.(?:com|org|net)/([^/?#]+)", exclude_ids=("laleenéelle", "about"), keep=("page_id",)
    )


@query
def extract_links_hidden(spark, sf):
    """The same links from pages that also hold links in comments and scripts, and ends of tags in attributes."""
    hidden = '<a href="http://example.com/thing/1">a link that is not shown</a>'
    html = F.replace("html", F.lit("<a href"), F.lit("""<a data-x='href="y"' title="1 > 0" href"""))
    html = F.concat(F.lit(f"<!-- {hidden} --><script>var s = '{hidden}';</script>"), html, F.lit(f"<style>{hidden}</style><!-- {hidden}"))
    pages = roles.table(spark, sf, "pages").withColumn("html", html)
    return news_io.extract_links(
        pages, r"example\.(?:com|org|net)/([^/?#]+)", exclude_ids=("laleenéelle", "about"), keep=("page_id",)
    )


@query
def parse_html_table(spark, sf):
    """Price pages per ticker and month, made from the bars, parsed back."""
    b = roles.bars(spark, sf)
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(
        F.lit("<tr>"), cell(F.date_format("date", "MMM d, yyyy")),
        *[cell(F.format_number(c, 8)) for c in ("open", "high", "low", "close")],
        cell(F.format_number("volume", 0)), F.lit("</tr>\n"),
    )
    pages = b.select("ticker", F.trunc("date", "MM").alias("month"), row.alias("row")).groupBy("ticker", "month").agg(
        F.concat(
            F.lit('<html><table class="t" id="historicalTable"><thead><tr><th>d</th></tr></thead><tbody>'),
            F.array_join(F.collect_list("row"), ""),
            F.lit("<tr><td>n/a</td><td>1</td></tr></tbody></table></html>"),
        ).alias("html")
    ).select(F.col("ticker").alias("symbol"), "html")
    return bar_io.parse_html_table(pages).select(*TD, *OHLC)


@query
def parse_json_items(spark, sf):
    """A feed payload per document, in the spellings the feed uses, parsed back."""
    a = roles.articles(spark, sf)
    quoted = lambda c: F.get(F.split(F.to_json(F.struct(c.alias("v"))), '^\\{"v":|\\}$'), 1)
    title, note = quoted(F.col("title")), quoted(F.col("title"))
    key = F.element_at(F.array(*[F.lit(k) for k in news_io.ID_KEYS]), (F.col("doc_id") % 4 + 1).cast("int"))
    heading = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), title, F.lit(', "second"]'))).otherwise(title)
    payload = F.concat(
        F.lit('[{"'), key, F.lit('":'), F.col("id"), F.lit(',"ModifyDateTime":"'), F.col("date").cast("string"),
        F.lit('T08:30:00","categoryName":"'), F.col("source"), F.lit('","Headings":{"Heading":'), heading,
        F.lit('},"descriptions":{"Description":['), note, F.lit("]}"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(',"link":"n-'), F.col("id"), F.lit('"'))).otherwise(""),
        F.lit('},{"Headings":{"Heading":"no id"}}]'),
    )
    return news_io.parse_json_items(a.select(payload.alias("payload")), base_url="https://feed.example.org/")


@query
def parse_event_props(spark, sf):
    """The JSON column of the events, by the same variant access."""
    e = roles.table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query
def parse_announcement_rows(spark, sf):
    a = roles.announcements(spark, sf)
    cells = F.array(
        F.lit("10:30 AM"), F.concat(F.lit(" "), F.col("date")), F.concat(F.lit("Company "), F.col("symbol"), F.lit(" Limited")),
        F.col("title"), F.lit("View PDF"),
    )
    rows = a.withColumn("cells", cells)
    return news_io.parse_announcement_rows(rows, roles.ANNOUNCEMENTS, year_from=2020, year_to=2021, keep=["conv_id", "turn"])


@query
def month_worklist(spark, sf):
    symbols = roles.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    return worklists.month_worklist(symbols, "2010-01-15", "2011-03-02")


@query
def date_worklist(spark, sf):
    kinds = roles.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    days = worklists.date_worklist(kinds, "2024-02-27", "2024-03-02")
    return days.select("symbol", "date")


@query
def type_worklist(spark, sf):
    symbols = roles.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    return worklists.type_worklist(symbols, ("C", "E", "D"), "E")


@query
def coverage_gaps(spark, sf):
    b = roles.bars(spark, sf)
    spans = b.groupBy(F.col("ticker").alias("symbol")).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    work = worklists.date_worklist(spans, F.col("lo"), F.col("hi")).select("symbol", "date")
    have = b.select(F.col("ticker").alias("symbol"), "date")
    return worklists.coverage_gaps(work, have, ["symbol", "date"])


def _spans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The years 1995 to 1999 for every brand of the parts, and the days with bars."""
    spans = roles.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct().select(
        "symbol", F.lit("1995-01-01").cast("date").alias("lo"), F.lit("1999-12-31").cast("date").alias("hi"))
    return spans, roles.bars(spark, sf).select(F.col("ticker").alias("symbol"), "date")


@query
def coverage_ranges(spark, sf):
    """Missing days of five years as ranges."""
    return worklists.coverage_ranges(*_spans(spark, sf))


@query
def coverage_months(spark, sf):
    """Months of the ranges, and how many days of each are missing."""
    return worklists.month_ranges(worklists.coverage_ranges(*_spans(spark, sf)))


@query
def covered_ranges(spark, sf):
    """Runs of days with bars; three days apart still belong to one run."""
    return worklists.covered_ranges(_spans(spark, sf)[1], most=3)


@query
def date_range_mask(spark, sf):
    return rounded(worklists.in_range(roles.bars(spark, sf), "1997-01-01", "1998-06-30"), TD, ["close"])


@query
def write_partitioned(spark, sf):
    path = durable_path(spark, "by-category")
    dim = joins.ticker_dimension(roles.TICKER_CATEGORIES)
    bar_io.write_partitioned(joins.ticker_category(roles.bars(spark, sf), {k.upper(): v for k, v in dim.items()}), path)
    back = spark.read.parquet(path)
    return back.select("ticker", "date", r("close", 8), F.col("category").cast("string").alias("category"))


@query
def bucketed_changes(spark, sf):
    """Bars and their changes stored by ticker in buckets, opened again and joined."""
    root = durable_path(spark, "bucketed")
    name = root.rsplit("-", 1)[1]
    bars = bar_io.write_bucketed(roles.bars(spark, sf), f"bars_{name}", f"{root}/bars", 8)
    changed = indicators.ldcp_change(bars).select(*TD, "ldcp", "change", "change_pct")
    bar_io.write_bucketed(changed, f"changes_{name}", f"{root}/changes", 8)
    changes = bar_io.open_bucketed(spark, f"again_{name}", f"{root}/changes", 8)
    return bars.join(changes, TD).select(*TD, r("close", 8), r("ldcp", 8), r("change", 2), r("change_pct", 2))


@query
def write_scaler_state(spark, sf):
    path = durable_path(spark, "scaler")
    split = dataset.split_by_order(roles.labelled(spark, sf))
    bar_io.write_scaler(dataset.scaler_fit(split, roles.SMALL_FEATURES), path)
    return bar_io.read_scaler(spark, path).select("ticker", "feature", r("mean", 4), r("scale", 4), "train_end_date")


@query
def symbol_clean(spark, sf):
    c = roles.table(spark, sf, "customer")
    suffix = F.element_at(F.array(F.lit(".ka "), F.lit(".PK"), F.lit(".KA.KA"), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int"))
    raw = F.concat(F.lit("  "), F.lower("c_name"), suffix)
    return c.select("c_custkey", text.symbol_clean(raw).alias("symbol"))


# -- filters and cleaning -----------------------------------------------------------

@query
def clean_bars(spark, sf):
    return rounded(indicators.clean_bars(roles.bars(spark, sf)), TD, OHLC)


@query
def drop_incomplete(spark, sf):
    changed = indicators.ldcp_change(roles.bars(spark, sf))
    return rounded(indicators.drop_incomplete(changed), TD, ["ldcp", "close"])


@query
def drop_warmup(spark, sf):
    changed = indicators.ldcp_change(roles.bars(spark, sf))
    return rounded(indicators.drop_warmup(changed), TD, ["ldcp", "close"])


@query
def noise_filter(spark, sf):
    return rounded(features.noise_filter(roles.clean(spark, sf)), TD, ["close", "next_ret"])


@query
def headline_gate(spark, sf):
    return gates.headline_gate(roles.articles(spark, sf), roles.HEADLINES).select("id", "title")


@query
def headline_gate_desc(spark, sf):
    kept = gates.headline_gate(
        roles.articles(spark, sf), roles.HEADLINES, ("title", "description"), anchor=False, feed_col="category"
    )
    return kept.select("id", "category")


@query
def relevance_cascade(spark, sf):
    a = roles.articles(spark, sf)
    return a.select("id", gates.relevant(F.col("title"), roles.RELEVANCE).cast("int").alias("relevant"))


@query
def headline_gate_table(spark, sf):
    """The gates by a table of some 50 000 rules, found as runs of words."""
    kept = rule_index.headline_gate_table(roles.articles(spark, sf), roles.rule_table(spark, sf))
    return kept.select("id", "labels")


@query
def relevance_cascade_table(spark, sf):
    decided = rule_index.relevance_table(roles.articles(spark, sf), roles.rule_table(spark, sf))
    return decided.select("id", F.col("relevant").cast("int").alias("relevant"))


@query
def announcement_clean(spark, sf):
    return gates.announcement_clean(roles.announcements(spark, sf), roles.ANNOUNCEMENTS).select("conv_id", "turn", "title")


@query
def project_reorder(spark, sf):
    return roles.bars(spark, sf).select("date", "ticker", *[r(c, 8) for c in OHLC])


@query
def clip(spark, sf):
    e = roles.table(spark, sf, "events")
    return e.select("event_id", numeric.clip(F.nullif(F.col("value"), F.lit(1.0)), 2.0, 9.5).alias("value"))


# -- joins --------------------------------------------------------------------------

@query
def map_category(spark, sf):
    return gates.map_category(roles.articles(spark, sf), roles.CATEGORY_TABLE).select("id", "category")


@query
def map_category_subcategory(spark, sf):
    a = roles.articles(spark, sf).withColumn("subcategory", F.when(F.col("doc_id") % 3 == 0, F.lit("Rates|macro")))
    mapped = gates.map_category(a, roles.CATEGORY_TABLE, ("subcategory", "category"))
    return mapped.select("id", "category")


def _dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Ticker dimension as a table: brands whose parts have a mean size of 25.5 or more, by their first type."""
    brands = roles.table(spark, sf, "part").groupBy(F.col("p_brand").alias("ticker"))
    sizes = brands.agg(F.min("p_type").alias("category"), F.sum("p_size").alias("size"), F.count(F.lit(1)).alias("parts"))
    return sizes.filter("2 * size >= 51 * parts").select("ticker", "category")


@query
def ticker_category(spark, sf):
    dim = {k.upper(): v for k, v in joins.ticker_dimension(roles.TICKER_CATEGORIES).items()}
    return joins.ticker_category(roles.bars(spark, sf), dim).select("ticker", "date", "category")


@query
def ticker_category_table(spark, sf):
    return joins.ticker_category(roles.bars(spark, sf), _dimension(spark, sf)).select("ticker", "date", "category")


@query
def unassigned_tickers(spark, sf):
    return joins.unassigned(roles.bars(spark, sf), _dimension(spark, sf))


def _dim() -> dict[str, str]:
    return joins.ticker_dimension(roles.TICKER_CATEGORIES)


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.merge_prices(roles.clean(spark, sf), roles.scored_articles(spark, sf), _dim())


@query
def price_sentiment_join(spark, sf):
    return rounded(_merged(spark, sf), ["ticker", "date", "category"], ["close", "sentiment"])


@query
def category_view(spark, sf):
    return rounded(joins.category_view(_merged(spark, sf), "macro"), TD, ["close", "sentiment_macro"])


@query
def broadcast_check(spark, sf):
    return joins.broadcast_check(roles.bars(spark, sf), "high", ["date"]).select("date", r("lowest", 8), r("highest", 8))


@query
def news_features_join(spark, sf):
    flags = joins.join_news_flags(roles.clean(spark, sf), roles.scored_articles(spark, sf), _dim(), roles.MENTIONS)
    return flags.select(*TD, r("sentiment_relevant", 10), r("sentiment_ticker", 10), "news_count")


@query
def news_decay_join(spark, sf):
    decay = joins.join_news_decay(roles.clean(spark, sf), roles.scored_articles(spark, sf), _dim(), roles.MENTIONS, half_life=3.7)
    return decay.select(*TD, r("sentiment_relevant", 10), r("sentiment_ticker", 10), "news_count")


@query
def seen_anti_join(spark, sf):
    seen = roles.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return dedup.seen_anti_join(roles.articles(spark, sf), seen).select("id", "source")


def _feed(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The articles as three deliveries: the first ten days of the month, the next ten, the rest."""
    a = roles.articles(spark, sf)
    day = F.dayofmonth("date")
    return [a.filter(day <= 10), a.filter((day > 10) & (day <= 20)), a.filter(day > 20)]


@query
def seen_ledger(spark, sf):
    """First article of each normalized title over three deliveries, the second delivered twice."""
    seen = ledger.SeenLedger(spark, durable_path(spark, "ledger"), buckets=32, cells=1 << 16)
    first, second, third = _feed(spark, sf)
    key = F.nullif(text.normalize_title(F.coalesce("title", F.lit(""))), F.lit(""))
    admitted = {}
    for number, batch in ((1, first), (2, second), (2, second), (3, third)):
        admitted[number] = seen.admit(batch, number, key, ["doc_id"]).select("id", F.lit(number).alias("batch"))
    return admitted[1].union(admitted[2]).union(admitted[3])


@query
def seen_ledger_batches(spark, sf):
    """How many new ids each delivery brings when each brings the whole month so far, and one comes again."""
    seen = ledger.SeenLedger(spark, durable_path(spark, "ledger"), buckets=16, cells=1 << 16)
    first, second, third = _feed(spark, sf)
    for number, batch in ((1, first), (2, first.union(second)), (1, first), (3, first.union(second).union(third)), (3, third)):
        seen.admit(batch, number, "id", ["doc_id"])
    return seen.batches()


@query
def stream_new_keys(spark, sf):
    """First arrivals of each (type, hour) of the events, from files by day of the month."""
    root = durable_path(spark, "events")
    events = roles.table(spark, sf, "events").select("event_id", "ts", "event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))
    events.repartition(4, "event_type").write.parquet(root)
    sdf = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(root)
    seen = ledger.SeenLedger(spark, durable_path(spark, "ledger"), buckets=16, cells=1 << 16)
    new = streams.stream_new_keys(sdf, seen, F.concat_ws("|", "event_type", "hour"), ["event_id"], durable_path(spark, "new"))
    return new.select("event_id", "event_type", "hour")


# -- deduplication ------------------------------------------------------------------

@query
def dedup_bars(spark, sf):
    """Lines as bars: many per (date, ticker)."""
    lines = roles.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("ticker"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )
    return dedup.dedup_bars(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])


@query
def dedup_url_title(spark, sf):
    return dedup.dedup_url_title(roles.articles(spark, sf), ["doc_id"]).select("id", "url")


@query
def url_feed(spark, sf):
    """Dedup by URL and title, then the gates, then labels."""
    return pipeline.process_url_feed(roles.articles(spark, sf), roles.HEADLINES, ["doc_id"]).select("id", "category")


@query
def dedup_date_title(spark, sf):
    """The gates, labels, then dedup by title."""
    return pipeline.process_title_feed(roles.articles(spark, sf), roles.HEADLINES, ["doc_id"]).select("id", "category")


@query
def dedup_id_title(spark, sf):
    twice = roles.articles(spark, sf).withColumn("id", F.floor(F.col("doc_id") * 2 / 3).cast("string"))
    return dedup.dedup_id_title(twice, ["doc_id"]).select("id", "doc_id")


@query
def id_feed(spark, sf):
    """Dedup by id and title, gates over title and description, then labels."""
    return pipeline.process_id_feed(roles.articles(spark, sf), roles.HEADLINES, ["doc_id"]).select("id", "subcategory")


@query
def dedup_cross_source(spark, sf):
    a = roles.articles(spark, sf)
    return dedup.dedup_cross_source(a, roles.PRIORITY, tie=["source", "doc_id"]).select("id", "date", "source")


@query
def dedup_announcements(spark, sf):
    a = roles.announcements(spark, sf).withColumn("title", F.substring_index("title", " ", 1))
    return dedup.dedup_announcements(a, ["type", "conv_id", "turn"]).select("date", "symbol", "title", "type", "conv_id", "turn")


# -- text and sentiment -------------------------------------------------------------

@query
def multi_label(spark, sf):
    return roles.articles(spark, sf).select("id", gates.multi_label(F.col("title"), roles.HEADLINES).alias("labels"))


@query
def primary_label(spark, sf):
    labels = gates.multi_label(F.col("title"), roles.HEADLINES)
    return roles.articles(spark, sf).select("id", text.primary_label(labels).alias("label"))


@query
def normalize_title(spark, sf):
    return roles.articles(spark, sf).select("id", text.normalize_title(F.col("title")).alias("norm"))


@query
def logits_to_sentiment(spark, sf):
    e = roles.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("logits"))
    s = sentiment.with_sentiment(e)
    return s.select("vec_id", "sentiment_label", r("sentiment_score"), r("sentiment_compound"))


@query
def score_text(spark, sf):
    a = sentiment.score_text(roles.articles(spark, sf), "title", positive=roles.POSITIVE, negative=roles.NEGATIVE)
    return a.select("id", "sentiment_label", r("sentiment_score"), r("sentiment_compound"))


@query
def score_text_model(spark, sf):
    """The pluggable scorer, with the same word counts in Python as its model."""
    positive, negative = list(roles.POSITIVE), list(roles.NEGATIVE)

    def factory():
        import re

        up, down = (re.compile(r"\b(?:" + "|".join(words) + r")\b", re.IGNORECASE) for words in (positive, negative))
        return lambda texts: [[len(up.findall(t)), len(down.findall(t)), 0.5] for t in texts]

    a = sentiment.score_text(roles.articles(spark, sf).select("id", "title"), "title", model_factory=factory)
    return a.select("id", "sentiment_label", r("sentiment_score"), r("sentiment_compound"))


@query
def daily_sentiment_pivot(spark, sf):
    d = sentiment.daily_scores(roles.scored_articles(spark, sf))
    return d.select("date", "category", *[r(f"sentiment_{c}") for c in sentiment.CATEGORIES])


@query
def daily_titles(spark, sf):
    return sentiment.daily_titles(roles.scored_articles(spark, sf), order=["doc_id"])


@query
def daily_title_cells(spark, sf):
    """Cells of three titles, so that most days span several."""
    return sentiment.title_cells(sentiment.daily_titles(roles.scored_articles(spark, sf), order=["doc_id"]), per_cell=3)


@query
def sentiment_lag(spark, sf):
    daily = sentiment.category_sentiment(sentiment.daily_scores(roles.scored_articles(spark, sf)))
    return rounded(sentiment.sentiment_lag(daily), ["date", "category"], ["sentiment"])


@query
def merged_news(spark, sf):
    """All sources to one clean table: category map, union, cross-source dedup, relevance."""
    root = durable_path(spark, "sources")
    names = stored_sources(spark, sf, root)
    sources = {s: spark.read.parquet(f"{root}/source={s}") for s in names}
    return pipeline.merged_news(sources, roles.CATEGORY_TABLE, roles.PRIORITY, roles.RELEVANCE)


@query
def ldcp_change(spark, sf):
    return rounded(indicators.ldcp_change(roles.bars(spark, sf)), TD, ["ldcp", "close", "change", "change_pct"], 4)


@query
def ema(spark, sf):
    out = roles.clean(spark, sf)
    for span in indicators.EMA_SPANS:
        out = indicators.ema(out, span)
    return rounded(out, TD, [f"ema_{s}" for s in indicators.EMA_SPANS], 4)


@query
def macd(spark, sf):
    return rounded(indicators.macd(roles.clean(spark, sf)), TD, ["macd"], 4)


@query
def rsi(spark, sf):
    return rounded(indicators.rsi(roles.clean(spark, sf)), TD, ["rsi"])


@query
def cci(spark, sf):
    return rounded(indicators.cci(roles.clean(spark, sf)), TD, ["cci"])


@query
def true_range(spark, sf):
    return rounded(indicators.true_range(roles.clean(spark, sf)), TD, ["true_range", "atr14"])


@query
def dmi_dx(spark, sf):
    return rounded(indicators.dmi_dx(roles.clean(spark, sf)), TD, ["dmi_dx"])


@query
def bollinger(spark, sf):
    cols = ["bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct"]
    return rounded(indicators.bollinger(roles.clean(spark, sf)), TD, cols)


@query
def turbulence(spark, sf):
    return rounded(indicators.turbulence(roles.clean(spark, sf)), TD, ["turbulence"])


@query
def technical_indicators(spark, sf):
    out = pipeline.indicator_bars(roles.bars(spark, sf))
    return rounded(out, TD, ["close", *indicators.INDICATOR_COLUMNS], 4)


@query
def log_returns(spark, sf):
    return rounded(features.log_returns(roles.clean(spark, sf)), TD, [f"ret_{n}d" for n in (1, 5, 10, 20)])


@query
def rolling_vol(spark, sf):
    out = features.rolling_vol(features.log_returns(roles.clean(spark, sf)))
    return rounded(out, TD, ["rolling_vol_10", "rolling_vol_20", "vol_ratio_5_20"])


@query
def volume_ratios(spark, sf):
    cols = ["volume_ma5_ratio", "volume_ma20_ratio", "volume_trend"]
    return rounded(features.volume_ratios(roles.clean(spark, sf)), TD, cols)


@query
def range_ratio(spark, sf):
    return rounded(features.range_ratio(roles.clean(spark, sf)), TD, ["52w_high_ratio", "52w_low_ratio"])


@query
def ffwd_return_label(spark, sf):
    out = features.forward_label(roles.clean(spark, sf))
    return out.select(*TD, r("next_ret"), "target")


@query
def row_offset(spark, sf):
    changed = series.over_series(
        roles.bars(spark, sf), lambda d, lay: indicators.warmup_layer(d, lay, 100), back=0
    )
    return rounded(changed, TD, ["close"])


@query
def ffill_by_date(spark, sf):
    prices = joins.ticker_category(roles.clean(spark, sf), _dim())
    daily = sentiment.category_sentiment(sentiment.daily_scores(roles.scored_articles(spark, sf)))
    return rounded(joins.ffill_by_date(daily, prices, "sentiment"), ["category", "date"], ["sentiment"])


@query
def split_by_order(spark, sf):
    return dataset.split_by_order(roles.labelled(spark, sf)).select(*TD, "split")


@query
def sequence_windows(spark, sf):
    split = dataset.split_by_order(roles.labelled(spark, sf))
    s = dataset.sequence_windows(split, roles.SMALL_FEATURES, seq_len=20)
    flat = F.flatten("X")
    return s.select(
        *TD, "split", F.size("X").alias("steps"), F.size(flat).alias("width"),
        F.col("X")[0][0].cast("double").alias("first_value"), F.col("X")[19][2].cast("double").alias("last_value"),
        F.round(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x.cast("double")), 2).alias("total"),
        F.col("y").cast("int").alias("y"),
    )


@query
def best_epoch(spark, sf):
    return rounded(metrics.best_epoch(roles.history(spark, sf)), ["run", "best_epoch"], ["best_val_loss", "best_val_auc"])


@query
def early_stop(spark, sf):
    out = metrics.early_stop(roles.history(spark, sf), patience=40)
    return out.select("run", "best_epoch", r("best_val_auc"), "stop_epoch", "epochs_run")


@query
def running_scan(spark, sf):
    """Running values of the event stream per type: extremes, sums, the last and the first large value."""
    e = roles.table(spark, sf, "events")
    large = F.when(F.col("value") > 50, F.col("event_id"))
    out = scans.running(e, "event_type", "ts", {
        "top": (F.col("value"), scans.MAX, True), "low_before": (F.col("value"), scans.MIN, False),
        "users": (F.col("user_id"), scans.SUM, True), "last_large": (large, scans.LAST, False), "first_large": (large, scans.FIRST, True),
    }, tie=["event_id"])
    return out.select("event_id", r("top"), r("low_before"), "users", "last_large", "first_large")


@query
def ffill_intraday(spark, sf):
    """The last large value at or before each instant of its type, 0 before the first."""
    e = roles.table(spark, sf, "events")
    large = e.filter("value > 50").groupBy("event_type", "ts").agg(F.max("value").alias("level"))
    out = joins.ffill_by_date(large, e, "level", by="event_type", ts="ts")
    return out.select("event_type", F.col("ts").cast("string").alias("ts"), r("level"))


# -- windows over an intraday series: the blocked layout ------------------------------

INTRADAY = {"ts": "ts", "tie": ["event_id"]}


@query
def intraday_indicators(spark, sf):
    """Event streams as price series: keys of any length, cut into blocks with the rows around them."""
    t = roles.trades(spark, sf)

    layers = [
        indicators.rsi_layer(), indicators.cci_layer(), indicators.bollinger_layer(),
        indicators.ema_layer("close", {"ema_9": 9, "ema_50": 50}), features.forward_layer(),
    ]
    out = series.series_layers(t, layers, back=indicators.ema_reach([50]), ahead=5, block_rows=1000, **INTRADAY)
    return rounded(out, ["ticker", "event_id"], ["rsi", "cci", "bb_mid", "bb_width", "ema_9", "ema_50", "next_ret"], 4)


def _hourly_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.intraday_matrix(roles.hourly(spark, sf), key="symbol", ts="at", block_rows=400)


@query
def intraday_feature_matrix(spark, sf):
    """All features, the target and the split of hourly bars: one sort over partitions for all steps."""
    matrix = dataset.split_by_order(checkpointed(_hourly_matrix(spark, sf)), key="symbol", ts="at", block_rows=400)
    values = [c for c in features.FEATURE_COLUMNS if c not in features.NEWS_COLUMNS]
    return matrix.select("symbol", F.unix_timestamp(F.col("at").cast("timestamp")).alias("instant"), r("close", 8), *[r(c, 4) for c in values], "target", "split")


@query
def intraday_sequences(spark, sf):
    """Samples of 20 hourly bars: unscaled closes and volumes summed, with the label of the row after them."""
    matrix = dataset.split_by_order(checkpointed(_hourly_matrix(spark, sf)), key="symbol", ts="at", block_rows=400)
    samples = dataset.sequence_windows(matrix, ["ret_1d", "rsi"], key="symbol", ts="at", block_rows=400)
    total = F.aggregate("X", F.lit(0.0), lambda acc, row: acc + row[1].cast("double"))
    return samples.select("symbol", F.unix_timestamp(F.col("at").cast("timestamp")).alias("instant"), "split", F.round(total, 1).alias("total"), "y")


@query
def intraday_positions(spark, sf):
    out = series.number_rows(roles.trades(spark, sf), "ticker", ["ts", "event_id"])
    return out.select("event_id", F.col("_position").alias("position"), F.col("_size").alias("size"))


@query
def intraday_split(spark, sf):
    return dataset.split_by_order(roles.trades(spark, sf), **INTRADAY).select("event_id", "ticker", "split")


# -- scalar features ----------------------------------------------------------------

@query
def ema_distance(spark, sf):
    out = roles.clean(spark, sf)
    for span in (9, 21, 50):
        out = indicators.ema(out, span)
    return rounded(features.ema_distance(out), TD, ["close_to_ema9", "close_to_ema21", "close_to_ema50"])


@query
def bar_shape(spark, sf):
    cols = ["close_to_high", "close_to_low", "high_low_range_pct", "gap_pct"]
    return rounded(features.bar_shape(roles.clean(spark, sf)), TD, cols)


@query
def macd_norm(spark, sf):
    out = features.bound_indicators(pipeline.indicator_bars(roles.bars(spark, sf)))
    return rounded(out, TD, ["macd", "bb_pct", "bb_width", "turbulence"])


@query
def circuit_flags(spark, sf):
    out = features.circuit_flags(indicators.ldcp_change(roles.bars(spark, sf)))
    return out.select(*TD, "near_upper_circuit", "near_lower_circuit")


@query
def calendar(spark, sf):
    return features.calendar(roles.bars(spark, sf)).select(*TD, "day_of_week", "month")


@query
def text_scalars(spark, sf):
    a = roles.articles(spark, sf)
    return a.select(
        "id", text.normalize_url(F.col("url")).alias("url_key"), text.canonical_url(F.trim("url")).alias("url"),
        F.upper(text.python_strip(F.col("category"))).alias("upper_label"),
        text.primary_label(F.lower(text.python_strip(F.col("category")))).alias("first_label"),
        F.length("title").cast("bigint").alias("n_chars"),
        F.size(F.split(F.col("category"), r"\|")).cast("bigint").alias("n_labels"),
    )


@query
def date_scalars(spark, sf):
    a = roles.announcements(spark, sf)
    broken = F.when(F.col("turn") % 3 == 0, F.lit("n/a")).otherwise(F.col("date"))
    parsed = news_io.announcement_date(broken)
    return a.select("conv_id", "turn", parsed.alias("parsed"), F.year(parsed).alias("year"), F.date_format(parsed, "yyyy-MM-dd").alias("iso"))


@query
def label_smoothing(spark, sf):
    l = roles.table(spark, sf, "labels")
    return l.select("doc_id", F.round(dataset.label_smoothing(F.col("quality"), 0.15), 6).alias("smoothed"))


def _matrix(spark: SparkSession, sf: str, decay: bool = False) -> DataFrame:
    return pipeline.features_with_news(
        roles.bars(spark, sf), roles.scored_articles(spark, sf), _dim(), roles.MENTIONS,
        pipeline.Parameters(half_life=3.7), decay,
    )


@query
def feature_matrix(spark, sf):
    m = _matrix(spark, sf)
    return m.select(*TD, r("close", 8), *[r(c, 10 if c in features.NEWS_COLUMNS else 4) for c in features.FEATURE_COLUMNS], "target")


@query
def feature_matrix_decay(spark, sf):
    return _matrix(spark, sf, decay=True).select(*TD, *[r(c, 10) for c in features.NEWS_COLUMNS], "target")


# -- aggregations, sorts, unions ----------------------------------------------------

@query
def scaler_fit(spark, sf):
    state = dataset.scaler_fit(dataset.split_by_order(roles.labelled(spark, sf)), roles.SMALL_FEATURES)
    return state.select("ticker", "feature", r("mean", 4), r("scale", 4), "train_end_date")


@query
def scaler_apply(spark, sf):
    scaled, _ = pipeline.scaled_splits(roles.labelled(spark, sf), roles.SMALL_FEATURES)
    return scaled.select(*TD, "split", *[r(c, 5) for c in roles.SMALL_FEATURES], "target")


@query
def train_end_date(spark, sf):
    return dataset.train_end_date(dataset.split_by_order(roles.labelled(spark, sf)))


@query
def class_weight(spark, sf):
    return dataset.class_weight(roles.labelled(spark, sf), by=["ticker"]).select("ticker", "n_pos", "n_neg", r("pos_weight"))


@query
def target_balance(spark, sf):
    return reports.target_balance(features.forward_label(features.log_returns(roles.clean(spark, sf))), ["ret_1d", "ret_20d"])


@query
def null_report(spark, sf):
    out = features.log_returns(roles.clean(spark, sf))
    return reports.null_report(out, ["ldcp", "ret_1d", "ret_5d", "ret_10d", "ret_20d"])


@query
def sentiment_reports(spark, sf):
    return reports.sentiment_reports(roles.scored_articles(spark, sf))


@query
def merge_summary(spark, sf):
    return reports.merge_summary(_merged(spark, sf))


@query
def announcement_reports(spark, sf):
    a = roles.announcements(spark, sf)
    return reports.announcement_reports(a, F.year(news_io.announcement_date(F.col("date"))))


@query
def category_summary(spark, sf):
    return reports.category_summary(joins.ticker_category(roles.bars(spark, sf), _dim()))


@query
def coverage_report(spark, sf):
    return reports.coverage_report(roles.bars(spark, sf))


@query
def sorts(spark, sf):
    a = news_io.sort_announcements(roles.announcements(spark, sf))
    return a.select("symbol", "date", "conv_id", "turn")


@query
def preview(spark, sf):
    a = roles.announcements(spark, sf)
    order = [F.col("symbol").asc(), news_io.announcement_date(F.col("date")).desc(), "conv_id", "turn"]
    return reports.preview(a, order, 20).select("symbol", "date", "conv_id", "turn")


@query
def union_sources(spark, sf):
    a = roles.articles(spark, sf).select("id", "source", "title")
    b = roles.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("title"))
    return news_io.union_sources([a, b])


@query
def trading_calendar(spark, sf):
    return reports.trading_calendar(roles.bars(spark, sf))


# -- metrics and models -------------------------------------------------------------

TS = ["ticker", "split"]


@query
def auc(spark, sf):
    return rounded(metrics.auc(roles.predictions(spark, sf), TS), TS, ["auc"])


@query
def acc_f1(spark, sf):
    return metrics.acc_f1(roles.predictions(spark, sf), TS)


@query
def metrics_summary(spark, sf):
    return metrics.metrics_summary(roles.predictions(spark, sf))


@query
def mae_rmse(spark, sf):
    return rounded(metrics.regression_errors(roles.predictions(spark, sf), ["ticker"], "prob_up"), ["ticker"], ["mae", "rmse"])


@query
def directional_accuracy(spark, sf):
    p = roles.predictions(spark, sf).withColumn("pred", (F.col("prob_up") >= 0.5).cast("int"))
    return rounded(metrics.directional_accuracy(p, ["ticker"]), ["ticker"], ["directional_acc_pct"], 4)


@query
def r2(spark, sf):
    return rounded(metrics.r2(roles.predictions(spark, sf), ["ticker"], "prob_up"), ["ticker"], ["r2"])


@query
def residuals(spark, sf):
    res = metrics.residuals(roles.predictions(spark, sf), "prob_up")
    return res.groupBy("ticker").agg(F.round(F.sum("residual"), 4).alias("total"), F.round(F.max("residual"), 6).alias("largest"))


@query
def weighted_logloss(spark, sf):
    out = metrics.weighted_logloss(roles.predictions(spark, sf), TS, pos_weight=0.25, smooth=0.15)
    return rounded(out, TS, ["loss"])


SMALL_STACK = {"gbt_trees": 5, "gbt_depth": 3, "gbt_rate": 0.1, "rf_trees": 5, "rf_depth": 4}


def _small_samples(spark: SparkSession, sf: str) -> DataFrame:
    scaled, _ = pipeline.scaled_splits(roles.labelled(spark, sf), roles.SMALL_FEATURES)
    return dataset.sequence_windows(scaled, roles.SMALL_FEATURES, seq_len=10)


@query
def classifier_train(spark, sf):
    samples = _small_samples(spark, sf)
    model = models.fit_classifier(samples, 10, grid=(0.0, 0.1), max_iter=10)
    return models.score_splits(model, samples)


@query
def stacked_ensemble(spark, sf):
    samples = _small_samples(spark, sf)
    base = models.fit_classifier(samples, 10, grid=(0.01,), max_iter=10)
    return models.score_splits(models.fit_stack(samples, base, SMALL_STACK), samples)


def _pooled(spark: SparkSession, sf: str) -> DataFrame:
    scaled, _ = pipeline.scaled_splits(roles.labelled(spark, sf), roles.SMALL_FEATURES)
    return models.pooled_samples(scaled, roles.SMALL_FEATURES)


@query
def pooled_samples(spark, sf):
    """Pooled sequences of the scaled rows, by windows."""
    names = models.pooled_names(roles.SMALL_FEATURES)
    cells = [F.round(F.col("pooled")[i], 5) + F.lit(0.0) for i in range(len(names))]
    return _pooled(spark, sf).select(*TD, "split", *[c.alias(n) for c, n in zip(cells, names)], F.col("y").cast("int").alias("y"))


@query
def score_with_coefficients(spark, sf):
    """A coefficient row per ticker and feature, the difference of its means over rising and other train samples, scores all samples."""
    samples, names = checkpointed(_pooled(spark, sf)), models.pooled_names(roles.SMALL_FEATURES)
    long = samples.filter("split = 'train'").select(
        F.col("ticker").alias("model"), "y", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), "pooled")).alias("feature", "value"))
    gap = F.avg(F.when(F.col("y") == 1, F.col("value"))) - F.avg(F.when(F.col("y") == 0, F.col("value")))
    weights = long.groupBy("model", "feature").agg(gap.alias("weight"))
    base = long.groupBy("model").agg((F.avg("y") - 0.5).alias("weight")).select("model", F.lit(models.INTERCEPT).alias("feature"), "weight")
    scored = models.score_with_coefficients(samples, weights.unionByName(base), names, by="ticker")
    return scored.select(*TD, "split", r("prob_up"))


@query
def score_splits(spark, sf):
    """The whole price pipeline: bars, features, scaling, sequences, model, metrics."""
    _, summary, _ = pipeline.train_and_score(_matrix(spark, sf), grid=(0.01,))
    return summary


# -- streaming ----------------------------------------------------------------------

@query
def stream_first_seen(spark, sf):
    events = streams.read_stream(spark, sf, "events.parquet")
    twice = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    seen = streams.stream_first_seen(twice, "event_id", "ts", "1 day")
    return streams.drain(seen).select("event_id", "event_type")


@query
def stream_daily_sentiment(spark, sf):
    build = lambda df: streams.stream_daily_sentiment(df, "value", "event_type", "ts", "1 day")
    drained = streams.drain(build(streams.read_stream(spark, sf, "events.parquet")))
    out = streams.finish(drained, roles.table(spark, sf, "events"), build, "date")
    return out.select("date", "category", r("mean_value"), "n")


@query
def stream_headline_gate(spark, sf):
    docs = streams.table_stream(spark, f"{sf}/documents.parquet").withColumn("title", F.col("text"))
    kept = gates.headline_gate(docs, roles.HEADLINES)
    return streams.drain(kept.select("doc_id", gates.multi_label(F.col("title"), roles.HEADLINES).alias("labels")))


@query
def stream_ohlc(spark, sf):
    build = lambda df: streams.stream_ohlc(
        df.withColumn("volume", F.lit(1.0)), "1 day", "event_type", "value", "volume", "ts", ["event_id"])
    drained = streams.drain(build(streams.read_stream(spark, sf, "events.parquet")))
    bars = streams.finish(drained, roles.table(spark, sf, "events"), build, "bar_start")
    return bars.select(F.col("bar_start").cast("date").alias("date"), "ticker", *[r(c, 8) for c in OHLC])


def _shuffled(events: DataFrame) -> DataFrame:
    """A stream of files that each hold rows of all days, one file a batch: most rows come late."""
    root = durable_path(events.sparkSession, "events")
    events.repartition(5, "event_id").write.parquet(root)
    return events.sparkSession.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(root)


@query
def stream_corrected_sentiment(spark, sf):
    """Daily means of events that come in any order; the rows so far are merged every second batch."""
    events = roles.table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    windows = corrections.daily_sentiment(spark, durable_path(spark, "daily"), "value", "event_type", "ts")
    out = corrections.drain_corrected(_shuffled(events), windows, compact_every=2)
    return corrections.with_mean(out).select("date", "category", r("mean_value"), "n")


@query
def stream_corrected_ohlc(spark, sf):
    """Daily bars of events that come in any order, one batch of them taken in twice."""
    events = roles.table(spark, sf, "events").select("event_id", "ts", "event_type", "value", F.lit(1.0).alias("volume"))
    windows = corrections.ohlc(spark, durable_path(spark, "ohlc"), "1 day", "event_type", "value", "volume", "ts", ["event_id"])
    half = F.col("event_id") % 2 == 0
    corrections.drain_corrected(_shuffled(events.filter(half)), windows)
    for _ in range(2):
        windows.add(events.filter(~half), 1_000)
    return windows.table().select(F.col("bar_start").cast("date").alias("date"), "ticker", *[r(c, 8) for c in OHLC])
