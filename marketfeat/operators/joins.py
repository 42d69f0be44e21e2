"""Joins of prices and news.

No side is broadcast by hint: Spark broadcasts a side when its measured size is
below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise, and adaptive
execution splits a skewed partition.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketfeat.functions.rules import word_pattern
from marketfeat.operators.gates import lookup
from marketfeat.operators.scans import LAST, running
from marketfeat.operators.sentiment import sentiment_lag
from marketfeat.operators.series import is_bounded
from marketfeat.session import checkpointed

UNASSIGNED = "unassigned"


def ticker_dimension(categories: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Ticker to category, from category to tickers."""
    return {t.upper(): c for c, tickers in categories.items() for t in tickers}


def ticker_category(df: DataFrame, dim: Mapping[str, str] | DataFrame, default: str = UNASSIGNED) -> DataFrame:
    """Adds ``category``; a ticker without one gets ``default``."""
    if isinstance(dim, DataFrame):
        named = dim.select(F.upper("ticker").alias("_ticker"), F.col("category").alias("_category"))
        joined = df.withColumn("_ticker", F.upper("ticker")).join(named, "_ticker", "left").drop("_ticker")
        return joined.withColumn("category", F.coalesce("_category", F.lit(default))).drop("_category")
    return df.withColumn("category", F.coalesce(lookup(F.upper("ticker"), dim), F.lit(default)))


def unassigned(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Distinct tickers the dimension does not know."""
    known = dim.select(F.upper("ticker").alias("ticker"))
    return df.select(F.upper("ticker").alias("ticker")).distinct().join(known, "ticker", "left_anti")


def ffill_by_date(
    df: DataFrame, calendar: DataFrame, col: str, by: str = "category", fill: float = 0.0, ts: str = "date"
) -> DataFrame:
    """Last known value at or before each calendar date, per ``by``; ``fill`` before the first one.

    ``df`` has one row per (by, ts). The scan runs over distinct dates, not over price rows; times of any kind may be the calendar.
    """
    days = calendar.select(by, ts).distinct().join(df.select(by, ts, F.col(col).alias("_value")), [by, ts], "left")
    known = running(days, by, ts, {"_known": (F.col("_value"), LAST, True)})
    return known.select(by, ts, F.coalesce("_known", F.lit(fill)).alias(col))


def join_sentiment(
    prices: DataFrame, daily: DataFrame, lag: int = 1, fill: float = 0.0, categories: Sequence[str] | None = None
) -> DataFrame:
    """Prices (with ``category``) and the lagged sentiment of their category on the same date.

    ``daily`` is ``(date, category, sentiment)``. Only values that fall on a price date take
    part; gaps carry the last value forward over the price dates of the category, and dates
    before the first value get ``fill``, and so does a category without any news. Tickers without a category
    (null or ``UNASSIGNED``) stay out, and with ``categories`` those of any other. Raises if ``daily`` has more than one
    row per (category, date), which would multiply price rows.
    """
    repeated = daily.groupBy("category", "date").count().filter("count > 1").count()
    if repeated:
        raise ValueError(f"{repeated} (category, date) groups have more than one sentiment row")
    lagged = sentiment_lag(daily, lag)
    served = prices.filter(F.col("category").isNotNull() & (F.col("category") != UNASSIGNED))
    if categories is not None:
        served = served.filter(F.col("category").isin(*categories))
    filled = ffill_by_date(lagged, served, "sentiment", fill=fill)
    return served.join(filled, ["category", "date"], "left")


def category_view(merged: DataFrame, category: str) -> DataFrame:
    """One category of the merged table, its value as ``sentiment_<category>``."""
    return (
        merged.filter(F.col("category") == category).drop("category")
        .withColumnRenamed("sentiment", f"sentiment_{category}")
    )


def broadcast_check(merged: DataFrame, col: str = "sentiment", by: Sequence[str] = ("category", "date")) -> DataFrame:
    """Groups in which the joined value is not the same on all rows; empty when the join is sound."""
    spread = merged.groupBy(*by).agg(F.min(col).alias("lowest"), F.max(col).alias("highest"))
    return spread.filter(F.col("lowest") != F.col("highest"))


def require_consistent(merged: DataFrame, col: str = "sentiment", by: Sequence[str] = ("category", "date")) -> DataFrame:
    """``merged`` again, after raising if ``broadcast_check`` finds a group."""
    broken = broadcast_check(merged, col, by).count()
    if broken:
        raise ValueError(f"{broken} groups have differing values of {col}")
    return merged


# -- news features per (ticker, date) -----------------------------------------------

def named_tickers(title: Column, mentions: Mapping[str, str]) -> Column:
    """Array of the distinct tickers a title names.

    ``mentions`` maps a word to the ticker it names. A title names a ticker when one of its
    words (runs of letters and digits) is such a word, whatever the case.
    """
    known = {w.lower(): t for w, t in mentions.items()}
    hits = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(word_pattern(known)), F.lit(0)))
    return F.array_distinct(F.transform(hits, lambda w: lookup(w, known)))


def news_by_key(articles: DataFrame, mentions: Mapping[str, str] | DataFrame) -> DataFrame:
    """Daily news of categories and of tickers, ``(kind, key, date, value, news_count)``, in one pass over the titles.

    ``value`` is the mean compound of the articles of a category (kind ``c``) or of those
    that name a ticker (kind ``t``); an article counts once per ticker. ``mentions`` may be
    a DataFrame ``(word, ticker)`` if it is large; articles then need a unique ``id``.
    """
    day = F.to_date("date").alias("date")
    category = F.struct(F.lit("c").alias("kind"), F.col("category").alias("key"))
    if isinstance(mentions, DataFrame):
        words = F.array_distinct(F.split(F.lower("title"), r"(?U)[^\w]+"))
        named = mentions.select("ticker", F.lower("word").alias("word")).distinct()
        exploded = articles.select("id", day, "sentiment_compound", F.explode(words).alias("word"))
        pairs = exploded.join(named, "word").select("ticker", "id", "date", "sentiment_compound").distinct()
        tickers = pairs.select(F.lit("t").alias("kind"), F.col("ticker").alias("key"), "date", "sentiment_compound")
        rows = articles.select(category.alias("_k"), day, "sentiment_compound").select("_k.*", "date", "sentiment_compound")
        rows = rows.unionByName(tickers)
    else:
        tickers = F.transform(
            named_tickers(F.col("title"), mentions), lambda t: F.struct(F.lit("t").alias("kind"), t.alias("key"))
        )
        keys = F.concat(F.array(category), F.coalesce(tickers, F.array().cast("array<struct<kind:string,key:string>>")))
        rows = articles.select(F.explode(keys).alias("_k"), day, "sentiment_compound").select(
            "_k.*", "date", "sentiment_compound")
    return rows.groupBy("kind", "key", "date").agg(
        F.avg("sentiment_compound").alias("value"), F.count(F.lit(1)).alias("news_count")
    )


def news_tables(articles: DataFrame, mentions: Mapping[str, str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(category, date, sentiment_relevant, news_count)`` and ``(ticker, date, sentiment_ticker)``.

    The daily table is written to durable storage first: it is small, and titles are then
    read and matched once however many joins follow.
    """
    daily = checkpointed(news_by_key(articles, mentions))
    by_category = daily.filter("kind = 'c'").select(
        F.col("key").alias("category"), "date", F.col("value").alias("sentiment_relevant"), "news_count"
    )
    by_ticker = daily.filter("kind = 't'").select(
        F.col("key").alias("ticker"), "date", F.col("value").alias("sentiment_ticker")
    )
    return by_category, by_ticker


def _attach(prices: DataFrame, dim, by_category: DataFrame, by_ticker: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The three news columns on price rows, 0 where there is no value."""
    joined = ticker_category(prices, dim).join(by_category, ["category", "date"], "left")
    joined = joined.join(by_ticker, ["ticker", "date"], "left")
    if counts is not None:
        joined = joined.join(counts, ["category", "date"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in prices.columns],
        F.coalesce("sentiment_relevant", F.lit(0.0)).alias("sentiment_relevant"),
        F.coalesce("sentiment_ticker", F.lit(0.0)).alias("sentiment_ticker"),
        F.coalesce("news_count", F.lit(0)).alias("news_count"),
    )


def join_news_flags(prices: DataFrame, articles: DataFrame, dim, mentions) -> DataFrame:
    """Same-day news features on price rows, 0 without news.

    ``sentiment_relevant`` is the mean compound of the articles in the ticker's category,
    ``sentiment_ticker`` that of the articles naming the ticker, ``news_count`` the number
    of articles in the category.
    """
    by_category, by_ticker = news_tables(articles, mentions)
    return _attach(prices, dim, by_category, by_ticker)


def carried_with_decay(news: DataFrame, dates: DataFrame, by: str, col: str, half_life: float, ts: str = "date") -> DataFrame:
    """As-of value per (by, ts): the last value at or before that time, halved every ``half_life`` days.

    Both inputs have one row per (by, ts); the scan runs over their distinct times.
    """
    wanted = dates.select(by, ts).distinct().withColumn("_wanted", F.lit(True))
    both = wanted.join(news.select(by, ts, F.col(col).alias("_value")), [by, ts], "full")
    latest = F.when(F.col("_value").isNotNull(), F.struct(F.col(ts).alias("at"), F.col("_value").alias("value")))
    known = running(both, by, ts, {"_last": (latest, LAST, True)}).filter(F.col("_wanted"))
    if is_bounded(dates, ts):
        age = F.date_diff(ts, F.col("_last.at"))
    else:
        age = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_last.at").cast("timestamp"))) / 86_400_000_000
    decayed = F.col("_last.value") * F.exp(F.lit(-math.log(2.0) / half_life) * age)
    return known.select(by, ts, F.coalesce(decayed, F.lit(0.0)).alias(col))


def join_news_decay(prices: DataFrame, articles: DataFrame, dim, mentions, half_life: float = 3.0) -> DataFrame:
    """As ``join_news_flags``, but both sentiments carry forward with exponential decay.

    News on days without prices counts too. ``news_count`` stays the count of the day.
    """
    by_category, by_ticker = news_tables(articles, mentions)
    days = ticker_category(prices.select("ticker", "date"), dim)
    return _attach(
        prices, dim,
        carried_with_decay(by_category, days, "category", "sentiment_relevant", half_life),
        carried_with_decay(by_ticker, days, "ticker", "sentiment_ticker", half_life),
        by_category.select("category", "date", "news_count"),
    )
