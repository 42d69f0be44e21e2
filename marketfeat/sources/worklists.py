"""Work items of a crawl and what is missing from its result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _date(value: str | Column) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else value.cast("date")


def month_worklist(symbols: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """One row per symbol and month from the month of ``start`` to the month of ``end``."""
    months = F.sequence(F.trunc(_date(start), "MM"), F.trunc(_date(end), "MM"), F.expr("interval 1 month"))
    return symbols.select("symbol", F.explode(months).alias("_month")).select(
        "symbol", F.year("_month").alias("year"), F.month("_month").alias("month")
    )


def date_worklist(sections: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """One row per row of ``sections`` and calendar day, both ends included."""
    days = F.sequence(_date(start), _date(end), F.expr("interval 1 day"))
    return sections.select("*", F.explode(days).alias("date"))


def type_worklist(symbols: DataFrame, types: Sequence[str], market_type: str) -> DataFrame:
    """Every symbol with every type but ``market_type``, which comes once for the whole market."""
    each = F.array(*[F.lit(t) for t in types if t != market_type])
    per_symbol = symbols.select("symbol", F.explode(each).alias("type"))
    spark = symbols.sparkSession
    market = spark.range(1).select(F.lit("").alias("symbol"), F.lit(market_type).alias("type"))
    return per_symbol.unionByName(market)


def coverage_gaps(worklist: DataFrame, data: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items for which ``data`` has no row."""
    return worklist.join(data.select(*keys).distinct(), list(keys), "left_anti")


def _days_within(data: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Distinct (key, date) of ``data`` inside the span of the key, with the span."""
    days = data.select(F.col(key), F.to_date("date").alias("date")).distinct()
    return days.join(spans.select(key, "lo", "hi"), key).filter(F.col("date").between(F.col("lo"), F.col("hi")))


def coverage_ranges(spans: DataFrame, data: DataFrame, key: str = "symbol") -> DataFrame:
    """Missing days as ranges ``(key, from, to, days)``; the day by day form is ``coverage_gaps`` of ``date_worklist``.

    ``spans`` has one row ``(key, lo, hi)`` per key, both ends included; keys without any day in ``data`` give one range, spans with ``lo`` after
    ``hi`` or a null end give none. A gap lies between two neighbouring days that are there, or between one and the end of the span, so the work is that
    of the days that are there: the product of keys and days is never made. The window over a key holds distinct dates, at most one a day.
    """
    spans = spans.select(F.col(key), F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi")).filter("lo <= hi")
    ends = spans.select(key, F.explode(F.array(F.date_sub("lo", 1), F.date_add("hi", 1))).alias("date"))
    days = ends.unionByName(_days_within(data, spans, key).select(key, "date"))
    before = F.lag("date").over(Window.partitionBy(key).orderBy("date"))
    gaps = days.withColumn("_before", before).filter(F.date_diff("date", "_before") > 1)
    return gaps.select(
        key, F.date_add("_before", 1).alias("from"), F.date_sub("date", 1).alias("to"), (F.date_diff("date", "_before") - 1).alias("days")
    )


def covered_ranges(data: DataFrame, key: str = "symbol", most: int = 1) -> DataFrame:
    """Runs of days that are there, ``(key, from, to, days)``; days at most ``most`` apart belong to one run, and ``days`` counts those that are there."""
    days = data.select(F.col(key), F.to_date("date").alias("date")).filter(F.col("date").isNotNull()).distinct()
    series = Window.partitionBy(key).orderBy("date")
    starts = F.coalesce(F.date_diff("date", F.lag("date").over(series)) > most, F.lit(True))
    runs = days.withColumn("_start", starts.cast("int")).withColumn("_run", F.sum("_start").over(series))
    return runs.groupBy(key, "_run").agg(
        F.min("date").alias("from"), F.max("date").alias("to"), F.count(F.lit(1)).alias("days")
    ).drop("_run")


def month_ranges(gaps: DataFrame, key: str = "symbol") -> DataFrame:
    """Months that a missing range touches, ``(key, year, month, days)``: the work list of a crawl that asks month by month."""
    months = F.sequence(F.trunc("from", "MM"), F.trunc("to", "MM"), F.expr("interval 1 month"))
    each = gaps.select(key, "from", "to", F.explode(months).alias("_month"))
    days = F.date_diff(F.least("to", F.last_day("_month")), F.greatest("from", "_month")) + 1
    return each.groupBy(key, F.year("_month").alias("year"), F.month("_month").alias("month")).agg(F.sum(days).alias("days"))


def in_range(df: DataFrame, start: str, end: str, ts: str = "date") -> DataFrame:
    """Rows whose date lies in the closed range."""
    return df.filter(F.col(ts).between(_date(start), _date(end)))
