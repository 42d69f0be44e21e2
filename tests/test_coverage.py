"""Ranges of days that are missing or there, and tables in buckets."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from marketfeat.operators import indicators
from marketfeat.sources import bars as bar_io
from marketfeat.sources import worklists
from helpers import BAR_DDL, random_bars

DAY = dt.date(2023, 12, 20)


def day(n):
    return DAY + dt.timedelta(days=n)


def exploded(ranges):
    out = set()
    for r in ranges.collect():
        assert r["days"] == (r["to"] - r["from"]).days + 1
        out |= {(r["symbol"], r["from"] + dt.timedelta(days=i)) for i in range(r["days"])}
    return out


def test_ranges_are_the_gaps_day_by_day(spark):
    rng = random.Random(5)
    spans = [("a", day(0), day(60)), ("b", day(10), day(10)), ("c", day(5), day(90)), ("d", day(9), day(3)), ("e", None, day(4)), (None, day(0), day(3))]
    rows = [(s, day(rng.randrange(-20, 110))) for s in "aaabcz" for _ in range(25)] + [("a", None), (None, day(1)), ("b", day(10))] * 2
    span = spark.createDataFrame(spans, "symbol string, lo date, hi date")
    data = spark.createDataFrame(rows, "symbol string, date date")
    got = worklists.coverage_ranges(span, data)
    have = set(rows)
    want = {(s, lo + dt.timedelta(days=i)) for s, lo, hi in spans if s and lo and lo <= hi for i in range((hi - lo).days + 1)}
    want = {x for x in want if x not in have}
    assert {x for x in exploded(got) if x[0] is not None} == want
    ranges = sorted((r["symbol"], r["from"], r["to"]) for r in got.filter("symbol IS NOT NULL").collect())
    assert all(a[0] != b[0] or b[1] > a[2] + dt.timedelta(days=1) for a, b in zip(ranges, ranges[1:]))
    work = worklists.date_worklist(span.filter("lo <= hi"), F.col("lo"), F.col("hi")).select("symbol", "date")
    assert {tuple(r) for r in worklists.coverage_gaps(work.dropna(), data, ["symbol", "date"]).collect()} == want
    months = {(r["symbol"], r["year"], r["month"]): r["days"] for r in worklists.month_ranges(got).collect() if r["symbol"]}
    assert months == {k: sum(1 for s, d in want if (s, d.year, d.month) == k) for k in {(s, d.year, d.month) for s, d in want}}


def test_empty_tables_give_whole_spans_or_nothing(spark):
    span = spark.createDataFrame([("a", day(0), day(9))], "symbol string, lo date, hi date")
    none = spark.createDataFrame([], "symbol string, date date")
    assert [tuple(r) for r in worklists.coverage_ranges(span, none).collect()] == [("a", day(0), day(9), 10)]
    assert worklists.coverage_ranges(span.limit(0), none).count() == 0
    assert worklists.covered_ranges(none).count() == 0


def test_runs(spark):
    data = spark.createDataFrame([("a", day(n)) for n in (1, 2, 2, 3, 5, 9)] + [("b", day(4))], "symbol string, date date")
    runs = lambda most: sorted((r["symbol"], (r["from"] - DAY).days, (r["to"] - DAY).days, r["days"]) for r in worklists.covered_ranges(data, most=most).collect())
    assert runs(1) == [("a", 1, 3, 3), ("a", 5, 5, 1), ("a", 9, 9, 1), ("b", 4, 4, 1)]
    assert runs(2) == [("a", 1, 5, 4), ("a", 9, 9, 1), ("b", 4, 4, 1)]


def test_work_on_buckets_has_no_exchange(spark, tmp_path):
    rows = [row for t in "abcde" for row in random_bars(t, 40)]
    plain = spark.createDataFrame(rows, BAR_DDL)
    name = uuid.uuid4().hex
    bars = bar_io.write_bucketed(plain, f"bars_{name}", str(tmp_path / "bars"), 4)
    again = bar_io.open_bucketed(spark, f"again_{name}", str(tmp_path / "bars"), 4)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        changed = indicators.ldcp_change(bars)
        joined = changed.join(again.select("ticker", "date", F.col("close").alias("c2")), ["ticker", "date"])
        per_ticker = bars.groupBy("ticker").agg(F.max("date").alias("last")).join(again, "ticker")
        for df in (changed, joined, per_ticker):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
            df.collect()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in indicators.ldcp_change(plain)._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == len(rows) and joined.filter("close <> c2").count() == 0
        assert sorted(map(tuple, changed.collect())) == sorted(map(tuple, indicators.ldcp_change(plain).select(*changed.columns).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql(f"DROP TABLE bars_{name}")
        spark.sql(f"DROP TABLE again_{name}")
