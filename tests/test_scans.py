"""Running values by the block scan against a plain loop, with one key over all partitions, nulls and ties."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketfeat.operators import joins, scans, series

START = dt.datetime(2024, 1, 1)


def loop(rows):
    """Expected states of (key, i, value) rows in order."""
    out, state = {}, {}
    for k, i, v in rows:
        s = state.setdefault(k, {"max": None, "sum": None, "last": None, "first": None})
        before = s["max"]
        if v is not None:
            s["max"] = v if s["max"] is None else max(s["max"], v)
            s["sum"] = (s["sum"] or 0) + v
            s["last"] = v
            s["first"] = v if s["first"] is None else s["first"]
        out[i] = (s["max"], before, s["sum"], s["last"], s["first"])
    return out


def states():
    v = F.col("v")
    return {"top": (v, scans.MAX, True), "before": (v, scans.MAX, False), "total": (v, scans.SUM, True),
            "last": (v, scans.LAST, True), "first": (v, scans.FIRST, True)}


@pytest.mark.parametrize("keys", [["hot"], ["hot", "hot", "hot", "a", "b"]])
@pytest.mark.parametrize("bounded", [False, True])
def test_running_values(spark, keys, bounded):
    rng = random.Random(3)
    rows = [(rng.choice(keys), i, None if rng.random() < 0.4 else rng.randrange(100)) for i in range(1200)]
    made = [(k, START.date() + dt.timedelta(days=i) if bounded else START + dt.timedelta(seconds=i // 3), i, v) for k, i, v in rows]
    df = spark.createDataFrame(made, f"k string, at {'date' if bounded else 'timestamp'}, i int, v long").repartition(4)
    df = df.unionByName(spark.createDataFrame([(None, made[0][1], -1, 5), ("hot", None, -2, 5)], df.schema))
    got = scans.running(df, "k", "at", states(), tie=["i"])
    assert set(got.columns) == {"k", "at", "i", "v", "top", "before", "total", "last", "first"}
    assert {r["i"]: (r["top"], r["before"], r["total"], r["last"], r["first"]) for r in got.collect()} == loop(rows)


def test_a_key_spreads_over_partitions(spark):
    df = spark.range(60_000).select(F.lit("hot").alias("k"), F.timestamp_seconds("id").alias("at"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = series.placed_rows(df, ["k"], ["at"])
        assert placed.select("_part").distinct().count() == 4
        out = scans.scan(placed, "k", {"s": (F.col("v"), scans.SUM, True), "m": (F.col("v"), scans.MAX, False)})
        assert out.filter("s != v * (v + 1) / 2 OR coalesce(m, -1) != v - 1").count() == 0
        twice = scans.scan(out, "k", {"t": (F.col("s"), scans.LAST, False)})
        assert twice.filter("coalesce(t, 0) != v * (v - 1) / 2").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_null_only(spark):
    none = spark.createDataFrame([], "k string, at timestamp, i int, v long")
    assert scans.running(none, "k", "at", states()).count() == 0
    nulls = spark.createDataFrame([("a", START, 1, None), ("a", START, 2, None)], none.schema)
    assert {tuple(r)[4:] for r in scans.running(nulls, "k", "at", states(), tie=["i"]).collect()} == {(None,) * 5}


def test_fill_and_decay_at_instants(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    news = spark.createDataFrame([("c", at(0), 8.0), ("c", at(36), 4.0)], "category string, ts timestamp, value double")
    days = spark.createDataFrame([("c", at(h)) for h in (-1, 0, 24, 36, 60)] + [("d", at(5))], "category string, ts timestamp")
    filled = joins.ffill_by_date(news, days, "value", ts="ts").collect()
    hours = {(r["category"], (r["ts"] - START).total_seconds() / 3600): r["value"] for r in filled}
    assert hours == {("c", -1): 0.0, ("c", 0): 8.0, ("c", 24): 8.0, ("c", 36): 4.0, ("c", 60): 4.0, ("d", 5): 0.0}
    decayed = joins.carried_with_decay(news, days, "category", "value", 1.0, ts="ts").collect()
    hours = {(r["category"], (r["ts"] - START).total_seconds() / 3600): round(r["value"], 9) for r in decayed}
    assert hours == {("c", -1): 0.0, ("c", 0): 8.0, ("c", 24): 4.0, ("c", 36): 4.0, ("c", 60): 2.0, ("d", 5): 0.0}
