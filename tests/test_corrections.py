"""Late and repeated batches give the batch result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketfeat.streaming import corrections, streams

T0 = dt.datetime(2024, 1, 1)
DDL = "id long, ts timestamp, category string, value double"


def rows_of(days, seed=3):
    rng = random.Random(seed)
    rows = [(i, T0 + dt.timedelta(days=rng.choice(days), minutes=rng.randrange(5)), rng.choice("ab"), rng.choice([None, 1.0, 2.5, -3.0])) for i in range(120)]
    rng.shuffle(rows)
    return rows


def plain(rows):
    """Mean and count, open, high, low and close per (day, category) by hand."""
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        groups.setdefault((row[1].date(), row[2]), []).append(row[3])
    out = {}
    for key, values in groups.items():
        known = [v for v in values if v is not None]
        out[key] = (sum(known) / len(known) if known else None, len(values)), (
            (known[0], max(known), min(known), known[-1]) if known else (None,) * 4)
    return out


def daily(table):
    return {(r["date"], r["category"]): (r["mean_value"], r["n"]) for r in corrections.with_mean(table).collect()}


def bars(table):
    return {(r["bar_start"].date(), r["ticker"]): (r["open"], r["high"], r["low"], r["close"]) for r in table.collect()}


@pytest.mark.parametrize("compact_every", [0, 1, 2])
def test_any_order_of_batches(spark, tmp_path, compact_every):
    rows, want = rows_of(range(9)), plain(rows_of(range(9)))
    sentiment = corrections.daily_sentiment(spark, str(tmp_path / "s"), "value")
    ohlc = corrections.ohlc(spark, str(tmp_path / "o"), "1 day", "category", "value", "value", "ts", ["id"])
    for number, start in enumerate(range(0, 120, 40)):
        batch = spark.createDataFrame(rows[start:start + 40], DDL)
        for windows in (sentiment, ohlc):
            for _ in range(2):
                windows.add(batch, number)
            if compact_every and (number + 1) % compact_every == 0:
                windows.compact(number)
                windows.compact(number)
            windows.add(batch, number)
        seen = plain(rows[:start + 40])
        assert daily(sentiment.table()).keys() == seen.keys()
    got = daily(sentiment.table())
    assert {k: v[0][1] for k, v in want.items()} == {k: v[1] for k, v in got.items()}
    assert all(got[k][0] == pytest.approx(v[0][0]) for k, v in want.items())
    assert bars(ohlc.table()) == {k: v[1] for k, v in want.items()}


def test_a_compaction_that_was_cut_off_is_done_again(spark, tmp_path):
    windows = corrections.daily_sentiment(spark, str(tmp_path / "s"), "value")
    rows = rows_of(range(3))
    windows.add(spark.createDataFrame(rows[:60], DDL), 0)
    windows.add(spark.createDataFrame(rows[60:], DDL), 1)
    # The table is there, its mark is not.
    spark.createDataFrame([(T0.date(), "a", 1e9, 1, 1)], "date date, category string, total double, n_values long, n long").write.parquet(f"{windows.path}/tables/upto=1")
    before = daily(windows.table())
    windows.compact(1)
    assert windows.compacted() == 1 and daily(windows.table()) == before
    windows.add(spark.createDataFrame([(1, T0, "new", 4.0)], DDL), 2)
    assert daily(windows.table())[(T0.date(), "new")] == (4.0, 1)


def test_a_stream_takes_late_rows_in_and_continues(spark, tmp_path):
    folder = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(folder)
    rows = sorted(rows_of(range(20)), key=lambda r: r[1], reverse=True)
    windows = corrections.daily_sentiment(spark, str(tmp_path / "s"), "value")
    for part in (rows[:50], rows[50:]):
        put(part)
        table = corrections.drain_corrected(streams.read_stream(spark, folder), windows)
    assert {k: v[1] for k, v in daily(table).items()} == {k: v[0][1] for k, v in plain(rows).items()}


def test_empty_batches_and_wrong_values(spark, tmp_path):
    windows = corrections.daily_sentiment(spark, str(tmp_path / "s"), "value")
    with pytest.raises(ValueError, match="no batch"):
        windows.table()
    windows.add(spark.createDataFrame([], DDL), 0)
    windows.compact(0)
    assert windows.table().count() == 0
    with pytest.raises(ValueError, match="unknown"):
        corrections.CorrectedWindows(spark, str(tmp_path), {}, {"x": ("median", F.col("value"))})
    with pytest.raises(ValueError, match="order"):
        corrections.CorrectedWindows(spark, str(tmp_path), {}, {"x": (corrections.FIRST, F.col("value"))})
