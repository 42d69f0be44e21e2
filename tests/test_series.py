"""Positions and layouts: the blocked layout must give the plain layout's values."""

import datetime as dt

import pytest
from helpers import BAR_DDL, by_key, close_to, ema_of, random_bars
from pyspark.sql import functions as F

from marketfeat.operators import dataset, features, indicators, series


@pytest.fixture(scope="module")
def bars(spark):
    # One ticker holds more than a third of the rows, one is very short.
    rows = random_bars("HOT", 900) + random_bars("B", 500) + random_bars("C", 300) + random_bars("D", 3)
    return spark.createDataFrame(rows, BAR_DDL).repartition(5).cache()


def collected(df, cols):
    return {(r["ticker"], r["date"]): [r[c] for c in cols] for r in df.collect()}


def assert_same(a, b, cols, tol=1e-9):
    left, right = collected(a, cols), collected(b, cols)
    assert left.keys() == right.keys()
    for key, values in left.items():
        for x, y, c in zip(values, right[key], cols):
            assert close_to(x, y, tol), (key, c, x, y)


def test_positions_match_a_window(spark, bars):
    got = series.number_rows(bars, "ticker", ["date"]).collect()
    for rows in by_key([r.asDict() for r in got], "ticker", "date").values():
        assert [r["_position"] for r in rows] == list(range(1, len(rows) + 1))
        assert {r["_size"] for r in rows} == {len(rows)}


@pytest.mark.parametrize("spread", ["hours", "one_instant"])
def test_positions_of_a_hot_key_do_not_meet_in_one_task(spark, spread):
    # One key holds nearly all rows, in one case at one instant: still no task may hold most of them.
    start = dt.datetime(2024, 1, 1)
    step = F.col("id") * 7 if spread == "hours" else F.lit(0)
    df = spark.range(80_000).select(
        F.when(F.col("id") < 100, "A").otherwise("HOT").alias("ticker"),
        (F.lit(start) + F.make_dt_interval(secs=step)).alias("ts"), "id", F.repeat(F.lit("x"), 200).alias("body"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = series.number_rows(df, "ticker", ["ts", "id"])
        first = F.when(F.col("ticker") == "A", 0).otherwise(100)
        assert got.filter(F.col("_position") != F.col("id") - first + 1).count() == 0
        assert {(r[0], r[1]) for r in got.select("ticker", "_size").distinct().collect()} == {("A", 100), ("HOT", 79_900)}
        tables = [p for p in got.inputFiles()]
        sizes = sorted(spark.read.parquet(p).count() for p in tables)
        assert len(sizes) == 4 and sizes[-1] < 2 * 80_000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_without_key_or_order_are_left_out(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, 1)), (None, dt.date(2020, 1, 1)), ("A", None)], "ticker string, date date")
    assert series.number_rows(df, "ticker", ["date"]).count() == 1


@pytest.mark.parametrize("block", [64, 300])
def test_blocked_indicators_equal_plain(bars, block):
    cols = list(indicators.INDICATOR_COLUMNS)
    plain = indicators.technical_indicators(bars, warmup=20)
    assert_same(plain, indicators.technical_indicators(bars, warmup=20, block_rows=block), cols)


def test_blocked_features_equal_plain(bars):
    changed = indicators.ldcp_change(bars)
    ind = indicators.technical_indicators(changed)
    cols = [*features.FEATURE_COLUMNS, "target"]
    assert_same(features.feature_matrix(ind), features.feature_matrix(indicators.technical_indicators(changed, block_rows=100), block_rows=70), cols)


def test_blocked_split_and_sequences_equal_plain(bars):
    labelled = features.forward_label(bars).na.drop()
    plain = dataset.split_by_order(labelled)
    blocked = dataset.split_by_order(labelled, block_rows=50)
    assert_same(plain, blocked, ["split"])
    a = dataset.sequence_windows(plain, ["close", "volume"], seq_len=7)
    b = dataset.sequence_windows(plain, ["close", "volume"], seq_len=7, block_rows=10)
    flat = lambda df: df.withColumn("x", F.to_json("X"))
    left = {(r["ticker"], r["date"]): r["x"] for r in flat(a).collect()}
    assert left == {(r["ticker"], r["date"]): r["x"] for r in flat(b).collect()}


@pytest.mark.parametrize("span,block", [(2, 5), (2, 64), (2, None), (9, 5), (9, 256), (9, 1000), (200, 300), (200, 1000), (200, None)])
def test_ema_does_not_depend_on_its_block(spark, bars, span, block):
    got = indicators.ema(bars.filter("ticker in ('HOT', 'D')"), span, block=block)
    for rows in by_key([r.asDict() for r in got.collect()], "ticker", "date").values():
        want = ema_of([r["close"] for r in rows], span)
        assert all(close_to(r[f"ema_{span}"], w) for r, w in zip(rows, want))


def test_timestamp_order_takes_the_blocked_layout(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("A", start + dt.timedelta(minutes=i), 100.0 + (i * 7919 % 101)) for i in range(500)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, close double")
    assert not series.is_bounded(df, "ts")
    got = indicators.ema(df, 9, ts="ts").orderBy("ts").collect()
    assert all(close_to(r["ema_9"], w) for r, w in zip(got, ema_of([r[2] for r in rows], 9)))


def test_one_sort_serves_all_steps(spark, bars, monkeypatch):
    """Bars at instants, placed once, give what plain daily series give: features, splits and samples."""
    from marketfeat.plans import pipeline

    sorts, place = [], series.placed_rows
    for module in (series, pipeline):
        monkeypatch.setattr(module, "placed_rows", lambda *a: sorts.append(1) or place(*a))
    raw = bars.select(F.col("ticker").alias("symbol"), F.col("date").cast("timestamp").alias("at"), "open", "high", "low", "close", "volume")
    options = {"key": "symbol", "ts": "at", "block_rows": 90}
    matrix = pipeline.intraday_matrix(raw, **options)
    samples = pipeline.intraday_samples(matrix, ["rsi", "ret_1d"], **options)
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    plain = pipeline.features_from_bars(bars.select("ticker", "date", "open", "high", "low", "close", "volume"))
    scaled, _ = pipeline.scaled_splits(plain, ["rsi", "ret_1d"])
    want = dataset.sequence_windows(scaled, ["rsi", "ret_1d"])
    named = matrix.withColumnRenamed("symbol", "ticker").withColumn("date", F.col("at").cast("date"))
    assert_same(named, plain, list(features.FEATURE_COLUMNS) + ["target", "close"], 1e-7)
    got = {(r["symbol"], r["at"].date(), r["split"]): (r["X"], r["y"]) for r in samples.collect()}
    expected = {(r["ticker"], r["date"], r["split"]): (r["X"], r["y"]) for r in want.collect()}
    assert got.keys() == expected.keys() and len(got) > 100
    for k, (x, y) in got.items():
        assert y == expected[k][1] and all(abs(a - b) < 1e-4 for p, q in zip(x, expected[k][0]) for a, b in zip(p, q))
    assert len(sorts) == 1 and "rangepartitioning" not in plan.lower()
