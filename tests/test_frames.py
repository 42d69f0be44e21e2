"""Long frames by chunks give what sliding frames give, in both layouts, with gaps, ties and constant series."""

import random

import pytest
from helpers import close_to
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketfeat.operators import frames, indicators, series


@pytest.fixture(scope="module")
def values(spark):
    import datetime as dt

    rng = random.Random(4)
    rows = []
    for key, size in (("A", 700), ("B", 40), ("C", 1), ("flat", 120), ("slope", 120), ("gaps", 300)):
        price = 100.0
        for i in range(size):
            price = {"flat": 7.3, "slope": price * 1.003}.get(key, price * (1 + rng.gauss(0, 0.02)))
            missing = key == "gaps" and (rng.random() < 0.05 or 100 <= i < 160)
            rows.append((key, dt.date(2001, 1, 1) + dt.timedelta(days=i), i, None if missing else price, float(rng.randrange(5))))
    return spark.createDataFrame(rows, "ticker string, date date, i int, close double, tied double").repartition(3).cache()


@pytest.mark.parametrize("n", [1, 2, 7, 30, 126])
@pytest.mark.parametrize("block", [None, 64])
def test_frames_equal_sliding_frames(values, n, block):
    layers = [frames.extremes_layer("close", n, "top", "bottom"), frames.moments_layer("tied", n, "mean", "sd"),
              frames.moments_layer("close", n, "avg", "dev", sample=True)]
    kept = series.over_series(values, lambda d, lay: series.run_layers(d, lay, layers), back=n, block_rows=block)
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(n - 1), 0)
    full, exact = F.count("close").over(w) == n, F.count("tied").over(w) == n
    want = kept.select("ticker", "date", "close", "tied", "top", "bottom", "mean", "sd", "avg", "dev").withColumns({
        "top2": F.when(full, F.max("close").over(w)), "bottom2": F.when(full, F.min("close").over(w)),
        "mean2": F.when(exact, F.avg("tied").over(w)), "sd2": F.when(exact, F.stddev_pop("tied").over(w)),
        "avg2": F.when(full, F.avg("close").over(w)), "dev2": F.when(full, F.stddev_samp("close").over(w)),
    }).collect()
    assert len(want) == values.count()
    for r in want:
        for c in ("top", "bottom", "mean", "sd", "avg", "dev"):
            assert close_to(r[c], r[f"{c}2"], 1e-9), (c, r)


@pytest.mark.parametrize("block", [None, 50])
def test_turbulence_of_constant_returns_is_zero(values, block):
    got = indicators.turbulence(values.filter("ticker IN ('flat', 'slope')"), 30, block_rows=block).collect()
    assert len(got) == 240 and all(r["turbulence"] == 0 or r["ticker"] == "slope" for r in got)
    # Returns of a slope differ by rounding only; a sliding frame finds them equal or nearly so.
    w = Window.partitionBy("ticker").orderBy("date")
    rows = values.filter("ticker = 'A'").withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    past = w.rowsBetween(-29, -1)
    z = (F.col("ret") - F.avg("ret").over(past)) / F.stddev_pop("ret").over(past)
    want = {r["i"]: r["t"] for r in rows.withColumn("t", F.when(F.count("ret").over(past) == 29, z * z).otherwise(0.0)).collect()}
    for r in indicators.turbulence(values.filter("ticker = 'A'"), 30, block_rows=block).collect():
        assert close_to(r["turbulence"], want[r["i"]], 1e-8)


def test_no_frame_slides_over_its_length(values):
    """Only growing frames and lags of one row are in the plan, none of 126 rows."""
    done = series.series_layers(values, [frames.extremes_layer("close", 126, "top", "bottom")], back=126)
    plan = done._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "rowframe, -125, currentrow" not in plan
