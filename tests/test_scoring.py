"""Pooled samples without sequences, and scoring by coefficient rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marketfeat.operators import dataset, models
from marketfeat.session import checkpointed
from helpers import day_of

COLS = ["x", "y z"]


def split_rows(spark, n=60, seed=2):
    rng = random.Random(seed)
    rows = [(t, day_of(i), rng.uniform(-2, 2), None if t == "c" and i == 30 else rng.uniform(5, 9), rng.randrange(2), "train" if i < 40 else "val")
            for t in "abc" for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, x double, `y z` double, target int, split string")


@pytest.mark.parametrize("block_rows", [None, 15])
def test_pooled_samples_are_the_pooled_sequences(spark, block_rows):
    df = split_rows(spark)
    sequences = dataset.sequence_windows(df, COLS, seq_len=7).withColumn("pooled", models.pooled(F.col("X"), 7))
    got = models.pooled_samples(df, COLS, seq_len=7, block_rows=block_rows)
    plain = lambda d: {(r["ticker"], r["date"]): (r["split"], r["y"], list(r["pooled"])) for r in d.select("ticker", "date", "split", "y", "pooled").collect()}
    want, have = plain(sequences), plain(got)
    assert want.keys() == have.keys() and len(want) == 3 * (33 + 13)
    for k, (split, y, pooled) in want.items():
        assert have[k][:2] == (split, y)
        for a, b in zip(pooled, have[k][2]):
            assert a is None and b is None or a == pytest.approx(b, rel=1e-5, abs=1e-6)  # sequences hold floats
    assert models.pooled_samples(df.limit(0), COLS).count() == 0
    assert models.pooled_samples(df, COLS, seq_len=60).count() == 0


def test_the_coefficients_of_a_fitted_model_give_its_probabilities(spark):
    df = split_rows(spark).filter("ticker <> 'c'")
    samples = checkpointed(models.pooled_samples(df, COLS, seq_len=5))
    model = models.fit_classifier(samples, 5, grid=(0.01,))
    weights = models.coefficient_table(model, COLS, spark)
    assert weights.count() == 5
    want = {(r["ticker"], r["date"]): r["prob_up"] for r in model.probabilities(samples).collect()}
    got = models.score_with_coefficients(samples, weights, models.pooled_names(COLS))
    assert set(got.columns) == {*samples.columns, "prob_up"}
    assert {(r["ticker"], r["date"]): r["prob_up"] for r in got.collect()} == pytest.approx(want, rel=1e-9)


def test_many_models_missing_and_repeated_coefficients(spark):
    samples = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("none", [1.0, 1.0]), (None, [1.0, 1.0]), ("a", [None, 2.0])], "ticker string, pooled array<double>")
    rows = [("a", "p", 0.5), ("a", "q", -1.0), ("a", "intercept", 0.25), ("b", "q", 2.0), ("b", "other", 99.0)]
    weights = spark.createDataFrame(rows, "model string, feature string, weight double")
    got = models.score_with_coefficients(samples, weights, ["p", "q"], by="ticker").collect()
    p = {(r["ticker"], tuple(r["pooled"])): r["prob_up"] for r in got}
    assert len(got) == 5
    assert p["a", (1.0, 2.0)] == pytest.approx(1 / (1 + math.exp(1.25)))
    assert p["b", (3.0, 4.0)] == pytest.approx(1 / (1 + math.exp(-8.0)))
    assert p["none", (1.0, 1.0)] is None and p[None, (1.0, 1.0)] is None and p["a", (None, 2.0)] is None
    for again in (0.5, 0.6):
        twice = weights.union(spark.createDataFrame([("a", "p", again)], weights.schema))
        with pytest.raises(Exception, match="comes twice"):
            models.score_with_coefficients(samples, twice, ["p", "q"], by="ticker").collect()
