"""Splits, scaling, sequences, metrics, models."""

import random

import pytest
from helpers import BAR_DDL, auc_of, close_to, random_bars, sd
from pyspark.sql import functions as F

from marketfeat.operators import dataset, features, metrics, models


def numbered(spark, n, ticker="A"):
    return spark.range(n).select(
        F.lit(ticker).alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        F.col("id").cast("double").alias("x"), F.lit(3.0).alias("flat"), (F.col("id") % 2).cast("int").alias("target"))


@pytest.mark.parametrize("n", [1, 2, 10, 20, 101, 1000])
def test_split_truncates(spark, n):
    got = [r["split"] for r in dataset.split_by_order(numbered(spark, n)).orderBy("date").collect()]
    a, b = int(n * 0.7), int(n * (0.7 + 0.15))
    assert got == ["train"] * a + ["val"] * (b - a) + ["test"] * (n - b)


def test_scaler(spark):
    df = dataset.split_by_order(numbered(spark, 100))
    state = dataset.scaler_fit(df, ["x", "flat"])
    rows = {r["feature"]: r for r in state.collect()}
    train = [float(i) for i in range(70)]
    assert close_to(rows["x"]["mean"], 34.5) and close_to(rows["x"]["scale"], sd(train, 0))
    assert rows["flat"]["scale"] == 1.0 and str(rows["x"]["train_end_date"]) == "2020-03-10"
    scaled = dataset.scaler_apply(df, state, ["x", "flat"])
    inside = scaled.filter("split = 'train'").agg(F.avg("x"), F.stddev_pop("x"), F.max("flat")).first()
    assert close_to(inside[0], 0.0) and close_to(inside[1], 1.0) and inside[2] == 0.0
    assert scaled.columns == df.columns and scaled.count() == 100


def test_scaler_does_not_see_later_rows(spark):
    df = dataset.split_by_order(numbered(spark, 100))
    changed = df.withColumn("x", F.when(F.col("split") == "train", F.col("x")).otherwise(F.col("x") * 1000))
    key = lambda d: sorted(map(tuple, dataset.scaler_fit(d, ["x"]).collect()))
    assert key(df) == key(changed)


def test_sequences(spark):
    df = dataset.split_by_order(numbered(spark, 40))  # 28, 6, 6 rows
    got = dataset.sequence_windows(df, ["x", "flat"], seq_len=6).orderBy("date").collect()
    assert len(got) == 22 and {r["split"] for r in got} == {"train"}
    for i, r in enumerate(got):
        assert r["X"] == [[float(i + k), 3.0] for k in range(6)] and r["y"] == (i + 6) % 2
    assert dataset.sequence_windows(df, ["x"], seq_len=5).filter("split = 'val'").count() == 1
    with pytest.raises(Exception, match="too few rows"):
        dataset.sequence_windows(df, ["x"], seq_len=6, strict=True).collect()


def test_class_weight_and_smoothing(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (0,)], "target int")
    row = dataset.class_weight(df).first()
    assert (row["n_pos"], row["n_neg"], row["pos_weight"]) == (1, 3, 3.0)
    assert dataset.class_weight(df.filter("target = 0")).first()["pos_weight"] == 3.0
    got = [round(r[0], 9) for r in df.select(dataset.label_smoothing(F.col("target"), 0.1)).collect()]
    assert got == [0.05, 0.05, 0.95, 0.05]


@pytest.mark.parametrize("kind", ["ties", "tight", "wide", "constant", "one_class"])
def test_auc_is_exact(spark, kind):
    rng = random.Random(kind)
    rows = []
    for g in ("a", "b", None):
        for _ in range(700 if g == "a" else 60):
            y = 1 if kind == "one_class" else rng.randrange(2)
            s = {"ties": rng.randrange(8) / 8 + y / 8, "tight": 0.5 + rng.random() * 1e-12, "wide": rng.gauss(y, 50),
                 "constant": 0.3, "one_class": rng.random()}[kind]
            rows.append((g, s, y))
    df = spark.createDataFrame(rows, "g string, prob_up double, actual int")
    got = {r["g"]: r["auc"] for r in metrics.auc(df, ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, value in got.items():
        assert close_to(value, auc_of([(s, y) for h, s, y in rows if h == g]))
    moved = metrics.auc(df.withColumn("prob_up", F.col("prob_up") * 3 - 7), ["g"])
    if kind != "tight":  # the shift would merge scores that close
        assert all(close_to(r["auc"], got[r["g"]]) for r in moved.collect())


def test_acc_f1_borders(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.4999, 0), ("b", 0.1, 0), ("b", 0.2, 0)], "g string, prob_up double, actual int")
    rows = {r["g"]: (r["n"], r["acc"], r["f1"]) for r in metrics.acc_f1(df, ["g"]).collect()}
    assert rows == {"a": (2, 1.0, 1.0), "b": (2, 1.0, 0.0)}
    both = {r["ticker"]: r["auc"] for r in metrics.metrics_summary(
        df.withColumnRenamed("g", "ticker").withColumn("split", F.lit("test"))).collect()}
    assert both == {"a": 1.0, "b": None}


def test_early_stop_against_a_loop(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for run in ("a", "b", "c", "d"):
        aucs = [round(rng.random(), 2) for _ in range(30)] if run != "d" else [i / 100 for i in range(1, 20)]
        best, waited, stop, best_at = 0.0, 0, None, None
        for epoch, value in enumerate(aucs, 1):
            rows.append((run, epoch, 1.0 - value, value))
            if stop is None:
                if value > best:
                    best, waited, best_at = value, 0, epoch
                else:
                    waited += 1
                if waited >= 6:
                    stop = epoch
        want[run] = (best_at, best, stop, stop or len(aucs))
    df = spark.createDataFrame(rows, "run string, epoch int, val_loss double, val_auc double")
    got = {r["run"]: (r["best_epoch"], r["best_val_auc"], r["stop_epoch"], r["epochs_run"]) for r in metrics.early_stop(df, 6).collect()}
    assert got == want
    assert want["d"][2] is None
    first = {r["run"]: r["best_epoch"] for r in metrics.best_epoch(df).collect()}
    for run in want:
        losses = [(loss, e) for r, e, loss, _ in rows if r == run]
        assert first[run] == min(losses)[1]


def test_regression_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", -3.0, -1.0), ("a", 2.0, -2.0)], "g string, pred double, actual double")
    e = metrics.regression_errors(df, ["g"]).first()
    assert close_to(e["mae"], 7 / 3) and close_to(e["rmse"], (21 / 3) ** 0.5)
    assert close_to(metrics.directional_accuracy(df, ["g"]).first()[1], 200 / 3)
    m = (2 - 1 - 2) / 3
    total = sum((x - m) ** 2 for x in (2, -1, -2))
    assert close_to(metrics.r2(df, ["g"]).first()["r2"], 1 - 21 / (total + 1e-8))


@pytest.fixture(scope="module")
def samples(spark):
    """Sequences whose label is the sign of the last value, with noise; 3 tickers, all splits."""
    rng = random.Random(1)
    rows = []
    for ticker in ("A", "B", "C"):
        for i in range(240):
            split = "train" if i < 160 else "val" if i < 200 else "test"
            x = [[rng.gauss(0, 1), rng.gauss(0, 1)] for _ in range(4)]
            y = float(x[-1][0] + rng.gauss(0, 0.3) > 0)
            rows.append((ticker, split, i, x, y))
    df = spark.createDataFrame(rows, "ticker string, split string, i int, X array<array<float>>, y float")
    return df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i"))).drop("i").cache()


def test_classifier_and_stack_learn(spark, samples, tmp_path):
    base = models.fit_classifier(samples, 4, grid=(0.0, 0.1))
    assert base.val_auc > 0.9
    stack = models.fit_stack(samples, base, {"gbt_trees": 5, "gbt_depth": 3, "gbt_rate": 0.3, "rf_trees": 5, "rf_depth": 4})
    for model in (base, stack):
        scored = models.score_splits(model, samples)
        assert scored.columns == ["ticker", "date", "actual", "prob_up", "pred", "correct", "split"] and scored.count() == 720
        test = metrics.metrics_summary(scored).filter("split = 'test'").collect()
        assert len(test) == 3 and min(r["auc"] for r in test) > 0.85
        path = str(tmp_path / type(model).__name__)
        model.save(path, spark)
        again = type(model).load(path, spark)
        assert sorted(models.score_splits(again, samples).collect()) == sorted(scored.collect())
        with pytest.raises(Exception, match="(?i)already exists"):
            model.save(path, spark)
        model.save(path, spark, overwrite=True)


def test_pooling(spark, samples):
    row = samples.select("X", models.pooled(F.col("X"), 4).alias("p")).first()
    want = [sum(step[k] for step in row["X"]) / 4 for k in (0, 1)] + row["X"][-1]
    assert all(close_to(a, b, 1e-6) for a, b in zip(row["p"], want))


def test_whole_pipeline(spark):
    from marketfeat.plans import pipeline

    raw = spark.createDataFrame(random_bars("P", 700) + random_bars("Q", 700), BAR_DDL)
    matrix = pipeline.features_from_bars(raw)
    predictions, summary, _ = pipeline.train_and_score(matrix, params=pipeline.Parameters(seq_len=5), grid=(0.1,))
    assert predictions.count() == sum(r["n"] for r in summary.collect()) > 0
    assert {r["split"] for r in summary.collect()} == {"train", "val", "test"}
    assert features.FEATURE_COLUMNS[0] in matrix.columns


def test_keys_without_train_rows_stay(spark):
    from marketfeat.operators import dataset

    df = spark.createDataFrame([("A", 1.0, "train"), ("A", 3.0, "train"), ("B", 5.0, "test")], "ticker string, x double, split string")
    state = spark.createDataFrame([("A", "x", 2.0, 1.0)], "ticker string, feature string, mean double, scale double")
    got = sorted(map(tuple, dataset.scaler_apply(df, state, ["x"]).collect()))
    assert got == [("A", -1.0, "train"), ("A", 1.0, "train"), ("B", None, "test")]
    assert [tuple(r) for r in dataset.keys_without_state(df, state).collect()] == [("B", 1)]


def test_category_without_news_stays(spark):
    import datetime as dt

    from marketfeat.operators import joins

    day = dt.date(2020, 1, 1)
    prices = spark.createDataFrame([("A", day, "banking"), ("B", day, "energy"), ("C", day, None)], "ticker string, date date, category string")
    daily = spark.createDataFrame([(day, "banking", 0.5)], "date date, category string, sentiment double")
    got = {r["ticker"]: r["sentiment"] for r in joins.join_sentiment(prices, daily).collect()}
    assert got == {"A": 0.0, "B": 0.0}
