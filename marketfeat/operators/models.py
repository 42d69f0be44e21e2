"""Direction models on sequence samples, with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.functions.numeric import array_round
from marketfeat.operators.dataset import class_weight
from marketfeat.operators.metrics import auc
from marketfeat.operators.series import Layout, as_keys, over_series
from marketfeat.session import checkpointed

THRESHOLD = 0.5


def pooled(x: Column, seq_len: int) -> Column:
    """Mean over the rows of a sequence, followed by its last row."""
    total = F.aggregate(
        F.slice(x, 2, seq_len - 1) if seq_len > 1 else F.slice(x, 1, 0),
        F.transform(x[0], lambda v: v.cast("double")),
        lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b.cast("double")),
    )
    mean = F.transform(total, lambda v: v / seq_len)
    return F.concat(mean, F.transform(F.element_at(x, -1), lambda v: v.cast("double")))


def pooled_names(cols: Sequence[str]) -> list[str]:
    """The names of the pooled features in their order."""
    return [f"mean_{c}" for c in cols] + [f"last_{c}" for c in cols]


def pooled_samples(
    df: DataFrame, cols: Sequence[str], target: str = "target", seq_len: int = 20, key: str | Sequence[str] = "ticker", ts: str = "date", **series
) -> DataFrame:
    """What ``pooled`` makes of ``sequence_windows``, as window expressions: no sequence is ever built or stored.

    One sample per row with ``seq_len`` rows before it in its (key, split): ``pooled`` holds their means, then the values of the last of them, in double
    precision; a column with a null among them gives a null mean. ``y`` is the label.
    """
    group = [*as_keys(key), "split"]

    def build(d: DataFrame, lay: Layout) -> DataFrame:
        before, last = lay.window.rowsBetween(-seq_len, -1), lay.window.rowsBetween(-1, -1)
        value = {c: F.col(f"`{c}`").cast("double") for c in cols}
        whole = {c: F.when(F.count(v).over(before) == seq_len, F.avg(v).over(before)) for c, v in value.items()}
        d = d.withColumns({
            "_before": F.count(F.lit(1)).over(before),
            "pooled": F.array(*whole.values(), *[F.max(v).over(last) for v in value.values()]),
        })
        return d.filter(F.col("_before") == seq_len).withColumn("y", F.col(f"`{target}`").cast("double"))

    built = over_series(df, build, back=seq_len, key=group, ts=ts, **series)
    keep = [c for c in (*group, ts, *series.get("tie", ()), "close") if c in built.columns]
    return built.select(*keep, "pooled", "y")


def with_features(samples: DataFrame, seq_len: int) -> DataFrame:
    """Samples with a ``features`` vector and a double ``label``; the sequence itself, or its pooled form, goes."""
    if "pooled" in samples.columns:
        return samples.withColumns({"features": array_to_vector(F.col("pooled")), "label": F.col("y").cast("double")}).drop("pooled", "y")
    return samples.withColumns({
        "features": array_to_vector(pooled(F.col("X"), seq_len)), "label": F.col("y").cast("double"),
    }).drop("X", "y")


def _up(model, df: DataFrame, out: str) -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


@dataclass
class DirectionModel:
    """A fitted logistic model on pooled sequences."""

    model: object
    seq_len: int
    reg_param: float
    val_auc: float

    def probabilities(self, samples: DataFrame) -> DataFrame:
        return _up(self.model, with_features(samples, self.seq_len), "prob_up")

    def save(self, path: str, spark: SparkSession, overwrite: bool = False) -> None:
        """Write the model below ``path``, a folder that driver and executors share. An existing one raises unless ``overwrite``."""
        _write(self.model, f"{path}/model", overwrite)
        facts = spark.createDataFrame([(self.seq_len, self.reg_param, self.val_auc)], _FACTS)
        facts.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/facts")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> DirectionModel:
        """The model that ``save`` wrote below ``path``."""
        facts = spark.read.schema(_FACTS).parquet(f"{path}/facts").first()
        return cls(LogisticRegressionModel.load(f"{path}/model"), facts["seq_len"], facts["reg_param"], facts["val_auc"])


_FACTS = "seq_len int, reg_param double, val_auc double"


def _write(model, path: str, overwrite: bool) -> None:
    (model.write().overwrite() if overwrite else model.write()).save(path)


def fit_classifier(
    samples: DataFrame,
    seq_len: int,
    grid: Sequence[float] = (0.0, 0.01, 0.1),
    max_iter: int = 50,
) -> DirectionModel:
    """Logistic model with weighted positives, fitted on ``train``; the penalty with the best AUC on ``val`` wins."""
    data = checkpointed(with_features(samples, seq_len))
    train, val = data.filter("split = 'train'"), data.filter("split = 'val'")
    weight = class_weight(train, "label").first()["pos_weight"]
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(weight))).otherwise(1.0))
    best = None
    for reg in grid:
        model = LogisticRegression(maxIter=max_iter, regParam=reg, weightCol="weight").fit(weighted)
        scored = _up(model, val, "prob_up").withColumn("_all", F.lit(1))
        row = auc(scored, ["_all"], "prob_up", "label").first()
        area = row["auc"] if row and row["auc"] is not None else 0.0
        if best is None or area > best.val_auc:
            best = DirectionModel(model, seq_len, reg, area)
    return best


# Sizes of the base learners.
STACK_SIZES = {"gbt_trees": 300, "gbt_depth": 6, "gbt_rate": 0.02, "rf_trees": 200, "rf_depth": 14}


@dataclass
class StackedModel:
    """Boosted trees and a forest next to the logistic model, joined by a logistic model on their probabilities."""

    base: DirectionModel
    gbt: object
    forest: object
    meta: object

    def _meta_features(self, data: DataFrame) -> DataFrame:
        scored = data
        for model, name in ((self.base.model, "_p_base"), (self.gbt, "_p_gbt"), (self.forest, "_p_rf")):
            scored = _up(model, scored, name)
        stacked = array_to_vector(F.array("_p_base", "_p_gbt", "_p_rf"))
        return scored.withColumn("features", stacked).drop("_p_base", "_p_gbt", "_p_rf")

    def probabilities(self, samples: DataFrame) -> DataFrame:
        return _up(self.meta, self._meta_features(with_features(samples, self.base.seq_len)), "prob_up")

    def save(self, path: str, spark: SparkSession, overwrite: bool = False) -> None:
        """Write all four models below ``path``, as ``DirectionModel.save`` does."""
        self.base.save(f"{path}/base", spark, overwrite)
        for name, model in (("gbt", self.gbt), ("forest", self.forest), ("meta", self.meta)):
            _write(model, f"{path}/{name}", overwrite)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> StackedModel:
        """The models that ``save`` wrote below ``path``."""
        return cls(
            DirectionModel.load(f"{path}/base", spark), GBTClassificationModel.load(f"{path}/gbt"),
            RandomForestClassificationModel.load(f"{path}/forest"), LogisticRegressionModel.load(f"{path}/meta"),
        )


def fit_stack(samples: DataFrame, base: DirectionModel, sizes: dict | None = None, seed: int = 42) -> StackedModel:
    """Base learners on ``train``, the joining model on ``val`` probabilities so that it sees no train leakage."""
    size = {**STACK_SIZES, **(sizes or {})}
    data = checkpointed(with_features(samples, base.seq_len))
    train, val = data.filter("split = 'train'"), data.filter("split = 'val'")
    gbt = GBTClassifier(
        maxIter=size["gbt_trees"], maxDepth=size["gbt_depth"], stepSize=size["gbt_rate"],
        subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=3, seed=seed,
    ).fit(train)
    forest = RandomForestClassifier(
        numTrees=size["rf_trees"], maxDepth=size["rf_depth"], featureSubsetStrategy="0.6", seed=seed,
    ).fit(train)
    stack = StackedModel(base, gbt, forest, None)
    features = checkpointed(stack._meta_features(val))
    # Penalty 1 on the sum of the losses; Spark's loss is their mean.
    penalty = 1.0 / max(1, features.count())
    stack.meta = LogisticRegression(maxIter=1000, regParam=penalty, standardization=False).fit(features)
    return stack


# -- scoring as arithmetic ----------------------------------------------------------

INTERCEPT = "intercept"


def coefficient_table(model: DirectionModel, cols: Sequence[str], spark: SparkSession, name: str = "all") -> DataFrame:
    """A fitted logistic model as rows ``(model, feature, weight)``: two per column and the intercept."""
    weights = [*zip(pooled_names(cols), (float(w) for w in model.model.coefficients)), (INTERCEPT, float(model.model.intercept))]
    return spark.createDataFrame([(name, f, w) for f, w in weights], "model string, feature string, weight double")


def score_with_coefficients(samples: DataFrame, weights: DataFrame, names: Sequence[str], by: str | None = None, features: str = "pooled") -> DataFrame:
    """``samples`` with ``prob_up`` from coefficient rows ``(model, feature, weight)``: no model object, any number of models at once.

    ``names`` are the features in the array ``features``. The model of a row is the value of its column ``by`` (null or without coefficients: no
    probability), or ``all`` for every row. A model's missing coefficients are zero, those of other names take no part. The rows of a model meet in one array of
    ``len(names) + 1`` weights, and samples join models, so nothing of a sample's size is exploded or exchanged by feature.
    Raises if a model has a coefficient twice.
    """
    places = [*names, INTERCEPT]
    place = F.array_position(F.array(*[F.lit(n) for n in places]), F.col("feature"))
    known = weights.withColumn("_place", place).filter(F.col("_place") > 0)
    repeated = F.count(F.lit(1)) > F.count_distinct("_place")
    message = F.concat(F.lit("a coefficient comes twice in model "), F.col("model"))
    by_place = F.map_from_entries(F.array_sort(F.collect_set(F.struct("_place", F.coalesce("weight", F.lit(0.0)).alias("w")))))
    models = known.groupBy("model").agg(F.when(repeated, F.raise_error(message).cast("map<bigint,double>")).otherwise(by_place).alias("_w")).select(
        F.col("model").alias("_model"),
        F.array(*[F.coalesce(F.element_at("_w", F.lit(i + 1).cast("long")), F.lit(0.0)) for i in range(len(places))]).alias("_weights"),
    )
    asked = samples.withColumn("_of", F.col(by).cast("string") if by else F.lit("all"))
    joined = asked.join(models, F.col("_of") == F.col("_model"), "left")
    terms = F.zip_with(F.col(features), F.slice("_weights", 1, len(names)), lambda x, w: x * w)
    z = F.aggregate(terms, F.element_at("_weights", -1), lambda total, t: total + t)
    return joined.withColumn("prob_up", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).drop("_of", "_model", "_weights")


def score_splits(model: DirectionModel | StackedModel, samples: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Prediction rows of all tickers and splits. The class comes from the unrounded probability."""
    scored = model.probabilities(samples)
    pred = (F.col("prob_up") >= threshold).cast("int")
    actual = F.col("label").cast("int")
    keep = [c for c in ("ticker", "date", "close") if c in scored.columns]
    return scored.select(
        *keep, actual.alias("actual"), array_round(F.col("prob_up"), 4).alias("prob_up"), pred.alias("pred"),
        (pred == actual).cast("int").alias("correct"), "split",
    )
