"""Exact evaluation metrics per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketfeat.functions.numeric import array_round
from marketfeat.operators.scans import LAST, MAX, SUM, scan
from marketfeat.operators.series import placed_rows

THRESHOLD = 0.5


def _join_on(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner join on columns that may hold NULL; the right side's copies go."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in cols})
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in cols])
    return left.join(renamed, condition).drop(*[f"_right_{c}" for c in cols])


def auc(df: DataFrame, by: Sequence[str], score: str = "prob_up", actual: str = "actual") -> DataFrame:
    """Exact area under the ROC curve with ties; NULL for a group with one class.

    Rows shrink to one per distinct score first, range-partitioned by group and score, so
    slices grow in number with the partitions. The negatives below a score are then counted
    inside its slice and over the slices before. No task holds all scores of a group,
    and where the cuts fall cannot change the result.
    """
    by = list(by)
    per_score = (
        df.filter(F.col(score).isNotNull() & F.col(actual).isNotNull())
        .withColumn("_score", F.col(score).cast("double"))
        .groupBy(*by, "_score")
        .agg(F.count_if(F.col(actual) == 1).alias("_pos"), F.count_if(F.col(actual) != 1).alias("_neg"))
    )
    sliced = placed_rows(per_score, by, ["_score"]).drop("_place")
    # With c negatives below in its own slice and b in the slices before, a score's share is pos * (b + c + neg / 2).
    inside = Window.partitionBy(*by, "_part").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    slices = sliced.withColumn("_won", F.col("_pos") * (below + F.col("_neg") / 2.0)).groupBy(*by, "_part").agg(
        F.sum("_won").alias("_won"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")
    )
    # One row per group and slice: a group has at most as many as there are range partitions.
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_neg").over(earlier), F.lit(0))
    wins = F.sum(F.col("_won") + F.col("_pos") * F.col("_before"))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return slices.withColumn("_before", before).groupBy(*by).agg((wins / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def acc_f1(
    df: DataFrame,
    by: Sequence[str],
    score: str = "prob_up",
    actual: str = "actual",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Rows, accuracy and F1 of ``score >= threshold``; F1 is 0 when it has no denominator."""
    up = F.col(score) >= threshold
    hit = F.col(actual) == 1
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(up == hit).alias("_right"),
        F.count_if(up & hit).alias("_tp"),
        F.count_if(up).alias("_up"),
        F.count_if(hit).alias("_hit"),
    )
    f1 = F.try_divide(2.0 * F.col("_tp"), F.col("_up") + F.col("_hit"))
    return counted.select(
        *by, "n",
        array_round(F.col("_right") / F.col("n"), 4).alias("acc"),
        array_round(F.coalesce(f1, F.lit(0.0)), 4).alias("f1"),
    )


def metrics_summary(
    df: DataFrame,
    by: Sequence[str] = ("ticker", "split"),
    score: str = "prob_up",
    actual: str = "actual",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per group: ``n, acc, auc, f1``, rounded to 4 digits."""
    by = list(by)
    area = auc(df, by, score, actual).withColumn("auc", array_round(F.col("auc"), 4))
    return acc_f1(df, by, score, actual, threshold).join(area, by, "left").select(*by, "n", "acc", "auc", "f1")


def regression_errors(df: DataFrame, by: Sequence[str], pred: str = "pred", actual: str = "actual") -> DataFrame:
    """Mean absolute error and root mean square error."""
    error = F.col(pred) - F.col(actual)
    return df.groupBy(*by).agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))


def directional_accuracy(df: DataFrame, by: Sequence[str], pred: str = "pred", actual: str = "actual") -> DataFrame:
    """Percent of rows whose prediction has the sign of the actual value (the class, for 0/1 columns)."""
    same = F.signum(F.col(pred).cast("double")) == F.signum(F.col(actual).cast("double"))
    return df.groupBy(*by).agg((F.avg(same.cast("double")) * 100).alias("directional_acc_pct"))


def residuals(df: DataFrame, pred: str = "pred", actual: str = "actual") -> DataFrame:
    """Prediction minus actual value, per row."""
    return df.withColumn("residual", F.col(pred) - F.col(actual))


def r2(df: DataFrame, by: Sequence[str], pred: str = "pred", actual: str = "actual") -> DataFrame:
    """``1 - SSres / (SStot + 1e-8)``; SStot comes from the population variance, in the same pass."""
    error = F.col(pred) - F.col(actual)
    total = F.var_pop(F.col(actual)) * F.count(F.col(actual))
    return df.groupBy(*by).agg((1 - F.sum(error * error) / (total + 1e-8)).alias("r2"))


def weighted_logloss(
    df: DataFrame,
    by: Sequence[str],
    logit: str = "logit",
    actual: str = "actual",
    pos_weight: float | Column = 1.0,
    smooth: float = 0.0,
) -> DataFrame:
    """Mean binary cross entropy on logits, positives weighted, labels optionally smoothed."""
    z = F.col(logit)
    y = F.col(actual) * (1 - smooth) + 0.5 * smooth
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    tail = F.log1p(F.exp(-F.abs(z)))
    loss_pos = F.greatest(-z, F.lit(0.0)) + tail
    loss_neg = F.greatest(z, F.lit(0.0)) + tail
    return df.groupBy(*by).agg(F.avg(weight * y * loss_pos + (1 - y) * loss_neg).alias("loss"))


# -- training history ---------------------------------------------------------------

def best_epoch(history: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """First epoch with the lowest validation loss, that loss, and the highest validation AUC."""
    return history.groupBy(*by).agg(
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"),
        F.max("val_auc").alias("best_val_auc"),
    )


def early_stop(history: DataFrame, patience: int, by: Sequence[str] = ("run",)) -> DataFrame:
    """Where training would stop: the first epoch that is the ``patience``-th without a new best AUC.

    An epoch is a new best when its AUC is above every earlier one (and above 0). The epochs are sorted and written once; the
    running best, the place of the last new best and whether patience has run out are three scans over that table, so a long run
    is not in one task. ``stop_epoch`` is NULL when patience never runs out; ``best_epoch``/``best_val_auc`` are as of the stop. Rows
    without a run or an epoch are left out.
    """
    by = list(by)
    placed = placed_rows(history.dropna(subset=[*by, "epoch"]), by, ["epoch"])
    best = scan(placed, by, {"_best": (F.col("val_auc"), MAX, False), "_nth": (F.lit(1).cast("long"), SUM, True)})
    improved = F.coalesce(F.col("val_auc") > F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.0)), F.lit(False))
    marked = scan(best.withColumn("_improved", improved), by, {"_mark": (F.when(F.col("_improved"), F.col("_nth")), LAST, True)})
    out = (F.col("_nth") - F.coalesce("_mark", F.lit(0)) >= patience).cast("int")
    until = scan(marked.withColumn("_out", out), by, {"_over": (F.col("_out"), MAX, False)}).filter(F.coalesce("_over", F.lit(0)) == 0)
    return until.groupBy(*by).agg(
        F.max_by("epoch", F.when(F.col("_improved"), F.col("_nth"))).alias("best_epoch"),
        F.max(F.when(F.col("_improved"), F.col("val_auc"))).alias("best_val_auc"),
        F.max(F.when(F.col("_out") == 1, F.col("epoch"))).alias("stop_epoch"),
        F.count(F.lit(1)).alias("epochs_run"),
    )
