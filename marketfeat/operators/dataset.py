"""Splits, scaling and sequence samples for the direction models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketfeat.operators.series import Layout, as_keys, over_series

TRAIN_RATIO = 0.70
VAL_RATIO = 0.15
EPSILON = 2.220446049250313e-16  # distance from 1.0 to the next double


def split_by_order(df: DataFrame, train: float = TRAIN_RATIO, val: float = VAL_RATIO, **series) -> DataFrame:
    """Column ``split``: the first ``int(n*train)`` rows of a series, then up to ``int(n*(train+val))``, then the rest."""

    def build(d: DataFrame, lay: Layout) -> DataFrame:
        d = d.withColumns({"_nth": lay.position, "_rows": lay.size})
        cut = F.when(F.col("_nth") <= F.floor(F.col("_rows") * F.lit(float(train))), F.lit("train")).when(
            F.col("_nth") <= F.floor(F.col("_rows") * F.lit(float(train + val))), F.lit("val")
        ).otherwise(F.lit("test"))
        return d.withColumn("split", cut).drop("_nth", "_rows")

    return over_series(df, build, back=0, **series)


# -- scaler -------------------------------------------------------------------------

def scaler_fit(df: DataFrame, cols: Sequence[str], key: str = "ticker", ts: str = "date") -> DataFrame:
    """Scaler state ``(key, feature, mean, scale, train_end_date)`` from the train rows alone.

    ``scale`` is the population deviation. A column that is constant up to rounding
    error gets scale 1.
    """
    train = df.filter(F.col("split") == "train")
    aggs = [F.max(ts).alias("train_end_date"), F.count(F.lit(1)).cast("double").alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.avg(F.col(f"`{c}`")).alias(f"_m{i}"), F.var_pop(F.col(f"`{c}`")).alias(f"_v{i}")]
    wide = train.groupBy(key).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_m{i}").alias("mean"), F.col(f"_v{i}").alias("variance"))
        for i, c in enumerate(cols)
    ])
    state = wide.select(key, "train_end_date", "_n", F.explode(rows).alias("s")).select(
        key, "s.feature", "s.mean", "s.variance", "train_end_date", "_n"
    )
    noise = F.col("_n") * EPSILON * F.col("variance") + F.pow(F.col("_n") * F.col("mean") * EPSILON, F.lit(2.0))
    scale = F.when(F.col("variance") <= noise, F.lit(1.0)).otherwise(F.sqrt("variance"))
    return state.select(key, "feature", "mean", scale.alias("scale"), "train_end_date")


def scaler_apply(df: DataFrame, state: DataFrame, cols: Sequence[str], key: str = "ticker") -> DataFrame:
    """``(x - mean) / scale`` on the listed columns of every split; other columns stay as they are.

    Rows of a key without state stay, with NULL in the listed columns; ``keys_without_state`` names them.
    """
    wide = state.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale")))).alias("_state")
    )
    joined = df.join(wide, key, "left")
    scaled = {
        c: ((F.col(f"`{c}`") - F.col("_state")[c]["mean"]) / F.col("_state")[c]["scale"]).alias(c) for c in cols
    }
    return joined.select(*[scaled.get(c, F.col(f"`{c}`")) for c in df.columns])


def keys_without_state(df: DataFrame, state: DataFrame, key: str = "ticker") -> DataFrame:
    """Keys of ``df`` that have no scaler state, as those without train rows, and their rows."""
    return df.join(state.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def train_end_date(df: DataFrame, key: str = "ticker", ts: str = "date") -> DataFrame:
    """Last train date per key."""
    return df.filter(F.col("split") == "train").groupBy(key).agg(F.max(ts).alias("train_end_date"))


# -- samples ------------------------------------------------------------------------

def sequence_windows(
    df: DataFrame,
    cols: Sequence[str],
    target: str = "target",
    seq_len: int = 20,
    strict: bool = False,
    key: str | Sequence[str] = "ticker",
    ts: str = "date",
    **series,
) -> DataFrame:
    """One sample per row: ``X`` holds the features of the ``seq_len`` rows before it, ``y`` its label.

    Windows stay inside one (key, split). A group of at most ``seq_len`` rows gives no
    sample; with ``strict`` such a group fails the query instead.
    """
    group = [*as_keys(key), "split"]

    def build(d: DataFrame, lay: Layout) -> DataFrame:
        before = lay.window.rowsBetween(-seq_len, -1)
        row = F.array(*[F.col(f"`{c}`").cast("float") for c in cols])
        d = d.withColumns({"X": F.collect_list(row).over(before), "_rows": lay.size})
        if strict:
            short = F.col("_rows") <= seq_len
            message = F.concat(F.lit("too few rows for one sequence: "), F.col("_rows").cast("string"))
            d = d.withColumn("_rows", F.when(short, F.raise_error(message).cast("long")).otherwise(F.col("_rows")))
            d = d.filter(F.col("_rows") > 0)
        return d.filter(F.size("X") == seq_len).withColumn("y", F.col(f"`{target}`").cast("float")).drop("_rows")

    built = over_series(df, build, back=seq_len, key=group, ts=ts, **series)
    keep = [c for c in (*group, ts, *series.get("tie", ()), "close") if c in built.columns]
    return built.select(*keep, "X", "y")


def class_weight(df: DataFrame, target: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """Negative and positive rows and their ratio ``n_neg / max(n_pos, 1)``."""
    counted = df.groupBy(*by).agg(
        F.count_if(F.col(target) == 1).alias("n_pos"), F.count_if(F.col(target) == 0).alias("n_neg")
    )
    return counted.withColumn("pos_weight", F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1)))


def label_smoothing(col: Column, s: float = 0.1) -> Column:
    """Label moved towards 0.5 by the share ``s``."""
    return col * (1 - s) + 0.5 * s
