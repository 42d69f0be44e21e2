"""The feature matrix: returns, ratios, calendar, label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketfeat.functions.numeric import clip, ieee_divide, ieee_ln, nonzero, rolling
from marketfeat.operators.frames import extremes_layer
from marketfeat.operators.series import (
    PLACE, Layer, Layout, Stage, as_keys, over_series, place_columns, run_layers, series_layers,
)

# The feature columns in their order, and the bounds of the returns per horizon.
FEATURE_COLUMNS = (
    "ret_1d", "ret_5d", "ret_10d", "ret_20d",
    "rsi", "macd", "bb_pct", "bb_width", "turbulence",
    "close_to_ema9", "close_to_ema21", "close_to_ema50",
    "close_to_high", "close_to_low", "gap_pct", "high_low_range_pct",
    "volume_ma5_ratio", "volume_ma20_ratio", "vol_ratio_5_20",
    "rolling_vol_10", "rolling_vol_20", "volume_trend",
    "52w_high_ratio", "52w_low_ratio",
    "near_upper_circuit", "near_lower_circuit",
    "day_of_week", "month",
    "sentiment_relevant", "sentiment_ticker", "news_count",
)
RETURN_BOUNDS = {1: 0.15, 5: 0.40, 10: 0.50, 20: 0.60}
NEWS_COLUMNS = ("sentiment_relevant", "sentiment_ticker", "news_count")
RANGE_ROWS = 126
HORIZON = 5
THRESHOLD = 0.01


# -- window features ----------------------------------------------------------------

def return_layer(bounds: dict[int, float] = RETURN_BOUNDS) -> Layer:
    def layer(lay: Layout) -> list[Stage]:
        bases = {n: "ldcp" if n == 1 else f"_close_{n}" for n in bounds}
        return [
            {f"_close_{n}": F.lag("close", n).over(lay.window) for n in bounds if n != 1},
            {f"_ratio_{n}": ieee_divide(F.col("close"), F.col(base)) for n, base in bases.items()},
            {f"_ln_{n}": ieee_ln(F.col(f"_ratio_{n}")) for n in bounds},
            {f"ret_{n}d": clip(F.col(f"_ln_{n}"), -bound, bound) for n, bound in bounds.items()},
        ]

    return layer


def log_returns(df: DataFrame, bounds: dict[int, float] = RETURN_BOUNDS, **series) -> DataFrame:
    """Clipped log returns; the one-day return uses ``ldcp``, the others the n-th row before."""
    return series_layers(df, [return_layer(bounds)], back=max(bounds), **series)


def volatility_layer(lay: Layout) -> list[Stage]:
    w = lay.window
    ret = F.col("ret_1d")
    return [
        {
            "_vol_5": rolling(F.stddev_samp, ret, 5, w),
            "rolling_vol_10": rolling(F.stddev_samp, ret, 10, w),
            "rolling_vol_20": rolling(F.stddev_samp, ret, 20, w),
        },
        {"_vol_ratio": F.col("_vol_5") / nonzero(F.col("rolling_vol_20"))},
        {"vol_ratio_5_20": clip(F.col("_vol_ratio"), 0, 5)},
    ]


def rolling_vol(df: DataFrame, **series) -> DataFrame:
    """Sample deviation of ``ret_1d`` over 10 and 20 rows, and the clipped ratio of 5 to 20."""
    return series_layers(df, [volatility_layer], back=19, **series)


def volume_layer(lay: Layout) -> list[Stage]:
    w = lay.window
    volume = F.col("volume")
    return [
        {"_sum_5": rolling(F.avg, volume, 5, w), "_sum_20": rolling(F.avg, volume, 20, w)},
        {"_mean_5": nonzero(F.col("_sum_5")), "_mean_20": nonzero(F.col("_sum_20"))},
        {
            "_ratio_v5": volume / F.col("_mean_5"), "_ratio_v20": volume / F.col("_mean_20"),
            "_ln_v": ieee_ln(F.col("_mean_5") / F.col("_mean_20")),
        },
        {
            "volume_ma5_ratio": clip(F.col("_ratio_v5"), 0, 10),
            "volume_ma20_ratio": clip(F.col("_ratio_v20"), 0, 10),
            "volume_trend": clip(F.col("_ln_v"), -2, 2),
        },
    ]


def volume_ratios(df: DataFrame, **series) -> DataFrame:
    """Volume against its 5- and 20-row means, and the log ratio of the means."""
    return series_layers(df, [volume_layer], back=19, **series)


def range_layer(n: int = RANGE_ROWS) -> Layer:
    extremes = extremes_layer("close", n, "_top", "_bottom")

    def layer(lay: Layout) -> list[Stage]:
        close = F.col("close")
        return [
            *extremes(lay),
            {"_to_top": ieee_divide(close, F.col("_top")) - 1, "_to_bottom": ieee_divide(close, F.col("_bottom")) - 1},
            {"52w_high_ratio": clip(F.col("_to_top"), -1, 0), "52w_low_ratio": clip(F.col("_to_bottom"), 0, 3)},
        ]

    return layer


def range_ratio(df: DataFrame, n: int = RANGE_ROWS, **series) -> DataFrame:
    """Close against the highest and the lowest close of the last ``n`` rows."""
    return series_layers(df, [range_layer(n)], back=n - 1, **series)


def forward_layer(horizon: int = HORIZON) -> Layer:
    return lambda lay: [
        {"_later": F.lead("close", horizon).over(lay.window)},
        {"_gain_ratio": ieee_divide(F.col("_later"), F.col("close"))},
        {"next_ret": ieee_ln(F.col("_gain_ratio"))},
    ]


def label(threshold: float = THRESHOLD) -> Column:
    """1 where the forward return is above the threshold."""
    return (F.col("next_ret") > threshold).cast("int")


def outside_noise(threshold: float = THRESHOLD) -> Column:
    """Strictly outside the noise band; a missing return is not."""
    return F.abs("next_ret") > threshold


def forward_label(df: DataFrame, horizon: int = HORIZON, threshold: float = THRESHOLD, **series) -> DataFrame:
    """Forward log return ``next_ret`` and the binary ``target``; NULL at the end of a series."""
    built = series_layers(df, [forward_layer(horizon)], back=0, ahead=horizon, **series)
    return built.withColumn("target", label(threshold))


def noise_filter(df: DataFrame, horizon: int = HORIZON, threshold: float = THRESHOLD, **series) -> DataFrame:
    """Rows whose forward return is strictly outside ``[-threshold, threshold]``."""
    built = series_layers(df, [forward_layer(horizon)], back=0, ahead=horizon, **series)
    return built.filter(outside_noise(threshold))


# -- row features -------------------------------------------------------------------

def ema_distance(df: DataFrame, spans=(9, 21, 50)) -> DataFrame:
    """Close relative to its exponential averages."""
    return row_columns(df, [distance_columns(spans)])


def bar_shape(df: DataFrame) -> DataFrame:
    """Where the close lies in the day's range, the size of the range, the opening gap."""
    return row_columns(df, [shape_columns()])


def bound_indicators(df: DataFrame) -> DataFrame:
    """Indicator columns brought to feature scale: ``macd`` per price, the rest clipped."""
    return row_columns(df, [bounded_columns()])


def circuit_flags(df: DataFrame) -> DataFrame:
    """1 where the close is near the day's upper or lower price limit; missing counts as 0."""
    return row_columns(df, [circuit_columns()])


def calendar(df: DataFrame) -> DataFrame:
    """Weekday (Monday is 0) and month."""
    return row_columns(df, [calendar_columns()])


def distance_columns(spans=(9, 21, 50)) -> Stage:
    return {f"close_to_ema{s}": clip(F.col("close") / nonzero(F.col(f"ema_{s}")) - 1, -0.5, 0.5) for s in spans}


def shape_columns() -> Stage:
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    day_range = nonzero(high - low)
    return {
        "close_to_high": clip((high - close) / day_range, 0, 1),
        "close_to_low": clip((close - low) / day_range, 0, 1),
        "high_low_range_pct": clip(ieee_divide(day_range, close), 0, 0.2),
        "gap_pct": clip(ieee_divide(F.col("open"), F.col("ldcp")) - 1, -0.5, 0.5),
    }


def bounded_columns() -> Stage:
    return {
        "macd": clip(F.col("macd") / nonzero(F.col("close")), -0.5, 0.5),
        "bb_pct": clip(F.col("bb_pct"), -0.5, 1.5),
        "bb_width": clip(F.col("bb_width"), 0, 1),
        "turbulence": clip(F.col("turbulence"), 0, 20),
    }


def circuit_columns() -> Stage:
    move = ieee_divide(F.col("close"), F.col("ldcp"))
    return {
        "near_upper_circuit": F.coalesce((move > 1.045).cast("int"), F.lit(0)),
        "near_lower_circuit": F.coalesce((move < 0.955).cast("int"), F.lit(0)),
    }


def calendar_columns(ts: str = "date") -> Stage:
    return {"day_of_week": F.weekday(ts), "month": F.month(ts)}


def row_columns(df: DataFrame, groups: list[Stage]) -> DataFrame:
    """Columns that look at their own row only, in one projection."""
    return df.withColumns({name: col for group in groups for name, col in group.items()})


# -- all together -------------------------------------------------------------------

WINDOW_LAYERS: tuple[Layer, ...] = (return_layer(), volume_layer, range_layer(), forward_layer())


def feature_layers(df: DataFrame, lay: Layout) -> DataFrame:
    """Columns that look at other rows; volatility goes second, it needs the one-day return."""
    return run_layers(run_layers(df, lay, WINDOW_LAYERS), lay, [volatility_layer])


def price_features(indicators: DataFrame, threshold: float = THRESHOLD, **series) -> DataFrame:
    """Bars that carry indicators and ``ldcp``, with every feature but the news ones, and the target.

    Rows inside the noise band and incomplete rows are gone. Key and order keep their names, and rows their place, if they carry one.
    """
    key, ts = as_keys(series.get("key", "ticker")), series.get("ts", "date")
    built = over_series(indicators, feature_layers, back=RANGE_ROWS, ahead=HORIZON, **series)
    built = built.filter(outside_noise(threshold))
    built = row_columns(built, [
        distance_columns(), shape_columns(), bounded_columns(), circuit_columns(), calendar_columns(ts),
        {"target": label(threshold)},
    ])
    own = [c for c in FEATURE_COLUMNS if c not in NEWS_COLUMNS]
    complete = built.na.drop(subset=[f"`{c}`" for c in own] + ["target"])
    lead = [ts, *key, *[c for c in series.get("tie", ()) if c in complete.columns], "close"]
    values = [F.col(f"`{c}`").cast("double").alias(c) for c in own]
    return complete.select(*lead, *values, "target", *place_columns(complete))


def with_news(
    features: DataFrame, news: DataFrame | None = None, key: str | Sequence[str] = "ticker", ts: str = "date"
) -> DataFrame:
    """The feature matrix in its column order.

    The news columns are those ``features`` has already, or those of ``news`` (one row per
    key and time), or 0. They join last: no other column depends on them.
    """
    keys = [*as_keys(key), ts]
    if news is not None:
        features = features.join(news.select(*keys, *NEWS_COLUMNS), keys, "left")
    present = set(features.columns)
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in present else F.lit(0.0) for c in NEWS_COLUMNS
    }
    lead = [c for c in features.columns if c not in (*FEATURE_COLUMNS, "target", *PLACE, ts, *as_keys(key), "close")]
    return features.withColumns(filled).select(
        ts, *as_keys(key), *lead, "close", *[F.col(f"`{c}`") for c in FEATURE_COLUMNS], "target", *place_columns(features)
    )


def feature_matrix(indicators: DataFrame, news: DataFrame | None = None, threshold: float = THRESHOLD, **series) -> DataFrame:
    """The 31 features and the target of bars that carry indicators and ``ldcp``; all rows complete."""
    return with_news(price_features(indicators, threshold, **series), news, series.get("key", "ticker"), series.get("ts", "date"))
