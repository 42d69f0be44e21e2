"""Technical indicators over daily bars.

Each indicator is a *layer*: column expressions in stages, over a Layout. The public
functions run one layer by itself; ``technical_indicators`` runs all of them over one
exchange, and layers of like depth share their window operators.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketfeat.functions.numeric import INF, array_round, ieee_divide, nonzero, rolling
from marketfeat.operators.frames import chunk_stage, frame_count, frame_moments, meet_stage, part_stage
from marketfeat.operators.series import Layer, Layout, Stage, as_keys, over_series, run_layers, series_layers

EMA_SPANS = (9, 21, 50, 200)
WARMUP_ROWS = 252

# A seed or a block older than this many e-folds is below double precision.
_FORGET = 42.0
# Largest weight ratio inside one EMA block, as a natural log (about 1e120).
_SPREAD = 276.0

INDICATOR_COLUMNS = (
    "macd", "rsi", "cci", "dmi_dx", "ema_9", "ema_21", "ema_50", "ema_200",
    "bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct", "turbulence",
)


# -- cleaning and derived prices ------------------------------------------------

def clean_bars(df: DataFrame) -> DataFrame:
    """Bars with a positive open and a positive volume."""
    return df.filter((F.col("open") > 0) & (F.col("volume") > 0))


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows without a missing value, in all or in the listed columns. NaN counts as missing."""
    return df.na.drop(subset=cols)


def change_layer(lay: Layout) -> list[Stage]:
    return [
        {"ldcp": F.lag("close", 1).over(lay.window)},
        {"change": array_round(F.col("close") - F.col("ldcp"), 2)},
        {"_share": ieee_divide(F.col("change"), F.col("ldcp"))},
        {"change_pct": array_round(F.col("_share") * 100, 2)},
    ]


def ldcp_change(df: DataFrame, **series) -> DataFrame:
    """Last day's close, change and change in percent (of the rounded change): order and key, prices, then any other columns."""
    lead = [series.get("ts", "date"), *as_keys(series.get("key", "ticker"))]
    names = [*lead, "ldcp", "open", "high", "low", "close", "change", "change_pct", "volume"]
    others = [c for c in df.columns if c not in names]
    return series_layers(df, [change_layer], back=1, **series).select(*[F.col(f"`{c}`") for c in (*names, *others)])


def warmup_layer(df: DataFrame, lay: Layout, n: int = WARMUP_ROWS) -> DataFrame:
    return df.withColumn("_place", lay.position).filter(F.col("_place") > n).drop("_place")


def drop_warmup(df: DataFrame, n: int = WARMUP_ROWS, **series) -> DataFrame:
    """Without the first ``n`` rows of each series, then without incomplete rows."""
    return drop_incomplete(over_series(df, lambda d, lay: warmup_layer(d, lay, n), back=0, **series))


# -- exponential averages ---------------------------------------------------------

def ema_reach(spans) -> int:
    """Rows after which the start of the longest average no longer shows in a double."""
    if min(spans) <= 1:
        raise ValueError("a span must be above 1")
    return max(math.ceil(_FORGET / -math.log(1 - 2 / (span + 1))) for span in spans)


def ema_layer(col: str, outputs: dict[str, int], block: int | None = None) -> Layer:
    """Exponential averages ``e0 = x0, e_t = a*x_t + (1-a)*e_(t-1)`` with ``a = 2/(span+1)``.

    The recurrence is unrolled over blocks of positions. Inside a block it is a
    running sum of ``x_k * q**-k`` scaled by ``q**j`` (all terms have one sign, so
    nothing cancels); the end value of an earlier block enters as ``q**distance``
    times that value, for as many blocks back as still count in a double.
    ``col`` must not be null.
    """
    decay = {name: 1 - 2 / (span + 1) for name, span in outputs.items()}
    if min(decay.values()) <= 0:
        raise ValueError("a span must be above 1")
    widest = max(-math.log(q) for q in decay.values())
    rows = block or max(1, min(1024, int(_SPREAD / widest)))

    def layer(lay: Layout) -> list[Stage]:
        at, step = F.col("_at"), F.col("_step")
        inside = Window.partitionBy(*lay.partition, "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        chunks = Window.partitionBy(*lay.partition).orderBy("_chunk")
        sums: Stage = {}
        ends: Stage = {}
        carried: Stage = {}
        for name, q in decay.items():
            x = F.when(at == 0, F.col(col)).otherwise(F.lit(1 - q) * F.col(col))
            sums[f"_sum_{name}"] = F.sum(x * F.pow(F.lit(q), -step)).over(inside)
            here = F.col(f"_sum_{name}") * F.pow(F.lit(q), step)
            ends[f"_end_{name}"] = F.when(step == rows - 1, here)
            depth = max(1, math.ceil(_FORGET / (-math.log(q) * rows)))
            carry = F.lit(0.0)
            for m in range(1, depth + 1):
                end = F.max(f"_end_{name}").over(chunks.rangeBetween(-m, -m))
                carry = carry + F.lit(q ** (rows * (m - 1))) * F.coalesce(end, F.lit(0.0))
            carried[name] = here + F.pow(F.lit(q), step + 1) * carry
        return [
            {"_at": lay.position - 1},
            {"_chunk": F.floor(at / F.lit(rows)), "_step": at % rows},
            sums, ends, carried,
        ]

    return layer


def ema(df: DataFrame, span: int, col: str = "close", out: str | None = None, block: int | None = None, **series) -> DataFrame:
    """One exponential average as a new column (``ema_<span>``)."""
    name = out or f"ema_{span}"
    return series_layers(df, [ema_layer(col, {name: span}, block)], back=ema_reach([span]), **series)


def macd_layer(fast: int, slow: int, col: str, out: str, others: dict[str, int] | None = None) -> Layer:
    averages = ema_layer(col, {"_fast": fast, "_slow": slow, **(others or {})})
    return lambda lay: [*averages(lay), {out: F.col("_fast") - F.col("_slow")}]


def macd(df: DataFrame, fast: int = 12, slow: int = 26, col: str = "close", out: str = "macd", **series) -> DataFrame:
    """Difference of a fast and a slow exponential average; there is no signal line."""
    return series_layers(df, [macd_layer(fast, slow, col, out)], back=ema_reach([fast, slow]), **series)


# -- oscillators ------------------------------------------------------------------

def rsi_layer(n: int = 14) -> Layer:
    def layer(lay: Layout) -> list[Stage]:
        w = lay.window
        delta = F.col("_delta")
        gain = F.when(delta > 0, delta).when(delta <= 0, F.lit(0.0))
        loss = F.when(delta < 0, -delta).when(delta >= 0, F.lit(0.0))
        return [
            {"_delta": F.col("close") - F.lag("close", 1).over(w)},
            {"_gain": gain, "_loss": loss},
            {"_gains": rolling(F.avg, F.col("_gain"), n, w), "_losses": rolling(F.avg, F.col("_loss"), n, w)},
            {"rsi": 100 - 100 / (1 + F.col("_gains") / nonzero(F.col("_losses")))},
        ]

    return layer


def rsi(df: DataFrame, n: int = 14, **series) -> DataFrame:
    """Relative strength from plain means of gains and losses; no loss in the frame gives NULL."""
    return series_layers(df, [rsi_layer(n)], back=n, **series)


def cci_layer(n: int = 20) -> Layer:
    def layer(lay: Layout) -> list[Stage]:
        w = lay.window
        spread = F.aggregate("_frame", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_tp_mean"))) / n
        return [
            {"_tp": (F.col("high") + F.col("low") + F.col("close")) / 3},
            {"_tp_mean": rolling(F.avg, F.col("_tp"), n, w), "_frame": F.collect_list("_tp").over(w.rowsBetween(-(n - 1), 0))},
            {"_spread": spread},
            {"cci": (F.col("_tp") - F.col("_tp_mean")) / (F.lit(0.015) * nonzero(F.col("_spread")))},
        ]

    return layer


def cci(df: DataFrame, n: int = 20, **series) -> DataFrame:
    """Commodity channel index: distance from the mean in units of 0.015 mean absolute deviations."""
    return series_layers(df, [cci_layer(n)], back=n - 1, **series)


def _ranges(lay: Layout) -> Stage:
    prev = F.lag("close", 1).over(lay.window)
    return {"true_range": F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )}


def true_range_layer(n: int = 14) -> Layer:
    return lambda lay: [_ranges(lay), {f"atr{n}": rolling(F.avg, F.col("true_range"), n, lay.window)}]


def true_range(df: DataFrame, n: int = 14, **series) -> DataFrame:
    """True range (high minus low on the first row) and its mean over ``n`` rows."""
    return series_layers(df, [true_range_layer(n)], back=n, **series)


def dmi_layer(n: int = 14) -> Layer:
    def layer(lay: Layout) -> list[Stage]:
        w = lay.window
        up, down = F.col("_up"), F.col("_down")
        atr = F.col("_atr")
        return [
            {
                "_true_range": _ranges(lay)["true_range"],
                "_up": F.col("high") - F.lag("high", 1).over(w),
                "_down": F.lag("low", 1).over(w) - F.col("low"),
            },
            {
                "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0),
                "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
            },
            {
                "_atr": nonzero(rolling(F.avg, F.col("_true_range"), n, w)),
                "_plus_mean": rolling(F.avg, F.col("_plus"), n, w),
                "_minus_mean": rolling(F.avg, F.col("_minus"), n, w),
            },
            {"_plus_di": 100 * F.col("_plus_mean") / atr, "_minus_di": 100 * F.col("_minus_mean") / atr},
            {"dmi_dx": 100 * F.abs(F.col("_plus_di") - F.col("_minus_di"))
                / nonzero(F.col("_plus_di") + F.col("_minus_di"))},
        ]

    return layer


def dmi_dx(df: DataFrame, n: int = 14, **series) -> DataFrame:
    """Directional movement index, unsmoothed."""
    return series_layers(df, [dmi_layer(n)], back=n, **series)


def bollinger_layer(n: int = 20, k: float = 2.0) -> Layer:
    def layer(lay: Layout) -> list[Stage]:
        w = lay.window
        mid, sd, band = F.col("bb_mid"), F.col("_sd"), F.col("_band")
        return [
            {},
            {"bb_mid": rolling(F.avg, F.col("close"), n, w), "_sd": rolling(F.stddev_pop, F.col("close"), n, w)},
            {"bb_upper": mid + k * sd, "bb_lower": mid - k * sd},
            {"_band": nonzero(F.col("bb_upper") - F.col("bb_lower"))},
            {"bb_width": band / nonzero(mid), "bb_pct": (F.col("close") - F.col("bb_lower")) / band},
        ]

    return layer


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, **series) -> DataFrame:
    """Bollinger bands from the population deviation; a band of width zero gives NULL ratios."""
    return series_layers(df, [bollinger_layer(n, k)], back=n - 1, **series)


def turbulence_layer(n: int = 252) -> Layer:
    m, name, stats = n - 1, "turb", ("mean", "var")

    def layer(lay: Layout) -> list[Stage]:
        change, ret, sigma = F.col("_change"), F.col("_ret"), F.col("_sigma")
        mean, deviation = frame_moments(m, name, ends=1)
        z = (ret - F.col("_mu")) / sigma
        return [
            {"_prev": F.lag("close", 1).over(lay.window), **chunk_stage(lay, m)},
            {"_change": ieee_divide(F.col("close"), F.col("_prev")) - 1},
            # An infinite return counts as missing in a rolling frame.
            {"_ret": F.when(F.abs(change) < INF, change)},
            part_stage(lay, "_ret", m, stats, name),
            meet_stage(lay, m, stats, name, ends=1),
            {"_mu": mean, "_sigma": deviation, "_seen": frame_count(m, name, ends=1)},
            {"turbulence": F.when((F.col("_seen") == m) & (sigma != 0) & ret.isNotNull(), z * z).otherwise(0.0)},
        ]

    return layer


def turbulence(df: DataFrame, n: int = 252, **series) -> DataFrame:
    """Squared z-score of today's return against the ``n - 1`` returns before it; 0 until those exist."""
    return series_layers(df, [turbulence_layer(n)], back=n, **series)


# -- all together -------------------------------------------------------------------

def technical_indicators(df: DataFrame, warmup: int = WARMUP_ROWS, **series) -> DataFrame:
    """All indicator columns of cleaned bars, warm-up rows and incomplete rows dropped."""
    bars = df.columns
    frames = [rsi_layer(), cci_layer(), dmi_layer(), bollinger_layer(), turbulence_layer()]
    averages = macd_layer(12, 26, "close", "macd", {f"ema_{span}": span for span in EMA_SPANS})

    def build(d: DataFrame, lay: Layout) -> DataFrame:
        d = run_layers(d, lay, [lambda lay: [{"nth": lay.position}], *frames])
        return run_layers(d, replace(lay, position=F.col("nth")), [averages]).filter(F.col("nth") > warmup)

    reach = max(ema_reach((12, 26, *EMA_SPANS)), 252)
    return drop_incomplete(over_series(df, build, back=reach, **series).select(*bars, *INDICATOR_COLUMNS))
