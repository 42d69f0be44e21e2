"""Every window operator against a few lines of plain Python."""

import math

import pytest
from helpers import BAR_DDL, by_key, close_to, mean, random_bars, sd, tail

from marketfeat.operators import features, indicators


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(random_bars("A", 420) + random_bars("B", 40, seed=3), BAR_DDL).cache()


def groups(df):
    return by_key([r.asDict() for r in df.collect()], "ticker", "date").values()


def check(df, col, expected, tol=1e-9):
    for rows in groups(df):
        want = expected(rows)
        for i, (row, w) in enumerate(zip(rows, want)):
            assert close_to(row[col], w, tol), (row["ticker"], i, col, row[col], w)


def col(rows, name):
    return [r[name] for r in rows]


def test_ldcp_change(bars):
    def changes(rows):
        closes = col(rows, "close")
        return [None] + [round((b - a) * 100) / 100 for a, b in zip(closes, closes[1:])]

    df = indicators.ldcp_change(bars)
    check(df, "ldcp", lambda rows: [None, *col(rows, "close")[:-1]])
    check(df, "change", changes)
    check(df, "change_pct", lambda rows: [
        None if c is None else round(c / r["ldcp"] * 100 * 100) / 100 for c, r in zip(changes(rows), rows)])


def test_rsi(bars):
    def want(rows):
        closes = col(rows, "close")
        delta = [None] + [b - a for a, b in zip(closes, closes[1:])]
        out = []
        for i in range(len(rows)):
            window = tail(delta, i, 14)
            if window is None:
                out.append(None)
                continue
            up, down = mean([max(x, 0) for x in window]), mean([max(-x, 0) for x in window])
            out.append(None if down == 0 else 100 - 100 / (1 + up / down))
        return out

    check(indicators.rsi(bars), "rsi", want)


def test_cci(bars):
    def want(rows):
        tp = [(r["high"] + r["low"] + r["close"]) / 3 for r in rows]
        out = []
        for i in range(len(rows)):
            window = tail(tp, i, 20)
            if window is None:
                out.append(None)
                continue
            m = mean(window)
            out.append((tp[i] - m) / (0.015 * mean([abs(x - m) for x in window])))
        return out

    check(indicators.cci(bars), "cci", want)


def ranges(rows):
    out = []
    for i, r in enumerate(rows):
        pc = rows[i - 1]["close"] if i else None
        options = [r["high"] - r["low"]] + ([abs(r["high"] - pc), abs(r["low"] - pc)] if i else [])
        out.append(max(options))
    return out


def means(xs, n):
    return [None if tail(xs, i, n) is None else mean(tail(xs, i, n)) for i in range(len(xs))]


def test_true_range(bars):
    df = indicators.true_range(bars)
    check(df, "true_range", ranges)
    check(df, "atr14", lambda rows: means(ranges(rows), 14))


def test_dmi_dx(bars):
    def want(rows):
        up, down = [0.0], [0.0]
        for a, b in zip(rows, rows[1:]):
            u, d = b["high"] - a["high"], a["low"] - b["low"]
            up.append(u if u > d and u > 0 else 0.0)
            down.append(d if d > u and d > 0 else 0.0)
        out = []
        for atr, p, m in zip(means(ranges(rows), 14), means(up, 14), means(down, 14)):
            if atr is None or p + m == 0:
                out.append(None)
            else:
                out.append(100 * abs(p - m) / (p + m))
        return out

    check(indicators.dmi_dx(bars), "dmi_dx", want, 1e-8)


def test_bollinger(bars):
    df = indicators.bollinger(bars)
    closes = lambda rows, i: tail(col(rows, "close"), i, 20)
    check(df, "bb_mid", lambda rows: means(col(rows, "close"), 20))
    check(df, "bb_upper", lambda rows: [
        None if closes(rows, i) is None else mean(closes(rows, i)) + 2 * sd(closes(rows, i), 0) for i in range(len(rows))])
    check(df, "bb_pct", lambda rows: [
        None if closes(rows, i) is None else
        (rows[i]["close"] - mean(closes(rows, i)) + 2 * sd(closes(rows, i), 0)) / (4 * sd(closes(rows, i), 0))
        for i in range(len(rows))])


def test_turbulence(bars):
    def want(rows):
        closes = col(rows, "close")
        ret = [None] + [b / a - 1 for a, b in zip(closes, closes[1:])]
        out = []
        for i in range(len(rows)):
            window = tail(ret, i, 252)
            past = window[:-1] if window else None
            out.append(((ret[i] - mean(past)) / sd(past, 0)) ** 2 if past else 0.0)
        return out

    check(indicators.turbulence(bars), "turbulence", want, 1e-8)


def test_returns_volatility_volume_range(bars):
    df = features.rolling_vol(features.log_returns(indicators.ldcp_change(bars)))
    clip = lambda x, lo, hi: None if x is None else min(max(x, lo), hi)

    def returns(rows, n, bound):
        closes = col(rows, "close")
        return [clip(math.log(c / closes[i - n]), -bound, bound) if i >= n else None for i, c in enumerate(closes)]

    for n, bound in features.RETURN_BOUNDS.items():
        check(df, f"ret_{n}d", lambda rows, n=n, bound=bound: returns(rows, n, bound))

    def deviations(rows, n):
        ret = returns(rows, 1, 0.15)
        return [None if tail(ret, i, n) is None else sd(tail(ret, i, n), 1) for i in range(len(rows))]

    check(df, "rolling_vol_10", lambda rows: deviations(rows, 10))
    check(df, "vol_ratio_5_20", lambda rows: [
        None if b is None else clip(a / b, 0, 5) for a, b in zip(deviations(rows, 5), deviations(rows, 20))])

    vol = features.range_ratio(features.volume_ratios(bars))
    check(vol, "volume_ma5_ratio", lambda rows: [
        None if m is None else clip(v / m, 0, 10) for v, m in zip(col(rows, "volume"), means(col(rows, "volume"), 5))])
    check(vol, "volume_trend", lambda rows: [
        None if b is None else clip(math.log(a / b), -2, 2)
        for a, b in zip(means(col(rows, "volume"), 5), means(col(rows, "volume"), 20))])
    check(vol, "52w_high_ratio", lambda rows: [
        None if tail(col(rows, "close"), i, 126) is None else
        clip(rows[i]["close"] / max(tail(col(rows, "close"), i, 126)) - 1, -1, 0) for i in range(len(rows))])


# -- edges --------------------------------------------------------------------------

def flat(spark, closes, **over):
    import datetime as dt

    rows = [("X", dt.date(2020, 1, 1) + dt.timedelta(days=i), over.get("open", c), c, c, c, over.get("volume", 10.0))
            for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR_DDL)


def test_constant_price(spark):
    df = flat(spark, [5.0] * 300)
    assert {r["bb_pct"] for r in indicators.bollinger(df).collect()} == {None}
    assert {r["turbulence"] for r in indicators.turbulence(df).collect()} == {0.0}
    assert {r["rsi"] for r in indicators.rsi(df).collect()} == {None}
    assert {r["cci"] for r in indicators.cci(df).collect()} == {None}


def test_rising_price_has_no_rsi(spark):
    assert {r["rsi"] for r in indicators.rsi(flat(spark, [float(i) for i in range(1, 40)])).collect()} == {None}


def test_zero_range_day(spark):
    row = features.bar_shape(indicators.ldcp_change(flat(spark, [5.0, 6.0]))).orderBy("date").collect()[1]
    assert row["close_to_high"] is None and row["high_low_range_pct"] is None


def test_zero_prices_follow_float_division(spark):
    df = features.log_returns(indicators.ldcp_change(flat(spark, [5.0, 0.0, 4.0])))
    assert [r["ret_1d"] for r in df.orderBy("date").collect()] == [None, -0.15, 0.15]
    flags = features.circuit_flags(indicators.ldcp_change(flat(spark, [5.0, 0.0, 4.0]))).orderBy("date").collect()
    assert [(r["near_upper_circuit"], r["near_lower_circuit"]) for r in flags] == [(0, 0), (0, 1), (1, 0)]


def test_cleaning_keeps_the_old_last_close(spark):
    """The change refers to a bar that cleaning removes later."""
    import datetime as dt

    rows = [("X", dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 5.0), ("X", dt.date(2020, 1, 2), 0.0, 2.0, 2.0, 2.0, 5.0),
            ("X", dt.date(2020, 1, 3), 3.0, 3.0, 3.0, 3.0, 0.0), ("X", dt.date(2020, 1, 4), 4.0, 4.0, 4.0, 4.0, 5.0)]
    kept = indicators.clean_bars(indicators.ldcp_change(spark.createDataFrame(rows, BAR_DDL))).orderBy("date").collect()
    assert [(r["close"], r["ldcp"]) for r in kept] == [(1.0, None), (4.0, 3.0)]


@pytest.mark.parametrize("n,left", [(5, 0), (252, 0), (253, 1), (378, 126)])
def test_warmup(spark, n, left):
    df = spark.createDataFrame(random_bars("W", n), BAR_DDL)
    assert indicators.drop_warmup(df).count() == left


def test_noise_filter_is_strict(spark):
    up, down = math.exp(0.01), math.exp(-0.01)
    closes = [1.0] * 5 + [up] * 5
    exact = features.forward_label(flat(spark, closes)).orderBy("date").collect()
    assert [r["target"] for r in exact[5:]] == [None] * 5
    steps = [100.0, 100.0, 100.0, 100.0, 100.0, 102.0, 100.5, 98.0, 100.0, 100.0]
    kept = features.noise_filter(flat(spark, steps)).orderBy("date").collect()
    assert [r["close"] for r in kept] == [100.0, 100.0] and [r["next_ret"] > 0 for r in kept] == [True, False]
    assert down < 1 < up


def test_feature_matrix_needs_378_rows_and_is_complete(spark):
    for n in (377, 420):
        raw = spark.createDataFrame(random_bars("F", n), BAR_DDL)
        from marketfeat.plans.pipeline import features_from_bars

        m = features_from_bars(raw)
        assert m.columns == ["date", "ticker", "close", *features.FEATURE_COLUMNS, "target"]
        rows = m.collect()
        assert (len(rows) == 0) == (n == 377)
        assert all(v is not None for r in rows for v in r)


def test_label_ignores_the_future_beyond_the_horizon(spark):
    rows = random_bars("L", 60)
    cut = spark.createDataFrame(rows[:40], BAR_DDL)
    longer = features.forward_label(spark.createDataFrame(rows, BAR_DDL)).orderBy("date").collect()
    shorter = features.forward_label(cut).orderBy("date").collect()
    assert [r["next_ret"] for r in shorter[:35]] == [r["next_ret"] for r in longer[:35]]
    assert [r["next_ret"] for r in shorter[35:]] == [None] * 5
