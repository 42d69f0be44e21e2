"""Small inputs and brute-force answers."""

from __future__ import annotations

import datetime as dt
import math
import random

DAY = dt.date(2015, 1, 1)


def day_of(n: int) -> dt.date:
    return DAY + dt.timedelta(days=n)


def random_bars(ticker: str, n: int, seed: int = 0, gap: bool = True):
    """Bars of one ticker, on irregular days."""
    rng = random.Random(f"{ticker}-{seed}")
    day, close, rows = DAY, 100.0, []
    for _ in range(n):
        day += dt.timedelta(days=rng.choice([1, 1, 1, 3]) if gap else 1)
        opened = close * (1 + rng.uniform(-0.02, 0.02))
        close = max(1.0, opened * (1 + rng.gauss(0, 0.03)))
        high, low = max(opened, close) * (1 + rng.random() * 0.01), min(opened, close) * (1 - rng.random() * 0.01)
        rows.append((ticker, day, opened, high, low, close, float(rng.randrange(1, 5000))))
    return rows


BAR_DDL = "ticker string, date date, open double, high double, low double, close double, volume double"


def by_key(rows, key, order):
    out = {}
    for row in rows:
        out.setdefault(row[key], []).append(row)
    for group in out.values():
        group.sort(key=lambda x: x[order])
    return out


def close_to(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, str):
        return a == b
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def mean(xs):
    return math.fsum(xs) / len(xs)


def sd(xs, ddof):
    m = mean(xs)
    return math.sqrt(math.fsum((x - m) ** 2 for x in xs) / (len(xs) - ddof))


def tail(xs, i, n):
    """The last n values up to i, or None if one is missing."""
    if i + 1 < n:
        return None
    window = xs[i + 1 - n:i + 1]
    return None if any(x is None for x in window) else window


def ema_of(xs, span):
    a, out = 2 / (span + 1), []
    for x in xs:
        out.append(x if not out else a * x + (1 - a) * out[-1])
    return out


def auc_of(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y != 1]
    if not pos or not neg:
        return None
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return wins / (len(pos) * len(neg))
