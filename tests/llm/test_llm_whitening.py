"""Whitening against numpy on the whole list, one vector a row."""

import math
import random

import numpy as np

from marketfeat.llm import whitening

DDL = "vec_id long, embedding array<double>, k1 string, x int"


def listed(rows, dim):
    out = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, [math.floor(1024 * c) + 100000 for c in v]))
    return out


def check(got, rows, dim, components=8, weights=None):
    mine = listed(rows, dim)
    fit = mine if weights is None else list({tuple(x): (i, x) for i, x in mine}.values())
    x = np.array([v for _, v in fit], np.int64)
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    here = {i: v for i, v in mine}
    signs = {}
    for i, x_ in here.items():
        times = sum(1 for j, _ in mine if j == i)
        assert sorted(by[i]) == list(range(1, components + 1))
        for k in range(1, components + 1):
            assert len(by[i][k]) == times
            for r in by[i][k]:
                assert r["n"] == n
                if times == 1:
                    assert r["deviation"] == sum((n * a - int(b)) ** 2 for a, b in zip(x_, s))
                    want = (n * np.array(x_) - s) / n @ u[:, k - 1] / math.sqrt(e[k - 1])
                    sign = signs.setdefault(k, 1.0 if abs(r["whitened"] - want) < abs(r["whitened"] + want) else -1.0)
                    assert abs(r["whitened"] - sign * want) < 1e-8
                assert math.isclose(r["explained"], e[k - 1] / np.trace(v), rel_tol=1e-9) and r["identity_error"] < 1e-9


def sample(seed, dim, count):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((dim, dim))
    return [(i, [float(a) for a in mix @ rng.standard_normal(dim)]) for i in range(count)]


def test_whitening(spark):
    rows = sample(1, 12, 120)
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(5, rows[5][1]), (7, rows[8][1])]
    odd = [(2000, None), (2001, []), (2002, [None] * 12), (2003, [float("nan")] + [0.0] * 11), (2004, [float("inf")] * 12), (2005, [1e300] * 12)]
    other = [(3000 + i, [float(a) for a in v]) for i, v in sample(2, 3, 30)]
    all_ = rows + odd + other
    df = spark.createDataFrame([(i, v, "k", 1) for i, v in all_], DDL)
    got = whitening.whiten(df).collect()
    assert len(got) == 8 * len(rows) + 3 * len(other) and not {r["vec_id"] for r in got} & {i for i, _ in odd}
    check([r for r in got if r["vec_id"] < 2000], rows, 12)
    check([r for r in got if r["vec_id"] >= 3000], other, 3, 3)
    once = whitening.whiten(df, counts=False).collect()
    check([r for r in once if r["vec_id"] < 2000], rows, 12, weights=1)


def test_large_entries_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** 30, float(rng.randrange(-5, 5)), 2.0 ** 29]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame([(i, v, "k", 1) for i, v in rows], DDL)).collect()
    x = {i: [math.floor(1024 * c) + 100000 for c in v] for i, v in rows}
    s = [sum(v[k] for v in x.values()) for k in range(3)]
    for r in got:
        want = sum((40 * a - b) ** 2 for a, b in zip(x[r["vec_id"]], s))
        assert r["deviation"] == (want if want < 1 << 63 else None)
    assert len(got) >= 40 and any(r["deviation"] is None for r in got)


def test_ties_and_small_tables(spark):
    square = spark.createDataFrame([(1, [0.0, 0.0], "a", 1), (2, [1.0, 0.0], "a", 1), (3, [0.0, 1.0], "a", 1), (None, [1.0, 1.0], "a", 1)], DDL)
    got = whitening.whiten(square).collect()
    z = np.zeros((4, 2))
    for r in got:
        z[(r["vec_id"] or 4) - 1, r["component"] - 1] = r["whitened"]
    assert np.allclose(z.T @ z / 4, np.eye(2)) and all(math.isclose(r["explained"], 0.5) for r in got)
    one = spark.createDataFrame([(1, [1.0, 2.0], "a", 1), (2, [1.0, 2.0], "a", 1)], DDL)
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0


def test_query(spark, testdata):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{testdata}/embeddings.parquet").collect()]
    check(whitening.op12_embedding_whitening(spark, testdata).collect(), rows, 64)
