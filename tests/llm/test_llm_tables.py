"""Mixing and vectors against brute force, and the pipeline as a whole."""

import math
import random

import numpy as np

from marketfeat.llm import common, embeddings, mixing


def test_connected(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, None)]
    got = {r["node"]: r["component"] for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    at = {n: n for e in edges for n in e if n is not None}
    for _ in range(400):
        for a, b in edges:
            if b is not None:
                at[a] = at[b] = min(at[a], at[b])
    assert all(got.get(n, n) == c for n, c in at.items())


def test_ranked(spark):
    df = spark.createDataFrame([(i % 3 or None, i) for i in range(500)], "k long, v long")
    got = {}
    for r in common.ranked(df, ["k"], ["v"], "rank", 7).collect():
        got.setdefault(r["k"], []).append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in got.values()) and len(got) == 3


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 5, 9, 40, 200]), rng.choice(["a", "b", "c", None, "b"]), "x") for i in range(400)]
    rows += [(3, rows[3][1], rows[3][2], "x"), (None, "w w", "a", "x"), (900, None, "zz", "x"), (901, "w " * 9000, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, want = {}, {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_ = 1.5 * sum(size.values()), set(names)
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * w[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            want[s] = 2 * size[s]
            left -= 2 * size[s]
        open_ -= full
    want |= {s: level * w[s] for s in open_}
    taken = {}
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == size[r["source"]] and 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 3 for s in names if s != "a")
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() <= 2 * len(rows)


def test_multipliers_meet_targets(spark):
    rng = np.random.default_rng(1)
    rows, targets = [], {k: f for k, f in enumerate((0.05, 0.5, 1.0, 1.7, 1.99))}
    for k, f in targets.items():
        sizes = np.unique(rng.integers(1, 5000, 300))
        n = rng.integers(1, 9, len(sizes))
        rows += [(k, float(s / sizes.max()), float(s * m), float(f * (sizes * n).sum())) for s, m in zip(sizes, n)]
    groups = spark.createDataFrame(rows, "k long, x double, tokens double, target double")
    for r in mixing.multipliers(groups, 2).collect():
        mine = [x for x in rows if x[0] == r["k"]]
        assert math.isclose(sum(x[2] * min(2, math.exp(r["lam"] * x[1])) for x in mine), mine[0][3], rel_tol=1e-6)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + 0.04 * rng.standard_normal(16)], i % 2) for i in range(160)]
    rows += [(500 + i, rows[0][1], 0) for i in range(5)]
    odd = [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, [None] * 16, 0), (604, rows[0][1], None), (605, [], 0),
           (606, rows[0][1][:8], 0), (607, [float("inf")] + [1.0] * 15, 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    found = sum(got[r[0]]["n_links"] for r in rows)
    assert 0.98 * (link.sum() - len(rows)) <= found <= link.sum() - len(rows)
    for r in odd:
        if r[0] != 606 and r[0] is not None:
            assert (got[r[0]]["n_links"], got[r[0]]["component_id"], got[r[0]]["kept"]) == (0, r[0], True)
    assert all(got[500 + i]["component_id"] == got[0]["component_id"] for i in range(5))


def test_vectors_of_large_buckets(spark, monkeypatch):
    """Blocks of any size count the same links as pairs do, each once."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((3, 12))
    rows = [(i, [float(x) for x in base[i % 3] + 0.05 * rng.standard_normal(12)], i % 7 // 6) for i in range(150)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(0, 20, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")

    def result(hot, block):
        monkeypatch.setattr(embeddings, "HOT", hot)
        monkeypatch.setattr(embeddings, "BLOCK", block)
        return sorted(map(tuple, embeddings.near_duplicates(df).collect()))

    pairs = result(10_000, 8)
    assert sum(r[1] for r in pairs) > 1000
    assert result(10, 2048) == pairs and result(6, 9) == pairs


def test_pipeline(spark, testdata):
    import corpus_pipeline

    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, testdata)
        assert out.columns == docs.columns
        docs = common.checkpointed(out)
        assert docs.count() > 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, testdata).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
