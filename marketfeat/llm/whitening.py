"""Whitening of embeddings by a weighted multiplicity covariance.

An entry c becomes the integer x = floor(1024 c) + 100000, so equal vectors are found exactly. Spark groups them: one row for each
different x with its count, by two hashes of 64 bits that are checked to be a key. The fit weighs a vector by its count, or by one. It takes two passes over
the different vectors, each a map with sums per task: sums of the entries, exact as integers, then products of the centred entries as one
weighted matrix product a batch. Spark adds the sums; the driver gets the dim^2 sums and their eigenvectors, whatever the number of
rows. Each different vector is whitened once, and rows fetch the result by the key; the row's own vector isn't sent again.

n x - S is an integer, so centring loses nothing: (n x - S) / n is the exact difference, rounded once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.llm.common import table
from marketfeat.session import checkpointed

#: Fixed values of the quantisation, and components returned.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries whose x would be larger are not finite to this operator.
LARGEST = float(1 << 62)
#: An eigenvalue of no more than this share of the trace is nought: its component doesn't exist.
NOUGHT = 1e-13
_SMALL = 1 << 31


@dataclass(frozen=True)
class Fit:
    """What whitening needs of the vectors of one length."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def quantised(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``x`` (array<long>) and the hashes ``k1``, ``k2`` of the rows of ``rows`` (vec_id, embedding) that have a vector."""
    c = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * SCALE) < LARGEST))
    x = F.transform("e", lambda v: F.floor(v * SCALE) + SHIFT)
    fit = c.filter((F.size("e") > 0) & fine).select("vec_id", x.alias("x"))
    return fit.select("vec_id", "x", F.xxhash64("x").alias("k1"), F.xxhash64(F.lit("second"), "x").alias("k2"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``x``, ``n`` of the different vectors of ``quantised`` rows, stored; a vector that many rows share is one row early."""
    different = checkpointed(rows.groupBy("k1", "k2", "x").agg(F.count(F.lit(1)).alias("n")))
    if not different.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
        raise ValueError("different vectors have the same two hashes")
    return different


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their entries as a matrix, for each length of vectors in the batch."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[(offsets[rows] - offsets[0])[:, None] + np.arange(size)]


def _summed(vectors: DataFrame, part: Callable[[np.ndarray, np.ndarray], list], kind: str) -> DataFrame:
    """``dim``, ``i``, ``s``: sums over all ``vectors`` (x, w) of what ``part`` makes of a matrix and its weights; a task adds up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for rows, x in _matrix(batch.column(0)):
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + part(x, weights[rows])
        for dim, s in sums.items():
            flat = [str(v) for v in s.ravel()] if kind == "string" else s.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(s.size, dim), pa.int32()), pa.array(np.arange(s.size), pa.int32()), pa.array(flat)], ["dim", "i", "s"]
            )

    added = vectors.select("x", "w").mapInArrow(run, f"dim int, i int, s {kind}")
    return added.groupBy("dim", "i").agg(F.sum(F.col("s").cast("decimal(38,0)") if kind == "string" else F.col("s")).alias("s"))


def _entry_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted sums of the entries and, last, of the weights, as Python integers."""
    if len(x) and int(np.abs(x).max()) < _SMALL and int(w.sum()) < _SMALL:
        return np.append(w @ x, w.sum()).astype(object)
    return np.append((x.astype(object) * w.astype(object)[:, None]).sum(axis=0), int(w.sum()))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit integers where they fit, else Python's."""
    if (int(np.abs(x).max(initial=0)) * n).bit_length() < 62 and max(map(abs, sums)).bit_length() < 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    d = _deviations(x, n, sums)
    return (d / n).astype(np.float64)


def _squares(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; one that no long holds is None."""
    most = int(np.abs(d).max(initial=0))
    if most * most * max(1, d.shape[1]) < 1 << 63:
        return (d.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (d.astype(object) ** 2).sum(axis=1).tolist()]


def fit(different: DataFrame, counts: bool = True) -> dict[int, Fit]:
    """The fit of the vectors of each length: ``counts`` weighs a vector by its rows, else every one weighs one."""
    weighed = different.select("x", (F.col("n") if counts else F.lit(1)).cast("long").alias("w"))
    totals: dict[int, dict[int, int]] = {}
    for r in _summed(weighed, _entry_sums, "string").collect():  # dim + 1 numbers for each length
        totals.setdefault(r["dim"], {})[r["i"]] = int(r["s"])
    known = {dim: (s[dim], [s[i] for i in range(dim)]) for dim, s in totals.items()}

    def products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        c = _centred(x, *known[x.shape[1]])
        return (c * w[:, None]).T @ c

    sums: dict[int, np.ndarray] = {dim: np.zeros(dim * dim) for dim in known}
    for r in _summed(weighed, products, "double").collect():  # dim^2 numbers for each length
        sums[r["dim"]][r["i"]] = r["s"]
    made = {}
    for dim, (n, s) in known.items():
        v = sums[dim].reshape(dim, dim) / n
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        top = np.abs(vectors).argmax(axis=0)
        made[dim] = Fit(n, s, vectors * np.sign(vectors[top, range(dim)]), values, float(np.trace(v)))
    return made


def whitened(different: DataFrame, fits: dict[int, Fit], components: int = COMPONENTS) -> DataFrame:
    """``k1``, ``k2``, ``n``, ``dim``, ``deviation``, ``z`` of each different vector: its projections over the root of the eigenvalue."""
    kept = {
        dim: min(components, int((f.values > NOUGHT * f.trace).sum())) if f.trace > 0 else 0 for dim, f in fits.items()
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrix(batch.column(2)):
                f = fits[x.shape[1]]
                k = kept[x.shape[1]]
                d = _deviations(x, f.n, f.sums)
                z = (d / f.n).astype(np.float64) @ f.vectors[:, :k] / np.sqrt(f.values[:k])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(z.ravel()))
                few = [batch.column(i).take(pa.array(rows)) for i in (0, 1, 3)]
                dim = pa.array(np.full(len(rows), x.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*few, dim, pa.array(_squares(d), pa.int64()), lists], names)

    names = ["k1", "k2", "n", "dim", "deviation", "z"]
    return different.select("k1", "k2", "x", "n").mapInArrow(run, "k1 long, k2 long, n long, dim int, deviation long, z array<double>")


def identity_errors(white: DataFrame, counts: bool = True) -> dict[int, float]:
    """For each length, the largest absolute entry of the covariance of ``z`` over the fit list minus the identity."""
    w = (F.col("n") if counts else F.lit(1)).cast("double")
    entries = white.select("dim", w.alias("w"), "z", F.posexplode("z").alias("i", "a"))
    means = {(r["dim"], r["i"]): (r["m"], r["w"]) for r in entries.groupBy("dim", "i").agg(
        (F.sum(F.col("w") * F.col("a")) / F.sum("w")).alias("m"), F.sum("w").alias("w")).collect()}  # `components` rows for each length
    if not means:
        return {}
    spark = white.sparkSession
    table_ = spark.createDataFrame([(d, i, m) for (d, i), (m, _) in means.items()], "dim int, i int, m double")
    lists = table_.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m"))
    centred = white.select("dim", w.alias("w"), "z").join(F.broadcast(lists), "dim").select(
        "dim", "w", F.zip_with("z", F.col("m.m"), lambda a, m: a - m).alias("c")
    )
    pairs = centred.select("dim", "w", "c", F.posexplode("c").alias("i", "a")).select("dim", "w", "i", "a", F.posexplode("c").alias("j", "b"))
    worst: dict[int, float] = {}
    for r in pairs.groupBy("dim", "i", "j").agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("s")).collect():
        error = abs(r["s"] / means[(r["dim"], r["i"])][1] - (r["i"] == r["j"]))
        worst[r["dim"]] = max(worst.get(r["dim"], 0.0), error)
    return worst


def whiten(rows: DataFrame, components: int = COMPONENTS, counts: bool = True) -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``: a row for each row and component.

    Rows whose vector is null, empty, or holds a null, non-finite or unrepresentable (|1024 c| >= 2^62) entry are left out; other columns
    are ignored. Repeated rows come back once each, a null vec_id stays null. Vectors of different lengths are fitted apart; n is the weight of the
    fit list. Components without variance don't exist, so a table of one different vector, or an empty one, gives no rows. A deviation
    that no long holds is null. Equal eigenvalues have some basis of their space, the same for all rows.
    """
    ready = quantised(rows)
    different = distinct_vectors(ready)
    fits = fit(different, counts)
    white = checkpointed(whitened(different, fits, components))
    errors = identity_errors(white, counts)
    spark = rows.sparkSession
    facts = spark.createDataFrame(
        [(dim, f.n, errors.get(dim), [float(e) / f.trace for e in f.values[:components]] if f.trace > 0 else []) for dim, f in fits.items()],
        "dim int, total long, identity_error double, shares array<double>",
    )
    each = ready.select("vec_id", "k1", "k2").join(white.drop("n"), ["k1", "k2"]).join(F.broadcast(facts), "dim")
    return each.select("vec_id", "total", "deviation", "identity_error", "shares", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.col("total").alias("n"), "deviation", "whitened",
        F.get("shares", F.col("at")).alias("explained"), "identity_error",
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
