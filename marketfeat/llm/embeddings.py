"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are normalised, so cosine c is distance sqrt(2 - 2c): 0.2 at 0.98. Each of TABLES tables hashes
PROJECTIONS Gaussian projections, shifted and cut into cells of WIDTH; two vectors at distance 0.2 share a table's bucket with
probability about 0.25, so 24 tables miss one in a thousand such pairs, and nearer ones far less. Candidates are the pairs of one
bucket, each once; the cosine of the vectors in double precision decides.

Equal vectors of one label are one row from the start, with a count, so a vector that a third of all rows share costs one row.
A bucket with more than HOT vectors isn't joined pair by pair: its rows are dealt in blocks, and each pair of blocks is compared in one
bounded task, which returns one row a vector (its number of links there and the group it found), never the pairs. A link is counted
in one place: as a pair of a small bucket if it has one, else in its first large bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.llm.common import connected, table
from marketfeat.session import checkpointed

TABLES, PROJECTIONS, WIDTH, COSINE, SEED = 24, 8, 1.0, 0.98, 7
#: A bucket with more vectors is compared by blocks of about BLOCK rows.
HOT, BLOCK = 64, 2048


def buckets(vectors: DataFrame, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """``rep``, ``cells`` (its bucket in each table) of ``vectors`` (rep, label, unit array<double>); labels and dimensions never share a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, label = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = flat[(offsets[rows] - offsets[0])[:, None] + np.arange(size)]
                rng = np.random.default_rng([seed, int(size)])
                a, b = rng.standard_normal((int(size), tables * projections)), rng.uniform(0, width, tables * projections)
                cells = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(rows), tables, projections)
                key = np.zeros((len(rows), tables), np.uint64) + np.arange(tables, dtype=np.uint64)
                for part in (label[rows].astype(np.int64)[:, None], np.int64(size), *np.moveaxis(cells, 2, 0)):
                    key = (key ^ np.asarray(part, np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[rows]), pa.array(list(key.view(np.int64)), pa.list_(pa.int64()))], ["rep", "cells"]
                )

    return vectors.select("rep", "label", "unit").mapInArrow(run, "rep long, cells array<long>")


def _blockwise(bucket: int, diagonal: bool, group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """``a``, ``b``, ``m``: the links of two blocks of a bucket (or inside one), of those that no other place counts.

    m is the number of rows that vector a links with here, b the first vector of the group it reaches here.
    """
    unit, cells, small = (np.stack(group[c].to_numpy()) for c in ("unit", "cells", "small"))
    n, mine = group["n"].to_numpy(), group["mine"].to_numpy()
    x = np.flatnonzero(mine)
    y = x if diagonal else np.flatnonzero(~mine)
    links = np.zeros(len(group), np.int64)
    label = np.arange(len(group), dtype=np.int32)
    if len(x) and len(y):
        near = unit[x] @ unit[y].T >= cosine
        if diagonal:
            np.fill_diagonal(near, False)
        here = int(np.flatnonzero(cells[0] == bucket)[0])
        for t in range(cells.shape[1]):
            if t != here:
                elsewhere = cells[x, t][:, None] == cells[y, t][None, :]
                near &= ~(elsewhere if t < here else elsewhere & small[x, t][:, None])
        links[x] += np.where(near, n[y][None, :], 0).sum(axis=1)
        if not diagonal:
            links[y] += np.where(near, n[x][:, None], 0).sum(axis=0)
        none = np.int32(len(group))
        while True:
            low = label.copy()
            low[x] = np.minimum(label[x], np.where(near, label[y][None, :], none).min(axis=1))
            low[y] = np.minimum(low[y], np.where(near, label[x][:, None], none).min(axis=0))
            low = low[low]
            if (low == label).all():
                break
            label = low
    rep = group["rep"].to_numpy()
    return pd.DataFrame({"a": rep, "b": rep[label], "m": links})[links > 0]


def linked(vectors: DataFrame, cosine: float = COSINE, **options) -> DataFrame:
    """``a``, ``b``, ``m`` of ``vectors`` (rep, label, n, unit): a links with m rows of other vectors, and reaches b.

    Two vectors link with equal label and a cosine of ``cosine`` or more. The sums of m are the numbers of links; the pairs (a, b) join
    the ends of every link, as a row or over rows of one star.
    """
    hashed = checkpointed(buckets(vectors, **options))
    found = hashed.select("rep", F.explode("cells").alias("bucket"))
    sizes = checkpointed(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    met = found.join(sizes.filter(F.col("size") <= HOT), "bucket")
    pairs = met.alias("x").join(met.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep"))).select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b")
    ).distinct()
    unit = vectors.select("rep", "unit", "label", "n")
    dot = F.aggregate(F.zip_with("u", "v", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    near = pairs.join(unit.toDF("a", "u", "l", "n"), "a").join(unit.toDF("b", "v", "k", "m"), "b").filter(
        (F.col("l") == F.col("k")) & (F.size("u") == F.size("v")) & (dot >= cosine)
    )
    single = near.select(F.inline(F.array(F.struct("a", "b", "m"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m")))))

    large = sizes.filter(F.col("size") > HOT).select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = checkpointed(found.join(large, "bucket"))
    # Buckets of a vector that are not large: a link that shares one of them is a pair above.
    own = dealt.groupBy("rep").agg(F.collect_set("bucket").alias("large"))
    rows = own.join(hashed, "rep").join(unit, "rep").withColumn("small", F.transform("cells", lambda c: ~F.array_contains("large", c)))
    rows = dealt.join(rows.drop("large"), "rep").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("i", F.least("own", "other")).withColumn(
        "j", F.greatest("own", "other")
    ).withColumn("mine", F.col("own") == F.col("i")).withColumn("dim", F.size("unit")).drop("own", "other", "blocks")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _blockwise(key[0], key[3] == key[4], group, cosine)

    return single.union(rows.groupBy("bucket", "label", "dim", "i", "j").applyInPandas(compare, "a long, b long, m long"))


def near_duplicates(rows: DataFrame, cosine: float = COSINE, **options) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of each row of ``rows`` (vec_id, embedding, label).

    Vectors that are null, empty, zero, hold null or non-finite components, or have no label or no vec_id, link with nothing and stand
    alone. Vectors of different lengths are never compared. Rows that repeat a vector under one label all link with each other;
    rows that share a vec_id count as rows, and reach what the id reaches. Other columns are ignored.
    """
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("long"))
    square = F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & (square > 0), F.lit(False))
    marked = rows.select("vec_id", "label", F.when(good, F.col("e")).alias("e"))
    same = checkpointed(
        marked.filter("e IS NOT NULL").groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    )
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    units = checkpointed(same.withColumn("norm", norm).select("rep", "label", "n", F.transform("e", lambda x: x / F.col("norm")).alias("unit")))
    pairs = checkpointed(linked(units, cosine, **options))
    degree = pairs.groupBy("a").agg(F.sum("m").alias("others"))
    groups = connected(pairs)
    known = same.join(degree.withColumnRenamed("a", "rep"), "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("label").alias("l"), F.col("e").alias("v"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    out = marked.join(known, (marked["label"] == known["l"]) & (marked["e"] == known["v"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op9_p_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
