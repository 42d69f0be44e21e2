"""What several operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketfeat.session import checkpointed

#: Bytes that what a Python worker remembers may take.
MEMORY = 48 << 20
T = TypeVar("T")
_held: dict[tuple, object] = {}


def held(*key, make: Callable[[], T]) -> T:
    """The one object that a Python worker keeps from task to task, by its key.

    Workers are reused by all operators and stages: asking for another object drops the one held before, so what one
    stage remembers never stays beside that of the next.
    """
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # freed memory goes back to the machine, for the next stage's workers
                trim(0)
        _held[key] = make()
    return _held[key]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(df: DataFrame, **keys: Column) -> DataFrame:
    """Each row of ``df`` as one struct ``row``, and ``keys`` beside it, given over ``row``'s fields.

    Inside the struct no column can clash with a name that an operator uses; ``select("row.*")`` gives the rows back.
    """
    held_ = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return held_.select("row", *[value.alias(name) for name, value in keys.items()])


def field(name: str) -> Column:
    """A field of a ``boxed`` row."""
    return F.col("row").getField(name)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts)).cast("int")


def hex64(value: Column) -> Column:
    """A long as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node of an edge list: columns ``node``, ``component``.

    Alternating large-star and small-star rounds. A round is two aggregations and two equi-joins on
    nodes, written to the shared folder, so neither a component nor the edge list meets in one task.
    A node that is the smallest of its component, or has no edge, is not returned; loops and null ends are ignored.
    """
    now = checkpointed(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))).distinct()
    )
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.toDF("node", "component")
        seen = state
        both = now.toDF("u", "v").union(now.select("lo", "hi"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = large.join(down, "hi")
        now = checkpointed(
            pairs.filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(down.select("hi", "m")).distinct()
        )


def ranked(df: DataFrame, key: list[str], order: list[str], rank: str, salts: int = 1024) -> DataFrame:
    """0-based rank of each row in its key, for keys of any size.

    Rows are ranked inside ``salts`` hashed slices of the key, then shifted by the sizes of the slices before;
    the windows hold a slice of a key, or one row per slice. The order is by slice, then by ``order``.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(salts)))
    inside = Window.partitionBy(*key, "_slice").orderBy(*order)
    before = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sliced.groupBy(*key, "_slice").agg(F.count(F.lit(1)).alias("_rows")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"),
    )
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = sliced.withColumn("_inside", F.row_number().over(inside).cast("long") - 1)
    return placed.join(shifts, same).select(*df.columns, (F.col("_inside") + F.col("_shift")).alias(rank))
