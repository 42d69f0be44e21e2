"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into ``SEGMENTS`` segments of equal width. Two fingerprints with at most ``DISTANCE`` differing
bits agree in one segment up to ``DISTANCE // SEGMENTS`` bits (pigeonhole), here one bit. Each segment has a table
of its values; a fingerprint looks up its own value and those of the small ball around it, and what it meets is verified
on all 64 bits. Only flips from 0 to 1 are looked up: of two values that differ in one bit, one has the 0.

Cost: distinct fingerprints only, each with 2 table rows and about 34 look-ups of 24 bytes. Copies share one row.
A table value with many fingerprints (a large group of near copies) isn't joined pair by pair: its rows are dealt in blocks,
each pair of blocks is compared in one bounded task, which returns a spanning star per group it finds, never its pairs.

``distinct_documents`` is the stage of the pipeline: the same links, shingles of three words and bit distance, one document of each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.llm.common import boxed, connected, field, hex64, table
from marketfeat.session import checkpointed

SEGMENTS, WIDTH, DISTANCE, SEED = 2, 32, 3, 42
#: A table value with more fingerprints is compared by blocks of BLOCK rows.
HOT, BLOCK = 64, 1024
#: Shingles turned into bits at once.
CHUNK = 1 << 16


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the shingles of ``shingle`` words, in order; of all words together if there are fewer."""
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())),
        np.uint64, len(words) - k + 1,
    )


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the shingles of ``shingle`` words; 0 without words."""
    words = _words(text)
    if not words:
        return 0
    hashes = shingles(words, shingle)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), ``fp`` (long) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int64())], ["doc_id", "h", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h"), text).mapInArrow(run, "doc_id long, h long, fp long")


def _segments(fps: DataFrame) -> DataFrame:
    """``seg``, ``val``, ``fp``: the tables."""
    parts = F.array(*[
        F.struct(F.lit(i).alias("seg"), F.expr(f"shiftrightunsigned(fp, {i * WIDTH}) & {2 ** WIDTH - 1}L").alias("val"))
        for i in range(SEGMENTS)
    ])
    return fps.select("fp", F.inline(parts)).select("seg", "val", "fp")


def _ball(tables: DataFrame) -> DataFrame:
    """The values one bit above each row's value."""
    near = F.expr(
        f"filter(transform(sequence(0, {WIDTH - 1}), i -> val | shiftleft(1L, i)), v -> v != val)"
    )
    return tables.select("seg", F.explode(near).alias("val"), "fp")


def _stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest index linked to each of ``fps`` through links inside this array."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= DISTANCE
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return fps, fps[label]
        label = low


def links(fps: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` that join every two of the distinct ``fp`` with at most DISTANCE differing bits.

    A link either stands as a row, or its ends are joined by rows of one star.
    """
    own = checkpointed(_segments(fps))
    sizes = own.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n"))
    hot = checkpointed(sizes.filter(F.col("n") > HOT).select("seg", "val"))
    cool = own.join(hot, ["seg", "val"], "left_anti").withColumnRenamed("fp", "b")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= DISTANCE
    same = own.alias("p").join(cool.alias("t"), (F.col("p.seg") == F.col("t.seg")) & (F.col("p.val") == F.col("t.val"))
                               & (F.col("p.fp") < F.col("t.b")) & far)
    flip = _ball(own).alias("p").join(cool.alias("t"), (F.col("p.seg") == F.col("t.seg")) & (F.col("p.val") == F.col("t.val")) & far)
    single = same.select("p.fp", "t.b").union(flip.select("p.fp", "t.b")).toDF("a", "b")

    met = own.union(_ball(own)).join(hot, ["seg", "val"], "left_semi")
    blocks = met.groupBy("seg", "val").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = met.join(blocks, ["seg", "val"]).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "seg", "val", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = _stars(np.unique(group["fp"].to_numpy()))
        return pd.DataFrame({"a": a, "b": b})[a != b]

    grouped = dealt.groupBy("seg", "val", "i", "j").applyInPandas(compare, "a long, b long")
    return single.union(grouped)


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (long), ``component_id`` of each row of ``docs`` (doc_id, text).

    Words are runs of non-white ASCII, A-Z in lower case; a text with fewer than ``shingle`` words has one shingle, one without
    words (null, empty) fingerprint 0, linked like any other. Copies and repeated rows share their fingerprint. The component
    is named by its smallest doc_id; a row without an id counts through its fingerprint, and a component without
    any id is null. Other columns are ignored.
    """
    rows, named = _grouped(docs, shingle)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(named, "fp").groupBy("group").agg(F.min("first").alias("component_id"))
    names = named.join(least, "group").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """``fingerprints`` of ``docs``, stored, and ``fp``, ``group`` of each different fingerprint."""
    rows = checkpointed(fingerprints(docs, shingle))
    fps = rows.select("fp").distinct()
    groups = connected(links(fps))
    return rows, fps.join(groups, fps["fp"] == groups["node"], "left").select("fp", F.coalesce("component", "fp").alias("group"))


def distinct_documents(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each group that ``near_duplicates`` links; columns stay as they are, whatever their names.

    The row with the smallest (id, hash of its text) stays, an id before none; of rows that repeat both, one. Texts without words
    are copies of each other. An empty table gives no rows.
    """
    rows, named = _grouped(docs, shingle)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = rows.join(named, "fp").groupBy("group").agg(F.min(key).alias("k")).select(
        F.col("k.doc_id").alias("first_id"), F.col("k.h").alias("first_h")
    )
    here = boxed(docs, id=field("doc_id").cast("long"), h=F.xxhash64(field("text").cast("string")))
    kept = here.join(first, here["id"].eqNullSafe(first["first_id"]) & here["h"].eqNullSafe(first["first_h"]), "left_semi")
    return kept.groupBy("id", "h").agg(F.first("row").alias("row")).select("row.*")


def op6_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), 3)
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
