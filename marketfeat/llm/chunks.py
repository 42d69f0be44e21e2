"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes; a chunk ends where its high bits are zero. Chunking is normalised: no end before LEAST
bytes, a harder mask up to NORMAL, an easier one after it, an end at MOST. Boundaries follow from the last 32 bytes alone, so
an insertion moves chunks without changing those after the next boundary. The fingerprint is the set of chunk digests with the bytes
each covers; containment is the share of a document's bytes whose chunks the other document has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.llm.common import table

LEAST, NORMAL, MOST = 12, 32, 96
#: High zero bits before and after NORMAL.
HARD, EASY = 6, 4
#: A gear value a byte, from a fixed seed.
GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes hashed at once.
BLOCK = 1 << 20


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: sum of GEAR of the last 32 bytes, shifted left by their age, modulo 2^32."""
    h = GEAR[data]
    age = 1
    while age < 32:
        older = h[:-age] << np.uint32(age)
        h = h.copy()
        h[age:] += older
        age *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; never inside a UTF-8 character, but for MOST reached in broken text."""
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    hard, easy = [], []
    for at in range(0, n, BLOCK):
        low = max(0, at - 31)
        h = gear(raw[low:at + BLOCK])[at - low:]
        for mask, found in ((HARD, hard), (EASY, easy)):
            found.append(np.flatnonzero((h & np.uint32((1 << mask) - 1 << 32 - mask)) == 0) + at + 1)
    inner = lambda ends: ends[(ends >= n) | ((raw[np.minimum(ends, n - 1)] & 0xC0) != 0x80)].tolist()
    hard, easy = inner(np.concatenate(hard)) + [n + MOST], inner(np.concatenate(easy)) + [n + MOST]
    ends, start, i, j = [], 0, 0, 0
    while n - start > LEAST:
        while hard[i] < start + LEAST:
            i += 1
        end = hard[i]
        if end > start + NORMAL:
            while easy[j] <= start + NORMAL:
                j += 1
            end = easy[j]
            if end > start + MOST:
                end = start + MOST
                while end < n and end > start + 1 and raw[end] & 0xC0 == 0x80:
                    end -= 1
        if end >= n:
            break
        ends.append(end)
        start = end
    return [*ends, n] if n else []


def weights(text: str) -> dict[int, int]:
    """Digest -> bytes covered."""
    data = text.encode("utf-8", "surrogatepass")
    out: dict[int, int] = {}
    digest, start = xxhash.xxh64_intdigest, 0
    for end in cuts(data) if data else []:
        d = digest(data[start:end])
        out[d] = out.get(d, 0) + end - start
        start = end
    return out


def written(found: dict[int, int]) -> str:
    """The fingerprint as text: ``digest:bytes`` in hexadecimal, by digest; empty for an empty text."""
    return " ".join([f"{d:016x}:{w:x}" for d, w in sorted(found.items())])


def read(fingerprint: str) -> dict[int, int]:
    return {int(d, 16): int(w, 16) for d, w in (x.split(":") for x in fingerprint.split())}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's bytes in chunks that b has, each as often as in both; 1 for two empty texts, 0 for an empty a otherwise."""
    total = sum(a.values())
    if not total:
        return float(not b)
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    return sum(min(w, many[d]) for d, w in few.items() if d in many) / total


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` of each row of ``docs`` (doc_id, text); a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [written(weights(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) dealt by id into parts, each in falling order, ending with the row that comes next.

    Bounds are ids that exist (at most 4 a task, from approx_percentile), so the row at a bound, the first of the part below, is also the
    last that the part above needs; the row with the largest id ends the part of the smallest. Columns ``part``, ``doc_id``,
    ``text``, ``extra`` (true for those ends). One exchange of the texts. A null id comes last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tasks = parts or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = [i / (4 * tasks) for i in range(1, 4 * tasks)]
    known = rows.agg(F.percentile_approx("doc_id", steps, 100 * tasks).alias("q"), F.max("doc_id").alias("m")).first()
    bounds = sorted(set(known["q"] or []) | ({known["m"]} if known["m"] is not None else set()))
    # Part i holds ids over bound i-1 up to bound i.
    part = F.lit(0)
    if bounds:
        part = F.array_size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("doc_id"))) if len(bounds) < 16 else _search(bounds)
    rows = rows.withColumn("part", part.cast("int"))
    at_bound = F.element_at(F.array(*map(F.lit, bounds or [0])), F.col("part") + 1) == F.col("doc_id")
    own = F.struct("part", F.lit(False).alias("extra"))
    above = F.struct(((F.col("part") + 1) % max(1, len(bounds))).cast("int").alias("part"), F.lit(True).alias("extra"))
    dealt = rows.select("doc_id", "text", F.inline(F.when(at_bound, F.array(own, above)).otherwise(F.array(own))))
    # The end of part 0 is the largest id, yet comes last there; elsewhere the extra row is the smallest anyway.
    return dealt.repartition("part").sortWithinPartitions("part", "extra", F.col("doc_id").desc(), F.col("text").desc())


def _search(bounds: list[int]):
    """Number of bounds below doc_id, by halving: as deep as the list's logarithm."""

    def half(a: int, b: int):
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(F.col("doc_id") > bounds[m], half(m + 1, b)).otherwise(half(a, m))

    return half(0, len(bounds))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and what they share.

    Edited: the last floor(n/2) code points give way to the first as many (or all) of the next document, by falling doc_id; after
    the last comes the first. A null text is empty. Rows with one id follow each other by falling text. A single
    row is its own next. Texts stream through a task in order; one row is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, str, dict[int, int]] | None = None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text, part, extra in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = text.as_py()
                ended = last is not None and last[0] != part
                found = weights(text) if not extra or not ended else {}
                if last is not None and last[0] == part:
                    _, before, old, fp = last
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    other = weights(edited)
                    values = (
                        None if before == -(1 << 63) else before, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        written(fp), written(other), containment(fp, other), containment(fp, found),
                    )
                    for column, value in zip(out, values):
                        column.append(value)
                # Of several extra rows only the first is the next one.
                last = None if extra else (part, doc_id, text, found)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], _PAIR)

    return with_next(docs).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(_PAIR, ("long", "long", "string", "string", "string", "double", "double"))))


_PAIR = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def op3_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
