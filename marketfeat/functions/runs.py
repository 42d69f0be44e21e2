"""Runs of neighbouring words as hashes of 96 bits, for many lines at once. A line is words with one blank between.

Two runs with the same hash count as the same: among 10^15 pairs of runs, a wrong one has a chance of about 10^-14.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Bits of the filter of known runs: so many a run, rounded up to a power of two, and least and most. With more runs than that more others pass, none is lost.
BITS_A_RUN, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
#: Bytes and lines that are hashed at once, and runs that pass the filter of one chunk of lines.
CHUNK_BYTES, CHUNK_LINES, CHUNK_RUNS = 2 << 20, (1 << 16) - 1, 1_500_000
#: Bytes of a key.
KEY = 16
#: Keys that a task remembers, so that it does not hash the same line again.
SEEN = 200_000

_ZSTD = pa.Codec("zstd", 1)
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of_bytes(step: np.uint64) -> np.ndarray:
    out = _mixed(np.arange(1, 257, dtype=np.uint64) * step)
    out[32] = 0
    return out


_BYTES = [_of_bytes(step) for step in _STEPS]


def _words(lines: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The line of each word, and two hashes of it."""
    if not len(lines):
        return np.empty(0, np.int64), [np.empty(0, np.uint64)] * 2
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset:lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    if not len(data):
        return np.empty(0, np.int64), [np.empty(0, np.uint64)] * 2
    offsets = offsets.astype(np.int64) - offsets[0]
    starts = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 32) + 1]))
    line = np.searchsorted(offsets, starts, side="right") - 1
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    hashes = []
    for step, of_byte in zip(_STEPS, _BYTES, strict=True):
        powers = np.cumprod(np.full(place.max() + 1, step))
        hashes.append(_mixed(np.add.reduceat(of_byte[data] * powers[place], starts)))
    return line, hashes


def runs(lines: pa.Array, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line, size, first 64 and last 32 bits of the hash of each run of so many words as ``sizes`` says."""
    line, hashes = _words(lines)
    found = []
    for size in sizes:
        n = len(line) - size + 1
        if n <= 0:
            continue
        inside = line[:n] == line[size - 1:]
        both = []
        for step, h in zip(_STEPS, hashes, strict=True):
            run = np.full(n, np.uint64(size))
            for j in range(size):
                run = run * step + h[j:n + j]
            both.append(_mixed(run[inside]))
        found.append((line[:n][inside], np.full(len(both[0]), size), both[0], both[1].astype(np.uint32)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint32)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def hash_lines(batches: Iterable[pa.RecordBatch], sizes: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """``hash`` and ``rest`` of each whole ``phrase``, which has a size of ``sizes``, before its other columns."""
    for batch in batches:
        phrases = batch.column("phrase")
        line, size, first, rest = runs(phrases, sizes)
        whole = np.bincount(_words(phrases)[0], minlength=len(phrases))[line] == size
        place = np.argsort(line[whole])
        yield pa.RecordBatch.from_arrays(
            [pa.array(first[whole][place].view(np.int64)), pa.array(rest[whole][place].view(np.int32)), *batch.columns], ["hash", "rest", *batch.schema.names])


def _pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    start, ends = 0, np.cumsum(lengths)
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        end = min(max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right"))), start + CHUNK_LINES)
        yield start, end
        start = end


def packed(values: np.ndarray) -> bytes:
    """The bytes of ``values``, all first ones, then all second ones and so on, each compressed by itself."""
    planes = [_ZSTD.compress(p.tobytes(), asbytes=True) for p in np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T]
    return b"".join(len(p).to_bytes(4, "little") for p in planes) + b"".join(planes)


def unpacked(data: bytes, count: int, kind: type) -> np.ndarray:
    """``count`` values of ``kind`` from what ``packed`` made of them."""
    width = np.dtype(kind).itemsize
    if not count:
        return np.empty(0, kind)
    ends = 4 * width + np.cumsum([0, *np.frombuffer(data, "<u4", width)])
    out = np.empty((count, width), np.uint8)
    for j in range(width):
        out[:, j] = np.frombuffer(_ZSTD.decompress(data[ends[j]:ends[j + 1]], count, asbytes=True), np.uint8)
    return out.reshape(-1).view(kind)


def filter_bits(known: int) -> int:
    """Bits of a filter of ``known`` runs, a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_RUN * known - 1).bit_length())) if known else LEAST_BITS


def _chunk(keys: list[bytes], name: bytes, line: np.ndarray, first: np.ndarray, rest: np.ndarray, buckets: int, slices: int) -> pa.RecordBatch:
    """The rows of some lines, one a group: each different hash once, as the difference to the one before, then its lines in the same way."""
    order = np.argsort(first, kind="stable")  # a run of some size comes in the order of its lines
    line, first, rest = line[order], first[order], rest[order]
    new = np.append(True, (first[1:] != first[:-1]) | (line[1:] != line[:-1]) | (rest[1:] != rest[:-1]))
    line, first, rest = line[new], first[new], rest[new]
    heads = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])))
    count = np.diff(np.append(heads, len(line))).astype(np.uint16)
    step = np.diff(line, prepend=0)
    step[heads] = line[heads]
    first, rest, step = first[heads], rest[heads], step.astype(np.uint16)
    bucket = ((first >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    places = np.append(heads, len(line))
    base = int.from_bytes(keys[0][:4], "little") % slices * buckets
    there = np.flatnonzero(np.diff(cuts))
    rows = []
    for b in there:
        part = slice(cuts[b], cuts[b + 1])
        rows.append((
            base + int(b), name, b"" if rows else b"".join(keys), 0 if rows else len(there), packed(step[places[cuts[b]]:places[cuts[b + 1]]]),
            packed(count[part]), int(cuts[b + 1] - cuts[b]), packed(np.diff(first[part], prepend=np.uint64(0))), packed(rest[part])))
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
        ["group", "chunk", "keys", "parts", "number", "count", "hashes", "hash", "rest"])


def grouped_runs(
    batches: Iterable[pa.RecordBatch], sizes: Sequence[int], known: bytes, buckets: int, slices: int
) -> Iterator[pa.RecordBatch]:
    """The different runs of each ``line`` that pass the filter ``known``: one row for a group and a chunk of lines.

    A group is a slice of the chunks and a range of the hashes. Only the first row of a chunk has the ``keys`` of its lines and in how many ``parts`` it went
    to the groups. A chunk is named by its task, its number there and its keys.
    """
    bits, seen = np.frombuffer(known, np.uint8), set()
    mask = np.uint64(8 * len(bits) - 1)
    task = TaskContext.get()
    keys, lines, passing, chunks = [], [], 0, 0

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal passing, chunks
        if passing:
            name = blake2b(f"{task.partitionId() if task else 0} {chunks} ".encode() + b"".join(keys), digest_size=KEY).digest()
            yield _chunk(keys, name, *(np.concatenate(x) for x in zip(*lines, strict=True)), buckets, slices)
        chunks += 1
        keys.clear(), lines.clear()
        passing = 0

    for batch in batches:
        fresh = []
        for i, key in enumerate(batch.column("key").to_pylist()):
            if key not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                fresh.append(i)
        batch = batch.take(pa.array(fresh, pa.int64()))
        lengths = np.diff(np.frombuffer(batch.column("line").buffers()[1], np.int32)[:len(fresh) + 1]) if fresh else np.empty(0, int)
        for start, end in _pieces(lengths):
            line, _, first, rest = runs(batch.column("line").slice(start, end - start), sizes)
            at = first & mask
            passed = np.flatnonzero((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            if passing and (len(keys) + end - start > CHUNK_LINES or passing + len(passed) > CHUNK_RUNS):
                yield from flushed()
            some, line = np.unique(line[passed], return_inverse=True)
            lines.append(((len(keys) + line).astype(np.int32), first[passed], rest[passed]))
            keys.extend(batch.column("key").slice(start, end - start).take(pa.array(some)).to_pylist())
            passing += len(passed)
    yield from flushed()


def met(found: pa.Table, rules: pa.Table) -> pa.Table:
    """The rules of the runs of one group: a row for a part of a chunk, with the least ``priority`` of each line, ``gate`` and ``label``."""
    rules = rules.combine_chunks()
    hashes = rules["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, others = hashes[order], rules["rest"].to_numpy().view(np.uint32)[order]
    kind = np.zeros(len(order), np.int64)
    for name in ("gate", "label"):
        codes = rules[name].combine_chunks().dictionary_encode("encode")
        codes = codes if isinstance(codes, pa.DictionaryArray) else codes.combine_chunks()
        kind = kind * (len(codes.dictionary) + 1) + codes.indices.to_numpy(zero_copy_only=False)
    _, example, kind = np.unique(kind, return_index=True, return_inverse=True)
    gates, labels, kind = rules["gate"].take(pa.array(example)), rules["label"].take(pa.array(example)), kind[order]
    none = rules["priority"].is_null().to_numpy()[order]
    priority = rules["priority"].fill_null(0).to_numpy()[order]
    out = []
    for row in found.to_pylist():
        first = np.cumsum(unpacked(row["hash"], row["hashes"], np.uint64), dtype=np.uint64)
        rest, size = unpacked(row["rest"], row["hashes"], np.uint32), unpacked(row["count"], row["hashes"], np.uint16).astype(np.int64)
        ends = np.cumsum(size)
        number = np.cumsum(unpacked(row["number"], int(ends[-1]), np.uint16), dtype=np.int64)
        number -= np.repeat(np.append(0, number[ends[:-1] - 1]), size)
        left = np.searchsorted(hashes, first, side="left")
        head, rule = _ranges(left, np.searchsorted(hashes, first, side="right") - left)
        same = others[rule] == rest[head]
        head, rule = head[same], rule[same]
        which, place = _ranges((ends - size)[head], size[head])
        rule = rule[which]
        number, which, values, nulls = _least(number[place], kind[rule], priority[rule], none[rule])
        used, which = np.unique(which, return_inverse=True)
        there = pa.array(used)
        out.append({
            "chunk": row["chunk"], "keys": row["keys"], "parts": row["parts"], "hits": len(number), "number": packed(np.diff(number, prepend=0).astype(np.uint16)),
            "gates": gates.take(there).to_pylist(), "labels": labels.take(there).to_pylist(), "kind": packed(which.astype(np.uint32)),
            "priority": packed(values.astype(np.int64)), "none": packed(nulls.astype(np.uint8))})
    return pa.Table.from_pylist(out, MET)


#: What the groups leave of each part of a chunk.
MET = pa.schema([
    ("chunk", pa.binary()), ("keys", pa.binary()), ("parts", pa.int32()), ("hits", pa.int32()), ("number", pa.binary()), ("gates", pa.list_(pa.string())),
    ("labels", pa.list_(pa.string())), ("kind", pa.binary()), ("priority", pa.binary()), ("none", pa.binary()),
])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place of the ranges that begin at ``starts``: the number of its range, and the place."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _least(number: np.ndarray, kind: np.ndarray, priority: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row a number and kind, in this order, with the least priority; none is the last."""
    place = np.lexsort((priority, none, kind, number))
    number, kind, priority, none = number[place], kind[place], priority[place], none[place]
    once = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (kind[1:] != kind[:-1]))[:len(number)])
    return number[once], kind[once], priority[once], none[once]


def of_chunk(found: pa.Table) -> pa.Table:
    """The rules of the lines of one chunk, from all its parts: a row for a key, with the least ``priority`` of each ``gate`` and ``label``."""
    rows = found.to_pylist()
    if len(rows) != sum(row["parts"] for row in rows):
        raise RuntimeError("a part of a chunk is missing: its titles were read again in another order")
    keys = np.frombuffer(b"".join(row["keys"] for row in rows), f"V{KEY}")
    codes: dict[tuple, int] = {}
    parts = []
    for row in rows:
        code = np.array([codes.setdefault(x, len(codes)) for x in zip(row["gates"], row["labels"], strict=True)], np.int64)
        n = row["hits"]
        parts.append((
            np.cumsum(unpacked(row["number"], n, np.uint16), dtype=np.int64), code[unpacked(row["kind"], n, np.uint32)],
            unpacked(row["priority"], n, np.int64), unpacked(row["none"], n, np.uint8) > 0))
    number, kind, priority, none = _least(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    which, sizes = np.unique(number, return_counts=True)
    names = [pa.array([x[i] for x in codes], pa.string()).take(pa.array(kind)) for i in (0, 1)]
    hits = pa.StructArray.from_arrays([*names, pa.array(priority, mask=none)], ["gate", "label", "priority"])
    key = keys[which].tobytes()
    binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY), len(key) // KEY, [None, pa.py_buffer(key)]).cast(pa.binary())
    return pa.table({"key": binary, "hits": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), hits)})
