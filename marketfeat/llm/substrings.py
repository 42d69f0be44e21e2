"""Removal of repeated word windows by recompression.

Words get names by hash, so equal words, runs and pairs have equal names in every task without an exchange of dictionaries. First
runs of one word are named, then, in ROUNDS rounds, pairs: a bit of each name puts it left or right, and a left
symbol followed by a right one becomes one symbol of at most SPAN words. A choice depends on the two symbols alone, so each symbol knows
the words that it depends on. A window holds those symbols whose dependence lies inside it: equal windows hold equal symbols,
whatever stands around them.

Each window is filed under its widest symbol (ties by name), a run of neighbouring windows with one symbol in one record, and
one Spark exchange brings the records of a symbol together. There the window's own hash, 56 bits beside the symbol's 64, verifies the repeat, and all but the first
(smallest doc_id, then start) go. Windows that hold no symbol are filed under their hash. A task first drops what repeats
within it, so a symbol that a third of all documents share arrives once a chunk; a symbol's records are read in order, in batches.
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

ROUNDS, SPAN, WINDOW = 3, 6, 20
#: Words named at once; a document is never cut. Window hashes compared at once.
CHUNK, COMPARED = 300_000, 1_000_000
#: Bytes of a window's hash that a record carries, beside the 64 bits of its symbol.
KEPT = 7
_LAST = (1 << 63) - 1
_FAR = np.int64(1 << 40)
_B = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(r: int) -> np.uint64:
    return np.uint64(r * int(_B) & 0xFFFFFFFFFFFFFFFF)


def symbols(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """``name``, ``start``, ``end``, ``first``, ``last`` of the symbols of ``words`` (name per word, number of its document per word).

    The symbol covers words start to end, and depends on words first to last (both ends half open); -_FAR or _FAR where it depends
    on a document's edge or on the length of a run over SPAN.
    """
    n = len(words)
    at = np.arange(n, dtype=np.int64)
    same = np.zeros(n + 1, bool)
    same[1:n] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    heads = np.flatnonzero(~same[:n])
    length = np.diff(np.append(heads, n))
    long = length > SPAN
    keep = np.ones(n, bool)
    keep[np.repeat(~long, length)] = ~same[:n][np.repeat(~long, length)]
    start = at[keep]
    size = np.where(np.repeat(long, length), 1, np.repeat(length, length))[keep]
    end = start + size
    name = np.where(size > 1, mixed(words[start] + _B * size.astype(np.uint64)), words[start])
    first, last = start - 1, end + 1
    over = np.repeat(long, length)[keep]
    own = doc[start]
    edge = np.zeros(len(start), bool)
    edge[0] = True
    edge[1:] = own[1:] != own[:-1]
    first[edge | over] = -_FAR
    close = np.append(edge[1:], True)
    last[close | over] = _FAR
    for r in range(ROUNDS):
        left = (mixed(name + _salt(r + 1)) & np.uint64(1)).astype(bool)
        beside = own[:-1] == own[1:]
        joins = np.append(left[:-1] & ~left[1:] & beside & (end[1:] - start[:-1] <= SPAN), False)
        joined = np.append(False, joins[:-1])
        full = end - start >= SPAN
        right_first, right_last = np.append(np.where(beside, first[1:], -_FAR), -_FAR), np.append(np.where(beside, last[1:], _FAR), _FAR)
        left_first, left_last = np.append(-_FAR, np.where(beside, first[:-1], -_FAR)), np.append(_FAR, np.where(beside, last[:-1], _FAR))
        to_right = joins | (left & ~full)
        to_left = ~joins & ~left & ~full
        new_first = np.where(to_right, np.minimum(first, right_first), np.where(to_left, np.minimum(first, left_first), first))
        new_last = np.where(to_right, np.maximum(last, right_last), np.where(to_left, np.maximum(last, left_last), last))
        next_name = np.append(name[1:], name[:1])
        name = np.where(joins, mixed(name * np.uint64(3) + mixed(next_name + _salt(r + 11))), name)
        end = np.where(joins, np.append(end[1:], end[-1:]), end)
        stay = ~joined
        name, start, end, first, last, own = name[stay], start[stay], end[stay], new_first[stay], new_last[stay], own[stay]
    return name, start, end, first, last


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Hash of each ``window`` words in a row, by doubling."""
    power, factor, done, total = words, _B, 0, None
    bit = 1
    with np.errstate(over="ignore"):
        while bit <= window:
            if window & bit:
                if total is None:
                    total = power
                else:  # what is done comes first, then this power of two
                    n = len(power) - done
                    total = total[:n] * factor + power[done:done + n] if n > 0 else total[:0]
                done += bit
            n = len(power) - bit
            power = power[:n] * factor + power[bit:bit + n] if n > 0 else power[:0]
            factor = np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF)
            bit *= 2
    return mixed(total[: max(0, len(words) - window + 1)])


def records(words: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at``, ``hash``, ``name`` of each window that lies in one document."""
    whole = window_hashes(words, window)
    at = np.flatnonzero(doc[: len(whole)] == doc[window - 1:]) if len(whole) else np.zeros(0, np.int64)
    if not len(at):
        return at, whole[:0], whole[:0]
    name, start, end, first, last = symbols(words, doc)
    rank = ((np.uint64(63) - (end - start).astype(np.uint64)) << np.uint64(58)) | (mixed(name) >> np.uint64(6))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(len(at), none)
    j = np.searchsorted(start, at)
    for _ in range(window):
        k = np.minimum(j, len(start) - 1)
        inside = (j < len(start)) & (first[k] >= at) & (last[k] <= at + window)
        best = np.where(inside & (rank[k] < best), rank[k], best)
        j = j + 1
    hashes = whole[at]
    return at, hashes, np.where(best == none, hashes, best)


_RECORD = "name long, doc_id long, tag int, start long, hashes binary"


def _named(docs: DataFrame, window: int) -> DataFrame:
    """One record for each run of windows under one symbol; ``hashes`` is null for a run that repeats within its chunk."""

    def chunk(texts: list[list[bytes]], ids: list[int], tags: list[int]) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i], tags[i]))
        flat = [w for i in order for w in texts[i]]
        digest, known = xxhash.xxh64_intdigest, {}
        words = np.fromiter((known[w] if w in known else known.setdefault(w, digest(w)) for w in flat), np.uint64, len(flat))
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        doc = np.repeat(np.arange(len(order)), sizes)
        at, hashes, name = records(words, doc, window)
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        own_id, own_tag = np.array([ids[i] for i in order], np.int64), np.array([tags[i] for i in order], np.int64)
        d = doc[at]
        start = at - begin[d]
        firsts = _first(hashes, own_id[d], start)
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (name[1:] != name[:-1]) | (firsts[1:] != firsts[:-1])
        heads = np.flatnonzero(cut)
        ends = np.append(heads[1:], len(at))
        data = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()
        # A repeat carries its length only; any name will do, so it is spread by its hash.
        values = [data[KEPT * a:KEPT * b] if f else None for a, b, f in zip(heads.tolist(), ends.tolist(), firsts[heads].tolist())]
        names = np.where(firsts, name, hashes)[heads].view(np.int64)
        length = np.where(firsts[heads], 0, ends - heads)
        return pa.RecordBatch.from_arrays([
            pa.array(names), pa.array(own_id[d][heads]), pa.array(own_tag[d][heads].astype(np.int32)),
            pa.array(start[heads] + (length << 40)), pa.array(values, pa.binary()),
        ], ["name", "doc_id", "tag", "start", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, tags, size = [], [], [], 0
            for doc_id, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    continue
                if texts and size + len(words) > CHUNK:
                    yield chunk(texts, ids, tags)
                    texts, ids, tags, size = [], [], [], 0
                texts.append(words)
                ids.append(doc_id)
                tags.append(tag)
                size += len(words)
            if texts:
                yield chunk(texts, ids, tags)

    return _keyed(docs).mapInArrow(run, _RECORD)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.hash(text).alias("tag"), text.alias("text")
    )


def _first(hashes: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each row has the smallest (id, start) of its hash; rows that share that too all have it."""
    order = np.lexsort((start, ids, hashes))
    h, i, s = hashes[order], ids[order], start[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.empty(len(h), bool)
    out[order] = (i == i[lead]) & (s == s[lead])
    return out


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``tag``, ``start``, ``end``: words start to end (half open) of windows that also start earlier.

    A null doc_id counts as the largest; ``tag`` tells texts under one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Records come by name, then doc_id and start, so what was seen of the last name is all earlier.
        seen_name, seen, seen_at = None, np.zeros(0, np.uint64), None
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seen_name, seen, seen_at
            name, ids, tags, start, hashes = (np.concatenate(c) for c in zip(*parts))
            key = mixed(name.view(np.uint64) * np.uint64(5)) ^ hashes
            if len(seen) and name[0] == seen_name:
                old_key, old_id, old_start = seen, seen_at[0], seen_at[1]
            else:
                old_key, old_id, old_start = seen[:0], ids[:0], start[:0]
            firsts = _first(np.concatenate([old_key, key]), np.concatenate([old_id, ids]), np.concatenate([old_start, start]))[len(old_key):]
            mine = firsts & (name == name[-1])
            keep_old = bool(len(old_key)) and name[-1] == seen_name
            fresh, place = np.unique(np.concatenate([old_key, key[mine]]) if keep_old else key[mine], return_index=True)
            all_id = np.concatenate([old_id, ids[mine]]) if keep_old else ids[mine]
            all_start = np.concatenate([old_start, start[mine]]) if keep_old else start[mine]
            seen_name, seen, seen_at = name[-1], fresh, (all_id[place], all_start[place])
            gone = ~firsts
            return _spans(ids[gone], tags[gone], start[gone], np.ones(int(gone.sum()), np.int64), window)

        for batch in batches:
            name, ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            start = batch.column(3).to_numpy(zero_copy_only=False)
            local = start >> 40 > 0
            if local.any():
                yield _spans(ids[local], tags[local], start[local] & ((1 << 40) - 1), start[local] >> 40, window)
            rows = np.flatnonzero(~local)
            if len(rows):
                values = [v for v in batch.column(4).to_pylist() if v is not None]
                n = np.array([len(v) // KEPT for v in values])
                full = np.zeros((int(n.sum()), 8), np.uint8)
                full[:, :KEPT] = np.frombuffer(b"".join(values), np.uint8).reshape(-1, KEPT)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                parts.append((np.repeat(name[rows], n), np.repeat(ids[rows], n), np.repeat(tags[rows], n),
                              np.repeat(start[rows], n) + inner, full.view("<u8").ravel()))
                held += int(n.sum())
            if held > COMPARED:
                yield flush()
                parts, held = [], 0
        if parts:
            yield flush()

    ordered = _named(docs, window).repartition("name").sortWithinPartitions("name", "doc_id", F.expr(f"start & {(1 << 40) - 1}L"))
    return ordered.mapInArrow(run, "doc_id long, tag int, start long, end long")


def _spans(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, length: np.ndarray, window: int) -> pa.RecordBatch:
    """Neighbouring windows as one span of words."""
    order = np.lexsort((start, tags, ids))
    ids, tags, start, length = ids[order], tags[order], start[order], length[order]
    cut = np.ones(len(ids), bool)
    cut[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (start[1:] > start[:-1] + length[:-1])
    heads = np.flatnonzero(cut)
    ends = np.append(heads[1:], len(ids)) - 1
    return pa.RecordBatch.from_arrays([
        pa.array(ids[heads], pa.int64()), pa.array(tags[heads].astype(np.int32)), pa.array(start[heads], pa.int64()),
        pa.array((start + length)[ends] + window - 1 if len(ids) else start, pa.int64()),
    ], ["doc_id", "tag", "start", "end"])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, with ``texts``, ``kept`` of each row of ``docs`` (doc_id, text).

    Kept words are joined by one space. A null text has no words; a text below ``window`` words keeps all. Rows that repeat id and
    text are one document and lose the same words; a null id counts as the largest. Other columns are ignored.
    """
    spans = repeats(docs, window).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("id"), F.col("tag").alias("t"), "spans")
    here = _keyed(docs)
    joined = here.join(spans, (here["doc_id"] == spans["id"]) & (here["tag"] == spans["t"]), "left").select(
        "doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text, starts, ends in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if starts.is_valid:
                    gone = np.zeros(n + 1, np.int64)
                    np.add.at(gone, starts.values.to_numpy(), 1)
                    np.add.at(gone, ends.values.to_numpy(), -1)
                    words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
                kept = b" ".join(words)
                values = (None if doc_id == _LAST else doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None)
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 + texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + texts]
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), WINDOW, texts=False)


#: Windows as joined words; equal texts are equal sequences, as words hold no space.
OP8_SQL = r"""
WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
s AS (SELECT doc_id, i AS start, array_to_string(words[i:i + 19], ' ') AS seq FROM w, unnest(range(1, len(words) - 18)) AS t(i)),
f AS (SELECT seq, min((doc_id, start)) AS first FROM s GROUP BY seq HAVING count(*) > 1),
r AS (SELECT DISTINCT s.doc_id, s.start + k AS pos FROM s JOIN f USING (seq), unnest(range(0, 20)) AS t(k) WHERE (s.doc_id, s.start) <> f.first),
p AS (SELECT w.doc_id, t.i AS pos, w.words[t.i] AS word, r.pos IS NOT NULL AS gone
  FROM w, unnest(range(1, len(words) + 1)) AS t(i) LEFT JOIN r ON r.doc_id = w.doc_id AND r.pos = t.i)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM p GROUP BY doc_id) q USING (doc_id)
"""
