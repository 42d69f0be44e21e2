"""Collocations: phrases of 2 to 4 words whose parts occur little without each other.

*Fingerprints.* Tasks read texts as bytes with numpy. The words of a group of texts have 64-bit hashes h; prefix polynomials P[i] = sum of h[j] B^j give
every n-gram's Rabin-Karp hash (P[i + k] - P[i]) B^-i, to which language and length are mixed. A task adds equal fingerprints up, Spark sums them over
tasks, and those that occur often enough stay. Words and pairs come first; a longer phrase is only hashed where each of its pairs
stayed, as it can't occur more often than they do.

*Verification.* A collision can only add occurrences, so what stays holds every frequent phrase. A bit table of what stayed, of bounded size, goes
to the tasks, which read the texts again: occurrences of one fingerprint are compared with the words at the first of them, and what
differs counts apart. Only these phrases are written out, with their count and a pointer to an occurrence; Spark sums by the phrase itself. The counts
are exact whatever collides and however full the bit table is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketfeat.llm import encoding
from marketfeat.llm.common import table
from marketfeat.session import checkpointed

#: Words of a phrase at most, occurrences at least, phrases returned for each language.
LONGEST, LEAST, TOP = 4, 30, 2000
#: A candidate goes if a longer one that holds it occurs in 80 of 100 of its places or more.
SHARE = (80, 100)
#: Bits of the bit table: at least, at most, and for each fingerprint.
FEWEST, MOST, EACH = 1 << 20, 1 << 28, 16
#: Bytes of text read at once.
GROUP = 1 << 20
#: Slices of a language that are ranked apart before their best are ranked together.
SLICES = 256
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Kinds of bytes: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Words:
    """The words of a group of texts: their numbers in ``different``, and how many words are left in the piece from each on."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = encoding.text_bytes(texts)
        data = _LOWER[data]
        kind = _KIND[data]
        word = kind == 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        begins, ends = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
        first[begins], last[ends] = word[begins], word[ends]
        self.starts = np.flatnonzero(first)
        sizes = np.flatnonzero(last) + 1 - self.starts
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        places = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(places), pa.py_buffer(data[word]))
        coded = words.dictionary_encode()
        self.different, self.number = coded.dictionary, coded.indices.to_numpy()
        piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts] if len(data) else self.starts
        n = len(sizes)
        new = np.ones(n, bool)
        new[1:] = (piece[1:] != piece[:-1]) | (self.text[1:] != self.text[:-1])
        heads = np.append(np.flatnonzero(new), n)
        self.room = np.repeat(heads[1:], np.diff(heads)) - np.arange(n)
        heads = np.searchsorted(self.text, np.arange(len(texts)))
        self.inside = np.arange(n) - heads[self.text]

    def fingerprints(self, langs: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
        """For k = 1, 2, ..., the fingerprints of the phrases of k words that begin at each word; those over a piece's end mean nothing."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.different.cast(pa.binary()).to_pylist()), np.uint64, len(self.different))
        n = len(self.number)
        power, back = (np.cumprod(np.append(np.uint64(1), np.full(max(n - 1, 0), b, np.uint64)))[:n] for b in (_BASE, _BACK))
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes[self.number] * power, dtype=np.uint64)))
        for k in range(1, LONGEST + 1):
            h = (prefix[k:] - prefix[:-k]) * back[: max(n + 1 - k, 0)] if n >= k else np.zeros(0, np.uint64)
            h += langs[self.text[: len(h)]] + np.uint64(k * 0xD1B54A32D192ED03 % (1 << 64))
            for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
                h ^= h >> np.uint64(shift)
                h *= np.uint64(factor)
            h ^= h >> np.uint64(33)
            yield k, np.append(h >> np.uint64(64 - bits), np.zeros(n - len(h), np.uint64))


class Bits:
    """Fingerprints that stayed, as a bit table with two bits each: nothing that stayed is missed."""

    def __init__(self, cells: np.ndarray, size: int) -> None:
        self.cells, self.size = cells, size

    def hits(self, fps: np.ndarray) -> np.ndarray:
        found = np.ones(len(fps), bool)
        for shift in (0, 32):
            at = (fps >> np.uint64(shift)) & np.uint64(self.size - 1)
            found &= (self.cells[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def bit_table(stayed: DataFrame) -> Bits:
    """The bit table of ``stayed`` (fp): made by Spark as 64-bit cells, at most MOST / 64 of them whatever the number of fingerprints."""
    size = min(MOST, max(FEWEST, 1 << (EACH * stayed.count()).bit_length()))
    fp = F.col("fp")
    cell = F.explode(F.array(fp.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(fp, 32).bitwiseAND(F.lit(size - 1))))
    bits = stayed.select(cell.alias("c")).groupBy(F.shiftright("c", 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("c").bitwiseAND(F.lit(63)).cast("int"))).alias("b")
    ).toArrow()
    cells = np.zeros(size // 64, np.uint64)
    cells[bits["at"].to_numpy()] = bits["b"].to_numpy().view(np.uint64)
    return Bits(cells, size)


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    return np.array([xxhash.xxh64_intdigest(x, 1) for x in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]


def _sources(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def _frequent(docs: DataFrame, sizes: tuple[int, ...], bits: int, least: int, pairs: Bits | None = None) -> DataFrame:
    """``fp`` of the phrases of ``sizes`` words that occur ``least`` times or more; with ``pairs``, of those whose pairs are all there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in encoding.groups(batch.column(1), GROUP):
                words = Words(texts)
                found, near = [], None
                for k, fps in words.fingerprints(_lang_hashes(batch.column(0).slice(at, len(texts))), bits):
                    if k == 2 and pairs is not None:
                        near = pairs.hits(fps)
                    if k in sizes:
                        here = words.room >= k
                        if near is not None:
                            for j in range(k - 1):
                                here[: len(here) - j] &= near[j:]
                        found.append(fps[here])
                at += len(texts)
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["fp", "n"])

    summed = _sources(docs).mapInArrow(run, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
    return summed.filter(F.col("n") >= least).select("fp")


def _counted(docs: DataFrame, stayed: Bits, bits: int) -> DataFrame:
    """``lang``, ``k``, ``phrase``, ``f``, ``doc_id``, ``word`` of what hits ``stayed``, exact; k = 0 with all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in encoding.groups(batch.column(1), GROUP):
                langs, ids = batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts))
                at += len(texts)
                words = Words(texts)
                code = langs.dictionary_encode().indices.to_numpy()[words.text]
                for k, fps in words.fingerprints(_lang_hashes(langs), bits):
                    where = np.flatnonzero((words.room >= k) & stayed.hits(fps))
                    if not len(where):
                        continue
                    _, first, inverse, counts = np.unique(fps[where], return_index=True, return_inverse=True, return_counts=True)
                    head = where[first][inverse]
                    same = reduce(np.logical_and, [words.number[where + j] == words.number[head + j] for j in range(k)], code[where] == code[head])
                    if not same.all():  # other words under this fingerprint: each occurrence for itself
                        counts = np.bincount(inverse[same], minlength=len(first))
                    begin = np.concatenate((where[first], where[~same]))
                    n = np.concatenate((counts, np.ones(len(begin) - len(counts), np.int64)))
                    yield _records(langs, ids, words, k, begin, n)
                many = np.bincount(words.text, minlength=len(texts))
                total = pa.array(np.zeros(len(texts)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [langs, total, pa.nulls(len(texts), pa.string()), pa.array(many), ids, pa.nulls(len(texts), pa.int64())], names
                )

    names = ["lang", "k", "phrase", "n", "doc_id", "word"]
    found = _sources(docs).mapInArrow(run, "lang string, k int, phrase string, n long, doc_id long, word long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f"), F.first("doc_id").alias("doc_id"), F.first("word").alias("word"))


def _records(langs: pa.Array, ids: pa.Array, words: Words, k: int, begin: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    parts = [words.different.take(pa.array(words.number[begin + j])) for j in range(k)]
    phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
    text = pa.array(words.text[begin])
    return pa.RecordBatch.from_arrays(
        [langs.take(text), pa.array(np.full(len(begin), k), pa.int32()), phrase, pa.array(n), ids.take(text), pa.array(words.inside[begin])],
        ["lang", "k", "phrase", "n", "doc_id", "word"],
    )


def phrase_counts(docs: DataFrame, least: int = LEAST, bits: int = 64) -> DataFrame:
    """``lang``, ``k``, ``phrase``, ``f``, ``doc_id``, ``word`` of all words and phrases that occur ``least`` times, stored; k = 0 has all words.

    ``docs`` has text, lang and doc_id; ``doc_id`` and the number ``word`` point to one of the occurrences. A word is lower-cased from A to Z; a phrase lies within a piece. A null text is empty and a
    null lang ``und``. Repeated rows count as often as they come; empty tables give no rows; other columns are ignored. ``bits`` is the width
    of fingerprints: narrower ones collide more, with the same result.
    """
    short = checkpointed(_frequent(docs, (1, 2), bits, least))
    long_ = _frequent(docs, tuple(range(3, LONGEST + 1)), bits, least, bit_table(short))
    stayed = bit_table(checkpointed(short.union(long_)))
    counted = _counted(docs, stayed, bits)
    return checkpointed(counted.filter((F.col("k") == 0) | (F.col("f") >= least)))


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, share: tuple[int, int] = SHARE, bits: int = 64) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``, ``first``: the ``top`` phrases of each language.

    a is the phrase's count, l and r those of its two parts at the cut of the lowest score floor(2000000 a / (l + r)) (ties: the
    first such cut), n that of all words of the language. A phrase within a longer candidate that has share[0] of share[1] of its
    occurrences is left out. Order: score and a falling, phrase rising by its UTF-8 bytes. Products are decimals of 38 digits.
    Nulls, empty texts, repeated rows and empty tables: see ``phrase_counts``.
    """
    counts = phrase_counts(docs, least, bits)
    known = counts.filter("k > 0").select("lang", "phrase", "f")
    candidates = counts.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.struct("doc_id", "word").alias("first"))
    cut = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumn(
        "head", F.expr("substring_index(phrase, ' ', cut)")
    ).withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    scored = cut.join(known.toDF("lang", "head", "l"), ["lang", "head"]).join(known.toDF("lang", "tail", "r"), ["lang", "tail"])
    scored = scored.withColumn("score", F.expr("(CAST(a AS DECIMAL(38,0)) * 2000000) div (CAST(l AS DECIMAL(38,0)) + r)"))
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("s"), F.first("a").alias("a"), F.first("first").alias("first")
    )
    words = F.split("phrase", " ")
    places = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> struct(i, m))))")
    inside = candidates.filter("k > 2").select("lang", "a", words.alias("w"), F.explode(places).alias("p")).select(
        "lang", F.array_join(F.slice("w", F.col("p.i"), F.col("p.m")), " ").alias("phrase"), F.col("a").alias("longer")
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (_wide(F.col("longer")) * share[1] < _wide(F.col("a")) * share[0])
    )
    flat = left.select("lang", "phrase", "a", "s.l", "s.r", "s.score", "first")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = flat.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    some = some.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).filter(F.col("_at") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("first")


OP13_SQL = r"""
WITH docs AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
lists AS (SELECT lang, list_filter(string_split_regex(p, '[ \x09]+'), lambda w: w <> '') AS w FROM pieces),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k) ks),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM places GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM cand),
parts AS (SELECT *, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail FROM cuts),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (2000000 * c.a) // (x.f + y.f) AS score
    FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
spans AS (SELECT lang, a, w, k, m, unnest(range(1, k - m + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS m) ms WHERE m < k),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM spans GROUP BY ALL),
kept AS (
    SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.longer IS NULL OR 100 * g.longer < 80 * b.a
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
