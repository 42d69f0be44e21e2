"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public byte-level vocabulary; each language has a probability for every piece. The probability
of a word is summed over all its segmentations by the forward algorithm, and that of a text is the product over its words. Words are
split at white space and carry the space before them as their first byte. All pieces of the vocabulary count, and a word of any length is
summed as a whole: many short words of one length at once; long ones (a text without spaces is one) block by block, carrying the sums of the last
places and, against underflow, a scale for each language that is renewed every RENEW bytes.

Learning counts (language, word) over all texts with a language, and spreads each word's count over its segmentations (forward and
backward, STEPS times, from equal probabilities). What comes to the driver has at most languages x pieces rows.
"""

from __future__ import annotations

import base64
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.llm.common import fold, held, table
from marketfeat.session import checkpointed

#: Steps of learning, a parameter: each reads the table of words once.
STEPS = 1
#: Bytes of a short word at most; of a block of a long one; between new scales; cells of long words read at once.
SHORT, STRIDE, RENEW, CELLS = 32, 4096, 16, 1 << 16
#: Count that every piece has from the start.
SMOOTH = 0.05
#: Languages at most (more raise): the table of probabilities goes to every task.
LANGUAGES = 256
#: Characters read at once; words remembered by a worker, and their characters at most.
CHARS, REMEMBERED, KEPT = 1_000_000, 250_000, 64
_B = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[bytes]:
    """All pieces of a file of ranks, with all single bytes."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted(pieces | {bytes([b]) for b in range(256)})


def _hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(rows.shape[0], np.uint64)
    for i in range(rows.shape[1]):
        h = (h + rows[:, i].astype(np.uint64) + np.uint64(1)) * _B
    return h


class Pieces:
    """Finds pieces in many words of one length at once."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = len(pieces)
        self.tables = {}
        for n in {len(p) for p in pieces}:
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == n])
            h = _hashes(np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, n))
            order = np.argsort(h)
            there = np.zeros(1 << 18, bool)
            there[(h >> np.uint64(46)).astype(np.int64)] = True
            self.tables[n] = (h[order], ids[order], there)
        self.longest = max(self.tables)

    def find(self, words: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray | slice, np.ndarray]]:
        """Rows of ``words`` whose bytes [start, end) are a piece, and which; a slice where all are. Empty places are left out."""
        count, width = words.shape
        out = {}
        h = np.zeros((count, width), np.uint64)
        plus = words.astype(np.uint64) + np.uint64(1)
        for n in range(1, min(self.longest, width) + 1):
            h = (h[:, : width - n + 1] + plus[:, n - 1:]) * _B
            if n not in self.tables:
                continue
            known, ids, there = self.tables[n]
            start, row = np.nonzero(there[(h >> np.uint64(46)).astype(np.int64)].T)
            at = np.minimum(np.searchsorted(known, h[row, start]), len(known) - 1)
            hit = known[at] == h[row, start]
            start, row, found = start[hit], row[hit], ids[at[hit]]
            first = np.flatnonzero(np.diff(start, prepend=-1))
            for low, high in zip(first.tolist(), [*first[1:].tolist(), len(start)]):
                out[(int(start[low]), int(start[low]) + n)] = (slice(None) if high - low == count else row[low:high], found[low:high])
        return out

    def forward(self, words: np.ndarray, p: np.ndarray, row: np.ndarray | None = None):
        """Sums over segmentations up to each place: array (width + 1, words, columns of ``p``), and the pieces.

        ``p`` is (pieces + 1, columns), its last row zero; with ``row``, each word takes its own column.
        """
        found = self.find(words)
        columns = 1 if row is not None else p.shape[1]
        a = np.zeros((words.shape[1] + 1, len(words), columns))
        a[0] = 1.0
        for (s, e), (at, ids) in sorted(found.items(), key=lambda x: x[0][1]):
            a[e, at] += a[s, at] * (p[ids, row[at]][:, None] if row is not None else p[ids])
        return a, found

    def expected(self, words: np.ndarray, times: np.ndarray, p: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Expected piece counts by column of ``p``, each word counted ``times``."""
        a, found = self.forward(words, p, row)
        b = np.zeros(a.shape[:2])
        b[-1] = 1.0
        flat = np.zeros(p.size)
        scale = times / np.maximum(a[-1, :, 0], 1e-300)
        for (s, e), (at, ids) in sorted(found.items(), key=lambda x: -x[0][0]):
            q = p[ids, row[at]] * b[e, at]
            b[s, at] += q
            np.add.at(flat, ids * p.shape[1] + row[at], a[s, at, 0] * q * scale[at])
        return flat.reshape(p.shape)

    def _edges(self, words: np.ndarray, ends: np.ndarray, back: bool = False) -> Iterator[tuple]:
        """Places, rows and pieces of long words by rising start, or falling; ``ends`` are the lengths, what is behind them is padding."""
        lows = range(0, words.shape[1], STRIDE)
        for low in reversed(lows) if back else lows:
            found = self.find(words[:, low:low + STRIDE + self.longest - 1])
            for s, e in sorted(found, reverse=back):
                if s < STRIDE:
                    at, ids = found[(s, e)]
                    yield low + s, low + e, at, np.where(low + e <= ends[at], ids, self.size)

    def long_forward(self, words: np.ndarray, ends: np.ndarray, p: np.ndarray, row: np.ndarray | None = None):
        """Scaled sums up to each place, (width + 1, words, columns), and the log scales of each RENEW places: the sum at e is a[e] exp(logs[e // RENEW])."""
        width, columns = words.shape[1], 1 if row is not None else p.shape[1]
        a = np.zeros((width + 1, len(words), columns))
        a[0] = 1.0
        logs = np.zeros((width // RENEW + 1, len(words), columns))
        block = 0
        for s, e, at, ids in self._edges(words, ends):
            while s // RENEW > block:
                block += 1
                live = a[block * RENEW:block * RENEW + self.longest + 1]
                scale = live.max(axis=0)
                scale[scale == 0] = 1.0
                live /= scale
                logs[block] = logs[block - 1] + np.log(scale)
            a[e, at] += a[s, at] * (p[ids, row[at]][:, None] if row is not None else p[ids])
        logs[block + 1:] = logs[block]
        return a, logs

    def long_logs(self, words: np.ndarray, ends: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log probabilities of long words by column of ``p``."""
        a, logs = self.long_forward(words, ends, p)
        each = np.arange(len(words))
        return np.log(np.maximum(a[ends, each], 1e-300)) + logs[ends // RENEW, each]

    def long_expected(self, words: np.ndarray, ends: np.ndarray, times: np.ndarray, p: np.ndarray, row: np.ndarray) -> np.ndarray:
        """``expected`` of long words."""
        a, logs = self.long_forward(words, ends, p, row)
        a, logs, each = a[:, :, 0], logs[:, :, 0], np.arange(len(words))
        b = np.zeros(a.shape)
        b[ends, each] = 1 / np.maximum(a[ends, each], 1e-300)
        flat = np.zeros(p.size)
        for s, e, at, ids in self._edges(words, ends, back=True):
            q = p[ids, row[at]] * np.exp(logs[s // RENEW, at] - logs[e // RENEW, at]) * b[e, at]
            b[s, at] += q
            np.add.at(flat, ids * p.shape[1] + row[at], a[s, at] * q * times[at])
        return flat.reshape(p.shape)


def split(text: str) -> list[str]:
    return text.split()


def word_bytes(word: str) -> bytes:
    return b" " + word.encode("utf-8", "surrogatepass")


def _long(parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indexes, padded bytes and lengths of the long parts, those of like length together, CELLS cells or one part at once."""
    widths = np.fromiter(map(len, parts), np.int64, len(parts))
    rows = np.flatnonzero(widths > SHORT)
    rows = rows[np.argsort(widths[rows], kind="stable")]
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and widths[rows[end]] * (end + 1 - at) <= CELLS and widths[rows[end]] <= 2 * widths[rows[at]]:
            end += 1
        some = rows[at:end]
        data = np.zeros((len(some), int(widths[some].max())), np.uint8)
        for k, i in enumerate(some.tolist()):
            data[k, :widths[i]] = np.frombuffer(parts[i], np.uint8)
        yield some, data, widths[some]
        at = end


def _by_width(parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes and bytes of the short parts of each length."""
    widths = np.fromiter(map(len, parts), np.int64, len(parts))
    for w in np.unique(widths[widths <= SHORT]).tolist():
        rows = np.flatnonzero(widths == w)
        for at in range(0, len(rows), 20_000):
            some = rows[at:at + 20_000]
            yield some, np.frombuffer(b"".join(parts[i] for i in some.tolist()), np.uint8).reshape(-1, w)


@dataclass
class Model:
    pieces: list[bytes]
    languages: list[str]
    p: np.ndarray
    prior: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    """Log probabilities of texts by language; remembers those of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.find = model, Pieces(model.pieces)
        self.number: dict[str, int] = {}
        self.rows = np.zeros((REMEMBERED, len(model.languages)))

    def words(self, words: list[str]) -> np.ndarray:
        parts = [word_bytes(w) for w in words]
        logs = np.zeros((len(parts), len(self.model.languages)))
        for rows, data in _by_width(parts):
            logs[rows] = np.log(np.maximum(self.find.forward(data, self.model.p)[0][-1], 1e-300))
        for rows, data, ends in _long(parts):
            logs[rows] = self.find.long_logs(data, ends, self.model.p)
        return logs

    def texts(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        counted = [Counter(split(t)) for t in texts]
        new = sorted({w for c in counted for w in c if w not in self.number}, key=lambda w: len(w) > KEPT)
        rows = self.words(new)
        room = max(0, min(sum(len(w) <= KEPT for w in new), REMEMBERED - len(self.number)))
        base = len(self.number)
        self.rows[base:base + room] = rows[:room]
        self.number.update(zip(new[:room], range(base, base + room)))
        more = dict(zip(new[room:], range(REMEMBERED, REMEMBERED + len(new) - room)))
        known = np.concatenate([self.rows, rows[room:]]) if more else self.rows
        number = self.number
        for text, c in zip(texts, counted):
            if not self.model.languages or not lettered(text):
                yield "und", 0.0
                continue
            ids = [number[w] if w in number else more[w] for w in c]
            total = np.fromiter(c.values(), float, len(c)) @ known[ids] + self.model.prior
            best = int(total.argmax())
            yield self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def scorer(model: Model) -> Scorer:
    """One scorer a Python worker and model."""
    return held("languages", model.name, make=lambda: Scorer(model))


def lettered(text: str) -> bool:
    """Whether a text has a letter; numbers like a half or a Roman numeral are none."""
    return any(map(str.isalpha, text))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n`` over ``docs`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                n = len(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = counts.get(lang)
                if c is None:
                    c = counts[lang] = Counter()
                c.update(split(text.as_py() or ""))
                if sum(map(len, counts.values())) > 300_000:
                    yield from out()
        yield from out()

    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(
        run, "lang string, word string, n long"
    ).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, path: str, steps: int = STEPS) -> Model:
    """The model of ``docs`` (lang, text); rows without a language are left out. Without any, every prediction is ``und``.

    Repeated rows count as often as they come, null texts as empty ones; other columns are ignored.
    """
    pieces = vocabulary(path)
    known = docs.filter("lang IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(sizes)
    k, v = len(languages), len(pieces)
    model = Model(pieces, languages, np.full((v + 1, k), 1.0 / v), np.log(np.array([sizes[x] for x in languages], float) / max(1, sum(sizes.values()))))
    model.p[v] = 0.0
    words = checkpointed(word_counts(known)) if languages else None
    for _ in range(steps if languages else 0):
        counts = np.full((v + 1, k), SMOOTH)
        p, number = model.p, {x: i for i, x in enumerate(languages)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = Pieces(pieces)
            total = np.zeros((v + 1, k))
            for batch in batches:
                parts = [word_bytes(w) for w in batch.column(1).to_pylist()]
                row = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
                times = np.array(batch.column(2).to_pylist(), float)
                for rows, data in _by_width(parts):
                    total += find.expected(data, times[rows], p, row[rows])
                for rows, data, ends in _long(parts):
                    total += find.long_expected(data, ends, times[rows], p, row[rows])
            piece, lang = np.nonzero(total[:v])
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        # Rounded, so that the order of a sum doesn't show.
        sums = words.select("lang", "word", "n").mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.round(F.sum("n"), 4).alias("n"))
        for r in sums.collect():
            counts[r["piece"], r["lang"]] += r["n"]
        counts[v] = 0.0
        model.p = counts / counts.sum(axis=0)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (posterior) of each row of ``docs`` (doc_id, text); ``und``, 0 for a null text or one without letters.

    Whole texts of any length are read. Of languages with equal probability the first by name is taken; repeated rows get equal results, a
    null id stays null; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = scorer(model)
        for batch in batches:
            found: list[tuple[str, float]] = []
            part: list[str] = []
            size = 0
            for text in batch.column(1):
                part.append(text.as_py() or "")
                size += len(part[-1])
                if size > CHARS:
                    found += use.texts(part)
                    part, size = [], 0
            found += use.texts(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op4_marginal_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(fold(F.col("doc_id"), 4) != 2), ranks())
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
