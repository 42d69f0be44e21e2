"""Toxicity of deobfuscated text.

*Channel.* A writer may replace letters (1d10t), space them out (i d i o t) or repeat them (idiooot). Every stretch of text where one
of these can have happened becomes a character lattice: each character may stand for itself or a letter it resembles, a separator
between single letters may be dropped, a repeat may be dropped. Viterbi takes the path with the best sum of channel costs and of a
character trigram model, gathered from all texts of the corpus. Text without such a stretch has one path, itself.

*Score.* Words of the restored text, whole and by their first characters, are the features. From labelled rows Spark counts, for each
feature, documents, occurrences and words by label; those that tell the labels apart are kept. A document's evidence is the best
single feature by presence and the best by rate of occurrence; a logistic model on the two gives the score.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.llm.common import MEMORY, boxed, fold, held, table

#: Labelled rows that the model is fitted on at most, taken by a hash of doc_id; lexicon entries at most; least G2 of an entry.
ROWS, TERMS, LEAST_G2 = 20_000, 4096, 25.0
#: First characters of a word that are features beside the whole word.
HEADS = (4, 5, 6, 7)
#: What a character may stand for (fixed values).
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "§": "s",
}
LEET = "".join(re.escape(c) for c in LOOKS)
#: Those of them that are no word characters.
SYMBOLS = frozenset(c for c in LOOKS if not c.isalnum())
#: Costs of the channel in nats: a symbol kept inside a word, replaced; a repeat or separator dropped.
KEEP, SWAP, DROP = 6.0, 1.0, 0.7
_LETTER = r"[^\W\d_]"
#: Single letters with separators between, a whole chain; which of its ends count is decided on the chain.
APART = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*,]{1,2}+[^\W_]){2,}+")
SPACED = re.compile(r"(?<!\w)[^\W_](?:[ .\-_*,]{1,2}+[^\W_]){2,}+")
#: Runs of word and look-alike characters; in them a look-alike next to a letter, a letter three times, and parts without look-alikes.
RUN = re.compile(rf"[\w{LEET}]++")
ALIKE = re.compile(rf"[{LEET}](?={_LETTER})|(?<={_LETTER})[{LEET}](?=[\w{LEET}])")
LETTER = re.compile(_LETTER)
TRIPLE = re.compile(rf"({_LETTER})\1\1")
WORDLIKE = re.compile(r"\w*+")
THRICE = re.compile(r"(.)\1\1")
WORDS = re.compile(r"[^\W\d_]+")
EDGES = ".,;:!?\"'()[]"
#: Characters of a token that a worker remembers at most, and about what remembering one takes in bytes, beside 60 for each feature kept.
KEPT, COST = 64, 250
_EDGE = " "


@dataclass
class CharModel:
    """Interpolated trigram model over lower-case letters and word ends: log probabilities by context."""

    three: dict[str, int]
    two: dict[str, int]
    one: dict[str, int]
    total: int

    def cost(self, a: str, b: str, c: str) -> float:
        n3, n2 = self.three.get(a + b + c, 0), self.two.get(a + b, 0)
        m2, m1 = self.two.get(b + c, 0), self.one.get(b, 0)
        p = 0.7 * n3 / n2 if n2 else 0.0
        p += 0.25 * m2 / m1 if m1 else 0.0
        p += 0.05 * (self.one.get(c, 0) + 1) / (self.total + 256)
        return -math.log(p)


#: What a path has written: the part before, its last character and its length; paths share their beginnings.
Path = tuple["Path", str, int] | None


def _written(path: Path, end: Path = None) -> str:
    out = []
    while path is not end:
        path, ch, _ = path
        out.append(ch)
    return "".join(reversed(out))


def _before(p: Path, q: Path) -> bool:
    """Whether ``p`` is the smaller text; only what comes after their common beginning is read."""
    a, b = p, q
    while a is not b:
        if a is not None and (b is None or a[2] >= b[2]):
            a = a[0]
        else:
            b = b[0]
    return _written(p, a) < _written(q, a)


def restore(stretch: str, model: CharModel) -> str:
    """The best path through the lattice of one stretch, of any length: few states a character, memory linear."""
    whole = SPACED.match(stretch)
    spaced = whole is not None and whole.end() == len(stretch)
    text = stretch.lower()
    states: dict[tuple[str, str, str], tuple[float, Path]] = {(_EDGE, _EDGE, ""): (0.0, None)}
    skip = 0
    for at, ch in enumerate(text):
        if at < skip:
            continue
        after: dict[tuple[str, str, str], tuple[float, Path]] = {}

        def reach(state, cost, before, wrote=""):
            old = after.get(state)
            if old is not None and cost > old[0]:
                return
            out = (before, wrote, before[2] + 1 if before else 1) if wrote else before
            if old is None or cost < old[0] or _before(out, old[1]):
                after[state] = (cost, out)

        for (a, b, raw), (cost, out) in states.items():
            if spaced and not ch.isalnum() and ch not in LOOKS:
                reach((a, b, raw), cost + DROP, out)
                if ch == " ":
                    reach((b, _EDGE, ""), cost + 2 * KEEP + model.cost(a, b, _EDGE), out, " ")
                continue
            if raw == ch:
                reach((a, b, raw), cost + DROP, out)
            for to in ch + LOOKS.get(ch, ""):
                extra = 0.0 if to.isalpha() and to == ch else KEEP if to == ch else SWAP
                lm = model.cost(a, b, to) if to.isalpha() else 3.0
                reach((b, to, ch), cost + extra + lm, out, to)
        if at and text[at - 1] == ch and len(after) == len(states) and all(s in states and after[s][1] is states[s][1] for s in after):
            # Every state dropped this repeat; it does so for the rest of them.
            skip = at + 1
            while skip < len(text) and text[skip] == ch:
                skip += 1
            after = {s: (cost + DROP * (skip - at - 1), out) for s, (cost, out) in after.items()}
        states = after
    ends = [(cost + model.cost(a, b, _EDGE), out) for (a, b, _), (cost, out) in states.items()]
    best = min(cost for cost, _ in ends)
    return min(_written(out) for cost, out in ends if cost == best)


def _ended(chain: re.Match) -> int:
    """Where the stretch of a chain of single letters ends: behind its last letter with no word character after it; its start if that leaves fewer than three."""
    text, start, end = chain.string, chain.start(), chain.end()
    while end > start and not (text[end - 1].isalnum() and (end == len(text) or not (text[end].isalnum() or text[end] == "_"))):
        end -= 1
    return end if sum(map(str.isalnum, text[start:end])) > 2 else start


def _chain(text: str, at: int) -> tuple[int, int]:
    """The next stretch of single letters from ``at`` on; the text's end if there is none."""
    while (chain := SPACED.search(text, at)) is not None:
        end = _ended(chain)
        if end > chain.start():
            return chain.start(), end
        at = chain.end()
    return len(text), len(text)


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Places of the stretches of ``text`` that are lattices, from left to right, in time linear in its length.

    In a run of word and look-alike characters a stretch begins at the first character from which look-alikes lead to a letter, if a look-alike
    stands next to a letter from there on, and reaches to the run's end; or it is the part without look-alikes around a letter three times; or
    single letters set apart begin there. The first to begin is taken, and the search goes on behind it.
    """
    chain = _chain(text, 0)
    done = 0
    for run in RUN.finditer(text):
        begin, end = run.span()
        last = None
        while (at := max(begin, done)) < end:
            if chain[0] < at:
                chain = _chain(text, at)
            found = []
            if chain[0] < end:
                found.append((chain[0], 0, chain[1]))
            if last is None:
                last = max((m.start() for m in ALIKE.finditer(text, begin, end)), default=-1)
            letter = LETTER.search(text, at, end) if last >= at else None
            if letter is not None:
                first = letter.start()
                while first > at and text[first - 1] in LOOKS:
                    first -= 1
                if first <= last:
                    found.append((first, 1, end))
            triple = TRIPLE.search(text, at, end)
            if triple is not None:
                first = triple.start()
                while first > at and text[first - 1] not in SYMBOLS:
                    first -= 1
                found.append((first, 2, WORDLIKE.match(text, first).end()))
            if not found:
                break
            first, _, done = min(found)
            yield first, done


class Memory(dict):
    """What a Python worker knows of tokens under one model, up to MEMORY bytes."""

    left = MEMORY


class Restorer:
    """Restores texts token by token; remembers what it made of short tokens, the first that fit in the memory's bytes.

    Tasks of one Python worker share the memory of one ``name``. ``keep`` turns the words of a token into what the caller needs of them.
    """

    def __init__(self, model: CharModel, keep=tuple, name: str = "") -> None:
        self.model, self.keep = model, keep
        self.seen = held("toxicity", name, make=Memory) if name else Memory()

    def _restored(self, text: str) -> str:
        if not (ALIKE.search(text) or TRIPLE.search(text) or SPACED.search(text)):
            return text
        out, at = [], 0
        for a, b in stretches(text):
            out += [text[at:a], restore(text[a:b], self.model)]
            at = b
        return "".join([*out, text[at:]]) if out else text

    def _path(self, chain: re.Match) -> str:
        start, end = chain.start(), _ended(chain)
        return restore(chain.string[start:end], self.model) + chain.string[end:chain.end()] if end > start else chain.group()

    def token(self, token: str):
        plain = token.strip(EDGES)
        if not plain.isalpha() or THRICE.search(plain):
            words = [w.lower() for w in WORDS.findall(self._restored(token))]
        else:
            words = [plain.lower()]
        found = self.keep(words)
        if len(token) <= KEPT and self.seen.left > 0:  # frequent tokens come early
            self.seen[token] = found
            self.seen.left -= COST + (0 if found is _NOTHING else 60 * len(found[0]))
        return found

    def text(self, text: str) -> str:
        """The restored text, for readers of it."""
        return self._restored(APART.sub(self._path, text))

    def tokens(self, text: str) -> Counter:
        """Tokens of the text, single letters put together, and how often each stands there."""
        return Counter(APART.sub(self._path, text).split())


def char_model(docs: DataFrame) -> CharModel:
    """Trigram counts over every text of ``docs`` (text): summed in tasks, then by Spark.

    The counts grow with the corpus; the table that comes back is over LETTERS and the word's end.
    """

    side = len(LETTERS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side ** 3, np.int64)
        number = np.zeros(0x180, np.int32)
        number[[ord(c) for c in LETTERS]] = np.arange(1, side)
        for batch in batches:
            part: list[str] = []
            size = 0
            for text in [*batch.column(0), None]:
                t = None if text is None else (text.as_py() or "").lower()
                if t is not None:
                    part.append(t)
                    size += len(t)
                if (t is None or size > 1 << 21) and part:
                    codes = np.frombuffer(f" {' '.join(part)} ".encode("utf-32-le", "replace"), np.uint32)
                    n = np.where(codes < 0x180, number[np.minimum(codes, 0x17F)], 0)
                    total += np.bincount((n[:-2] * side + n[1:-1]) * side + n[2:], minlength=side ** 3)
                    part, size = [], 0
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(total[grams], pa.int64())], ["g", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    three, two, one = Counter(), Counter(), Counter()
    for g, n in counted.collect():  # at most side^3 rows, whatever the corpus
        a, b, c = ((_EDGE + LETTERS)[x] for x in (g // side ** 2, g // side % side, g % side))
        three[a + b + c] += n
        two[a + b] += n
        one[a] += n
    return CharModel(three, two, one, sum(one.values()))


#: Lower-case Latin letters below U+0180; anything else is a word's end to the character model.
LETTERS = "".join(chr(c) for c in range(0x180) if chr(c).isalpha() and chr(c) == chr(c).lower())


def names(words: list[str]) -> tuple[tuple[str, ...], int]:
    """Features of a token's words, and how many words."""
    return tuple(f for w in words for f in (w + "$", *[w[:h] for h in HEADS if len(w) >= h])), len(words)


def features(text: str, restorer: Restorer) -> tuple[dict[str, int], int]:
    """Feature counts and number of words of one text; the restorer keeps ``names``."""
    counts: dict[str, int] = {}
    n = 0
    known, make = restorer.seen.get, restorer.token
    for token, k in restorer.tokens(text).items():
        found, words = known(token) or make(token)
        n += k * words
        for f in found:
            counts[f] = counts.get(f, 0) + k
    return counts, n


@dataclass
class Model:
    """Lexicon (feature -> evidence of presence, rates per word if toxic and if not) and the logistic weights."""

    chars: CharModel
    lexicon: dict[str, tuple[float, float, float]]
    weights: tuple[float, float, float]
    name: str = ""


_NOTHING: tuple[tuple[str, ...], int] = ((), 1)


def reader(model: Model) -> Restorer:
    """A restorer that keeps only what is in the lexicon."""
    lexicon = model.lexicon

    def keep(words: list[str]) -> tuple[tuple[str, ...], int]:
        if len(words) == 1:
            w = words[0]
            found = [f for f in (w + "$", w[:4], w[:5], w[:6], w[:7]) if f in lexicon and len(f) <= len(w) + 1]
            return (tuple(dict.fromkeys(found)), 1) if found else _NOTHING
        return tuple(f for f in names(words)[0] if f in lexicon), len(words)

    return Restorer(model.chars, keep, model.name)


def evidence(text: str, lexicon: dict[str, tuple[float, float, float]], restorer: Restorer) -> tuple[float, float]:
    """Best presence and best rate evidence of a text, both in [-3, 10]; the restorer is a ``reader``."""
    hits, n = features(text, restorer)
    present, rate = -3.0, -3.0
    for f, k in hits.items():
        odds, r1, r0 = lexicon[f]
        present = max(present, odds)
        rate = max(rate, odds + k * math.log(r1 / r0) - n * (r1 - r0))
    return min(10.0, present), min(10.0, rate)


def probability(text: str, model: Model, restorer: Restorer) -> float:
    a, b = evidence(text, model.lexicon, restorer)
    w0, w1, w2 = model.weights
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, w0 + w1 * a + w2 * b))))


def fit(docs: DataFrame, labels: DataFrame, chars: CharModel, rows: int = ROWS, terms: int = TERMS) -> Model:
    """Fit on at most ``rows`` labelled documents; labels that are null or neither 0 nor 1 are left out, and so are those without an id.

    Which rows are taken follows from a hash of doc_id, ties from the id; of labels of one id the largest counts, and each row of ``docs`` with
    that id. Entries with equal evidence are taken by their text. Without labels of both kinds, or without rows, every text gets one score.
    """
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("y")
    ).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(chars, names)
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for text, y in zip(batch.column(1), batch.column(2).to_pylist()):
                counts, n = features(text.as_py() or "", restorer)
                counts[""] = n
                for f, k in counts.items():
                    s = sums.get(f)
                    if s is None:
                        s = sums[f] = [0, 0, 0, 0, 0, 0]
                    s[3 * y] += 1
                    s[3 * y + 1] += k
                    s[3 * y + 2] += n
            columns = [list(c) for c in zip(*sums.values())] or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], _COUNTS)

    sums = known.mapInArrow(count, "f string, " + ", ".join(f"{c} long" for c in _COUNTS[1:])).groupBy("f").agg(
        *[F.sum(c).alias(c) for c in _COUNTS[1:]]
    )
    base = sums.filter("f = ''").first()
    if base is None or not base["d0"] or not base["d1"]:
        share = 0.0 if base is None or not base["d1"] else 1.0
        return Model(chars, {}, (math.log((share + 0.01) / (1.01 - share)), 0.0, 0.0))
    n0, n1 = base["d0"], base["d1"]
    p, n = n1 / (n0 + n1), F.col("d0") + F.col("d1")
    log = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    g2 = 2 * (log(F.col("d1"), p) + log(F.col("d0"), 1 - p))
    best = sums.filter((F.col("f") != "") & (F.col("d1") > p * n)).withColumn("g2", g2).filter(F.col("g2") >= LEAST_G2)
    lexicon = {}
    for r in best.orderBy(F.col("g2").desc(), "f").limit(terms).collect():
        odds = math.log((r["d1"] + 0.5) / (n1 + 1) / ((r["d0"] + 0.5) / (n0 + 1)))
        r1 = r["k1"] / r["w1"]
        r0 = (r["k0"] + 0.2) / (r["w0"] + 0.2 * r["w1"] / r["k1"] * 20)
        lexicon[r["f"]] = (odds, r1, min(r0, r1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = reader(Model(chars, lexicon, (0.0, 0.0, 0.0)))
        for batch in batches:
            found = [evidence(t.as_py() or "", lexicon, restorer) for t in batch.column(1)]
            columns = [pa.array([e[i] for e in found], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(2)], ["a", "b", "y"])

    rounded = known.mapInArrow(measure, "a double, b double, y int").groupBy(
        F.round("a", 2).alias("a"), F.round("b", 1).alias("b"), "y"
    ).agg(F.count(F.lit(1)).alias("n"))
    cells = np.array([tuple(r) for r in rounded.collect()], float)  # at most `rows` cells
    return Model(chars, lexicon, _logistic(cells[:, :2], cells[:, 2], cells[:, 3]), uuid.uuid4().hex)


_COUNTS = ["f", "d0", "k0", "w0", "d1", "k1", "w1"]


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Newton steps for a logistic model with a small ridge."""
    x1 = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(3), np.diag([1e-6, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (n * p * (1 - p))[:, None]).T @ x1 + ridge, x1.T @ (n * (y - p)) - ridge @ w)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` of each row of ``docs`` (doc_id, text); a null or empty text has the score of no evidence.

    Whole texts of any length are read, in time linear in it; repeated rows get equal scores, a null id stays null; an empty table gives
    no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = reader(model)
        for batch in batches:
            found = [probability(t.as_py() or "", model, restorer) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a corpus: characters of all texts, labels of the rows outside the held-out third."""
    return fit(docs, labels.filter(fold(F.col("doc_id"), 3) != 1), char_model(docs))


def not_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``; columns stay as they are, whatever their names. Scored in one pass beside the row, no join."""
    model = trained(docs, labels)
    here = boxed(docs.withColumn("text", F.col("text").cast("string")))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = reader(model)
        for batch in batches:
            keep = [probability(t.as_py() or "", model, restorer) < limit for t in batch.column(0).field("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    kept = here.mapInArrow(one, here.schema).select("row.*")
    return kept.withColumn("text", F.col("text").cast(docs.schema["text"].dataType))


def op2_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, trained(docs, labels)).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )
