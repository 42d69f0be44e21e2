"""Best-fit packing by bin completion.

Sequences hold CAPACITY tokens, so a piece has one of CAPACITY lengths. The plan is made on the counts of lengths, a table of at most CAPACITY rows
whatever the number of documents. Best fit, or the fullest filling around each largest length, is the incumbent. Where it needs more sequences than
the lower bound, a branch-and-bound looks for a plan with fewer: around the largest length left it tries every undominated filling, goes back to
other ones, and gives a branch up once its waste is more than a better plan can have; it ends at the bound, by a proof, or after STEPS. Spark counts the lengths, ranks the
pieces of each length (in slices, for lengths that many pieces have), and joins ranks to the places of the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.llm import encoding
from marketfeat.llm.common import held, ranked, table
from marketfeat.session import checkpointed

CAPACITY, END = 1024, 2
#: Work that the branch-and-bound over sequences may take, in fillings tried and lengths looked at.
STEPS = 2_000_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _encoder(path: str) -> encoding.Encoder:
    def make() -> encoding.Encoder:
        from tokenizers import Tokenizer

        return encoding.Encoder(Tokenizer.from_file(path))

    return held("packing", path, make=make)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pieces of each row of ``docs`` (doc_id, text): its ids and END, cut from the end into ``capacity`` tokens.

    Only a document longer than ``capacity`` is cut; its first piece may be shorter. A null text is empty: one piece with END.
    ``ids`` adds the ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).encode
        for batch in batches:
            at = 0
            for texts in encoding.groups(batch.column(1)):
                found, begins = encode(texts)
                yield _cut(batch.column(0).slice(at, len(texts)), np.insert(found, begins[1:], END).astype("<u4"), begins, capacity, ids)
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, _PIECES + ", ids array<int>" * ids
    )


def _cut(doc_ids: pa.Array, found: np.ndarray, begins: np.ndarray, capacity: int, ids: bool) -> pa.RecordBatch:
    """Pieces of texts whose ids, with END, are ``found``; ``begins`` are their starts without the ENDs."""
    begins = begins + np.arange(len(begins))
    sizes = np.diff(begins)
    many = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), many)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    first = sizes - (many - 1) * capacity
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    length = np.where(piece == 0, first[doc], capacity)
    places = np.append(0, np.cumsum(length))
    data = memoryview(found.tobytes())
    crc = [zlib.crc32(data[a:b]) for a, b in zip((4 * places[:-1]).tolist(), (4 * places[1:]).tolist())]
    out = [doc_ids.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
    if ids:
        out.append(pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(found.astype(np.int32))))
    return pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])


def completions(left: list[tuple[int, int]], room: int, most: int = 4000) -> list[int]:
    """The fullest filling of ``room`` by ``left``, (length, count) with lengths falling: ties prefer larger lengths.

    Depth first, larger lengths first, so the first filling is the best fit greedily found and later ones must waste less. A branch ends
    when what is left in all can't reach the best. ``most`` bounds the search: this filling only makes an incumbent.
    """
    lengths, counts = [a for a, _ in left], [n for _, n in left]
    tail = [0] * (len(left) + 1)
    for i in range(len(left) - 1, -1, -1):
        tail[i] = tail[i + 1] + lengths[i] * counts[i]
    best: tuple[int, list[int]] = (room, [])
    steps = 0
    stack: list[tuple[int, int, list[int]]] = [(0, room, [])]
    while stack and best[0] and steps < most:
        i, free, chosen = stack.pop()
        steps += 1
        while i < len(lengths) and lengths[i] > free:
            i += 1
        if i == len(lengths) or not free:
            if free < best[0]:
                best = (free, chosen)
            continue
        if free - tail[i] >= best[0]:
            continue
        stack.append((i + 1, free, chosen))
        for take in range(1, min(counts[i], free // lengths[i]) + 1):
            stack.append((i + 1, free - take * lengths[i], chosen + [lengths[i]] * take))
    return best[1]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Fillings and how many sequences get each; together they use every length as often as ``counts`` says."""
    counts = {a: n for a, n in counts.items() if n}
    bound = -(-sum(a * n for a, n in counts.items()) // capacity)
    fits = _best_fit(counts, capacity)
    if sum(n for _, n in fits) == bound:
        return fits
    left, found = dict(counts), []
    while left:
        largest = max(left)
        rest = sorted(((a, n - (a == largest)) for a, n in left.items() if n > (a == largest)), reverse=True)
        filling = [largest, *completions(rest, capacity - largest)]
        used = {a: filling.count(a) for a in filling}
        times = min(left[a] // k for a, k in used.items())
        found.append((filling, times))
        for a, k in used.items():
            left[a] -= k * times
            if not left[a]:
                del left[a]
    best = min(found, fits, key=_size)
    steps = [STEPS]
    while _size(best) > bound:
        better = _fewer(counts, capacity, _size(best) - 1, steps)
        if better is None:
            break
        best = better
    return best


def _size(fillings: list[tuple[list[int], int]]) -> int:
    return sum(n for _, n in fillings)


def _fillings(left: dict[int, int], room: int, waste: int, steps: list[int]) -> Iterator[list[int]]:
    """Undominated fillings of ``room`` by ``left`` that leave at most ``waste`` free, larger lengths first.

    A filling is dominated if a length left out could take the place of nothing, of a smaller length, or of two lengths of no
    larger sum in it: what it puts back can be used wherever that length would have been.
    """
    lengths = sorted(left, reverse=True)
    tail = [0] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        tail[i] = tail[i + 1] + lengths[i] * left[lengths[i]]
    stack: list[tuple[int, int, list[int]]] = [(0, room, [])]
    while stack and steps[0] > 0:
        i, free, chosen = stack.pop()
        steps[0] -= 1
        while i < len(lengths) and lengths[i] > free:
            i += 1
        if i < len(lengths):
            if free - tail[i] <= waste:
                stack.append((i + 1, free, chosen))
                for take in range(1, min(left[lengths[i]], free // lengths[i]) + 1):
                    stack.append((i + 1, free - take * lengths[i], chosen + [lengths[i]] * take))
        elif free <= waste:
            out = [a for a in lengths if a <= room and chosen.count(a) < left[a]]
            steps[0] -= len(out)
            parts = {b: 1 for b in chosen} | {b + c: 2 for k, b in enumerate(chosen) for c in chosen[k + 1:]}
            if not any(a <= free or any(b < a <= b + free for b in chosen) or any(
                b <= a <= b + free and n == 2 for b, n in parts.items()
            ) for a in out):
                yield chosen


def _fewer(counts: dict[int, int], capacity: int, most: int, steps: list[int]) -> list[tuple[list[int], int]] | None:
    """A plan of at most ``most`` sequences, or None if there is none or ``steps`` run out (then ``steps[0]`` is 0 or less).

    A filling is tried as often as the counts allow, then once; a state (what is left, how much was wasted) is tried once.
    """
    left, plan_, tried = dict(counts), [], set()

    def choices(waste: int) -> Iterator[tuple[list[int], int, int]]:
        steps[0] -= len(left)
        largest = max(left)
        rest = {a: n - (a == largest) for a, n in left.items() if n > (a == largest)}
        for filling in _fillings(rest, capacity - largest, waste, steps):
            filling = [largest, *filling]
            free = capacity - sum(filling)
            times = min(left[a] // filling.count(a) for a in filling)
            if free:
                times = min(times, waste // free)
            for n in dict.fromkeys((times, 1)):
                yield filling, n, waste - n * free

    waste = most * capacity - sum(a * n for a, n in counts.items())
    if waste < 0:
        return None
    frames = [choices(waste)]
    while frames and steps[0] > 0:
        step = next(frames[-1], None)
        if step is None:
            frames.pop()
            if plan_:
                filling, n = plan_.pop()
                for a in filling:
                    left[a] = left.get(a, 0) + n
            continue
        filling, n, waste = step
        for a in filling:
            left[a] -= n
            if not left[a]:
                del left[a]
        plan_.append((filling, n))
        if not left:
            return plan_
        state = hash((waste, frozenset(left.items())))
        frames.append(iter(()) if state in tried else choices(waste))
        tried.add(state)
    return None


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit decreasing on counts: open fillings of one content are kept together. The first incumbent."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                k = capacity // length
                full, odd = divmod(n, k)
                for content, times in (((length,) * k, full), ((length,) * odd, 1)):
                    if content and times:
                        rooms.setdefault(capacity - sum(content), {})[content] = times
                break
            content, times = rooms[room].popitem()
            k = min(room // length, n)
            times, spare = (1, times) if n < k * 2 else (min(times, n // k), times)
            if spare > times:
                rooms[room][content] = spare - times
            if not rooms[room]:
                del rooms[room]
            new = content + (length,) * k
            slot = rooms.setdefault(capacity - sum(new), {})
            slot[new] = slot.get(new, 0) + times
            n -= k * times
    return [(list(c), n) for slot in rooms.values() for c, n in slot.items()]


def pack(lengths: DataFrame, key: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``lengths`` (key columns and ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Rows with the same key are placed one by one. The plan and its places grow with ``capacity``, not with the rows.
    """
    counted = {r["length"]: r["n"] for r in lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(a is None or not 1 <= a <= capacity for a in counted):
        raise ValueError(f"a piece is empty or longer than {capacity}")
    next_id, next_rank, places = 0, dict.fromkeys(counted, 0), []
    for filling, times in plan(counted, capacity):
        at = 0
        for a in filling:
            places.append((a, next_rank[a], next_rank[a] + times, next_id, at))
            next_rank[a] += times
            at += a
        next_id += times
    spark = lengths.sparkSession
    slots = spark.createDataFrame(places, "slot_length long, first long, last long, base long, offset long")
    placed = ranked(lengths, ["length"], key, "rank")
    met = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    return placed.join(F.broadcast(slots) if len(places) < 1 << 17 else slots, met).select(
        *lengths.columns, (F.col("base") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` with their sequence and offset. Empty tables give no rows; other columns are ignored."""
    return pack(checkpointed(pieces(docs, tokenizer, capacity)), ["doc_id", "piece"], capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id``, ``ids``, ``doc_ids``, ``starts``: the training sequences themselves, each at most ``capacity`` ids."""
    whole = checkpointed(pieces(docs, tokenizer, capacity, ids=True))
    placed = pack(whole, ["doc_id", "piece"], capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts")
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary())
