"""Byte-level BPE by the tokenizers library, from a file of ranks, and back.

*Ranks to a tokenizer.* A rank file maps byte strings to ranks. Each byte stands as one printable character in the library's model, so a
token is a string of such characters; its merges are all pairs of tokens that make a token, in the order of the ranks made, and a match
that is a token as a whole is that token. The rule that sets matches apart is a parameter; each match is encoded for itself.

*Encoding.* Tasks read Arrow batches in groups of texts (``encoding.Encoder``). A token's place is first known in bytes: numpy sums the
lengths of tokens, and counts the bytes that begin a character, so each token has the code points it touches as ``[start, end)``; tokens that
share a split character both cover it.

*Decoding* reverses the byte table and puts the bytes of the ids together. Bytes need not be whole characters: ``bytes`` are exact, ``text``
reads them with a replacement character for what is none, and ``parts`` gives each id the text that it completes, so a split
character comes with the id of its last byte.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from marketfeat.llm import encoding
from marketfeat.llm.common import held, table

#: Characters that stand for bytes: printable ones for themselves, the others from U+0100 on (fixed rule of the format).
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file: base64 and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_of(ranks: dict[bytes, int], pattern: str):
    """A tokenizer of the library with the ids ``ranks`` that encodes each match of ``pattern`` for itself; the rest is dropped."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = {t: "".join(map(BYTE_CHARS.__getitem__, t)) for t in ranks}
    merges = [
        (shown[token[:k]], shown[token[k:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks
    ]
    made = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return made


class Bytes:
    """Bytes of each id: all in one array, and each id's start and length; an id without a token has length 0."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        self.known = np.zeros(size, bool)
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank], self.lengths[rank], self.known[rank] = token, len(token), True
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def valid(self, ids: np.ndarray) -> np.ndarray:
        inside = (ids >= 0) & (ids < len(self.known))
        return inside & self.known[np.where(inside, ids, 0)]


def _coder(path: str, rule: str) -> tuple[encoding.Encoder, Bytes]:
    def make() -> tuple[encoding.Encoder, Bytes]:
        ranks = read_ranks(path)
        return encoding.Encoder(tokenizer_of(ranks, rule)), Bytes(ranks)

    return held("bpe", path, rule, make=make)


def _bytes(path: str) -> Bytes:
    return held("bytes", path, make=lambda: Bytes(read_ranks(path)))


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _spans(texts: pa.Array, ids: np.ndarray, begins: np.ndarray, table_: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points that each id touches, from the start of its text."""
    data, offsets = encoding.text_bytes(texts)
    sizes = table_.lengths[ids]
    ends = np.cumsum(sizes)
    if (ends[-1] if len(ends) else 0) != len(data):
        raise ValueError("the rule leaves out parts of the texts; their ids have no places")
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    first = np.repeat(np.append(character, 0)[np.minimum(offsets[:-1], len(character))], np.diff(begins))
    return character[ends - sizes] - first, character[ends - 1] + 1 - first


def encode(docs: DataFrame, path: str, rule: str, packed: bool = False, offsets: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` of each row of ``docs`` (doc_id, text), whole texts, without special tokens.

    ``ids`` is array<int>, or with ``packed`` binary: 4 little-endian bytes an id. ``offsets`` adds ``starts`` and ``ends``, array<int>: the
    code points of the text that an id touches. A null or empty text has no ids. Repeated rows come back once each; a null doc_id stays null; other columns are ignored; an empty table
    gives no rows. Texts of any length are encoded whole: a task holds the bytes of one group of texts, or of one text. ``rule`` must
    be one whose matches end where ``encoding.cut_points`` says, as the rule of the 50k vocabularies does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table_ = _coder(path, rule)
        for batch in batches:
            at = 0
            for texts in encoding.groups(batch.column(1)):
                ids, begins = encoder.encode(texts)
                if packed:
                    whole = pa.py_buffer(ids.astype("<u4"))
                    out = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(begins * 4), whole]).cast(pa.binary())]
                else:
                    out = [_lists(begins, ids)]
                if offsets:
                    out += [_lists(begins, c) for c in _spans(texts, ids, begins, table_)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *out], names)
                at += len(texts)

    names = ["doc_id", "ids"] + ["starts", "ends"] * offsets
    kinds = "doc_id long, ids " + ("binary" if packed else "array<int>") + ", starts array<int>, ends array<int>" * offsets
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)


def _lists(begins: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(values.astype(np.int32)))


def decode(rows: DataFrame, path: str, text: bool = False, parts: bool = False) -> DataFrame:
    """``rows`` (``ids``, array of integers or packed binary) with ``ids`` replaced by ``n_tokens`` and ``bytes``, other columns beside them.

    ``text`` adds the bytes read as UTF-8, with U+FFFD for what is no character; ``parts`` adds array<string>: the text that each id completes. A null id, or
    one without a token, has no bytes and counts in ``n_tokens``; null ``ids`` are empty. Names that clash are an error of the caller.
    """
    added = ["n_tokens", "bytes"] + ["text"] * text + ["parts"] * parts
    others = [c for c in rows.columns if c != "ids"]
    clash = sorted(set(others) & set(added))
    if clash:
        raise ValueError(f"columns {clash} of the rows have names of results")
    ids = F.col("ids") if dict(rows.dtypes)["ids"] == "binary" else F.col("ids").cast("array<long>")
    source = rows.select(*[F.col(f"`{c}`") for c in others], ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = _bytes(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for at, part in _parts(column):
                found, begins = _ids(part)
                good = table_.valid(found)
                safe = np.where(good, found, 0)
                sizes = np.where(good, table_.lengths[safe], 0)
                data = encoding.gathered(table_.flat, table_.starts[safe], sizes).tobytes()
                ends = np.concatenate(([0], np.cumsum(sizes)))
                places = ends[begins]
                whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(places), pa.py_buffer(data)])
                out = [pa.array(np.diff(begins)), whole.cast(pa.binary())]
                if text:
                    out.append(pa.array([b.as_py().decode("utf-8", "replace") for b in whole], pa.string()))
                if parts:
                    out.append(pa.array([_steps(data, ends[a:b + 1]) for a, b in zip(begins[:-1], begins[1:])], pa.list_(pa.string())))
                before = [batch.column(i).slice(at, len(part)) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(before + out, [*others, *added])

    kinds = [LongType(), BinaryType()] + [StringType()] * text + [ArrayType(StringType())] * parts
    schema = StructType([*source.schema.fields[:-1], *map(StructField, added, kinds)])
    return source.mapInArrow(run, schema)


def _parts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a column of ids of at most ``most`` ids, or of one row."""
    sizes = np.diff(_ids(column)[1])
    ends = np.cumsum(sizes)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield at, column.slice(at, end - at)
        at = end


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column and where each row's begin, with the end; what is null is -1."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        data, offsets = encoding.text_bytes(column)
        return np.frombuffer(data.tobytes(), "<u4").astype(np.int64), offsets // 4
    sizes = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    return pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _steps(data: bytes, ends: np.ndarray) -> list[str]:
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    last = len(ends) - 2
    return [reader.decode(data[a:b], k == last) for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()))]


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rule = ranks_path(), pattern()
    encoded = encode(table(spark, sf_dir, "documents"), path, rule, packed=True)
    # The decoder gets nothing but the ids, and a copy of them to be hashed.
    back = decode(encoded.withColumn("kept", F.col("ids")), path)
    return back.select("doc_id", "n_tokens", F.sha2("kept", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
