"""Ids of many texts at once, by a byte-level tokenizer of the 50k rule, where each text is read as bytes with numpy and Arrow.

The rule of these vocabularies takes a contraction, or a run of letters, of digits or of other characters, each with one space before it, or
white space. Some borders of its matches are plain from the bytes around them: in front of the white space after a word, in front of the last
white character before a word (and behind it, unless it is a space), and where an ASCII letter, digit or other sign meets another kind, but
for a letter behind an apostrophe. Texts are cut there only, so the ids of a cut are the same alone as in its text. Arrow numbers
the different cuts of a group of texts, only those not met before are encoded, and numpy puts the ids of all cuts together.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marketfeat.llm.common import MEMORY

#: Bytes of text encoded at once; a longer text is a group of its own.
GROUP = 4 << 20
#: Bytes of a cut that is remembered at most, and about what remembering one takes.
KEPT, COST = 64, 250
#: Cuts that are encoded as lines of one text.
JOINED = 500
_LETTER, _DIGIT, _SIGN, _OTHER, _WHITE, _SPACE = 1, 2, 3, 4, 5, 6
_KIND = np.zeros(256, np.uint8)
for _low, _high, _kind in ((0x21, 0x7F, _SIGN), (0x30, 0x3A, _DIGIT), (0x41, 0x5B, _LETTER), (0x61, 0x7B, _LETTER),
                           (0x80, 0x100, _OTHER), (0x09, 0x0E, _WHITE), (0x20, 0x21, _SPACE)):
    _KIND[_low:_high] = _kind


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (or binary values) and where each begins, with the end; a null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, pa.scalar(b"" if "binary" in str(texts.type) else "", texts.type))
    wide = np.int64 if str(texts.type).startswith("large") else np.int32
    _, places, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(places, wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def groups(texts: pa.Array, size: int = GROUP) -> Iterator[pa.Array]:
    """Slices of ``texts`` of at most ``size`` bytes, or of one text."""
    offsets = text_bytes(texts)[1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; 0 for what no border is taken beside."""
    kind = _KIND[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):  # white characters beyond ASCII (fixed values)
        b0, b1, b2 = data[lead], data[np.minimum(lead + 1, len(data) - 1)], data[np.minimum(lead + 2, len(data) - 1)]
        two = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        three = ((b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80)) | ((b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)) | (
            (b0 == 0xE2) & (((b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))) | ((b1 == 0x81) & (b2 == 0x9F)))
        )
        for found, width in ((two, 2), (three, 3)):
            for k in range(width):
                kind[lead[found] + k] = 0
    return kind


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where cuts begin, with the end of the last; ``offsets`` are the starts of the texts with the end."""
    if not len(data):
        return np.zeros(1, np.int64)
    kind = kinds(data)
    solid, white = (kind > 0) & (kind < _WHITE), kind >= _WHITE
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = solid[:-1] & white[1:]
    last = np.append(white[:-1] & solid[1:], False)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = False
    edge[:-1] |= last
    edge[1:] |= last & (kind == _WHITE)
    a, b = kind[:-1], kind[1:]
    edge[1:-1] |= (a != b) & (a > 0) & (a < _OTHER) & (b > 0) & (b < _OTHER) & ~((data[:-1] == 0x27) & (b == _LETTER))
    edge[offsets] = True
    return np.flatnonzero(edge)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[s:s + n]`` of all starts and lengths, one after another."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return flat[at]


class Encoder:
    """Ids of texts by one tokenizer, with a memory of cuts that is bounded in bytes.

    When the memory is full, the cuts met most often since the last time stay, up to half of it. A text that holds the content
    of an added token of the tokenizer is encoded whole.
    """

    def __init__(self, tokenizer, memory: int = MEMORY) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        self.tokenizer, self.memory = tokenizer, memory
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        #: Bytes of each token; each stands as one character.
        self.sizes = np.zeros(tokenizer.get_vocab_size() + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        for i, t in tokenizer.get_added_tokens_decoder().items():
            self.sizes[i] = len(t.content.encode())
        self.slots: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.lengths, self.hits, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _shrink(self) -> None:
        cuts = list(self.slots)
        at = np.fromiter(self.slots.values(), np.int64, len(cuts))
        cost = COST + 4 * self.lengths[at]
        most = np.argsort(-self.hits[at], kind="stable")
        kept = np.sort(most[(np.cumsum(cost[most]) < self.memory // 2) & (self.hits[at][most] > 0)])
        starts = np.cumsum(self.lengths) - self.lengths
        at = at[kept]
        self.flat, self.lengths = gathered(self.flat, starts[at], self.lengths[at]), self.lengths[at]
        self.hits, self.used = np.zeros(len(kept), np.int64), int(cost[kept].sum())
        self.slots = {cuts[i]: k for k, i in enumerate(kept.tolist())}

    def _ids(self, texts: list[str]) -> np.ndarray:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(made), np.uint32, sum(map(len, made)))

    def _encoded(self, different: pa.StringArray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the ``new`` ones of some different cuts, one after another, and how many each has.

        A cut without white space, but for a first space, keeps its borders between line breaks: such cuts are encoded many at once, and
        the bytes of the tokens tell whose they are.
        """
        data, offsets = text_bytes(different)
        solid = kinds(data)
        solid = (solid > 0) & (solid < _WHITE)
        begin, end = offsets[new], offsets[new + 1]
        others = np.concatenate(([0], np.cumsum(~solid)))
        others = others[end] - others[begin] - ((end - begin > 1) & (data[begin] == 0x20))
        cuts = different.take(pa.array(new)).to_pylist()
        joined, alone = np.flatnonzero(others == 0), np.flatnonzero(others)
        lines = ["\n".join([cuts[i] for i in joined[k:k + JOINED].tolist()]) + "\n" for k in range(0, len(joined), JOINED)]
        lengths = np.zeros(len(new), np.int64)
        parts = []
        if lines:
            ids = self._ids(lines)
            ends = np.cumsum(self.sizes[ids])
            breaks = np.cumsum((end - begin)[joined] + 1)
            last = np.searchsorted(ends, breaks)  # the line break behind each cut
            if len(ids) == 0 or ends[-1] != breaks[-1] or (ends[last] != breaks).any() or (self.sizes[ids[last]] != 1).any():
                raise ValueError("the tokenizer joins cuts over a line break")
            lengths[joined] = np.diff(np.concatenate(([-1], last))) - 1
            parts.append(np.delete(ids, last))
        if len(alone):
            made = [e.ids for e in self.tokenizer.encode_batch_fast([cuts[i] for i in alone.tolist()], add_special_tokens=False)]
            lengths[alone] = np.fromiter(map(len, made), np.int64, len(made))
            parts.append(np.fromiter(chain.from_iterable(made), np.uint32, int(lengths[alone].sum())))
        order = np.concatenate([joined, alone])
        starts = np.zeros(len(new), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return gathered(np.concatenate(parts), starts, lengths), lengths

    def _slots(self, different: pa.StringArray) -> np.ndarray:
        """Where the memory has each of some different cuts; new ones are encoded, those of over KEPT bytes are not found again."""
        if self.used > self.memory:
            self._shrink()
        cuts = different.to_pylist()
        slots = np.fromiter(map(self.slots.get, cuts, repeat(-1)), np.int64, len(cuts))
        new = np.flatnonzero(slots < 0)
        if len(new):
            ids, lengths = self._encoded(different, new)
            slots[new] = np.arange(len(new)) + len(self.lengths)
            sizes = np.diff(text_bytes(different)[1])[new]
            short = sizes <= KEPT
            self.slots.update(zip([cuts[i] for i in new[short].tolist()], slots[new[short]].tolist()))
            self.flat = np.concatenate([self.flat, ids])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.hits = np.concatenate([self.hits, np.full(len(new), -1, np.int64)])
            self.used += int(COST * short.sum() + 4 * lengths.sum())
        self.hits[slots] += 1
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, unsigned 32-bit, and where each text's ids begin, with the end."""
        data, offsets = text_bytes(texts)
        points = cut_points(data, offsets)
        for content in self.added:
            whole = np.flatnonzero(pc.match_substring(pc.fill_null(texts, ""), content).to_numpy(zero_copy_only=False))
            for i in whole:
                points = points[(points <= offsets[i]) | (points >= offsets[i + 1])]
        if len(points) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cuts = pa.StringArray.from_buffers(len(points) - 1, pa.py_buffer(points.astype(np.int32)), pa.py_buffer(data))
        coded = cuts.dictionary_encode()
        which = self._slots(coded.dictionary)[coded.indices.to_numpy()]
        lengths = self.lengths[which]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = gathered(self.flat, (np.cumsum(self.lengths) - self.lengths)[which], lengths)
        return ids, ends[np.searchsorted(points, offsets)]
