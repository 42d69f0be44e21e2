"""Byte-level BPE against the tiktoken library and exact round trips; whole batches of texts against the tokenizer alone."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from marketfeat.llm import bpe, encoding, packing

ODD = list("abXZ019 \t\n.,!?()-_'strevmdl") + ["\r\n", "é", "ß", "　", "中文", " ", "“", "\x1c", "\x00", "½", "‍", "😀", "́", "\x85", "Ⅷ", " "]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(7)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.choice([0, 1, 2, 5, 40, 300]))) for _ in range(1500)]
    return texts + [None, "", " ", "  ", "a  ", "<|endoftext|> a", "x" * 200_000, "中" * 100_000, "1_" * 50_000, " ." * 50_000, "\n" * 60_000, "it's 'S 's"]


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.read_ranks(bpe.ranks_path()), special_tokens={})


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "n") for i, t in enumerate(texts)] + [(None, "no id", 1, "n"), (3, texts[3], 2, "n")],
                                 "doc_id long, text string, ids int, bytes string")


def test_encoding_and_decoding(spark, odd_texts, own):
    docs = table(spark, odd_texts)
    path, rule = bpe.ranks_path(), bpe.pattern()
    encoded = bpe.encode(docs, path, rule, offsets=True)
    rows = encoded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = "no id" if r["doc_id"] is None else odd_texts[r["doc_id"]] or ""
        assert r["ids"] == own.encode_ordinary(text)
        if len(text) < 1000:
            tokens = [own.decode_single_token_bytes(i) for i in r["ids"]]
            at, data = 0, text.encode()
            for t, a, b in zip(tokens, r["starts"], r["ends"]):
                whole = [k for k, c in enumerate(text) if len(text[:k + 1].encode()) > at and len(text[:k].encode()) < at + len(t)]
                assert (a, b) == (whole[0], whole[-1] + 1)
                at += len(t)
            assert b"".join(tokens) == data
    back = bpe.decode(encoded, path, text=True, parts=True).collect()
    for r in back:
        text = "no id" if r["doc_id"] is None else odd_texts[r["doc_id"]] or ""
        assert (bytes(r["bytes"]), r["text"], "".join(r["parts"])) == (text.encode(), text, text) and len(r["parts"]) == r["n_tokens"] == len(r["starts"])
    packed = bpe.decode(bpe.encode(docs, path, rule, packed=True), path)
    assert sorted((r["doc_id"] or 0, bytes(r["bytes"])) for r in packed.collect()) == sorted((r["doc_id"] or 0, bytes(r["bytes"])) for r in back)


def test_split_characters_and_unknown_ids(spark, own):
    ids = own.encode_ordinary("a\U0001F984b")
    rows = spark.createDataFrame([(1, ids[:2]), (2, ids), (3, None), (4, [None, 50256, -1, 10**9, ids[0]]), (5, [])], "k int, ids array<long>")
    got = {r["k"]: r for r in bpe.decode(rows, bpe.ranks_path(), text=True, parts=True).collect()}
    assert got[1]["text"].startswith("a�") and bytes(got[1]["bytes"]) == own.decode_bytes(ids[:2])
    assert got[2]["text"] == "a\U0001F984b" and [p for p in got[2]["parts"] if p] == ["a", "\U0001F984", "b"] and len(got[2]["parts"]) == len(ids) > 3
    assert (got[3]["n_tokens"], bytes(got[3]["bytes"])) == (0, b"") == (got[5]["n_tokens"], bytes(got[5]["bytes"]))
    assert got[4]["n_tokens"] == 5 and got[4]["text"] == "a"
    with pytest.raises(ValueError):
        bpe.decode(rows.withColumn("bytes", F.lit(1)), bpe.ranks_path())


def test_memory_of_cuts_is_bounded(odd_texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary())
    small = encoding.Encoder(plain, memory=20_000)
    texts = [t for t in odd_texts if t is None or len(t) < 1000]
    for low in range(0, len(texts), 50):
        part = texts[low:low + 50]
        ids, begins = small.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in part]
    assert small.used < 2_000_000 and len(small.slots) < 20_000
    assert sum(map(len, encoding.groups(pa.array(odd_texts, pa.string()), 1000))) == len(odd_texts)


def test_cuts_are_borders_of_matches(odd_texts):
    import regex

    matches = regex.compile(bpe.pattern())
    for text in odd_texts[:1500]:
        data = np.frombuffer((text or "").encode(), np.uint8)
        points = encoding.cut_points(data, np.array([0, len(data)])).tolist()
        borders = {len((text or "")[:m.start()].encode()) for m in matches.finditer(text or "")} | {len(data)}
        assert not len(data) or set(points) <= borders


def test_query(spark, testdata, own):
    got = {r["doc_id"]: r for r in bpe.op11_byte_bpe(spark, testdata).collect()}
    for r in spark.read.parquet(f"{testdata}/documents.parquet").collect():
        text = r["text"] or ""
        ids = own.encode_ordinary(text)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    encoded = bpe.encode(none, bpe.ranks_path(), bpe.pattern())
    assert encoded.count() == 0 and bpe.decode(encoded, bpe.ranks_path()).count() == 0
