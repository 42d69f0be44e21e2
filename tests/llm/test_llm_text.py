"""Operators of the llm folder that read texts, against plain Python on small inputs with nulls, ties, copies and odd texts."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marketfeat.llm import chat, chunks, languages, lines, packing, simhash, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, _h int, part int"


def corpus(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", "en"), f"s{(i or 0) % 3}", len(t or ""), "x", 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["the", "of", "a", "b", "c", "d", "ünder", "straße", "x1", "re."] + [f"w{i}" for i in range(40)]
    some = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 19, 20, 21, 60, 150]))) for _ in range(40)]
    shared = " ".join(rng.choice(words) for _ in range(30))
    some += [f"{a} {shared}\n {b}" for a, b in zip(some[:12], some[12:24])]
    some += [None, "", " \t\n", "the " * 500, "the " * 20, some[30], some[30], "a b " * 60, " x " * 30, "z" * 5000]
    rows = list(enumerate(some))
    return rows + [(7, some[7]), (9, some[20]), (None, some[30])]


def test_substrings(spark, texts):
    got = sorted(map(tuple, substrings.dedup_substrings(corpus(spark, texts)).drop("kept").collect()), key=str)
    last = 1 << 63
    rows = [(last if i is None else i, (t or "").encode().split()) for i, t in texts]
    first = {}
    for i, w in rows:
        for s in range(len(w) - 19):
            key = tuple(w[s:s + 20])
            first[key] = min(first.get(key, (i, s)), (i, s))
    want = []
    for i, w in rows:
        gone = {s + k for s in range(len(w) - 19) if first[tuple(w[s:s + 20])] != (i, s) for k in range(20)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((None if i == last else i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)


def test_simhash(spark, texts):
    import xxhash

    def brute(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for _, t in texts:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == brute(t)
    got = simhash.near_duplicates(corpus(spark, texts)).collect()
    assert len(got) == len(texts)
    fps = [r["fp"] & (1 << 64) - 1 for r in got]
    group = list(range(len(got)))
    for _ in got:
        for i, a in enumerate(fps):
            group[i] = min(group[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 3)
    for i, r in enumerate(got):
        assert r["component_id"] == min(x["doc_id"] for j, x in enumerate(got) if group[j] == group[i] and x["doc_id"] is not None)


def test_simhash_large_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 4)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(20)]
    fps = sorted({b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base for _ in range(12)} | set(base))
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()

    def closed(pairs):
        at = {f: f for f in fps}
        for _ in fps:
            changed = False
            for a, b in pairs:
                low = min(at[a], at[b])
                changed |= at[a] != low or at[b] != low
                at[a] = at[b] = low
            if not changed:
                return at

    assert closed([(r["a"], r["b"]) for r in edges]) == closed([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 3])


def test_distinct_documents(spark, texts):
    docs = corpus(spark, texts)
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    fps = [simhash.fingerprint(t) & (1 << 64) - 1 for _, t in texts]
    group = list(range(len(texts)))
    for _ in range(6):
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    hashes = [r["h"] for r in spark.createDataFrame([(t,) for _, t in texts], "t string").select(F.xxhash64("t").alias("h")).collect()]
    first = {}
    for (i, t), g, h in zip(texts, group, hashes):
        first[g] = min(first.get(g, (True, 0, 0, "")), (i is None, i or 0, h, t or ""))
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((i, t) for _, i, _, t in first.values())
    assert len(first) < len(texts) - 3


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    docs = corpus(spark, texts)
    got = packing.packed(docs, packing.vocabulary(), 64).collect()
    want = []
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        n = len(ids)
        cut = n - (-(-n // 64) - 1) * 64
        for k, a in enumerate([0, *range(cut, n, 64)]):
            part = ids[a:cut if k == 0 else a + 64]
            want.append((i, k, a, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=str) == sorted(want, key=str)
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert at.get(r["sequence_id"], 0) == r["offset"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
    counts = {}
    for w in want:
        counts[w[3]] = counts.get(w[3], 0) + 1
    assert max(at.values()) <= 64 and len(at) <= sum(n for _, n in packing._best_fit(counts, 64))
    whole = packing.sequences(docs, packing.vocabulary(), 64).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(w[3] for w in want)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_length(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))}
    used = {}
    for filling, times in packing.plan(counts, 100):
        assert sum(filling) <= 100
        for a in filling:
            used[a] = used.get(a, 0) + times
    assert used == counts


def test_plan_goes_back_to_other_fillings():
    pieces = [614, 430, 420, 420, 399, 369, 225, 184]
    assert sum(n for _, n in packing.plan({a: pieces.count(a) for a in pieces}, 1024)) == 3

    def fewest(todo, rooms):  # brute force, each piece into every open sequence
        if not todo:
            return len(rooms)
        a, best = todo[0], 99
        for i, r in enumerate(rooms):
            if r >= a and r not in rooms[:i]:
                best = min(best, fewest(todo[1:], rooms[:i] + [r - a] + rooms[i + 1:]))
        return min(best, fewest(todo[1:], rooms + [100 - a])) if len(rooms) < 8 else best

    rng = random.Random(4)
    for _ in range(150):
        todo = sorted((rng.randrange(12, 70) for _ in range(8)), reverse=True)
        assert sum(n for _, n in packing.plan({a: todo.count(a) for a in todo}, 100)) == fewest(todo, [])


def test_chunks(spark, texts):
    rows = [(i, t) for i, t in texts if i not in (7, 9)]
    got = {r["doc_id"]: r for r in chunks.edited_pairs(corpus(spark, rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        edited = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert chunks.read(r["fingerprint"]) == chunks.weights(t) and chunks.read(r["edited_fingerprint"]) == chunks.weights(edited)
        assert r["near_next"] == chunks.containment(chunks.weights(t), chunks.weights(u))


def test_cuts_hold_and_shift():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    data = text.encode()
    ends = chunks.cuts(data)
    assert ends[-1] == len(data) and all(b - a <= chunks.MOST for a, b in zip([0, *ends], ends))
    assert "".join(data[a:b].decode() for a, b in zip([0, *ends], ends)) == text
    assert chunks.containment(chunks.weights(text), chunks.weights("new start " + text)) > 0.95


def test_chat(spark):
    rows = [(1, 1, "assistant", "b\\"), (1, 0, "user", None), (1, 1, "assistant", "</turn>\n### user: x"), (2, None, None, "#<:\\"), (None, 3, "assistant:", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("head", F.lit(1))
    formatted = chat.format_turns(df)
    read = [t for r in formatted.collect() for t in chat.parse(r["formatted"])]
    assert sorted(read) == sorted((r or "", t or "") for _, _, r, t in rows)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == len(rows[0][3]) + len(rows[2][3]) and set(got) == {1, 2, None}


def test_chat_parts(spark):
    parts = [("text", "a<", None, None, None, None, None), ("image", None, "u", 57, 28, None, None), ("document", None, "d", None, None, None, 2), None]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_turns(df).first()
    assert r["formatted"] == "### assistant: a\\<<image:1><document:2></turn>\n"
    assert [(a["n"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, "u", 3), (2, "d", 512)]
    assert [r["formatted"][s["start"]:s["start"] + s["length"]] for s in r["loss"]] == ["a\\<", ""]


def test_languages(spark):
    rows = [(i, t, l, "s", 0, "x", 1, 2) for i, (t, l) in enumerate([("der und die das ist nicht", "de"), ("the and of with this that", "en")] * 8)]
    rows += [(90, None, "de", "s", 0, "x", 1, 2), (91, "12 !", "en", "s", 0, "x", 1, 2), (92, "q" * 3000, None, "s", 0, "x", 1, 2)]
    docs = spark.createDataFrame(rows, DOCS)
    model = languages.learn(docs, languages.ranks())
    got = {r["doc_id"]: r for r in languages.identify(docs, model).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows[:16])
    assert got[90]["lang_pred"] == got[91]["lang_pred"] == "und" and got[92]["lang_pred"] in ("de", "en")
    assert {r["lang_pred"] for r in languages.identify(docs, languages.learn(docs.filter("false"), languages.ranks())).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = sorted([b"a", b"b", b"ab", b"ba", b"aba"])
    p = np.array([[0.1], [0.2], [0.3], [0.15], [0.25], [0.0]])

    def brute(word):
        return 1.0 if not word else sum(p[i, 0] * brute(word[len(x):]) for i, x in enumerate(pieces) if word.startswith(x))

    words = [b"abab", b"baba", b"aaaa"]
    rows = np.frombuffer(b"".join(words), np.uint8).reshape(-1, 4)
    find = languages.Pieces(pieces)
    assert np.allclose(find.forward(rows, p)[0][-1][:, 0], [brute(w) for w in words])
    total = find.expected(rows, np.ones(3), p, np.zeros(3, int))
    assert np.isclose(sum(total[i, 0] * len(x) for i, x in enumerate(pieces)), 12)


def test_toxicity(spark):
    rng = random.Random(3)
    words = ["thing", "reon", "anders", "house", "tree", "over"]
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        t = [rng.choice(words) for _ in range(30)] + (["moron"] if bad else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t), "en", "s", 0, "x", 1, 2))
        labels.append((i, int(bad)))
    odd = ["what a m0r0n", "m o r o n", "morooooon", "m.o.r.o.n over", "over there", None, "", "1 2 3", "o" * 20000]
    rows += [(1000 + i, t, "en", "s", 0, "x", 1, 2) for i, t in enumerate(odd)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.trained(docs, known)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == (y == 1) for i, y in labels)
    assert all(got[1000 + i] >= 0.7 for i in range(4)) and all(got[1000 + i] < 0.7 for i in range(4, 9))
    kept = toxicity.not_toxic(docs, known)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 60 - 4
    none = toxicity.trained(docs, known.filter("false"))
    assert max(r["score"] for r in toxicity.score(docs, none).collect()) < 0.7


def test_long_spaced_stretches_are_read_whole():
    words = "you are really such a moron and nobody here wants that any more".split()
    one, two, three = {}, {}, {}
    text = " " + " ".join(words * 50) + " "
    for i in range(len(text) - 2):
        for grams, n in ((one, 1), (two, 2), (three, 3)):
            grams[text[i:i + n]] = grams.get(text[i:i + n], 0) + 1
    restorer = toxicity.Restorer(toxicity.CharModel(three, two, one, sum(one.values())))
    spaced = " ".join("".join(words))
    assert len(spaced) > 64 and restorer.text(spaced).replace(" ", "") == "".join(words)
    assert max(map(len, restorer.text(spaced).split())) > 1 and " m o r o n " not in restorer.text(spaced)
    long = "m0r0n" * 40
    assert restorer.text(long) == toxicity.restore(long, restorer.model) == "moron" * 40


def test_lines(spark):
    body = [f"alpha{chr(97 + i)} beta{chr(97 + i)} gamma" for i in range(12)]
    rows = [(i, f"{b} one\nPage {i} of the big site\n\n{b} two", "en", "s", 9, "x", 1, 2) for i, b in enumerate(body)]
    copy = "same first line here\nsame second line here"
    rows += [(50 + i, copy, "en", "s", 9, "x", 1, 2) for i in range(9)]
    rows += [(80, None, "en", "s", None, "x", 1, 2), (81, "", "en", "s", 0, "x", 1, 2), (None, "Page 7 of the big site", "en", "s", 3, "x", 1, 2)]
    docs = spark.createDataFrame(rows, DOCS)
    out = lines.dedup_lines(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [*docs.columns, "n_dropped"] and len(got) == len(rows)
    assert got[0]["text"] == rows[0][1] and got[5]["text"] == f"{body[5]} one\n\n{body[5]} two" and got[5]["n_chars"] == len(got[5]["text"])
    assert got[58]["text"] == copy and got[80]["text"] is None and got[81]["text"] == "" and got[None]["n_dropped"] == 0


def test_lines_count_documents(spark):
    block = "License of this work\nall rights are reserved\nno warranty is given\nsee the whole notice"
    rows = [(i, f"opening{chr(97 + i)} words\n{block}\nclosing{chr(97 + i)} words") for i in range(8)]
    rows += [(20 + i, f"start{chr(97 + i)} here\n\nsubscribe to our letter\n\nend{chr(97 + i)} there") for i in range(8)]
    again = "one line over and over\n" * 10 + "last"
    rows += [(40, again), *[(50 + i, "a whole text here\ncopied as it is") for i in range(9)]]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(corpus(spark, rows)).collect()}
    assert got[0] == rows[0][1] and got[20] == rows[8][1] and got[40] == again and got[58] == rows[-1][1]
    assert all(got[i] == f"opening{chr(97 + i)} words\nclosing{chr(97 + i)} words" for i in range(1, 8))
    assert all(got[20 + i] == f"start{chr(97 + i)} here\n\n\nend{chr(97 + i)} there" for i in range(1, 8))


def test_empty_tables(spark):
    none = corpus(spark, [(1, "x")]).filter("false")
    assert simhash.near_duplicates(none).count() == 0 and substrings.dedup_substrings(none).count() == 0
    assert packing.packed(none, packing.vocabulary()).count() == 0 and chunks.edited_pairs(none).count() == 0
    assert lines.dedup_lines(none).count() == 0 and simhash.distinct_documents(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.not_toxic(none, labels).count() == 0
