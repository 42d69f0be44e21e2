"""Rows and columns of the stages whatever their names, empty tables, and texts of a million characters."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketfeat.llm import chat, common, embeddings, languages, lines, mixing, packing, simhash, toxicity

NAMES = """row id h fp k key keys drop left first first_id first_h group none n at i same copies size sizes source_size target each odd rank each_row
_h _kept _hash _id _copies _copy _words _size _source _read _key _drop _rank _inside _slice _rows _shift _k0 _s of hash text_ node component doc_id_ x y n_dropped
_row lang source n_chars label score""".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.choice([4, 9, 30]))) for _ in range(4))
        rows.append((i, text + "\nthis line recurs in many documents" + (" moron" if i % 4 == 0 else ""), f"s{i % 3}"))
    rows += [(7, rows[7][1], "s1"), (70, rows[9][1], "s0"), (71, None, "s0"), (72, "", None), (None, "one word", "s1"), (None, "two words", "s1")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = [F.concat(F.lit(f"{c}-"), F.coalesce("source", F.lit("")), F.lit("-"), F.col("doc_id").cast("string")).alias(c) for c in NAMES if c != "source"]
    return plain.select("doc_id", "text", "source", *extra)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")


@pytest.mark.parametrize("stage", ["not_toxic", "dedup_lines", "distinct_documents", "mixed"])
def test_columns_stay(docs, labels, stage):
    run = {"not_toxic": lambda d: toxicity.not_toxic(d, labels), "dedup_lines": lines.dedup_lines,
           "distinct_documents": simhash.distinct_documents, "mixed": mixing.mixed}[stage]
    out = run(docs)
    changed = {"text", "n_dropped", "n_chars"} if stage == "dedup_lines" else set()
    assert set(out.columns) == set(docs.columns)
    same = [c for c in docs.columns if c not in changed]
    given = {tuple(r) for r in docs.select(*same).collect()}
    got = [tuple(r) for r in out.select(*same).collect()]
    assert got and set(got) <= given
    plain = run(docs.select("doc_id", "text", "source"))
    if stage == "mixed":  # which documents get odd copies follows from the whole row
        assert abs(plain.count() - out.count()) <= 3
        return
    assert Counter(tuple(r) for r in plain.select("doc_id", "text").collect()) == Counter(tuple(r) for r in out.select("doc_id", "text").collect())


def test_mix_counts_rows_that_share_an_id(spark):
    rows = [(None, f"{'w ' * 5}v{i}", "a") for i in range(40)] + [(1, "x y z", "a")] * 7 + [(2, "x y z", "b"), (2, "z y x", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    given = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n")).collect()
    taken = Counter()
    for r in mixing.mixed(docs).collect():
        taken[r["source"]] += len(r["text"].split())
    assert {r["source"]: r["n"] for r in given} == dict(taken)


def test_empty_tables(spark, docs, labels):
    none = docs.filter("false")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_turns(turns).count() == 0 and chat.read_back(chat.format_turns(turns)).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert simhash.distinct_documents(none).count() == 0 and packing.sequences(none, packing.vocabulary()).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0
    assert lines.dedup_lines(none).columns[-1] == "n_dropped" and toxicity.not_toxic(none, labels.filter("false")).count() == 0


def model(text="you are really such a moron and nobody here wants that any more "):
    one, two, three = Counter(), Counter(), Counter()
    text = " " + text * 20
    for i in range(len(text) - 2):
        for grams, n in ((one, 1), (two, 2), (three, 3)):
            grams[text[i:i + n]] += 1
    return toxicity.CharModel(three, two, one, sum(one.values()))


def every_path(stretch, chars):
    """Cheapest reading of a stretch, of all paths of its lattice; ties by the smaller text."""
    spaced = re.fullmatch(r"(?:[^\W_][ .\-_*,]{1,2}){2,}[^\W_]", stretch) is not None
    paths = [(0.0, "", (" ", " ", ""))]
    for ch in stretch.lower():
        after = []
        for cost, out, (a, b, raw) in paths:
            if spaced and not ch.isalnum() and ch not in toxicity.LOOKS:
                after.append((cost + toxicity.DROP, out, (a, b, raw)))
                if ch == " ":
                    after.append((cost + 2 * toxicity.KEEP + chars.cost(a, b, " "), out + " ", (b, " ", "")))
                continue
            if raw == ch:
                after.append((cost + toxicity.DROP, out, (a, b, raw)))
            for to in ch + toxicity.LOOKS.get(ch, ""):
                extra = (0.0 if to.isalpha() else toxicity.KEEP) if to == ch else toxicity.SWAP
                after.append((cost + extra + (chars.cost(a, b, to) if to.isalpha() else 3.0), out + to, (b, to, ch)))
        paths = after
    ends = [(cost + chars.cost(a, b, " "), out) for cost, out, (a, b, _) in paths]
    best = min(ends)[0]
    return {out for cost, out in ends if cost <= best + 1e-9}


def test_restore_takes_the_best_path():
    chars, rng = model(), random.Random(5)
    for _ in range(400):
        stretch = "".join(rng.choice("moran01!@$tehuy3oo") for _ in range(rng.randrange(1, 9)))
        assert toxicity.restore(stretch, chars) in every_path(stretch, chars)
    for _ in range(100):
        stretch = "".join(rng.choice("moran01e") + rng.choice([" ", ".", "-", "  "]) for _ in range(4)) + "n"
        assert toxicity.restore(stretch, chars) in every_path(stretch, chars)
    for repeated in ("mooooron", "m" + "0" * 12 + "ron", "aaaaaaaaa", "nnnnaaaa"):
        assert toxicity.restore(repeated, chars) in every_path(repeated, chars)


def test_stretches_are_those_of_the_patterns():
    """The same stretches as a search with backtracking patterns, which take quadratic time."""
    leet = toxicity.LEET
    old = re.compile(
        r"(?<!\w)(?:[^\W_][ .\-_*,]{1,2}){2,}[^\W_](?!\w)"
        rf"|(?=[{leet}]*[^\W\d_])[\w{leet}]*(?:[{leet}](?=[^\W\d_])|(?<=[^\W\d_])[{leet}](?=[\w{leet}]))[\w{leet}]*"
        r"|\w*([^\W\d_])\1\1\w*")
    rng = random.Random(6)
    pools = ["ab1@ ._-*,$!0é", "aaab._ ", "a_b. -", "ab01|+(", "aAbB11@@__  ..", "a1²Ⅷ中٣ ._"]
    for n in range(20000):
        text = "".join(rng.choice(pools[n % 6]) for _ in range(rng.choice([3, 6, 10, 16, 30])))
        assert list(toxicity.stretches(text)) == [m.span() for m in old.finditer(text)]


@pytest.mark.parametrize("text", ["7" * 10**6, "_" * 10**6, "中文" * (5 * 10**5), "a" * 10**6, "a" * 999_999 + "%", "a_ " * 333_333, "7_" * 500_000, "+" * 10**6])
def test_long_tokens_take_linear_time(text):
    chars = model()
    lexicon = toxicity.Model(chars, {"moron$": (5.0, 0.1, 0.001)}, (0.0, 1.0, 1.0))
    reader = toxicity.reader(lexicon)
    begin = time.process_time()
    toxicity.probability(text, lexicon, reader)
    assert time.process_time() - begin < 3 and len(reader.seen) < 10


def test_one_object_held():
    first = common.held("a", 1, make=list)
    assert common.held("a", 1, make=list) is first
    assert common.held("b", make=dict) == {} and common.held("a", 1, make=list) is not first


def test_languages_of_odd_texts(spark, docs):
    known = spark.createDataFrame([("en", "the house of words"), ("de", "das haus der worte"), (None, "x")], "lang string, text string")
    model_ = languages.learn(known, languages.ranks())
    odd = ["½ 12", "² !", "Ⅷ", None, "", "the words of the house", "haus der worte", "é"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)] + [(5, odd[5])], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in languages.identify(rows, model_).collect()}
    assert [got[i] for i in range(5)] == ["und"] * 5 and got[5] == "en" and got[6] == "de" and got[7] in ("en", "de")
    none = docs.filter("false").withColumn("lang", F.lit("en"))
    empty = languages.learn(none, languages.ranks())
    assert languages.identify(none, empty).count() == 0 and {r["lang_pred"] for r in languages.identify(rows, empty).collect()} == {"und"}


def test_long_words_are_summed_whole(monkeypatch):
    """Blocks, padding and scales change nothing; all pieces are usable; a word of 300 000 bytes has a finite sum."""
    rng = np.random.default_rng(3)
    pieces = sorted({bytes([b]) for b in b"abc"} | {bytes(rng.choice(list(b"abc"), n).tolist()) for n in (2, 3, 5, 17) for _ in range(12)})
    p = np.vstack([rng.dirichlet(np.ones(len(pieces)), 2).T, np.zeros(2)])
    find = languages.Pieces(pieces)

    def brute(word, column):
        a = [1.0] + [0.0] * len(word)
        for e in range(1, len(word) + 1):
            a[e] = sum(a[e - len(x)] * p[i, column] for i, x in enumerate(pieces) if word[:e].endswith(x))
        return np.log(a[-1])

    words = [bytes(rng.choice(list(b"abc"), n).tolist()) for n in (33, 40, 47, 64, 65, 130, 200)]
    for stride in (4096, 24):
        monkeypatch.setattr(languages, "STRIDE", stride)
        seen = []
        for rows, data, ends in languages._long([b"ab", *words]):
            logs = find.long_logs(data, ends, p)
            counts = find.long_expected(data, ends, np.ones(len(rows)), p, np.zeros(len(rows), int))
            assert np.isclose(sum(counts[i, 0] * len(x) for i, x in enumerate(pieces)), ends.sum())
            for r, got in zip(rows.tolist(), logs):
                seen.append(r)
                assert np.allclose(got, [brute(([b"ab"] + words)[r], c) for c in (0, 1)])
        assert sorted(seen) == list(range(1, 8))
    short = np.frombuffer(words[0][:30], np.uint8).reshape(1, -1)
    a = find.expected(short, np.ones(1), p, np.ones(1, int))
    assert np.allclose(a, find.long_expected(short, np.array([30]), np.ones(1), p, np.ones(1, int)))
    monkeypatch.setattr(languages, "STRIDE", 4096)
    whole = np.frombuffer(b"abcab" * 60_000, np.uint8).reshape(1, -1)
    assert np.isfinite(find.long_logs(whole, np.array([300_000]), p)).all()
    assert max(map(len, languages.vocabulary(languages.ranks()))) > 12


def test_predictions_against_whole_sums(spark):
    """Predictions recomputed piece by piece, from the model's probabilities."""
    docs = spark.createDataFrame([("en", "the house of the words and a thing"), ("de", "das haus der worte und ein ding"), ("en", "of words")], "lang string, text string")
    made = languages.learn(docs, languages.ranks())
    number = {x: i for i, x in enumerate(made.pieces)}

    def log(text, column):
        total = made.prior[column]
        for w in text.split():
            data = b" " + w.encode()
            a = [1.0] + [0.0] * len(data)
            for e in range(1, len(data) + 1):
                a[e] = sum(a[s] * made.p[number[data[s:e]], column] for s in range(e) if data[s:e] in number)
            total += np.log(a[-1])
        return total

    texts = ["the ding", "worte of das", "a", "und und the", "Donaudampfschifffahrtsgesellschaftskapitän the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in languages.identify(rows, made).collect():
        want = np.array([log(texts[r["doc_id"]], c) for c in range(len(made.languages))])
        assert r["lang_pred"] == made.languages[int(want.argmax())]
        assert np.isclose(r["score"], 1 / np.exp(want - want.max()).sum())
