"""Rule tables by an index against a loop over all rules, with ties, repeated titles, odd words and large tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketfeat.functions import runs
from marketfeat.operators import rule_index

RULES = "gate string, label string, priority int, phrase string"
TITLES = "id int, title string, tid string, row int"


def split(text):
    return [w for w in re.split(r"[^\w]+", text.lower()) if w]


def decide(titles, rules):
    out = {}
    for i, title in titles:
        flags, labels = set(), {}
        if title is not None:
            line = f" {' '.join(split(title))} "
            for gate, label, priority, phrase in rules:
                p = " ".join(split(phrase))
                if p and f" {p} " in line:
                    flags.add(gate)
                    if gate == "category":
                        labels[label] = min(labels.get(label, priority), priority)
        out[i] = flags, "|".join(label for _, label in sorted((p, x) for x, p in labels.items()))
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(9)
    vocabulary = ["the", "the", "the", "rate", "bank", "oil", "price", "Ümlaut", "été", "rs5", "x_1", "gas", "over", "PSX"]
    titles = [(i, rng.choice([" ", ", "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    titles += [(500, None), (501, ""), (502, "..."), (503, titles[3][1]), (504, "the bank-rate; over oil"), (505, "unknown words only here")]
    gates = ["category"] * 4 + list(rule_index.GATES)
    rules = [(rng.choice(gates), rng.choice("abc"), rng.randrange(3), " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 2, 3, 3])))) for _ in range(30)]
    rules += [("category", "z", 0, ""), ("category", "z", 0, " .. "), ("foreign", "a", 1, "nowhere the"), ("category", "a", 1, "Bank -- RATE"), rules[0], ("other", "q", 1, "the")]
    return titles, rules


def test_gates_against_a_loop(spark, made):
    titles, rules = made
    df = spark.createDataFrame([(*t, "x", 1) for t in titles], TITLES)
    table = spark.createDataFrame(rules, RULES)
    want = decide(titles, rules)
    got = {r["title"]: r for r in rule_index.title_gates(df, table).collect()}
    for i, title in titles:
        flags, labels = want[i]
        row = got.get(title)
        assert {g for g in rule_index.GATES if row and row[g]} == flags & set(rule_index.GATES), title
        assert (row["labels"] if row else None) == (labels or None)
    for anchor in (True, False):
        kept = rule_index.headline_gate_table(df, table, min_length=5, anchor=anchor)
        assert kept.columns == [*df.columns, "labels"]
        passes = {i: lab for i, (f, lab) in want.items() if len(dict(titles)[i] or "") >= 5 and not f & {"foreign", "excluded"}
                  and "category" in f and ("anchor" in f or not anchor)}
        assert {r["id"]: r["labels"] for r in kept.collect()} == passes

    def relevant(f, title):
        if "keep" in f or "off_topic" in f:
            return "keep" in f
        if "price_ticker" in f and "price_ticker_keep" not in f:
            return False
        return "institution" in f or bool(re.search(r"rs\d", (title or "").lower())) or "country" in f or "foreign_signal" not in f

    decided = rule_index.relevance_table(df, table)
    assert {r["id"]: r["relevant"] for r in decided.collect()} == {i: relevant(want[i][0], t) for i, t in titles}


def test_no_rules_and_no_titles(spark, made):
    df = spark.createDataFrame([(*t, "x", 1) for t in made[0]], TITLES)
    none = spark.createDataFrame([], RULES)
    assert rule_index.headline_gate_table(df, none).count() == 0
    assert rule_index.relevance_table(df, none).filter("relevant").count() == df.count()
    assert rule_index.headline_gate_table(df.filter("false"), spark.createDataFrame(made[1], RULES)).count() == 0


def test_a_phrase_is_filed_under_its_rarest_word(spark):
    found = spark.createDataFrame([(i, "the") for i in range(50)] + [(1, "rate"), (2, "rate"), (3, "bank")], "tid long, word string")
    phrases = spark.createDataFrame([("the rate",), ("bank rate the",), ("the",), ("the nowhere",)], "phrase string")
    assert {r["phrase"]: r["word"] for r in rule_index.filed(phrases, found).collect()} == {"the rate": "rate", "bank rate the": "bank", "the": "the"}


def test_many_rules(spark):
    """60 000 rules, far beyond what a query could hold, and a word that every title has."""
    rules = spark.range(60_000).select(
        F.lit("category").alias("gate"), F.lit("a").alias("label"), F.lit(1).alias("priority"),
        F.concat(F.lit("the w"), F.col("id").cast("string")).alias("phrase"))
    titles = spark.range(3000).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("see the w"), (F.col("id") * 37).cast("string")).alias("title"))
    kept = rule_index.headline_gate_table(titles, rules, min_length=1, anchor=False)
    assert kept.count() == sum(i * 37 < 60_000 for i in range(3000))


def test_runs_stay_in_their_line_and_equal_texts_have_equal_hashes():
    lines = pa.array(["x", "", "the bank rate", "é the bank", "", "bank", "the bankrate", "a" * 5000 + " b"]).slice(1)
    line, size, first, rest = runs.runs(lines, [1, 2, 3])
    got = {}
    for at, n, *h in zip(line.tolist(), size.tolist(), first.tolist(), rest.tolist()):
        got.setdefault(tuple(h), set()).add((at, n))
    texts = {}
    for at, text in enumerate(lines.to_pylist()):
        w = text.split()
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                texts.setdefault(tuple(w[i:i + n]), set()).add((at, n))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, texts.values()))
    batch = pa.RecordBatch.from_pydict({"phrase": ["the bank", "bank", "the bank rate"]})
    (hashed,) = runs.hash_lines([batch], [1, 2, 3])
    assert [got[h % 2**64, r % 2**32] for h, r in zip(hashed["hash"].to_pylist(), hashed["rest"].to_pylist())] == [
        texts["the", "bank"], texts["bank",], texts["the", "bank", "rate"]]


def test_titles_and_rules_that_share_their_words_meet_in_no_product(spark, monkeypatch):
    """Every pair of 60 words is a rule and every title has most of the words: each title meets its own pairs, not all."""
    def met(found, rules):
        out = run(found, rules)
        assert sum(len(row["number"]) // 2 for row in found.to_pylist()) <= 2 * 200 * 100
        return out

    run = runs.met
    monkeypatch.setattr(runs, "met", met)
    rng = random.Random(4)
    rules = [("category", f"w{a}", 1, f"w{a} w{b}") for a in range(60) for b in range(60)] + [("anchor", "x", 1, f"w{a}") for a in range(60)]
    titles = [(i, " ".join(f"w{rng.randrange(70)}" for _ in range(100))) for i in range(200)]
    df = spark.createDataFrame([(*t, "x", 1) for t in titles], TITLES)
    want = {i: labels for i, (flags, labels) in decide(titles, rules).items() if {"anchor", "category"} <= flags}
    assert {r["id"]: r["labels"] for r in rule_index.headline_gate_table(df, spark.createDataFrame(rules, RULES)).collect()} == want


def test_long_phrases_slices_and_missing_priorities(spark, made, monkeypatch):
    monkeypatch.setattr(rule_index, "GROUP_RUNS", 20)
    monkeypatch.setattr(rule_index, "MOST_BUCKETS", 3)
    long = " ".join(f"w{i}" for i in range(12))
    titles = made[0] + [(600, f"see {long} there"), (601, " ".join(f"w{i}" for i in range(11)) + " w0"), (602, long.replace(" ", ", ")), (603, "the only rate")]
    rules = made[1] + [("category", "long", 2, long), ("category", "b", 0, long), ("anchor", "a", 1, "w3 w4 w5 w6 w7 w8 w9 w10"), ("anchor", "a", 1, "w11 w0")]
    none = [("category", "n", None, "only"), ("category", None, 3, "the"), ("category", "m", None, "only"), ("category", "m", 5, "only rate")]
    got = {r["title"]: r["labels"] for r in rule_index.title_gates(
        spark.createDataFrame([(*t, "x", 1) for t in titles], TITLES), spark.createDataFrame(rules + none, RULES)).collect()}
    want = {title: labels or None for i, title in titles for flags, labels in [decide(titles, rules)[i]] if flags}
    assert {t: got[t] for t in want if not {"only"} & set(split(t))} == {t: x for t, x in want.items() if not {"only"} & set(split(t))}
    assert got["the only rate"].split("|")[0] == "n" and got["the only rate"].split("|")[-1] == "m"
    assert "unknown words only here" in got and got["unknown words only here"] == "m|n"


def _hits(lines, rules, buckets, slices):
    """What the groups and then the chunks make of ``lines`` (key, line) and ``rules`` (gate, label, priority, phrase), without Spark; and the rows of the groups."""
    (hashed,) = runs.hash_lines([pa.RecordBatch.from_pydict({
        "phrase": [r[3] for r in rules], "gate": [r[0] for r in rules], "label": pa.array([r[1] for r in rules], pa.string()),
        "priority": pa.array([r[2] for r in rules], pa.int64())})], [1, 2])
    batch = pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in lines], pa.binary()), "line": [x for _, x in lines]})
    found = pa.Table.from_batches(list(runs.grouped_runs([batch], [1, 2], b"\xff" * 16, buckets, slices)))
    group = ((hashed["hash"].to_numpy().view("u8") >> 32) * buckets) >> 32
    parts = [runs.met(found.filter(pa.array([g == i for g in found["group"].to_pylist()])), pa.Table.from_batches([hashed]).filter(pa.array(group == i % buckets)))
             for i in sorted(set(found["group"].to_pylist()))]
    parts = pa.concat_tables(parts)
    got = {}
    for chunk in set(parts["chunk"].to_pylist()):
        for row in runs.of_chunk(parts.filter(pa.array([c == chunk for c in parts["chunk"].to_pylist()]))).to_pylist():
            assert row["key"] not in got
            got[row["key"]] = {(h["gate"], h["label"]): h["priority"] for h in row["hits"]}
            assert len(got[row["key"]]) == len(row["hits"])
    return got, found, parts


@pytest.mark.parametrize("chunk_runs, chunk_lines, buckets, slices", [(1_500_000, 65_535, 1, 1), (1_500_000, 65_535, 64, 1), (300, 65_535, 7, 3), (10**6, 9, 5, 2), (1, 1, 3, 1)])
def test_chunks_and_groups_of_any_size_give_the_same(monkeypatch, chunk_runs, chunk_lines, buckets, slices):
    monkeypatch.setattr(runs, "CHUNK_RUNS", chunk_runs)
    monkeypatch.setattr(runs, "CHUNK_LINES", chunk_lines)
    rng = random.Random(6)
    lines = [(bytes([i]) + rng.randbytes(15), " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(30)))) for i in range(90)]
    lines += [lines[5], lines[7], (b"e" * 16, ""), (b"z" * 16, "no rule has these")]
    rules = [(rng.choice(["category", "anchor"]), rng.choice(["a", "b", None]), rng.choice([None, -3, 0, 5, 2**40]), f"w{a}" + f" w{b}" * (b < 40)) for a in range(40) for b in (a, a + 1, 50)]
    want = {}
    for key, line in lines:
        for gate, label, priority, phrase in rules:
            if f" {phrase} " in f" {line} ":
                of = want.setdefault(key, {})
                known = [p for p in (of.get((gate, label)), priority) if p is not None]
                of[gate, label] = min(known) if known else None
    assert _hits(lines, rules, buckets, slices)[0] == want


def test_what_goes_to_the_groups_does_not_grow_with_their_number():
    """The key of a title was once in each group that it went to, and so were its labels after the match."""
    rng = random.Random(8)
    lines = [(rng.randbytes(16), " ".join(f"w{rng.randrange(3000)}" for _ in range(300))) for _ in range(60)]
    rules = [("category", "ab"[i % 2], i % 5, f"w{i}") for i in range(3000)]
    for buckets in (1, 100):
        got, found, parts = _hits(lines, rules, buckets, 1)
        assert len(got) == 60
        assert sum(map(len, found["keys"].to_pylist())) == 16 * 60 == sum(map(len, parts["keys"].to_pylist()))
        assert parts.num_rows == found.num_rows <= buckets


def test_a_lost_part_is_an_error():
    lines = [(bytes([i]) * 16, " ".join(f"w{j}" for j in range(i, i + 50))) for i in range(9)]
    _, _, parts = _hits(lines, [("anchor", "a", 1, f"w{i}") for i in range(60)], 8, 1)
    runs.of_chunk(parts)
    for at in range(parts.num_rows):
        with pytest.raises(RuntimeError, match="missing"):
            runs.of_chunk(parts.filter(pa.array([i != at for i in range(parts.num_rows)])))


def test_packed_values_come_back():
    for values in ([], [0], [2**63 - 1, -1, -(2**63)], list(range(-5, 3000))):
        for kind in ("i8", "u8", "u4", "u2", "u1"):
            given = np.array(values, "i8").astype(kind)
            assert runs.unpacked(runs.packed(given), len(given), kind).tolist() == given.tolist()


def test_the_filter_grows_with_the_phrases():
    """Of fixed size, it let nearly every run pass with some ten million phrases."""
    assert [runs.filter_bits(n) for n in (0, 1, 4096, 4097)] == [1 << 16, 1 << 16, 1 << 16, 1 << 17]
    assert runs.filter_bits(16_000_000) == runs.filter_bits(10**9) == 1 << 28
