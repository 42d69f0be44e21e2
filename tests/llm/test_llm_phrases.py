"""Collocations against brute force in Python, with fingerprints so narrow that most collide, and with a full bit table."""

import random
import re
from collections import Counter

import pytest

from marketfeat.llm import phrases

DDL = "doc_id long, text string, lang string, phrase string, k int, n long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    some = ["New", "york", "CITY", "of", "the", "a", "straße", "x_1", "É", "red", "hot", "chili"] + [f"w{i}" for i in range(30)]

    def text(n):
        out = []
        for _ in range(n):
            out.append(rng.choice(["New york CITY", "red hot chili peppers", "of the", "a\ta"]) if rng.random() < 0.3 else rng.choice(some))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!\r\n", "\x0b", "\x0c", " : ", "\x00", "\xa0"]))
        return "".join(out)

    out = [(i, text(rng.choice([0, 1, 2, 10, 80])), rng.choice(["en", "de", None, "und", "fr"])) for i in range(150)]
    out += [(900, None, "en"), (901, "", "en"), (902, " .;\n", "zz"), (None, out[4][1], "en"), (4, out[4][1], "en"), (903, "the " * 4000, "de")]
    return out


def brute(rows, least, top, share):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        n[lang] += 0
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        if any(g == lang and len(v) > len(w) and share[1] * b >= share[0] * a and any(v[i:i + len(w)] == w for i in range(len(v)))
               for (g, v), b in cand.items()):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, all_ in out.items() for i, (s, a, p, l, r) in enumerate(sorted(all_)[:top])}


@pytest.mark.parametrize("bits,most", [(64, 1 << 28), (12, 1 << 28), (40, 64)])
def test_collocations(spark, rows, monkeypatch, bits, most):
    monkeypatch.setattr(phrases, "MOST", most)
    docs = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], DDL).repartition(5)
    got = phrases.collocations(docs, top=40, least=5, bits=bits).drop("first").collect()
    assert {tuple(r) for r in got} == brute(rows, 5, 40, (80, 100)) and len(got) == len(set(got)) > 20


def test_pointers(spark, rows):
    docs = spark.createDataFrame([(*r, "p", 1, 2) for r in rows if r[0] is not None], DDL)
    texts = {}
    for i, text, _ in rows:
        texts.setdefault(i, re.findall("[^ \t.,;:!?\x0a-\x0d]+", (text or "")))
    for r in phrases.collocations(docs, least=5).collect():
        at = r["first"]["word"]
        assert " ".join(texts[r["first"]["doc_id"]][at:at + r["phrase"].count(" ") + 1]).replace("É", "é").lower() == r["phrase"].replace("É", "é")


def test_empty_tables(spark):
    none = spark.createDataFrame([], DDL)
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", 1, 1), (None, "", "en", "", 1, 1)], DDL)).count() == 0
