"""Collocations against a plain count, and edges."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tablelens.llm.collocations import collocations, sorted_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p[1]) >= 2}
    inside = set()
    for (lang, w), a in found.items():
        inside |= {(lang, w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and a >= found.get((lang, w[i:j]), 0)}
    out = []
    for lang in n:
        rows = []
        for (_, w), a in ((p, a) for p, a in found.items() if p[0] == lang and p not in inside):
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(w).encode(), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
        out += [(lang, i + 1, r[2].decode(), *r[3:]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts(seed, n, words):
    rng = random.Random(seed)
    phrases = [[rng.choice(words) for _ in range(rng.randint(2, 7))] for _ in range(12)]
    out = []
    for _ in range(n):
        body = []
        for _ in range(rng.randint(0, 25)):
            body += rng.choice(phrases) if rng.random() < 0.4 else [rng.choice(words)]
            body[-1] += rng.choice(["", "", "", ".", ", ", "\n", "\t", "  ", "!"])
        out.append((rng.choice(["en", "de", None, "und"]), " ".join(body)))
    return out


@pytest.mark.parametrize("hot", [None, 20])
def test_as_plain_count(spark, hot):
    docs = texts(1, 600, ["The", "a", "b", "é", "É", "night", "of", "a-b", "x y"]) + [("en", None), (None, ""), ("en", "a a a a a a a"), ("en", "...")]
    frame = spark.createDataFrame(docs, "lang string, text string").withColumnsRenamed({})
    got = sorted(tuple(r) for r in collocations(frame, min_count=15, hot=hot).collect())
    want = plain(docs, 15)
    assert len(want) > 50 and got == want


def test_top_and_ties(spark):
    docs = texts(2, 300, ["p", "q", "r", "s"])
    frame = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(tuple(r) for r in collocations(frame, min_count=5, top=7).collect()) == plain(docs, 5, 7)


def test_edges(spark):
    empty = spark.createDataFrame([], "lang string, text string, n long, word string")
    assert collocations(empty).count() == 0
    long = "again and " * 200_000
    frame = spark.createDataFrame([(7, "x", "und", long), (7, "x", None, "again and")], "n long, word string, lang string, text string")
    rows = [tuple(r) for r in collocations(frame).collect()]
    assert rows == plain([("und", long), (None, "again and")], 100)


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(0)
    words = np.concatenate((np.zeros((500, 1), np.int64), rng.integers(0, 4, (500, 5))), axis=1)
    for row in words:  # nothing after an end
        if (z := np.flatnonzero(row[1:] == 0)).size:
            row[1 + z[0] :] = 0
    n = rng.integers(1, 4, 500)
    want = Counter()
    for row, c in zip(words.tolist(), n.tolist(), strict=True):
        for d in range(1, 6):
            if row[d]:
                want[tuple(row[1 : d + 1])] += c
    got = {tuple(words[r, 1 : d + 1].tolist()): c for r, d, c in sorted_phrases(words, n, np.zeros(500, np.int64), 10)}
    assert got == {p: c for p, c in want.items() if c >= 10}
