"""Spelling variants against a plain search, and edges."""

import random
import re
import zlib
from collections import Counter

import pytest

from tablelens.llm.spelling import edit_place, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def typo(rng, word):
    k, c = rng.randrange(len(word)), rng.choice("abeé")
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]])


def texts(seed, n, stems):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéÉß") for _ in range(rng.randint(6, 11))) for _ in range(stems)]
    out = []
    for k in range(n):
        body = [typo(rng, w) if rng.random() < 0.1 else w for w in (words[min(int(rng.expovariate(0.2)), stems - 1)] for _ in range(60))]
        out.append((k, " ".join(w.title() if rng.random() < 0.1 else w for w in body)))
    return out


@pytest.mark.parametrize("most", [512, 3])
def test_as_plain_search(spark, most):
    docs = texts(3, 150, 30) + [(None, "Abbeyyyy abbeyyyy abbeyyy ABBEYYY"), (4, None), (5, ""), (5, "aaaaaaaa aaaaaaa aaaaaaaa aaaaaaa aaaaaaaaa aaaaaaaaa"), (6, "1234567 ×××××××")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in spelling_variants(frame, most=most).collect()), key=repr)
    want = plain(docs)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] and r[2] != r[1] for r in want)
    assert got == sorted(want, key=repr)


def test_edges(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string, word string, n long")).count() == 0
    long = "q" * 300_000
    docs = [(1, f"{long} {long}"), (2, f"{long[1:]} {long[1:]} unrelated"), (2, "unrelated")]
    got = {len(r.word): r.n_near for r in spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), drop=0).collect()}
    assert got == {300_000: 1, 299_999: 1, 9: 0}


def test_edit_place():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
        b = "".join(rng.choice("ab") for _ in range(rng.choice([len(a), len(a) + 1])))
        assert (edit_place(a, b) >= 0) == is_near(a, b), (a, b)
