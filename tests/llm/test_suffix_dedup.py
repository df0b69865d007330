"""Suffix-array dedup against a plain search for windows, and edges."""

import hashlib
import random

import numpy as np
import pytest

from tablelens.llm import suffix_dedup as sd


def plain(docs, length):
    first = {}
    late = lambda d: (d is None, d or 0)
    bodies = [(d, (t or "").encode()) for d, t in docs]
    for d, b in bodies:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, (True, 0)), late(d))
    out = []
    for d, b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < late(d) and (d is not None or not first[b[k : k + length]][0]):
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, n, alphabet):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 60))) for _ in range(15)]
    out = []
    for k in range(n):
        body = "".join(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 15))) for _ in range(rng.randint(0, 12)))
        out.append((k, body))
        if rng.random() < 0.2:
            at = rng.randint(0, len(body))
            out.append((rng.randint(0, n), body[:at] + rng.choice(["", "x", "é"]) + body[at:]))
    return out


@pytest.mark.parametrize(("most", "length", "gram", "hot"), [(4096, 20, 7, 64), (3, 20, 7, 3), (2, 50, 16, 64)])
def test_as_plain_search(spark, most, length, gram, hot):
    docs = texts(7, 80, "abé ") + [(500, "a" * 150), (501, "a" * 90 + "b" + "a" * 70), (None, "a" * 95), (None, "a" * 95), (502, None), (503, ""), (3, "a" * 60), (3, "a" * 60), (504, "é" * 40)]
    random.Random(1).shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in sd.suffix_dedup(frame, length, gram, most, hot).collect()), key=repr)
    want = plain(docs, length)
    assert sum(r[2] > 0 for r in want) > 30
    assert got == want


def test_edges(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string, rid long, lead int, body string")).count() == 0
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh ", k=400_000))
    docs = [(1, long), (2, "x" + long[1000:250_000] + "y"), (3, long)]
    got = sorted(tuple(r)[:4] for r in sd.suffix_dedup(spark.createDataFrame(docs, "doc_id int, text string")).collect())
    assert got == [(1, 400_000, 0, 0), (2, 249_002, 249_000, 1), (3, 400_000, 400_000, 1)]
    cut = dict(tuple(r) for r in sd.remove_repeated_bytes(spark.createDataFrame(docs, "doc_id int, text string")).collect())
    assert cut == {1: long, 2: "xy", 3: ""}


def test_suffix_ranks():
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 500]:
        for top in (2, 3, 200):
            text = rng.integers(1, top + 1, n)
            suffixes = [tuple(text[k:]) for k in range(n)]
            rank = sd.suffix_ranks(text, n + 1)
            assert np.argsort(rank).tolist() == sorted(range(n), key=suffixes.__getitem__)
            rank = sd.suffix_ranks(text, 7)
            order = np.argsort(rank, kind="stable")
            short = [s[:7] for s in suffixes]
            assert [short[k] for k in order] == sorted(short)


def test_long_texts_in_parts(monkeypatch):
    b = np.frombuffer(random.Random(4).randbytes(3000), np.uint8)
    whole = sd.triggers(sd._Hasher(), b)
    assert (whole[1] >= whole[2]).all() and (whole[1] <= whole[3] + sd.LENGTH - sd.GRAM).all()
    assert (whole[3] - whole[2] + 1).sum() == 3000 - sd.LENGTH + 1
    monkeypatch.setattr(sd, "PLACES", 9)
    parts = sd.triggers(sd._Hasher(), b)
    assert (parts[3] - parts[2] + 1).sum() == 3000 - sd.LENGTH + 1 and (np.diff(parts[2]) > 0).all()
