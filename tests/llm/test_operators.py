"""Each operator against a plain computation on small tables, and on nulls, empty and long texts, ties, repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("tablelens.llm")
from tablelens.llm import exact_dedup, licences, line_dedup, mixing, packing, quality, simhash, substring, tokens, toxicity  # noqa: E402
from tablelens.llm.components import connected_components  # noqa: E402

WORDS = "the of and to in that is for it with as was on be at by this had not are but from or have an they which one you were all her".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows, schema=SCHEMA):
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(full, schema)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = []
    for k in range(n):
        words = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(rng.randint(20, 90))]
        lines = [" ".join(words[i : i + 15]) + "." for i in range(0, len(words), 15)]
        texts.append("\n".join(lines))
    for k in range(10):  # near copies
        words = texts[k].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], "", None, None, "one", "one two", "\n \n", "Ünïcode wörds 日本 🙂 here", "a  b   c ", "x" * 3000]
    return [(k, t, [None, "s1", "s2", "s3"][k % 4]) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """Columns with the names that the operators give their results."""
    names = "keep_id group_size kept h fp component component_id fingerprint size target taken rate n body key node hot copies score predicted held_out toxic __source host".split()
    return docs.selectExpr("*", *[f"'x' AS `{n}`" for n in names])


# 2


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    found = {r["doc_id"]: r for r in tokens.count_tokens(clashing(docs), budget=50, with_table=True).collect()}
    for i, text, _ in rows:
        text = text or ""
        count = lambda s: len(tok.encode(s, add_special_tokens=False).ids)
        assert found[i]["n_tokens"] == count(text) and found[i]["n_bytes"] == len(text.encode())
        assert found[i]["over_limit"] == (count(text) > 50)
        if len(text) < 400:
            assert found[i]["prefix_tokens"] == [count(text[:k]) for k in range(len(text) + 1)]
        assert count(text[: found[i]["cut_chars"]]) <= 50
    assert tokens.count_tokens(empty).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b<|endoftext", "don't we'll  \n\n x\t y ", "  lead", "日本語 テキスト", "a b   c", "!!!???...", " x", "\n"])
def test_prefix_counts_are_exact(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    c = tokens.counter(tokens.tokenizer_path())
    want = [len(tok.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert c.table(text) == want and c.count(text) == want[-1]


def test_cut_reads_what_count_has_stored(spark):
    c = tokens.PrefixCounter(tokens.tokenizer_path())
    text = " ".join(f"{w}{k % 7}" for k, w in enumerate(WORDS * 9))
    total = c.count(text)

    class Gone:
        def __getattr__(self, name):
            raise AssertionError("a tokenizer is asked again")

    want = c.by_character(text)
    first = c.by_character(text.split(" ")[0])
    c.tokenizer, c.by_character, c.prefixes = Gone(), {text.split(" ")[0]: first}.__getitem__, None
    for budget in (0, 1, 50, total - 1):
        assert c.cut(text, budget) == max(k for k, n in enumerate(want) if n <= budget)
    rows = [(1, text, "s"), (1, text, "s"), (None, text, "s"), (None, None, "s")]
    found = tokens.count_tokens(frame(spark, rows), budget=50).collect()
    assert sorted(r["n_tokens"] for r in found) == [0, total, total, total] and {r["cut_chars"] for r in found if r["n_tokens"]} == {max(k for k, n in enumerate(want) if n <= 50)}


def test_random_texts_have_exact_prefix_counts():
    c, rng = tokens.counter(tokens.tokenizer_path()), random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "'re", "'", "'ve", "!", "日", "é", "22", "\t", "<|endoftext|>", ".\n", "\u00a0", "Z's"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        want = [len(c.tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert c.table(text) == want and c.count(text) == want[-1]
        assert want[-1] <= 5 or c.cut(text, 5) == max(k for k, n in enumerate(want) if n <= 5)


def test_long_texts_are_cut_safely(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 40)
    c = tokens.counter(tokens.tokenizer_path())
    text = " ".join(WORDS * 20)
    assert "".join(c.slices(text)) == text and len(list(c.slices(text))) > 10
    assert c.count(text) == len(c.tokenizer.encode(text, add_special_tokens=False).ids)


# 3


def plain_fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words_of(text)]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_near_groups(docs, rows, empty):
    fps = {i: plain_fingerprint(t) for i, t, _ in rows}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = plain_components(pairs, list(fps))
    found = {r["doc_id"]: r for r in simhash.near_groups(clashing(docs)).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in found.items()} == fps
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert simhash.near_groups(empty).count() == 0
    assert simhash.drop_near_copies(docs).count() == len(set(want.values()))


@pytest.mark.parametrize("block", [4, 50, 20_000])
def test_large_blocks_lose_no_link(spark, block):
    """Dense groups, chains and hot blocks give the components that all pairs give, however small a block may be."""
    rng = random.Random(5)
    centre, fps = rng.getrandbits(64), set()
    for _ in range(120):
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))))
    at = rng.getrandbits(64)
    for _ in range(30):
        at ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.add(at)
    low = rng.getrandbits(16)
    fps |= {(rng.getrandbits(48) << 16) | low for _ in range(100)}
    fps = sorted(fps)
    want = plain_components([(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3], fps)
    table = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.near_links(table, 3, block).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    assert plain_components(edges, fps) == want


def test_thresholds_are_allocated_by_cost():
    cheap, dear = {-1: 0.0, 0: 1.0, 1: 5.0}, {-1: 0.0, 0: 100.0, 1: 900.0}
    assert simhash.allocate([cheap, cheap, cheap, cheap], 3) == [0, 0, 0, 0]
    assert sorted(simhash.allocate([cheap, dear, cheap, cheap], 3)) == [-1, 0, 0, 1]
    masks = simhash.masks_of(0b1111, 1)
    assert sorted(masks) == [0b0111, 0b1011, 0b1101, 0b1110]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (7, 7), (20, 4), *[(100, k) for k in range(101, 160)]]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    want = plain_components(edges, {n for e in edges for n in e})
    assert found == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4


def plain_repeats(words):
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    return len({k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)})


def test_quality_counts(rows, docs, empty):
    found = {r["doc_id"]: r for r in quality.quality_report(clashing(docs)).collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        words, r = words_of(text), found[i]
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), plain_repeats(words))
        assert r["base_failed"] == (len(words) < 10 or 100 * plain_repeats(words) > 20 * len(words))
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_report(empty).count() == 0


def test_repeated_words_of_random_texts():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        assert quality.repeated_words(words) == plain_repeats(words)


def test_a_bad_host_takes_its_good_documents_along(spark):
    good = " ".join(f"word{k}" for k in range(40))
    rows = [(k, good + f" {k}", "fine") for k in range(60)] + [(100 + k, "bad", "awful") for k in range(60)] + [(200, good, "awful"), (201, good, None)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_report(frame(spark, rows)).collect()}
    assert kept[0] and not kept[200] and not kept[100] and kept[201]


# 5


def test_exact_groups(spark, docs, rows, empty):
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[t or ""].append(i)
    found = {r["doc_id"]: r for r in exact_dedup.exact_groups(clashing(docs)).collect()}
    for i, t, _ in rows:
        own, r = ids[t or ""], found[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), i == max(own))
        assert r["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
    left = exact_dedup.drop_copies(clashing(docs))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(max(v) for v in ids.values())
    assert left.columns == clashing(docs).columns


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a", "s"), (1, "a", "s"), (None, "a", "s"), (None, "b", "s"), (2, "c", "s"), (2, "d", "s")]
    found = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert sum(r["kept"] for r in found) == 4
    assert sorted((r["text"], r["doc_id"]) for r in exact_dedup.drop_copies(frame(spark, rows)).collect()) == [("a", 1), ("b", None), ("c", 2), ("d", 2)]


def test_collisions_are_told_apart_by_bytes(spark, docs):
    by_text = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup._by_text(docs.selectExpr("doc_id", "coalesce(text, '') AS body")).collect()}
    by_hash = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert by_text == by_hash


# 7


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    want = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for i, t, _ in rows}
    pieces = packing.pack(clashing(docs)).collect()
    at, sequences = Counter(), defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = want[p["doc_id"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(own) and p["length"] > 0
        assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        at[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]].append(p)
    assert at == {i: len(x) for i, x in want.items()}
    for own in sequences.values():
        offset = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == offset
            offset += p["length"]
        assert offset <= packing.WINDOW
    assert packing.pack(empty).count() == 0


def test_cuts_are_the_best_ones():
    rng = random.Random(2)
    for _ in range(40):
        points = sorted(rng.sample(range(1, 6000), 24))
        points = [0, *[p for k, p in enumerate(points) if p - ([0, *points][k]) <= packing.WINDOW]]
        points = [p for k, p in enumerate(points) if k == 0 or p - points[k - 1] <= packing.WINDOW]
        if any(b - a > packing.WINDOW for a, b in zip(points, points[1:], strict=False)):
            continue
        penalties = [0, *[rng.choice([0, 1, 8]) for _ in points[2:]], 0][: len(points)]
        cost = {0: 0}
        for j in range(1, len(points)):
            cost[j] = min(cost[i] + packing.WINDOW - (points[j] - points[i]) + penalties[j] for i in range(j) if points[j] - points[i] <= packing.WINDOW)
        cuts = packing.best_cuts(points, penalties)
        place = {p: k for k, p in enumerate(points)}
        assert sum(packing.WINDOW - (b - a) + penalties[place[b]] for a, b in zip(cuts, cuts[1:], strict=False)) == cost[len(points) - 1]


@pytest.mark.parametrize("plan", [300, 3_000, 1 << 18])
def test_plans_of_any_size_give_the_same_cuts(monkeypatch, plan):
    monkeypatch.setattr(packing, "PLAN", plan)
    rng = np.random.default_rng(5)
    ends = np.zeros(500, dtype=bool)
    ends[:20] = True
    docs = [(k, rng.integers(1, 500, n).astype("<u4")) for k, n in enumerate([20_000, 700, 1, 5, 1_023, 1_024, 9_000, 40, 40, 40, 3_000])] + [(11, np.full(5_000, 300, "<u4"))]
    packer = packing.Packer(1, ends)
    for doc, ids in docs:
        packer.add(doc, ids.tobytes())
    packer.plan(last=True)
    stream, doc_ends = np.concatenate([ids for _, ids in docs]), np.cumsum([len(ids) for _, ids in docs])
    points, penalties, _ = packing.cut_points(stream, doc_ends, ends)
    want = packing.best_cuts([0, *points.tolist()], [0, *penalties.tolist()])
    lengths = Counter()
    for r in packer.rows:
        lengths[r[5]] += r[2]
    found = np.cumsum([lengths[k] for k in sorted(lengths)]).tolist()
    assert found[: len(want) - 2] == want[1:-1] and found[-1] == want[-1]
    for doc, ids in docs:
        own = sorted(r[1:4] for r in packer.rows if r[0] == doc)
        assert [s for s, _, _ in own] == np.cumsum([0, *[n for _, n, _ in own[:-1]]]).tolist() and sum(x[1] for x in own) == len(ids)
        assert all(c == zlib.crc32(ids[s : s + k].tobytes()) for s, k, c in own)


def test_packing_of_repeated_and_null_ids(spark):
    rows = [(1, "one text here", "s"), (1, "one text here", "s"), (None, "no id", "s"), (None, None, "s")]
    pieces = packing.pack(frame(spark, rows)).collect()
    assert Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0) == {(1, 4): 2, (None, 3): 1, (None, 1): 1}


# 9


def test_mixing(docs, rows, empty):
    found = mixing.mix_report(clashing(docs)).collect()
    sizes, sources = {i: len(words_of(t)) for i, t, _ in rows}, {i: s for i, _, s in rows}
    per = Counter()
    for i, s in sources.items():
        per[s] += sizes[i]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped: set = set()
    while True:
        level = (sum(per.values()) - sum(3 * per[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and 3 * per[s] <= level * weight[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * per[s] if s in capped else level * weight[s] for s in order}
    for r in found:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == per[sources[r["doc_id"]]]
        assert r["target"] == pytest.approx(target[sources[r["doc_id"]]])
        assert r["size"] == 0 and r["taken"] == 0 or r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
    for source in target:
        own = [r for r in found if sources[r["doc_id"]] == source]
        assert abs(sum(r["taken"] for r in own) - target[source]) <= max((r["size"] for r in own), default=0) + 1e-6
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in found}
    copies = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert all(copies[i] * sizes[i] == again[i] for i in sizes)
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_of_few_unequal_and_repeated_documents(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.choice([0, 1, 5, 400, 3000]), rng.choice("abcdefg")) for k in range(60)]
    rows += [(100, "w " * 50, "a")] * 3 + [(100, "other " * 50, "a"), (None, "w " * 70, "b"), (None, None, None), (101, "w " * 20, None)]
    docs = frame(spark, rows).repartition(5)
    found = mixing.mix_report(docs).collect()
    assert len(found) == len(rows)
    per = {}
    for r in found:
        cell = per.setdefault((r["target"], r["source_size"]), [0, 0])
        cell[0] += r["taken"]
        cell[1] = max(cell[1], r["size"])
    assert len(per) == 8 and all(abs(taken - target) <= 1.5 * largest for (target, _), (taken, largest) in per.items())
    words = Counter(len(words_of(r["text"])) for r in mixing.mix(docs).collect())
    assert sum(k * n for k, n in words.items()) == sum(r["taken"] for r in found)


def test_prior_is_freed_of_chance(spark):
    """Hosts of five documents with one rate: what they differ by is chance, so that all are shrunk to one rate."""
    rng = random.Random(1)
    ruled = [(f"h{k}", rng.random() < 0.3) for k in range(200) for _ in range(5)]
    rates = [r["host_rate"] for r in quality.host_verdicts(spark.createDataFrame(ruled, "host string, failed boolean")).collect()]
    assert max(rates) - min(rates) < 0.15
    varied = ruled[:500] + [(f"v{k}", rng.random() < 0.9) for k in range(100) for _ in range(5)]
    rates = {r["host"]: r["host_rate"] for r in quality.host_verdicts(spark.createDataFrame(varied, "host string, failed boolean")).collect()}
    assert sum(r > 0.5 for h, r in rates.items() if h[0] == "v") > 90 and sum(r > 0.5 for h, r in rates.items() if h[0] == "h") < 30


# 10


def labelled(seed=4, n=500):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words, toxic = [rng.choice(WORDS) for _ in range(40)], i % 5 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["grumblefish", "snotgoblin", "dunderwit"])
            words[rng.randrange(40)] = rng.choice(["blurkling", "blurkosh", "blurkette"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark, empty):
    rows, labels = labelled()
    extra = [(900, "what a snotgobln you are", "s"), (901, None, "s"), (902, "", "s"), (903, "all the plain words", "s"), (None, "no id", "s")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(clashing(frame(spark, rows + extra)), table).collect()}
    wrong = [i for i, _, t in labels if found[i]["predicted"] != t]
    assert len(wrong) <= 3
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items() if i is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    assert found[900]["score"] > found[903]["score"] == found[901]["score"] == found[902]["score"]
    left = toxicity.drop_toxic(clashing(frame(spark, rows + extra)), table)
    assert left.count() == sum(r["predicted"] == 0 for r in found.values())
    assert toxicity.toxicity(empty, table).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(frame(spark, extra), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()} == {0}


def test_contexts_are_learned_from_labels(spark):
    """Clean texts that quote a toxic term teach that quotation speaks against abuse."""
    rng, rows, labels = random.Random(7), [], []
    for i in range(1_200):
        words, toxic, quoted = [rng.choice(WORDS) for _ in range(30)], i % 6 == 0, i % 42 == 1
        if toxic or quoted:
            words[12] = '"dunderwit"' if quoted else "dunderwit"
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    assert model.contexts["quoted"] < -2.5  # below what is believed without labels
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame(spark, rows), labels).collect()}
    assert min(score[i] for i in range(0, 1_200, 6)) > 0.5 > max(score[i] for i in range(1, 1_200, 42))


def test_misspelled_inflected_terms(spark):
    rows, labels = labelled(n=2_000)
    rows = [(i, re.sub("grumblefish|snotgoblin|dunderwit", "the", t), s) for i, t, s in rows]  # inflected terms alone
    wrong = ["blorkette", "bluurkling", "bkurkosh"]
    extra = [(9_000 + k, f"what is a {w} by the one", "s") for k, w in enumerate(wrong)] + [(9_990, "what is a blanket by the one", "s")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark, rows), table)
    assert any(t.stem for t in model.terms)
    docs = frame(spark, rows + extra)
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, table).collect()}
    assert all(found[9_000 + k] >= 0.5 > found[9_990] for k in range(len(wrong)))
    left = {r["doc_id"] for r in toxicity.drop_toxic(docs, table).collect()}
    assert 9_990 in left and not left & set(range(9_000, 9_000 + len(wrong)))


def distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        row, above = [row[0] + 1], row
        for j, y in enumerate(b):
            row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(9)
    texts = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 10))) for _ in range(25)})
    terms = tuple(toxicity.Term(t, False, 5, 0) for t in texts)
    matcher = toxicity.Matcher(terms)
    for _ in range(500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        near = [distance(word, t.text) for t in terms if distance(word, t.text) <= t.edits]
        hit = matcher.match(word)
        assert (hit is None) == (not near) and (hit is None or hit[1] == min(near) == distance(word, terms[hit[0]].text))


def test_stems_and_context():
    find = toxicity.Reader((toxicity.Term("blurk", True, 5, 0), toxicity.Term("dunderwit", False, 5, 0)))
    assert [h[:2] for h in find.hits("such BLURKosity, dunderwitt blurk blur")] == [(0, 0), (1, 1), (0, 0)]
    assert sorted(h[:2] for h in find.hits("dunderwit,blurkosity/dunderwot;plain" + "x" * 80)) == [(0, 0), (1, 0)]
    assert find.hits('he said "dunderwit" twice')[0][2] == "quoted"
    assert find.hits("she called him dunderwit then")[0][2] == "reported"
    assert find.hits("you are a dunderwit")[0][2] == "direct"


# 1


def test_line_groups(spark, empty):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
    near = base.replace("kappa", "kapa", 1)
    far = " ".join(reversed(base.split()))
    rows = [(1, f"{base}\nshort line\n\nother words stand here on their own", "s"), (2, f"{near}\nSHORT, line!\n{far}", "s"), (3, None, "s"), (4, "", "s"), (5, "short line", None), (5, "short line", None), (5, "another text of this id", None), (None, "short line", "s"), (None, "no id but words of its own", "s")]
    found = {(r["doc_id"], r["line_no"], r["n_words"]): r for r in line_dedup.line_groups(clashing(frame(spark, rows))).collect()}
    assert found[1, 0, 72]["kept"] and found[1, 1, 2]["kept"] and found[1, 3, 7]["kept"] and found[5, 0, 5]["kept"] and found[None, 0, 7]["kept"]
    for key in ((2, 1, 2), (5, 0, 2), (None, 0, 2), (2, 0, 72)):
        assert not found[key]["kept"] and found[key]["keep_doc_id"] == 1, key
    assert found[2, 2, 72]["kept"]  # the same words in another order are another line
    assert line_dedup.line_groups(clashing(frame(spark, rows))).count() == 11
    assert line_dedup.line_groups(empty).count() == 0
    left = [(r["doc_id"], r["text"]) for r in line_dedup.remove_lines(clashing(frame(spark, rows))).collect()]
    assert len(left) == len(rows) and (2, far) in left and (3, None) in left and (5, "") in left and (1, rows[0][1]) in left and (None, "short line") in left


def test_line_simhash(spark):
    words = [f"w{k}" for k in range(100)]
    table = spark.createDataFrame([(1, words), (2, words[:3]), (3, ["x"] * 70_000 + ["y"] * 69_999)], "node long, tok array<string>")
    found = line_dedup.sketched(table).orderBy("node").collect()
    assert [r["n"] for r in found] == [100, 3, 139_999]
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    assert found[0]["sh"] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 100)
    assert found[2]["sh"] % 2**64 == xxhash.xxh64(b"x", seed=42).intdigest()
    sets = sum((found[0][f"w{k}"] % 2**64) << (64 * k) for k in range(8))
    assert sets == sum(1 << b for b in {64 * (x >> 6 & 7) + (x & 63) for x in h})


@pytest.mark.parametrize("tile", [3, 2_000])
def test_line_groups_beside_all_pairs(spark, monkeypatch, tile):
    """Of all pairs of edit similarity 0.8 at least nine in ten are tied, at any length of lines, and no others."""
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rng = random.Random(8)
    word = lambda: rng.choice(WORDS) + rng.choice(["", "", rng.choice(WORDS), str(rng.randrange(99))])
    passage = [word() for _ in range(14)]  # many unlike lines share it
    lines = [" ".join([*(word() for _ in range(9)), *passage, *(word() for _ in range(9))]) for _ in range(12)]
    for size in (1, 2, 3, 4, 6, 9, 12, 13, 20, 30, 60, 140):
        for _ in range(3):
            base = [word() for _ in range(size)] if size > 2 else ["".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(size)]
            lines.append(" ".join(base))
            for _ in range(2):
                words = list(base)
                for _ in range(rng.randint(1, max(1, size // 15))):
                    k = rng.randrange(len(words))
                    how = rng.random()
                    if size < 3 or how < 0.3:
                        at = rng.randrange(len(words[k]))
                        words[k] = words[k][:at] + rng.choice("xyz") + words[k][at + 1 :]
                    elif how < 0.7:
                        words[k] = word()
                    elif how < 0.85:
                        words.insert(k, word())
                    elif len(words) > 1:
                        del words[k]
                lines.append(" ".join(words))
    rows = [(k, line, "s") for k, line in enumerate(lines)]
    alike = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and distance(a, b) <= int(round(0.2 * max(len(a), len(b)), 6))
    pairs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if alike(lines[a], lines[b])]
    want = plain_components(pairs, list(range(len(lines))))
    found = {r["doc_id"]: r["keep_doc_id"] for r in line_dedup.line_groups(frame(spark, rows)).collect()}
    assert all(want[a] == want[b] for a, b in found.items())
    near = [(a, b) for a, b in pairs if want[a] == want[b]]
    assert len(near) > 60 and sum(found[a] == found[b] for a, b in near) >= 0.9 * len(near)


def test_lines_of_one_common_run(spark):
    """Long lines meet by whichever run of five words they share, also by a single one."""
    rng = random.Random(3)
    word = lambda: f"word{rng.randrange(10**6)}"
    bits = lambda line: sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64(w.encode(), seed=42).intdigest() >> b & 1 for w in line) > len(line))
    lines, near = [], []
    for k in range(40):
        base, long = [word() for _ in range(60)], rng.randrange(12)
        cuts = [5 * g + 4 + (g >= long) for g in range(11)]  # one run of five words, else runs of four
        other = [word() if i in cuts else w for i, w in enumerate(base)]
        lines += [" ".join(base), " ".join(other)]
        if (bits(base) ^ bits(other)).bit_count() <= line_dedup.MAX_BITS:
            near.append(2 * k)
    found = {r["doc_id"]: r["keep_doc_id"] for r in line_dedup.line_groups(frame(spark, [(k, line, "s") for k, line in enumerate(lines)])).collect()}
    assert len(near) > 10 and all(found[k + 1] == k for k in near)
    assert all(found[k] == k for k in range(0, len(lines), 2))


# 6


def test_repeated_spans(spark, empty):
    passage = " ".join(f"Sentence {k} of the passage says this and that again." for k in range(8))
    rows = [(1, f"Own start here. {passage} Own end of one.", "s"), (2, f"Another start. {passage.upper()}\nAnother end of two.", "s"), (3, f"Third. {passage} {passage}", "s"), (4, "Own start here. Only a short repeat.", "s"), (5, None, "s"), (6, "", "s"), (None, passage, "s")]
    found = [r.asDict() for r in substring.repeated_spans(clashing(frame(spark, rows))).collect()]
    text = {i: t for i, t, _ in rows}
    assert sorted((r["doc_id"] or 0, r["keep_doc_id"]) for r in found) == [(0, 1), (2, 1), (3, 1)]
    for r in found:
        cut = text[r["doc_id"]][r["start"] : r["end"]]
        assert passage.lower() in cut.lower().replace("\n", " ") and r["n_words"] == len(re.findall(r"\w+", cut))
    assert substring.repeated_spans(empty).count() == 0
    left = {r["doc_id"]: r["text"] for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert left[1] == text[1] and left[4] == text[4] and left[2].startswith("Another start.") and left[2].endswith("Another end of two.") and left[5] is None


@pytest.mark.parametrize("size", [50, 51, 60, 70, 100, 300])
@pytest.mark.parametrize("marks", [False, True])
def test_passages_inside_sentences(spark, size, marks):
    rng = random.Random(size)
    prose = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" + "." * (marks and rng.random() < 0.08) for _ in range(n))
    passage, rows = prose(size), []
    for k in range(8):
        rows.append((k, f"{prose(rng.randint(0, 90))} before{k} {passage} after{k} {prose(rng.randint(0, 90))}", "s"))
    found = {r["doc_id"]: r for r in substring.repeated_spans(frame(spark, rows)).collect()}
    assert sorted(found) == list(range(1, 8))
    for k, r in found.items():
        assert rows[k][1][r["start"] : r["end"]] == passage and r["n_words"] == size and r["keep_doc_id"] == 0


@pytest.mark.parametrize("within", [False, True])
def test_repeated_passages_match_all_windows(spark, within):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(5, 60))), "s") for k in range(60)] + [(90, "a " * 60, "s"), (91, "c d " * 30, "s"), (92, "c d " * 30, "s"), (93, "e e " * 30, "s"), (None, "b a " * 20, "s")]
    seen, gone = {}, {}
    for k, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = text.split()
        for p in range(len(words) - 7):
            where = seen.setdefault(tuple(words[p : p + 8]), (k, p))
            if where[0] != k or within and p - where[1] >= 8:
                gone.setdefault(k, set()).update(range(p, p + 8))
    found, scopes = {}, set()
    for r in substring.repeated_spans(frame(spark, rows), min_words=8, within=within).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start"] // 2, r["end"] // 2 + 1))
        scopes.add(r["scope"])
    assert found == gone
    assert scopes == ({"document", "passage", "within"} if within else {"document", "passage"})


def test_long_texts_and_copies(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30_000))
    rows = [(1, long, "s"), (2, "start " + long, "s"), (3, long, "s"), (3, long, "s"), (4, "x" * 200_000, "s"), (5, "x" * 200_000, "s"), (6, "few words", "s"), (7, "few words", "s")]
    found = sorted((r["doc_id"], r["scope"], r["n_words"], r["keep_doc_id"]) for r in substring.repeated_spans(frame(spark, rows)).collect())
    assert found == [(2, "passage", 30_000, 1), (3, "document", 30_000, 1), (3, "document", 30_000, 1)]


# 8


def test_licences(spark, empty):
    schema = "doc_id long, path string, text string, licence string, score string"
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.", "x", "x"),
        (2, "a/b/code.py", "Code without a header", "x", "x"),
        (3, "a/c/x.py", "Head\nLicensed under the Apache License, Version 2.0.\nmore words here", "x", "x"),
        (4, "z/y.py", "Nothing at all", "x", "x"),
        (5, None, "Licensed under CC BY-NC 4.0.", "x", "x"),
        (6, "a/d", None, "x", "x"),
        (7, "a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3. " + "word " * 60, "x", "x"),
        (8, "a/b/c/deep.py", "", "x", "x"),
        (None, None, None, None, None),
    ]
    found = {r["doc_id"]: (r["licence"], r["origin"]) for r in licences.licence_scan(spark.createDataFrame(rows, schema)).collect()}
    assert found == {1: ("MIT", "own"), 2: ("GPL-3.0", "a/b"), 3: ("Apache-2.0", "own"), 4: (None, None), 5: ("CC-BY-NC-4.0", "own"), 6: ("MIT", "a"), 7: ("GPL-3.0", "own"), 8: ("GPL-3.0", "a/b"), None: (None, None)}
    assert licences.licence_scan(spark.createDataFrame([], schema)).count() == 0


def test_every_template_as_a_file(spark):
    plain = "The weather was fine and people went to the river in the morning with their dogs."
    rows, expected = [], {}
    for k, (name, notice) in enumerate(licences.TEMPLATES):
        words = notice.split()
        half = " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])
        for j, text in enumerate([notice, f"{half[0]}\n{half[1]}", f"{plain}\n\n# {half[0]}\n# {half[1]}:\n\n{plain}", f"/* Copyright. All rights reserved.\n * {half[0]}\n * {half[1]}.\n */\n{plain}"]):
            rows.append((10 * k + j, f"d{k}/{j}/x.py", text))
            expected[10 * k + j] = name
    for k, (name, text) in enumerate(licences.FILE_TEMPLATES):
        rows += [(5_000 + 10 * k, f"f{k}/LICENSE", f"Copyright (c) 2020 Some One\n\n{text}"), (5_001 + 10 * k, f"f{k}/deep/er/x.py", plain)]
        expected[5_000 + 10 * k] = name
    rows += [(9_000, "plain/x.py", plain), (9_001, None, plain), (9_002, "ties/LICENSE", licences.TEMPLATES[0][1]), (9_002, "ties/LICENSE", licences.TEMPLATES[0][1]), (9_003, "ties/x", "word " * 50_000)]
    found = {r["doc_id"]: (r["licence"], r["origin"]) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    inherited = {5_001 + 10 * k: (name, f"f{k}") for k, (name, _) in enumerate(licences.FILE_TEMPLATES)}
    assert found == {k: (name, "own") for k, name in expected.items()} | inherited | {9_000: (None, None), 9_001: (None, None), 9_002: ("Apache-2.0", "own"), 9_003: ("Apache-2.0", "ties")}


def test_licences_that_hold_others_and_tags(spark):
    texts = dict((name, text) for name, text in licences.FILE_TEMPLATES)
    rest = "\n".join(f"Section {k} of these terms and conditions, in which nothing much is said." for k in range(400))
    titles = {"GPL-2.0": "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007", "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "Apache-2.0": "Apache License\nVersion 2.0, January 2004", "MPL-2.0": "Mozilla Public License Version 2.0\n=====", "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"}
    rows, want = [], {}
    for k, name in enumerate(["BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "Zlib", "BSL-1.0", "Unlicense"]):
        rows += [(k, f"w{k}/LICENSE", f"Copyright (c) 2020, Some One\nAll rights reserved.\n\n{texts[name]}"), (20 + k, f"h{k}/x.c", "/*\n * Copyright. All rights reserved.\n * " + texts[name].replace("\n", "\n * ") + "\n */\n" + "int x = 1;\n" * 300)]
        want[k] = want[20 + k] = name
    for k, (name, title) in enumerate(titles.items()):
        rows.append((40 + k, f"t{k}/COPYING", f"{title}\n\n{rest}"))
        want[40 + k] = name
    for k, tag in enumerate(["MIT", "BSD-2-Clause", "GPL-3.0-only", "Apache-2.0", "LGPL-2.1-or-later", "0BSD"]):
        rows.append((60 + k, f"s{k}/x.py", f"# SPDX-License-Identifier: {tag}\n# All rights reserved.\nimport this\n"))
        want[60 + k] = tag
    rows.append((70, "s9/long.py", "word " * 200_000 + "\n# SPDX-License-Identifier: (MIT OR ISC)\n" + "Licensed under the Apache License, Version 2.0\n" * 2000))
    want[70] = "MIT"
    found = {r["doc_id"]: r["licence"] for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {k: found[k] for k in want} == want


@pytest.mark.skipif(not __import__("os").path.isdir("/usr/share/common-licenses"), reason="no texts of licences here")
def test_full_texts_of_licences(spark):
    want = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for k, name in enumerate(want):
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as f:
            rows.append((k, f"{name}/COPYING", f.read()))
    found = {r["path"].split("/")[0]: r["licence"] for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert found == want


def test_scores_are_tf_idf_cosines(spark):
    """Against dense vectors in numpy."""
    rng = random.Random(4)
    pool = sorted({w for _, t in licences.TEMPLATES[:8] for w in re.findall(licences.TERM, t.lower())}) + ["other", "plain", "words"]
    units = [(k, k % 7 == 0, k % 3, [rng.choice(pool) for _ in range(rng.randint(2, 14))]) for k in range(60)] + [(90 + k, False, 1, re.findall(licences.TERM, t.lower())) for k, (_, t) in enumerate(licences.TEMPLATES)]
    found = {r["unit"]: (r["licence"], r["score"]) for r in licences.matched_units(spark.createDataFrame(units, "unit long, whole boolean, n long, terms array<string>")).collect()}
    total, df = sum(n for _, _, n, _ in units), Counter()
    for _, _, n, terms in units:
        df.update({t: n for t in set(terms)})
    present = {t for *_, terms in units for t in terms}
    idf = lambda t: np.log((1 + total) / (1 + df[t])) + 1 if t in present else np.log(1 + total) + 1
    vector = lambda terms: {t: c * idf(t) for t, c in Counter(terms).items()}
    length = lambda v: np.sqrt(sum(x * x for x in v.values()))
    want = {}
    for unit, whole, _, terms in units:
        v, scores = vector(terms), []
        for k, (name, text) in enumerate([*licences.TEMPLATES, *licences.FILE_TEMPLATES]):
            t = vector(re.findall(licences.TERM, text.lower()))
            score = round(sum(v[x] * t[x] for x in v if x in t) / (length(v) * length(t)), 6)
            if (k >= len(licences.TEMPLATES)) == whole and len(set(v) & set(t)) >= licences.MIN_SHARED and score >= (licences.MIN_FILE_COSINE if whole else licences.MIN_COSINE):
                scores.append((-score, k, name))
        if scores:
            want[unit] = (min(scores)[2], -min(scores)[0])
    assert set(found) == set(want) and len(want) > 20
    assert all(found[u][0] == want[u][0] and abs(found[u][1] - want[u][1]) < 2e-6 for u in want)


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels = labelled(n=200)
    rows += [(300 + k, rows[k][1], "s2") for k in range(5)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.agg({"length": "sum"}).first()[0] == sum(r["doc_tokens"] for r in out.collect() if r["start"] == 0)
