"""Toxicity: a learned lexicon, Levenshtein automata over its trie for misspelled terms, and context windows.

The lexicon holds words and word stems that labelled texts mark as toxic. A text's words run through one automaton:
the Levenshtein automata of all terms intersected with the lexicon's trie, made deterministic as far as words ask for.
Around each hit a window of words tells quotation and report from abuse. Scores are log-odds from counted labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import held, materialise, maybe_broadcast

#: The classifier is fitted on about so many labelled rows at most, drawn by a hash of the id.
MAX_LABELLED = 16_000
#: A term needs this share of toxic texts among those that hold it, this G-squared against chance, and so many toxic
#: texts, less clean ones, that fewer than COVER better terms have found already (copies of a text teach many words).
MIN_PRECISION, MIN_G2, MIN_TOXIC, COVER = 0.85, 25.0, 5, 3
STEM_LENGTHS = (4, 5, 6, 7)
#: Edits that are allowed in a term of at least so many letters. Stems, whose rest is open, need more letters than
#: STEM_LENGTHS gives them; misspellings are found by the whole words that are kept beside a stem.
EDITS = ((9, 2), (5, 1))
STEM_EDITS = ((8, 1),)
#: How often a misspelled form is expected for one correct form, by edits.
MISSPELLED = {0: 1.0, 1: 0.02, 2: 0.005}
CONTEXT = 6
#: Chunks whose hits a process keeps, and the most characters of one: longer ones are looked through each time.
CACHE_ENTRIES, MAX_KEPT = 400_000, 64
STATES = 50_000
#: Marks of quotation, and words that report speech or talk about words.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word words term terms slur insult insults dit appelle mot sagte sagt nannte wort dijo dice llamó palabra".split())
ADDRESS = frozenset("you your you're youre u ur du dich dir ihr tu toi vous te usted ustedes vosotros".split())
_WORD = re.compile(r"[^\W_]+")

HELD_OUT_PARTS = 5


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_PARTS == 0, F.lit(False))


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    toxic: int
    clean: int

    @property
    def edits(self) -> int:
        return next((k for n, k in (STEM_EDITS if self.stem else EDITS) if len(self.text) >= n), 0)


class Matcher:
    """Finds the term nearest to a word. A state of the automaton is the set of (trie node, edits so far)."""

    def __init__(self, terms: tuple[Term, ...]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]  # most edits of any term below a node
        for number, term in enumerate(terms):
            node = 0
            for letter in term.text:
                self.reach[node] = max(self.reach[node], term.edits)
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][letter]
            self.reach[node] = max(self.reach[node], term.edits)
            self.ends[node].append(number)
        self.terms = terms
        self._clear()

    def _clear(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.states: list[tuple[dict[int, int], tuple[int, int] | None]] = []
        self.numbers: dict = {}
        self.first = self._number(self._closed({0: 0}), None)

    def _number(self, live: dict[int, int], stem: tuple[int, int] | None) -> int:
        key = (frozenset(live.items()), stem)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append((live, stem))
        return self.numbers[key]

    def _closed(self, live: dict[int, int]) -> dict[int, int]:
        """With the nodes that are reached by leaving out letters of a term."""
        todo = list(live.items())
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.reach[child] and edits + 1 < live.get(child, 9):
                    live[child] = edits + 1
                    todo.append((child, edits + 1))
        return live

    def _best(self, live: dict[int, int], stems: bool) -> tuple[int, int] | None:
        found = [(e, t) for node, e in live.items() for t in self.ends[node] if self.terms[t].stem == stems and e <= self.terms[t].edits]
        if not found:
            return None
        edits, term = min(found)
        return term, edits

    def _step(self, state: int, letter: str) -> int:
        live, stem = self.states[state]
        out: dict[int, int] = {}
        for node, edits in live.items():
            for edge, child in self.children[node].items():
                cost = edits + (edge != letter)
                if cost <= self.reach[child] and cost < out.get(child, 9):
                    out[child] = cost
            if edits + 1 <= self.reach[node] and edits + 1 < out.get(node, 9):
                out[node] = edits + 1
        out = self._closed(out)
        here = self._best(out, stems=True)
        if here and (stem is None or here[1] < stem[1]):
            stem = here
        found = self.steps[state, letter] = self._number(out, stem)
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """(number of the term, edits), or None."""
        if len(self.states) > STATES:
            self._clear()
        state, steps = self.first, self.steps
        for letter in word:
            nxt = steps.get((state, letter))
            state = self._step(state, letter) if nxt is None else nxt
            if not self.states[state][0]:
                return self.states[state][1]
        live, stem = self.states[state]
        whole = self._best(live, stems=False)
        if whole and (stem is None or whole[1] < stem[1]):
            return whole
        return stem


class Reader:
    """Finds hits in texts; keeps what it has found for each run of non-space characters."""

    def __init__(self, terms: tuple[Term, ...]):
        self.matcher = Matcher(terms)
        self.known: dict[str, tuple[tuple[int, int], ...]] = {}

    def _look(self, chunk: str) -> tuple[tuple[int, int], ...]:
        """The terms that a chunk holds, each with its fewest edits."""
        found: dict[int, int] = {}
        for word in _WORD.findall(chunk.lower()):
            hit = self.matcher.match(word)
            if hit:
                found[hit[0]] = min(hit[1], found.get(hit[0], hit[1]))
        out = tuple(found.items())
        if len(chunk) <= MAX_KEPT:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[chunk] = out
        return out

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """(term, edits, context) of every hit; context is quoted, reported, direct or plain."""
        chunks, known, look = text.split(), self.known, self._look
        found = []
        for at, chunk in enumerate(chunks):
            try:
                hits = known[chunk]
            except KeyError:
                hits = look(chunk)
            if hits:
                context = self._context(chunks, at)
                found += [(*hit, context) for hit in hits]
        return found

    @staticmethod
    def _context(chunks: list[str], at: int) -> str:
        before, after = chunks[max(0, at - CONTEXT) : at], chunks[at + 1 : at + 1 + CONTEXT]
        own = chunks[at]
        opened = sum(c in QUOTES for w in before for c in w) + (own[0] in QUOTES)
        closed = sum(c in QUOTES for w in after for c in w) + (own[-1] in QUOTES or own[-2:-1] in QUOTES if len(own) > 1 else 0)
        if opened % 2 and closed:
            return "quoted"
        words = {w.strip(".,;:!?()").lower() for w in (*before, *after)}
        if words & REPORTING:
            return "reported"
        return "direct" if words & ADDRESS else "plain"


def reader(terms: tuple[Term, ...]) -> Reader:
    return held("toxicity", terms, lambda: Reader(terms))


# Learning


def _forms(text: str) -> set[tuple[str, bool]]:
    words = set(_WORD.findall(text.lower()))
    return {(w, False) for w in words if len(w) > 2} | {(w[:n], True) for w in words for n in STEM_LENGTHS if len(w) > n}


def _form_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, stem, toxic, clean): texts that hold a form, counted within the task first."""
    counts: dict[tuple[str, bool], list[int]] = {}

    def flush() -> pa.RecordBatch:
        keys, values = list(counts), list(counts.values())
        counts.clear()
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([v[1] for v in values], pa.int64()), pa.array([v[0] for v in values], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["form", "stem", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for form in _forms(text or ""):
                counts.setdefault(form, [0, 0])[toxic] += 1
            if len(counts) > CACHE_ENTRIES:
                yield flush()
    yield flush()


def labelled_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(body, toxic) of the labelled rows to learn from: not held out, at most about `bound`, drawn by the id's hash."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("__tl_toxic"))
    known = materialise(known.withColumnRenamed("doc_id", "__tl_id").filter(~held_out("__tl_id")), "labels")
    share = min(1.0, bound / max(1, known.count()))
    drawn = materialise(known.filter(F.pmod(F.xxhash64(F.lit("toxic"), "__tl_id"), F.lit(1 << 20)) < int(share * (1 << 20))), "drawn")
    rows = docs.select(F.col("doc_id").cast("long").alias("__tl_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    joined = rows.join(maybe_broadcast(drawn), F.col("__tl_doc") == F.col("__tl_id"))
    return materialise(joined.select("body", F.col("__tl_toxic").alias("toxic")), "train")


def learn_terms(train: DataFrame, n_toxic: int, n_clean: int) -> tuple[Term, ...]:
    """Words and stems that toxic texts hold far more often than chance; words of a kept stem stay for their misspellings."""
    if not n_toxic or not n_clean:
        return ()
    counts = train.mapInArrow(_form_counts, "form string, stem boolean, toxic long, clean long")
    counts = counts.groupBy("form", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n, rate = F.col("toxic") + F.col("clean"), n_toxic / (n_toxic + n_clean)
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(F.lit(0.0))
    scored = counts.withColumn("g2", 2 * (part(F.col("toxic"), rate) + part(F.col("clean"), 1 - rate)))
    picked = scored.filter((F.col("toxic") >= MIN_TOXIC) & (F.col("toxic") >= MIN_PRECISION * n) & (F.col("g2") >= MIN_G2))
    rows = picked.orderBy(F.desc("g2"), "stem", "form").collect()  # forms of the bounded sample's toxic texts
    words = {r["form"]: r for r in rows if not r["stem"]}
    kept: dict[str, Term] = {}
    for r in sorted((r for r in rows if r["stem"]), key=lambda r: (len(r["form"]), r["form"])):
        form = r["form"]
        one_word = any(w["toxic"] >= 0.95 * r["toxic"] for f, w in words.items() if f.startswith(form))
        if not one_word and not any(form[:n] in kept for n in STEM_LENGTHS):
            kept[form] = Term(form, True, r["toxic"], r["clean"])
    terms = [*kept.values()]
    covered = {f for f in words if any(f[:n] in kept for n in STEM_LENGTHS)}
    terms += [Term(f, False, r["toxic"], r["clean"]) for f, r in words.items() if f not in covered]
    chosen = _needed(train, tuple(terms))
    # Stems are too short to forgive edits, so the whole words that a chosen stem covers stay beside it with their own.
    stems = {t.text for t in chosen if t.stem}
    spelled = [Term(f, False, r["toxic"], r["clean"]) for f, r in words.items() if f in covered and any(f[:n] in stems for n in STEM_LENGTHS)]
    return (*chosen, *spelled)


def _needed(train: DataFrame, terms: tuple[Term, ...]) -> tuple[Term, ...]:
    """Greedy cover of the toxic texts: a term stays if it finds enough texts that better terms haven't."""
    found = train.filter("toxic = 1").mapInArrow(partial(_term_sets, terms=terms), "terms array<int>")
    texts = [set(r["terms"]) for r in found.collect()]  # small sets, of the bounded sample
    often, left = [0] * len(texts), set(range(len(terms)))
    holders: dict[int, list[int]] = {}
    for k, own in enumerate(texts):
        for t in own:
            holders.setdefault(t, []).append(k)
    chosen = []
    while left:
        gain = {t: sum(often[k] < COVER for k in holders.get(t, ())) - terms[t].clean for t in left}
        best = max(left, key=lambda t: (gain[t], -t))
        if gain[best] < MIN_TOXIC:
            break
        chosen.append(best)
        left.discard(best)
        for k in holders.get(best, ()):
            often[k] += 1
    return tuple(terms[t] for t in chosen)


def _term_sets(batches: Iterator[pa.RecordBatch], terms: tuple[Term, ...]) -> Iterator[pa.RecordBatch]:
    stems, words = {t.text: k for k, t in enumerate(terms) if t.stem}, {t.text: k for k, t in enumerate(terms) if not t.stem}
    for batch in batches:
        sets = []
        for text in batch.column(0).to_pylist():
            seen = set(_WORD.findall((text or "").lower()))
            own = {words[w] for w in seen if w in words}
            sets.append(sorted(own | {stems[w[:n]] for w in seen for n in STEM_LENGTHS if w[:n] in stems}))
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32()))], ["terms"])


def _hit_counts(batches: Iterator[pa.RecordBatch], terms: tuple[Term, ...]) -> Iterator[pa.RecordBatch]:
    """(kind, key, label, n): texts by the forms, contexts and absence of hits that they hold."""
    counts: dict[tuple[str, int, int], int] = {}
    find = reader(terms)
    contexts = list(_CONTEXTS)
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            hits = find.hits(text or "")
            seen = {("form", 3 * t + e) for t, e, _ in hits} | {("context", contexts.index(c)) for _, _, c in hits} | ({("none", 0)} if not hits else set())
            for kind, key in seen:
                counts[kind, key, toxic] = counts.get((kind, key, toxic), 0) + 1
    keys = list(counts)
    columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()), pa.array([counts[k] for k in keys], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["kind", "key", "label", "n"])


#: What a context adds to the log-odds where no labelled text shows it, and how many texts that belief counts as.
_CONTEXTS = {"plain": 0.0, "direct": 0.0, "reported": -1.0, "quoted": -2.0}
PRIOR_TEXTS = 10


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    weights: dict[tuple[int, int], float]  # log-odds of a text with this (term, edits)
    contexts: dict[str, float]  # what a context adds
    none: float  # log-odds of a text without hits
    shift: float = 0.0  # score = logistic(shift + slope * log-odds), fitted on the labelled rows
    slope: float = 1.0


def _log_odds(toxic: float, clean: float) -> float:
    return math.log(toxic / clean)


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model:
    """Learns lexicon, weights and contexts from labelled rows that aren't held out. Without labels, scores are low."""
    train = labelled_rows(docs, labels, bound)
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    terms = learn_terms(train, n_toxic, n_clean)
    counted = train.mapInArrow(partial(_hit_counts, terms=terms), "kind string, key long, label long, n long")
    rows = counted.groupBy("kind", "key", "label").agg(F.sum("n").alias("n")).collect()  # a few rows for each term
    n = {(r["kind"], r["key"], r["label"]): r["n"] for r in rows}
    prior = _log_odds(n_toxic + 0.5, n_clean + 1)
    weights = {}
    for t, term in enumerate(terms):
        for e in range(term.edits + 1):
            expected = MISSPELLED[e] * term.toxic if e else 0.0
            weights[t, e] = _log_odds(n.get(("form", 3 * t + e, 1), 0) + expected + 0.1, n.get(("form", 3 * t + e, 0), 0) + 0.5)
    plain = _log_odds(n.get(("context", 0, 1), 0) + 1, n.get(("context", 0, 0), 0) + 1)
    contexts = {}
    for k, (name, against) in enumerate(_CONTEXTS.items()):
        toxic, clean = n.get(("context", k, 1), 0), n.get(("context", k, 0), 0)
        seen = toxic + clean
        own = _log_odds(toxic + 1, clean + 1) - plain
        contexts[name] = 0.0 if name == "plain" else max(-4.0, min(1.0, (seen * own + PRIOR_TEXTS * against) / (seen + PRIOR_TEXTS)))
    none = min(prior, _log_odds(n.get(("none", 0, 1), 0) + 0.5, n.get(("none", 0, 0), 0) + 1))
    model = Model(terms, weights, contexts, none)
    return replace(model, **calibrated(train, model)) if n_toxic and n_clean else replace(model, none=-4.0)


def _binned(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    find, counts = reader(model.terms), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[round(4 * text_odds(model, find, text or "")), toxic] += 1
    columns = [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["odds", "label", "n"])


def calibrated(train: DataFrame, model: Model) -> dict[str, float]:
    """shift and slope of the logistic curve that fits the labels best, from counts by quarters of log-odds."""
    counted = train.mapInArrow(partial(_binned, model=model), "odds long, label long, n long")
    rows = counted.groupBy("odds", "label").agg(F.sum("n").alias("n")).collect()  # some hundred bins at most
    x, y, n = (np.array([float(r[k]) for r in rows]) for k in ("odds", "label", "n"))
    x, fit = np.stack([np.ones(len(x)), x / 4]), np.array([0.0, 1.0])
    ridge = np.diag([1e-3, 1.0])  # draws the slope to 1
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(fit @ x, -30, 30)))
        gradient = x @ (n * (y - p)) - ridge @ (fit - [0.0, 1.0])
        step = np.linalg.solve((x * (n * p * (1 - p))) @ x.T + ridge, gradient)
        fit = fit + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return {"shift": float(fit[0]), "slope": float(max(0.1, fit[1]))}


# Scoring


def text_odds(model: Model, find: Reader, text: str) -> float:
    hits = find.hits(text)
    if not hits:
        return model.none
    each: dict[int, float] = {}
    for term, edits, context in hits:
        value = model.weights[term, edits] + model.contexts[context]
        each[term] = max(value, each.get(term, value))
    ranked = sorted(each.values(), reverse=True)
    return max(model.none, ranked[0] + sum(0.5 * x for x in ranked[1:4] if x > 0))


def text_score(model: Model, find: Reader, text: str) -> float:
    odds = model.shift + model.slope * text_odds(model, find, text)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    find = reader(model.terms)
    for batch in batches:
        scores = pa.array([text_score(model, find, x or "") for x in batch.column(batch.num_columns - 1).to_pylist()], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*batch.schema.names[:-1], "__tl_score"])


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Columns `keep` of `docs` and __tl_score. Only the text is an input of the score."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("__tl_body"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "__tl_score double"])
    return rows.mapInArrow(partial(_score, model=model), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts hold no hit and get the score of such texts. Repeated rows get the same score. Rows without
    an id are scored and are not held out. Other columns of `docs` are ignored. Repeated labels count as toxic if one is.
    """
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels), "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), F.col("__tl_score").alias("score"), (F.col("__tl_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows whose score is 0.5 or more; all columns stay."""
    rows = docs.select("*", F.col("text").cast("string").alias("__tl_body"))
    model = fit(docs, labels)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "__tl_score double"])
    return rows.mapInArrow(partial(_score, model=model), schema).filter("__tl_score < 0.5").select(*docs.columns)
