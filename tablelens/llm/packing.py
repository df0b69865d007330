"""Packing: order-preserving cuts of the token stream into windows, by dynamic programming with a monotone queue.

Documents are taken in the order in which each Spark partition reads them, so nothing is shuffled. Windows may end
at the end of a document, after a sentence, or, where no sentence ends for long, at a fixed grid. The cost of a
window is its padding and a penalty for the kind of its end; cost(i, j) = size - (P_j - P_i) + penalty_j, so the best
start for each end is the least cost_i + P_i within the window's reach, which a monotone queue gives in constant time.
The queue runs on over a partition's whole stream. Whatever comes later starts from an entry of the queue, so the cuts
that all its entries have behind them are settled and are given out at once.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from contextlib import suppress
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import held
from tablelens.llm.tokens import KEY_CHARS, Cache, Chunks, tokenizer_path

WINDOW = 1024
#: The id that ends a document.
END = 0
_END = struct.pack("<I", END)
#: Packers of few ids, which most words have.
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(64)]
#: Penalties, in tokens of padding, for cutting a document after a sentence and inside one.
SENTENCE_CUT, INNER_CUT = 1, 8
#: From twice this after the end of a sentence or document on, cuts are allowed at this spacing.
GRID = 8
#: Tokens that are taken in before settled cuts are given out; it bounds memory and doesn't change the cuts.
PLAN = 1 << 18
ENDINGS = (".", "!", "?", "\n", '."', ".\n", "!\n", "?\n", ".)")

_LETTERS, _MARKS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F", r"!-/:-@\[-`{-~"
#: Pre-tokens of byte-level tokenizers in text of Latin letters, ASCII digits and marks, spaces and line ends. What it
#: passes over is for the library.
PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|[ \n]+(?![^ \n])|[ \n]+")

#: Marks after a word that are one pre-token together; an apostrophe may belong to letters after it.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Chunks in the younger half of a process's cache; ids take more memory than counts.
KEPT = 300_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Words(Cache):
    """Ids of chunks, each a space and letters in most cases. Of a word and marks after it, the word is kept at once and
    the whole when the word is there already: most words are rare and needn't be worked out for every mark."""

    def __init__(self, work, word, marks: Cache, entries: int):
        super().__init__(work, entries)
        self.word, self.marks = word, marks

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            if key.isalpha():
                found = self.word(key)
            else:
                word = key.rstrip(TAIL)
                if word.isalpha():
                    known = self.get(word)
                    if known is None:
                        return self[word] + self.marks[key[len(word) :]]
                    found = known + self.marks[key[len(word) :]]
                else:
                    found = self.work(key)
        if len(key) <= KEY_CHARS:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class ChunkIds(Chunks):
    """Token ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        self.model = self.tokenizer.model
        self.spelling = "".join(chr(b).translate(self.characters) for b in range(256))
        self.firsts, self.marks = Cache(self._whole, KEPT // 10), Cache(self._piece, KEPT // 10)
        self.known = Words(self._chunk, self._word, self.marks, KEPT) if self.letters_alone else Cache(self._chunk, KEPT)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sentence_end = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for i in vocab.values():
            self.sentence_end[i] = self.tokenizer.decode([i], skip_special_tokens=False).rstrip(" ").endswith(ENDINGS)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> bytes | None:
        """The ids of a chunk with its leading space; None if the chunk can't be taken by itself."""
        if self.letters_alone and chunk.isalpha():
            return self._piece(" " + chunk)
        if self.unsafe(chunk):
            return None
        spaced = " " + chunk
        if self.letters_alone:
            first, *rest = found = PIECES.findall(spaced)
            if sum(map(len, found)) == len(spaced):
                alone = self.known.get(first[1:]) or self.known.older.get(first[1:]) or self._piece(first)
                return b"".join([alone, *[self._piece(p) if p.isalpha() else self.marks[p] for p in rest]])
        return self._bytes([t.id for word in self.pre_tokens(spaced) for t in self.model.tokenize(word)])

    def spell(self, text: str) -> str:
        return codecs.charmap_decode(text.encode(), "strict", self.spelling)[0]

    def _word(self, word: str) -> bytes:
        """The ids of a space and letters."""
        ids = [t.id for t in self.model.tokenize("\u0120" + word if word.isascii() else self.spell(" " + word))]
        return _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else self._bytes(ids)

    def _piece(self, pre_token: str) -> bytes:
        """The ids of one pre-token."""
        spelled = "\u0120" + pre_token[1:] if pre_token[0] == " " and pre_token.isascii() and "\n" not in pre_token else self.spell(pre_token)
        return self._bytes([t.id for t in self.model.tokenize(spelled)])

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        """The ids of a text, and then the id that ends a document."""
        if any(s in text for s in self.special):
            return self._whole(text) + _END
        return b"".join([*map(self._slice, self.slices(text)), _END])

    def _slice(self, text: str) -> bytes:
        found = self.chunks(text)
        if found is not None and not found[0][-1:].isspace():
            with suppress(TypeError):  # None among the chunks
                return b"".join([self.firsts[found[0]], *map(self.known.__getitem__, found[1])])
        return self._whole(text)


def chunk_ids(path: str) -> ChunkIds:
    return held("packing", path, lambda: ChunkIds(path))


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, since: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Allowed cuts after some of `ids`, counted from their first, and the penalty of each.

    doc_ends are the cuts at ends of documents. The last end of a document or sentence lies `since` ids before the
    first; the same is given back for what follows.
    """
    penalty = np.full(len(ids) + 1, -1, dtype=np.int64)  # -1: no cut here
    penalty[1:][sentence_end[ids]] = SENTENCE_CUT
    penalty[doc_ends] = 0
    place = np.arange(len(ids) + 1)
    gap = place - np.maximum.accumulate(np.where(penalty >= 0, place, -since))
    penalty[(penalty < 0) & (gap >= 2 * GRID) & (gap % GRID == 0)] = INNER_CUT
    penalty[0] = -1
    points = np.flatnonzero(penalty >= 0)
    return points, penalty[points], int(gap[-1])


class Cutter:
    """Cuts of least padding plus penalties in a stream whose allowed cuts come in parts; no window is longer than WINDOW."""

    def __init__(self):
        self.points, self.value, self.back = [0], [0], [0]  # value: least cost up to a point, plus the point itself
        self.queue = deque([0])

    def extend(self, points: list[int], penalties: list[int]) -> None:
        all_points, value, back, queue = self.points, self.value, self.back, self.queue
        keep, keep_back, put, pop = value.append, back.append, queue.append, queue.pop
        j, head, tail = len(all_points), queue[0], value[queue[-1]]
        head_point, head_value = all_points[head], value[head]
        all_points += points
        for p, penalty in zip(points, penalties, strict=True):
            while head_point < p - WINDOW:
                queue.popleft()
                head = queue[0]
                head_point, head_value = all_points[head], value[head]
            keep_back(head)
            v = head_value + WINDOW + penalty
            keep(v)
            while tail >= v:
                pop()
                if not queue:
                    head, head_point, head_value = j, p, v
                    break
                tail = value[queue[-1]]
            put(j)
            tail = v
            j += 1

    def cuts(self, at: int) -> list[int]:
        """The cuts that lead to point number `at`, the first one of the stream included."""
        found = [self.points[at]]
        while at:
            at = self.back[at]
            found.append(self.points[at])
        return found[::-1]

    def settled(self) -> int:
        """The last point that lies on the way to every entry of the queue."""
        heads = [-k for k in self.queue]
        heapify(heads)
        while True:
            top = heappop(heads)
            while heads and heads[0] == top:
                heappop(heads)
            if not heads:
                return -top
            heappush(heads, -self.back[-top])

    def forget(self, at: int) -> None:
        """What lies before point number `at` is given out; points count from there now."""
        low = self.points[at]
        self.points = [p - low for p in self.points[at:]]
        self.value = [v - self.value[at] for v in self.value[at:]]
        self.back = [max(0, b - at) for b in self.back[at:]]
        self.queue = deque(k - at for k in self.queue)


def best_cuts(points: list[int], penalties: list[int]) -> list[int]:
    """The cuts of a whole stream, first and last point included."""
    cutter = Cutter()
    cutter.extend(points[1:], penalties[1:])
    return cutter.cuts(len(points) - 1)


class Packer:
    """Packs one partition's documents; holds the tokens that no settled cut has passed, and up to PLAN more."""

    def __init__(self, partition: int, sentence_end: np.ndarray):
        self.sentence_end, self.next_sequence = sentence_end, partition << 33
        self.docs: list[list] = []  # [doc_id, start of what is here, doc_tokens, ids]
        self.fresh = self.seen = self.since = 0  # tokens not yet planned, tokens held that are, and see cut_points
        self.cutter = Cutter()
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        for at in range(0, total, PLAN):
            part = ids[4 * at : 4 * (at + PLAN)]
            self.docs.append([doc_id, at, total, part])
            self.fresh += len(part) // 4
            if self.fresh >= PLAN:
                self.plan(last=False)

    def plan(self, last: bool) -> None:
        if not self.docs:
            return
        stream = b"".join(d[3] for d in self.docs)
        ids, lengths = np.frombuffer(stream, dtype="<u4"), np.array([len(d[3]) // 4 for d in self.docs])
        edges = np.cumsum(lengths)
        doc_ends = edges[[d[1] + n == d[2] for d, n in zip(self.docs, lengths.tolist(), strict=True)]]
        points, penalties, self.since = cut_points(ids[self.seen :], doc_ends[doc_ends > self.seen] - self.seen, self.sentence_end, self.since)
        self.cutter.extend((points + self.seen).tolist(), penalties.tolist())
        self.seen, self.fresh = len(ids), 0
        at = len(self.cutter.points) - 1 if last else self.cutter.settled()
        cuts = self.cutter.cuts(at)
        if last:  # the rest fills windows of powers of two, which need no padding
            low, rest = cuts[-2], cuts[-1] - cuts[-2]
            cuts[-1:] = np.cumsum([low] + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]).tolist()[1:]
        if len(cuts) > 1:
            self._emit(stream, edges.tolist(), cuts)
            self.seen -= cuts[-1]
            self.cutter.forget(at)

    def _emit(self, stream: bytes, edges: list[int], cuts: list[int]) -> None:
        k, begin = 0, 0
        for low, high in zip(cuts, cuts[1:], strict=False):
            at = low
            while at < high:
                end = min(high, edges[k])
                doc_id, start, total, _ = self.docs[k]
                self.rows.append((doc_id, start + at - begin, end - at, zlib.crc32(stream[4 * at : 4 * end]), total, self.next_sequence, at - low))
                at = end
                if at == edges[k]:
                    begin, k = edges[k], k + 1
            self.next_sequence += 1
        done = cuts[-1]
        if k < len(self.docs):
            doc_id, start, total, ids = self.docs[k]
            self.docs = [[doc_id, start + done - begin, total, ids[4 * (done - begin) :]], *self.docs[k + 1 :]]
        else:
            self.docs = []


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    encoder = chunk_ids(tokenizer_path(tokenizer))
    packer = Packer(TaskContext.get().partitionId(), encoder.sentence_end)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def flush() -> pa.RecordBatch:
        columns = list(zip(*packer.rows, strict=True)) or [[]] * len(names)
        packer.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            packer.add(doc_id, encoder.ids(text or ""))
        if packer.rows:
            yield flush()
    packer.plan(last=True)
    yield flush()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its tokens and then id 0; null texts are empty and are that id alone. Rows that repeat an id are
    packed again, each as a document of its own, and ids may be null. Sequences of less than 1024 tokens are to be padded, but for those
    whose length is a power of two: the rest of each partition is cut into such. Other columns are ignored, and an
    empty table gives an empty table. The order of the input's rows is kept within each partition, and cuts and
    sequence ids follow the partitions in which the input is read: other partitions give other sequences.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(partial(_pack, tokenizer=tokenizer), SCHEMA)
