"""Token counts by dynamic programming over prefixes of byte-pair tokens, and a chunk cache for token ids.

A text is cut at single spaces. What stands between two of them, the space before it included, is a chunk; the
tokenizer's own pre-tokenizer never joins characters of two chunks unless white space meets white space, and such
texts are given to it whole. Chunks repeat, so each is worked out once per executor process and then looked up.

Inside a pre-token every prefix has one last token: the token t ending there for which the tokens (last token of
the prefix before t, t) stand together, that is, the tokenizer leaves their concatenation as these two. So the
counts of all prefixes follow from left to right: count(prefix) = count(prefix without its last token) + 1.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import held

#: Entries of the younger half of a process's cache, and the most characters of a key: longer ones are worked out anew.
CACHE_ENTRIES, KEY_CHARS = 800_000, 64

#: Characters of a text that are cut into chunks at a time, to bound the memory that a very long text takes.
SLICE = 1 << 20
#: Stands for a chunk's count where the chunk can't be taken by itself; more than any text has tokens.
UNSAFE = 1 << 60
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache(dict):
    """What `work` gives for a key. When full, the younger half becomes the older one, which is asked before `work`."""

    def __init__(self, work, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.work, self.entries, self.older = work, entries, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.work(key)
        if len(key) <= KEY_CHARS:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Chunks:
    """Cuts texts into chunks and special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.characters = {b: c for c, b in _byte_characters().items()}
        # A space and letters are one pre-token, spelled by bytes, in byte-level tokenizers with their usual pattern.
        self.letters_alone = json.loads(self.tokenizer.to_str())["pre_tokenizer"] == BYTE_LEVEL

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens, a character for each byte."""
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def spell(self, text: str) -> str:
        """A text's bytes as the characters that stand for them."""
        return text.encode().decode("latin-1").translate(self.characters)

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """(ordinary text, id of the special token after it or None)."""
        out, rest = [], text
        while rest:
            at, name = min(((k, s) for s in self.special if (k := rest.find(s)) >= 0), default=(-1, ""))
            if at < 0:
                return [*out, (rest, None)]
            out.append((rest[:at], self.special[name]))
            rest = rest[at + len(name) :]
        return out

    @staticmethod
    def slices(text: str) -> Iterator[str]:
        """A long text in parts, cut before a space between two characters that aren't white space."""
        at = 0
        while len(text) - at > SLICE:
            cut = text.find(" ", at + SLICE)
            while cut >= 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    @staticmethod
    def chunks(text: str) -> tuple[str, list[str]] | None:
        """What stands before the first space, and the chunks after it without their spaces.

        None if white space meets white space, so that chunks can't be told apart safely.
        """
        if "  " in text or "\n " in text or text[-1:].isspace():
            return None
        first, *rest = text.split(" ")
        return first, rest

    @staticmethod
    def unsafe(chunk: str) -> bool:
        """Whether white space in this chunk could reach into the next one."""
        return chunk[-1:].isspace() or not chunk


def _byte_characters() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable Latin-1 as it is, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class PrefixCounter(Chunks):
    """Exact token counts of every prefix of a text."""

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.spelled = {token[:n]: False for token in vocab for n in range(1, len(token))} | dict.fromkeys(vocab, True)
        self.together: dict[str, Cache] = Cache(lambda a: Cache(lambda b: self.stand_together(a, b)), 1 << 17)
        self.counts = Cache(self.chunk_count)
        self.kept = Cache(self.chunk_prefixes)  # by the same keys, so that both forget alike

    def stand_together(self, a: str, b: str) -> bool:
        return [t.value for t in self.tokenizer.model.tokenize(a + b)] == [a, b]

    def prefixes(self, pre_token: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, 2, ... bytes of a pre-token.

        Every token that starts after a prefix, and stands together with that prefix's last token, is the last token
        of the prefix that it ends; each prefix has exactly one.
        """
        size, spelled = len(pre_token), self.spelled
        counts, last = [0] + [-1] * size, [""] * (size + 1)
        for start in range(size):
            if counts[start] < 0:
                raise ValueError(f"no token ends after byte {start} of a pre-token")
            after = self.together[last[start]] if start else None
            count = counts[start] + 1
            for end in range(start + 1, size + 1):
                token = pre_token[start:end]
                whole = spelled.get(token)
                if whole is None:
                    break
                if whole and counts[end] < 0 and (after is None or after[token]):
                    counts[end], last[end] = count, token
        return counts

    def chunk_prefixes(self, chunk: str) -> bytes | list[int] | None:
        """Tokens of the first 0, 1, 2, ... characters of a chunk with its leading space; None if the chunk is unsafe."""
        if self.unsafe(chunk):
            return None
        if chunk.isascii() and chunk.isalpha() and self.letters_alone:
            found = self.prefixes(self.spell(" " + chunk))
        else:
            found = self.by_character(" " + chunk)
        return bytes(found) if len(found) <= KEY_CHARS and max(found) < 256 else found

    def chunk_count(self, chunk: str) -> int:
        """Tokens of a chunk with its leading space; UNSAFE if the chunk can't be taken by itself."""
        found = self.kept[chunk]
        return UNSAFE if found is None else found[-1]

    def by_character(self, text: str) -> list[int]:
        """Tokens of the first 0, 1, 2, ... characters of a text without special tokens."""
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        out, before, k = [0], 0, 0
        while k < len(words):
            last, (at, end) = k, words[k][1]
            while text[at:end].isspace() and last + 1 < len(words) and text[words[last + 1][1][0]].isspace():
                last += 1  # a run of white space ends with the space before a word, or is whole where the text is cut
                end = words[last][1][1]
            run = len(text[at:end]) - len(text[at:end].lstrip())
            if last > k or text[at:end].isspace():
                spaces = self.prefixes(self.spell(text[at : at + run]))
                sizes = [len(c.encode()) for c in text[at : at + run]]
                byte = 0
                for size in sizes:
                    byte += size
                    out.append(before + spaces[byte])
            for j in range(k, last + 1):
                a, b = words[j][1]
                counts, byte = self.prefixes(words[j][0]), 0
                contraction = b - a == 3 and text[a] == "'" and text[a + 1].isalpha()  # its first letter alone is a word of its own
                for place in range(a, b):
                    byte += len(text[place].encode())
                    if len(out) <= place + 1:
                        alone = contraction and place == a + 1
                        out.append(before + (counts[1] + self.prefixes(self.spell(text[place]))[-1] if alone else counts[byte]))
                before += counts[-1]
            k = last + 1
        return out

    def _laid_out(self, text: str) -> Iterator[tuple[int, int, object]]:
        """(characters, tokens, counts by character or a function that gives them) of a text's parts, in order."""
        for segment, special in self.segments(text):
            for part in self.slices(segment):
                found = self.chunks(part)
                if found is not None and not found[0][-1:].isspace() and not any(map(self.unsafe, found[1])):
                    if found[0]:
                        first = self.by_character(found[0])
                        yield len(found[0]), first[-1], first
                    for chunk in found[1]:
                        yield len(chunk) + 1, self.counts[chunk], self.kept[chunk]
                elif part:
                    counts = self.by_character(part)
                    yield len(part), counts[-1], counts
            if special is not None:
                name = next(s for s, i in self.special.items() if i == special)
                yield len(name), 1, self._cut_special(segment, name)

    def _cut_special(self, segment: str, name: str) -> list[int]:
        """Counts where a special token's string is cut: it is ordinary text then, and may join with what stands before."""
        at = segment.rfind(" ", 0, len(segment.rstrip()))
        tail = segment[at:] if at > 0 and not segment[at - 1].isspace() else segment
        whole = self.by_character(tail)[-1]
        return [self.by_character(tail + name[:k])[-1] - whole for k in range(len(name))] + [1]

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return sum(sum(map(self._count, self.slices(segment))) + (special is not None) for segment, special in self.segments(text))

    def _count(self, text: str) -> int:
        if not text:
            return 0
        found = self.chunks(text)
        if found is not None and not found[0][-1:].isspace():
            rest = sum(map(self.counts.__getitem__, found[1]))
            if rest < UNSAFE:
                return self._plain(found[0]) + rest
        return self._plain(text)

    def _plain(self, text: str) -> int:
        return sum(self.prefixes(w)[-1] for w in self.pre_tokens(text))

    def table(self, text: str) -> list[int]:
        """Exact token counts of the prefixes of 0, 1, 2, ... characters of `text`, read from the stored ones."""
        out, before = [0], 0
        for _, tokens, counts in self._laid_out(text):
            out += [before + n for n in counts[1:]]
            before += tokens
        return out

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens, read from the stored counts up to there."""
        length, before = 0, 0
        for size, tokens, counts in self._laid_out(text):
            if before + tokens > budget:
                return length + max(k for k, n in enumerate(counts) if before + n <= budget)
            length, before = length + size, before + tokens
        return length


def counter(path: str) -> PrefixCounter:
    return held("tokens", path, lambda: PrefixCounter(path))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 1024, tokenizer: str = "byte_bpe_50k.json", with_table: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, cut_chars; with_table adds prefix_tokens.

    n_tokens counts the tokens of the whole text; null texts are empty. over_limit tells whether that is more than
    `budget`, and cut_chars how many characters the longest prefix within it has (the whole text's, if it fits).
    prefix_tokens[i] is the exact count of the first i characters. Special tokens' strings in a text count as those
    tokens. Repeated rows are counted again; other columns are ignored. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path(tokenizer))
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = [c.count(x) for x in texts]
            arrays = [
                batch.column(0),
                pa.array([len(x.encode()) for x in texts], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([x > budget for x in n], pa.bool_()),
                pa.array([c.cut(x, budget) if k > budget else len(x) for x, k in zip(texts, n, strict=True)], pa.int64()),
            ]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"]
            if with_table:
                arrays.append(pa.array([c.table(x) for x in texts], pa.list_(pa.int64())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long" + ", prefix_tokens array<long>" * with_table
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(run, schema)
