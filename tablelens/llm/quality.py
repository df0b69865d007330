"""Host-level quality rules: rule failures by domain, rates shrunk by an empirical beta prior, verdicts joined back."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import maybe_broadcast, materialise

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Document rules besides the base rules: symbols per hundred words, and repeated lines per hundred words.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 10
#: A host is turned down if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found at least twice in the text, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, dtype=bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe).tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in at]  # equal hashes are only a hint: the words decide
    counts = Counter(windows)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.array([i for i, w in zip(at, windows, strict=True) if counts[w] > 1], dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    text = text or b""
    words = text.split()
    spaces = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = sum(text.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS)))
    return len(words), len(text.decode("utf-8", "replace")) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [text_counts(x) for x in batch.column(2).cast(pa.binary()).to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "host", *[c.split()[0] for c in COUNTS.split(", ")]])


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, and the counts that the rules read, one row per document. Null texts count as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(_count_batches, f"doc_id long, host string, {COUNTS}")


def with_rules(counts: DataFrame) -> DataFrame:
    """Adds base_failed and failed (any rule of the document)."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    more = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", base).withColumn("failed", base | more)


def host_verdicts(ruled: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n_docs, n_failed, host_rate (shrunk), host_ok.

    The beta prior is fitted to the hosts' raw rates by moments, hosts counting alike. What a host's rate varies by chance,
    as it has so few documents, is taken off the variance first, so that small hosts don't make the prior too wide. Rates
    that vary no more than by chance get a prior that weighs as much as all documents. A null host is one more host.
    """
    hosts = ruled.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    hosts = materialise(hosts, "hosts")
    raw = F.col("n_failed") / F.col("n_docs")
    chance = F.avg(raw * (1 - raw) / F.greatest(F.col("n_docs") - 1, F.lit(1)))
    mean, variance, size = hosts.agg(F.avg(raw), F.coalesce(F.var_samp(raw), F.lit(0.0)) - chance, F.sum("n_docs")).first()
    if mean is None:  # no hosts
        mean, variance, size = 0.0, 0.0, 1.0
    spread = mean * (1 - mean)
    strength = spread / variance - 1 if 0 < variance < spread else size
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(float(strength)))
    rated = hosts.withColumn("host_rate", rate)
    return rated.select("host", "n_docs", "n_failed", "host_rate", (F.col("host_rate") <= max_rate).alias("host_ok"))


def quality_report(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: the counts, base_failed, kept (false if base_failed, else the host's verdict), host_rate.

    Empty and null texts have no words, so the base rule fails them. Repeated rows are judged as often as they come.
    Columns of `docs` other than doc_id, text and source are ignored. An empty table gives an empty table.
    """
    ruled = with_rules(materialise(document_counts(docs), "counts"))
    hosts = host_verdicts(ruled, max_rate).withColumnRenamed("host", "__host")
    joined = ruled.join(maybe_broadcast(hosts), F.col("host").eqNullSafe(F.col("__host")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_ok")).alias("kept"), "host_rate",
    )
