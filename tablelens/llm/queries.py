"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import collocations, exact_dedup, licences, line_dedup, mixing, packing, quality, simhash, spelling, substring, suffix_dedup, tokens, toxicity
from tablelens.llm.common import read_documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_groups(read_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_documents(spark, sf_dir))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read_documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_documents(spark, sf_dir)).drop("host_rate")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(read_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: a source's languages are its directories."""
    docs = read_documents(spark, sf_dir)
    none = F.lit("unknown")  # concat_ws would leave out what is null and move the document up
    path = F.concat_ws("/", F.coalesce("source", none), F.coalesce("lang", none), F.coalesce(F.col("doc_id").cast("string"), none))
    return licences.licence_scan(docs.select("doc_id", "text", path.alias("path")))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_documents(spark, sf_dir))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_license_scan": op8_license_scan,
    "op9_source_mixing": op9_source_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": r"""
        WITH w AS (
            SELECT doc_id, source, coalesce(text, '') AS body,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        win AS (
            SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS win
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
        rep AS (
            SELECT doc_id, count(DISTINCT i + k) AS n
            FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win), range(5) AS r(k)
            WHERE c > 1 GROUP BY doc_id),
        ln AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n
            FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM w)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        c AS (
            SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words,
                   length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                   length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
        r AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                   n_words < 10 OR 100 * n_repeat_words > 20 * n_words
                   OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 10 * n_words AS failed
            FROM c),
        h AS (SELECT source, count(*) AS n, sum(failed::INT) AS f, sum(failed::INT) / count(*) AS p FROM r GROUP BY source),
        m AS (SELECT avg(p) AS m, coalesce(var_samp(p), 0) - avg(p * (1 - p) / greatest(n - 1, 1)) AS v, sum(n) AS size FROM h),
        b AS (SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE size END AS s FROM m),
        ok AS (SELECT source, (f + m * s) / (n + s) <= 0.5 AS host_ok FROM h, b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND host_ok AS kept
        FROM r JOIN ok ON r.source IS NOT DISTINCT FROM ok.source""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_source_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT AS w
            FROM d GROUP BY source),
        o AS (
            SELECT *, sum(3 * source_size) OVER before AS taken, sum(w) OVER (ORDER BY 3 * source_size / w DESC, source) AS w_left,
                   sum(source_size) OVER () AS total
            FROM s WINDOW before AS (ORDER BY 3 * source_size / w, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, 3 * source_size * w_left <= w * (total - coalesce(taken, 0)) AS capped FROM o),
        l AS (
            SELECT (any_value(total) - coalesce(sum(3 * source_size) FILTER (capped), 0))::BIGINT
                   / sum(w) FILTER (NOT capped) AS level
            FROM c),
        t AS (
            SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE level::DOUBLE * w END AS target
            FROM c, l),
        r AS (
            SELECT doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                   row_number() OVER (PARTITION BY d.source ORDER BY size, md5('mix:' || doc_id), doc_id) AS k,
                   ('0x' || substr(md5('mix:' || coalesce(d.source, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (size * (floor(rate) + floor(u + k * (rate - floor(rate))) - floor(u + (k - 1) * (rate - floor(rate)))))::BIGINT AS taken
        FROM r""",
    "op11_collocations": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
            FROM documents),
        p AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
            FROM (SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
        g AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
        t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY 1),
        c AS (
            SELECT * FROM f WHERE k >= 2 AND NOT EXISTS (
                SELECT 1 FROM f AS l
                WHERE l.lang = f.lang AND l.k > f.k AND l.a >= f.a AND contains(' ' || l.phrase || ' ', ' ' || f.phrase || ' '))),
        u AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM c),
        s AS (
            SELECT u.lang, u.phrase, u.a, l.a AS l, r.a AS r, t.n, cut,
                   ((1000::HUGEINT * u.a * t.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
            FROM u JOIN t ON t.lang = u.lang
                JOIN f AS l ON l.lang = u.lang AND l.k = cut AND l.phrase = array_to_string(w[1:cut], ' ')
                JOIN f AS r ON r.lang = u.lang AND r.k = u.k - cut AND r.phrase = array_to_string(w[cut + 1:], ' ')
            QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, cut) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM s QUALIFY rank <= 2000""",
    "op13_suffix_dedup": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (
            SELECT r, doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 100 <= len(h) THEN substr(h, 2 * i + 1, 100) END AS s
            FROM (SELECT *, unnest(range(len(h) // 2)) AS i FROM d)),
        m AS (SELECT *, s IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY s) AS starts FROM w),
        c AS (SELECT *, bool_or(starts) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM c),
        s AS (
            SELECT r, count_if(gone) AS n_removed, count_if(begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept
            FROM e GROUP BY r)
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN s USING (r)""",
}
