"""The queries of the training-data operators, with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join, line_dedup, media, mixing, quality_rules, sentencepiece_codec, substring_dedup, token_counts, token_files, toxicity
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_jaccard_join, op3_substring_dedup, op4_quality_rules, op5_media_columns, op6_toxicity, op7_line_dedup, op8_source_mixing, op9_sentencepiece, op10_token_files)
    return {f.__name__: f for f in found}


#: The word break of the contracts, as DuckDB writes it.
_BREAK = r"[\x20\x09-\x0D]+"
_STRIP = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": f"""
            WITH RECURSIVE words AS (
              SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '{_BREAK}'), lambda x: x <> '') AS w FROM documents),
            sets AS (
              SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
            grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
            links AS (
              SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
            reach(doc_id, other) AS (
              SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
            SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
            FROM sets s LEFT JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)""",
        "op3_substring_dedup": f"""
            WITH words AS (
              SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_BREAK}'), lambda x: x <> '') AS w FROM documents),
            windows AS (
              SELECT doc_id, unnest(range(1, greatest(len(w) - 48, 1))) AS i, w FROM words WHERE len(w) >= 50),
            digests AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS d FROM windows),
            firsts AS (SELECT d, min(doc_id) AS least FROM digests GROUP BY d HAVING min(doc_id) < max(doc_id)),
            gone AS (
              SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + 50)) AS p FROM digests x JOIN firsts f ON x.d = f.d AND x.doc_id > f.least),
            cut AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
            kept AS (
              SELECT w.doc_id, len(w.w) AS n, coalesce(len(c.ps), 0) AS r,
                CASE WHEN c.ps IS NULL THEN w.w ELSE (SELECT coalesce(list(u.word ORDER BY u.p), []) FROM (SELECT unnest(w.w) AS word, unnest(range(1, len(w.w) + 1)) AS p) u WHERE NOT list_contains(c.ps, u.p)) END AS k
              FROM words w LEFT JOIN cut c ON c.doc_id = w.doc_id)
            SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept""",
        # A row is a document, so rows are numbered: ids may repeat.
        "op7_line_dedup": f"""
            WITH numbered AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
            lines AS (
              SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM numbered),
            keyed AS (SELECT rid, doc_id, p, line, {_LOWER.format(f"trim(line, {_STRIP})")} AS k FROM lines),
            heavy AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10),
            marked AS (SELECT x.rid, x.doc_id, x.p, x.line, h.k IS NOT NULL AS drop_it FROM keyed x LEFT JOIN heavy h ON x.k = h.k)
            SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(drop_it AS INTEGER)) AS BIGINT) AS n_dropped,
              sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT drop_it), '')) AS kept_sha256
            FROM marked GROUP BY rid, doc_id""",
    }
