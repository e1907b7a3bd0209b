"""The thin queries over whole tables, one per operator, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.llm import archive as _archive
from hunkwise.llm import chunks as _chunks
from hunkwise.llm import decontaminate as _decontaminate
from hunkwise.llm import html_text as _html_text
from hunkwise.llm import language as _language
from hunkwise.llm import packing as _packing
from hunkwise.llm import quality as _quality
from hunkwise.llm import simhash as _simhash
from hunkwise.llm import suffix as _suffix
from hunkwise.llm import tokens as _tokens
from hunkwise.llm._shared import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language.identify(table(spark, sf_dir, "documents"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens.count_tokens(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _quality.judge(docs, _quality.learn(docs, table(spark, sf_dir, "labels")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(table(spark, sf_dir, "documents"))


def op8_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _chunks.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html_text.extract(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _archive.archive_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix": op2_suffix,
    "op3_language": op3_language,
    "op4_tokens": op4_tokens,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_pack": op7_pack,
    "op8_chunks": op8_chunks,
    "op9_html": op9_html,
    "op10_warc": op10_warc,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op6_decontaminate": f"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents
        ), items AS (
            SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS v FROM benchmark
        ), sized AS (
            SELECT item, v, least(10, len(v)) AS n FROM items WHERE len(v) > 0
        ), windows AS (
            SELECT DISTINCT item, n, array_to_string(v[i:i + n - 1], ' ') AS win
            FROM (SELECT *, unnest(range(1, len(v) - n + 2)) AS i FROM sized)
        ), places AS (
            SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM sized))
        ), hits AS (
            SELECT DISTINCT row, n, i, item FROM places JOIN windows USING (n, win)
        ), words AS (
            SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS k FROM hits) GROUP BY row
        ), found AS (
            SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY row
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (row) LEFT JOIN found USING (row)
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, sha1(encode(coalesce(html, ''))) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages
        ), t AS (
            SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS top FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
            CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
        FROM t
    """,
}
