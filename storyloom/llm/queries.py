"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, cover_tree, line_dedup, minhash, packing, quality_pu, quality_rules, sharding, substring, url_trust
from .common import load

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(load(spark, sf_dir, "documents"))


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality_pu.score_documents(docs, quality_pu.train(docs, load(spark, sf_dir, "labels")))


def op3_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge_pages(load(spark, sf_dir, "pages"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(load(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=2).drop("d", "t")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(load(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup_digest(load(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_digest(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_pu": op2_quality_pu,
    "op3_url_trust": op3_url_trust,
    "op4_cover_tree": op4_cover_tree,
    "op5_sharding": op5_sharding,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, {SPACE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
c AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, c.k IS NULL OR k.doc_id = c.keeper AS stays FROM k LEFT JOIN c ON k.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op6_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({LOWER_SQL}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 2 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id)),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT a AS root, a AS node FROM l UNION SELECT r.root, l.b FROM r JOIN l ON r.node = l.a),
c AS (SELECT root, min(node) AS low FROM r GROUP BY root)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.root = d.doc_id""",
    "op8_substring_dedup": """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
g AS (SELECT doc_id, i, word, CASE WHEN i + 34 <= n THEN
        md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM t),
r AS (SELECT h FROM g WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
m AS (SELECT doc_id, i, word, max(CASE WHEN r.h IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
      FROM g LEFT JOIN r ON g.h = r.h)
SELECT d.doc_id, count(m.word) AS n_words, count(m.word) FILTER (WHERE gone = 1) AS n_removed,
       sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id""",
}
