"""Registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.bpe import decode_column, encode_column
from eventlens.llm.chat_format import digest_chats, format_chats, read_chats
from eventlens.llm.common import ORACLES, QUERIES, query, table
from eventlens.llm.embedding_dedup import embedding_dedup
from eventlens.llm.exact_dedup import exact_dedup
from eventlens.llm.line_dedup import line_dedup
from eventlens.llm import tree_queries  # noqa: F401  registers its queries
from eventlens.llm.packing import pack
from eventlens.llm.quality import score_quality, train
from eventlens.llm.secrets import BASE, KINDS, LINE_END, WEAK, scan_secrets, span_list
from eventlens.llm.simhash import simhash_dedup
from eventlens.llm.url_filter import filter_urls

__all__ = ["ORACLES", "QUERIES"]


@query("""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_hash")).alias("text_sha256"),
    )


@query("""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM split),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS max_doc FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.line, k.place, s.key IS NOT NULL AND k.doc_id < s.max_doc AS drops
  FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drops) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT drops), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode_column(table(spark, sf_dir, "documents"), path)
    return decode_column(encoded, path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text_bytes", 256).alias("decoded_sha256"),
    )


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )


def _secret_sql() -> str:
    """The scan by DuckDB: matches and gaps as lists, and a plain range join for the links."""
    patterns = {k: (pattern, group, least) for k, (pattern, group, least) in BASE.items()}
    patterns |= {k: (pattern, 0, 0) for k, pattern in WEAK.items()}
    patterns["line_end"] = (LINE_END, 0, 0)
    kinds = [*KINDS, "line_end"]
    scans = []
    for kind, (pattern, group, least) in patterns.items():
        quoted = "'" + pattern.replace("'", "''") + "'"
        scans.append(f"""SELECT doc_id, {kinds.index(kind)} AS kind, string_split_regex(t, {quoted}) AS gaps,
    regexp_extract_all(t, {quoted}, 0) AS hits, regexp_extract_all(t, {quoted}, {group}) AS counted, {least} AS least FROM d""")
    secrets = ", ".join(str(KINDS.index(k)) for k in ("assign", "hex", "weak_secret"))
    ids = ", ".join(str(KINDS.index(k)) for k in ("access", "weak_id"))

    def near(kinds: str) -> str:
        return f"""EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = p.doc_id AND o.kind IN ({kinds})
      AND (o.s <= p.e + 200 AND o.e >= p.s - 200 OR o.block = p.block AND o.line <> p.line) AND (o.e <= p.s OR o.s >= p.e))"""

    wanted = f"""CASE {KINDS.index('weak_secret')} WHEN kind THEN {near(ids)} ELSE
      CASE {KINDS.index('weak_id')} WHEN kind THEN {near(secrets)} ELSE {near(ids)} AND {near(secrets)} END END"""
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = f"{names}[kind + 1] || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {KINDS.index(k)}) AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
scans AS ({" UNION ALL ".join(scans)}),
placed AS (
  SELECT doc_id, kind, gaps, hits, least, unnest(range(len(hits))) AS i, unnest(counted) AS c FROM scans WHERE len(hits) > 0),
spans AS (
  SELECT doc_id, kind, s, s + length(hits[i + 1]) AS e FROM (
    SELECT *, CAST(list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) +
      coalesce(list_sum(list_transform(hits[1:i], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM placed) WHERE length(c) >= least),
parts AS (
  SELECT * FROM (SELECT *, count(*) FILTER (WHERE kind = {len(KINDS)}) OVER before AS line,
    count(*) FILTER (WHERE kind = {len(KINDS)} AND e - s > 1) OVER before AS block FROM spans
    WINDOW before AS (PARTITION BY doc_id ORDER BY CASE kind WHEN {len(KINDS)} THEN e ELSE s END, kind <> {len(KINDS)}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE kind < {len(KINDS)}),
base AS (SELECT * FROM parts WHERE kind < {len(BASE)}),
extra AS (
  SELECT DISTINCT p.* FROM parts p WHERE kind >= {len(BASE)} AND ({wanted})
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.s <= p.s AND b.e >= p.e)),
bases AS (SELECT doc_id, {counts}, string_agg({text}, ',' ORDER BY s, kind, e) AS listed FROM base GROUP BY doc_id),
listing AS (
  SELECT doc_id, string_agg({text}, ',' ORDER BY s, kind, e) AS spans
  FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
  sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN bases USING (doc_id) LEFT JOIN listing USING (doc_id)"""


@query(_secret_sql())
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"),
    )


# The rules of the query, as verdict, host and path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

_URL_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, coalesce(html, '') AS html,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
judged AS (
  SELECT p.page_id, p.host, p.path,
         arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule,
         arg_max(r.verdict, length(r.rule_host || r.rule_path)) AS rule_verdict
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR suffix(p.host, '.' || r.rule_host)) AND prefix(p.path, r.rule_path)
  GROUP BY ALL),
hosts AS (
  SELECT host, avg((rule_verdict IS NOT DISTINCT FROM 'allow')::INT) AS allowed,
         avg((rule_verdict IS NOT DISTINCT FROM 'block')::INT) AS blocked
  FROM judged WHERE host <> '' GROUP BY host),
seed_hosts AS (
  SELECT 'trust' AS kind, host FROM hosts WHERE allowed > 0.5
  UNION ALL SELECT 'distrust', host FROM hosts WHERE blocked > 0.5),
seeds AS (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS seed FROM seed_hosts),
addresses AS (
  SELECT host AS source,
         unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''\s>]+)', 1)) AS target
  FROM parts),
links AS (
  SELECT source, translate(target, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target, count(*) AS links
  FROM addresses GROUP BY ALL),
edges AS (
  SELECT 'trust' AS kind, source AS a, target AS b, links FROM links WHERE source <> '' AND source <> target
  UNION ALL SELECT 'distrust', target, source, links FROM links WHERE source <> '' AND source <> target),
steps AS (SELECT kind, a, b, 0.85::DOUBLE * links / sum(links) OVER (PARTITION BY kind, a) AS weight FROM edges),
walk AS (
  SELECT 0 AS n, kind, host, 0.15::DOUBLE * seed AS score FROM seeds
  UNION ALL
  SELECT n + 1, s.kind, s.b, sum(s.weight * w.score) FROM walk w JOIN steps s ON s.kind = w.kind AND s.a = w.host
  WHERE n < 400 GROUP BY n, s.kind, s.b),
scores AS (
  SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust,
         coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS distrust
  FROM walk GROUP BY host)
SELECT page_id, j.host, path, rule,
       coalesce(rule_verdict, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN scores s ON s.host = j.host
"""


@query(_URL_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest_chats(read_chats(format_chats(turns, path), path))


@query("""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
usable AS (SELECT * FROM v WHERE size > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)
""")
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
