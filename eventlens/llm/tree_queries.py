"""Registered queries of the manifest, the license scan and the prefix trie, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import query, table
from eventlens.llm.licenses import BAND, BETWEEN, GRAM, SHARE, TEMPLATES, gram_width, labels_of, scan_licenses, words_of
from eventlens.llm.merkle import leaf_digest, merkle_manifest, proof_digests, verify_manifest
from eventlens.llm.prefix_trie import number_turns, prefix_trie, rebuilt

# CRC-32 in SQL: the table of the reflected polynomial, then a fold over the characters of a decimal number.
_CRC_TABLE = """crc_steps(n, k, c) AS (
  SELECT n, 0, n FROM range(256) t(n)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_steps WHERE k = 8)"""


def _crc(number: str) -> str:
    """Unsigned CRC-32 of the decimal text of ``number``, beside ``crc_table``."""
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(n_chars: str) -> str:
    one = "coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(one.format(c=n_chars if f == 'n_chars' else f) for f in _FIELDS)})"


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of each level of the trees of ``leaves`` (``g, i, h``), with the parent of each, and the steps of proofs."""
    return f"""{name}_n AS (SELECT g, count(*) AS n FROM {leaves} GROUP BY g),
{name}(lvl, g, i, h, n) AS (
  SELECT 0, g, i, h, n FROM {leaves} JOIN {name}_n USING (g)
  UNION ALL
  SELECT DISTINCT lvl + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i) OVER (
      PARTITION BY g, i // 2 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 1) // 2
  FROM {name} WHERE n > 1)"""


@query(f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, '=' || lang AS lang_key, coalesce('=' || lang, '') AS g, n_chars,
    {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN {_crc('doc_id')} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS claim
  FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
leaves AS (SELECT g, pos AS i, leaf AS h FROM placed),
{_tree_sql('low', 'leaves')},
subs AS (SELECT g AS sub, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM low WHERE n = 1),
tops AS (SELECT 'all' AS g, pos AS i, subroot AS h FROM subs),
{_tree_sql('high', 'tops')},
steps AS (
  SELECT p.g, p.pos, t.lvl, (p.pos >> t.lvl) % 2 AS place, s.h AS other
  FROM placed p JOIN low t ON t.g = p.g AND t.i = (p.pos >> t.lvl) AND t.n > 1
  LEFT JOIN low s ON s.g = p.g AND s.lvl = t.lvl AND s.i = xor(t.i, 1)
  UNION ALL
  SELECT p.g, p.pos, 1000 + t.lvl, (u.pos >> t.lvl) % 2, s.h
  FROM placed p JOIN subs u ON u.sub = p.g JOIN high t ON t.i = (u.pos >> t.lvl) AND t.n > 1
  LEFT JOIN high s ON s.lvl = t.lvl AND s.i = xor(t.i, 1)),
proofs AS (
  SELECT g, pos, list({{'place': place, 'other': coalesce(other, '')}} ORDER BY lvl) AS proof,
    sha256(coalesce(string_agg(other, '' ORDER BY lvl), '')) AS proof_sha256
  FROM steps GROUP BY g, pos),
folded AS (
  SELECT p.*, proof_sha256, subroot, (SELECT h FROM high WHERE n = 1) AS root,
    list_reduce(list_prepend({{'place': 0::BIGINT, 'other': coalesce(claim, leaf)}}, coalesce(proof, [])),
      lambda a, s: {{'place': 0::BIGINT, 'other': sha256(
        CASE WHEN s.place = 0 THEN a.other || s.other ELSE s.other || a.other END)}}).other AS folded_root
  FROM placed p LEFT JOIN proofs q ON q.g = p.g AND q.pos = p.pos JOIN subs u ON u.sub = p.g)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = root AS verified
FROM folded
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in _FIELDS]
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_digest(*tampered))
    checked = verify_manifest(merkle_manifest(docs, _FIELDS, claim=claim))
    return checked.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(proof_digests(F.col("proof")), ""), 256).alias("proof_sha256"),
        "folded_root", "verified",
    )


def _license_sql() -> str:
    """The scan by grams as texts, their diagonals as groups and the covered words as rows."""
    values = ", ".join(
        f"({n}, '{t.label}', {'true' if t.base else 'false'}, {gram_width(len(words_of(t.text)), GRAM)}, "
        f"string_split('{' '.join(words_of(t.text))}', ' '))" for n, t in enumerate(TEMPLATES)
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH t(template, label, base, width, tw) AS (VALUES {values}),
d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{BETWEEN}'),
    lambda x: x <> '') AS w FROM documents),
tg AS (
  SELECT template, width, len(tw) AS n, p AS place, array_to_string(tw[p + 1:p + width], ' ') AS gram
  FROM (SELECT *, unnest(range(len(tw) - width + 1)) AS p FROM t)),
dg AS (
  SELECT doc_id, width, i AS start, array_to_string(w[i + 1:i + width], ' ') AS gram
  FROM (SELECT doc_id, w, width, unnest(range(len(w) - width + 1)) AS i FROM d, (SELECT DISTINCT width FROM t))),
votes AS (SELECT doc_id, template, width, n, place, start, start - place AS diagonal FROM dg JOIN tg USING (width, gram)),
lines AS (SELECT DISTINCT doc_id, template, diagonal FROM votes),
cut AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER v <= {BAND} AND NOT base THEN 0 ELSE 1 END AS opens
  FROM lines JOIN t USING (template) WINDOW v AS (PARTITION BY doc_id, template ORDER BY diagonal)),
bands AS (SELECT doc_id, template, base, label, diagonal, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS band FROM cut),
voted AS (SELECT * FROM votes JOIN bands USING (doc_id, template, diagonal)),
ends AS (
  SELECT doc_id, template, band, any_value(base) AS base, any_value(label) AS label, any_value(n) AS n, any_value(width) AS width,
    min(start) AS s, max(start) + any_value(width) AS e, count(DISTINCT place) AS places
  FROM voted GROUP BY doc_id, template, band),
words AS (SELECT DISTINCT doc_id, template, band, unnest(range(place, place + width)) AS word FROM voted),
covered AS (SELECT doc_id, template, band, count(*) AS covered FROM words GROUP BY ALL),
found AS (
  SELECT *, covered / n AS coverage FROM ends JOIN covered USING (doc_id, template, band)
  WHERE CASE WHEN base THEN places = n - width + 1 ELSE covered / n >= {SHARE} AND e - s <= ceil(n / {SHARE}) + {BAND} END),
told AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN told USING (doc_id)"""


@query(_license_sql())
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), TEMPLATES)
    bases = [n for n, t in enumerate(TEMPLATES) if t.base]
    base = F.filter("spans", lambda s: s["template"].isin(bases))
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels_of(base, TEMPLATES).alias("base_labels"),
        labels_of(F.col("spans"), TEMPLATES).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


@query(f"""
WITH RECURSIVE {_CRC_TABLE},
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc('conv_id')} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc_table),
built AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth,
    sha256(strlen(role) || ':' || role || text) AS said, length(text) AS chars FROM built),
paths AS (
  SELECT conv_id, depth, chars, list(said) OVER (
    PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
lasts AS (SELECT conv_id, max(depth) AS last FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, any_value(p.depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE p.depth = last), '')) AS ends_sha256
  FROM paths p JOIN lasts USING (conv_id) GROUP BY path),
kids AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
up AS (SELECT path[:d] AS path, n_children, (n_convs - 1) * chars AS saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM full_nodes)),
totals AS (SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_nodes n JOIN totals USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    turns, convs = rebuilt(
        number_turns(table(spark, sf_dir, "conversations")), F.crc32(conv.cast("string")) % 6, conv - conv % 100,
    )
    return prefix_trie(turns, convs)
