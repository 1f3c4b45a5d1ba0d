"""The registered queries of these operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeflow.llm import (
    bpe, credentials, fuzzy_lines, html_suffix, iblt, mixing, nn_descent, ordinal, piece_bpe, prefix_trie, shards, trie_simhash, whitening,
)
from cladeflow.llm.common import WORD, table


def op1_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_suffix.main_text(table(spark, sf_dir, "pages"))


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.minimax_shards(table(spark, sf_dir, "documents"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.vector_groups(table(spark, sf_dir, "embeddings")).drop("audited_recall")


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = ordinal.train(docs, labels.select("doc_id", ordinal.grade_of(F.col("quality"), F.col("toxic")).alias("grade")))
    graded = ordinal.grade(docs.select("doc_id", "text"), model)
    return graded.select("row.doc_id", "expected_grade", "tail_1", "tail_2", (F.col("tail_2") >= 0.5).alias("kept"))


def op5_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secret_report(table(spark, sf_dir, "documents"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.length(kept).cast("long").alias("n_chars"), F.sha2(kept, 256).alias("text_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_trie_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = trie_simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("row.doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = piece_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_host_suffix_array, op2_minimax_shards, op3_nn_descent, op4_ordinal_quality, op5_credential_links, op6_fuzzy_lines, op7_bpe,
        op8_trie_simhash, op9_source_mix, op10_iblt, op11_spectrum_whitening, op12_prefix_trie, op13_piece_bpe,
    )
}

_OP9 = f"""
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, [{', '.join(map(str, mixing.WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight FROM totals),
filled AS (SELECT *, {mixing.MOST} * source_size / weight AS level FROM ranked),
levels AS (
  SELECT level AS reached,
         ({mixing.SHARE} * (SELECT sum(source_size) FROM filled) - {mixing.MOST} * (SELECT coalesce(sum(source_size), 0) FROM filled f WHERE f.level < g.level))
           / (SELECT sum(weight) FROM filled f WHERE f.level >= g.level) AS found
  FROM filled g),
chosen AS (SELECT coalesce(arg_min(found, reached) FILTER (WHERE found < reached), CAST('Infinity' AS DOUBLE)) AS level FROM levels),
targets AS (
  SELECT source, source_size, CAST(least({mixing.MOST} * source_size, chosen.level * weight) AS DOUBLE) AS target FROM filled, chosen),
rates AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(target / source_size, CAST({mixing.MOST} AS DOUBLE)) ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {mixing.DIGITS})) AS BIGINT)
           / {float(16**mixing.DIGITS)!r} AS draw
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rates"""

# The least capacity follows from the best split of each prefix of groups into k runs, which needs no search.
_STEPS = "".join(
    f""",
d{k} AS MATERIALIZED (SELECT g.i, min(greatest(d.cap, g.ends - h.ends)) AS cap FROM g JOIN d{k - 1} d ON d.i <= g.i JOIN g0 h ON h.i = d.i GROUP BY g.i
  UNION ALL SELECT 0, 0)"""
    for k in range(2, shards.SHARDS + 1)
)
_OP2 = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS key,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS slot_key FROM documents),
crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (SELECT key, hex(encode(text)) AS h FROM docs GROUP BY ALL),
crcs AS MATERIALIZED (
  SELECT key, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS crc FROM bytes, crc_table),
g AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY key) AS i, key, sum(sum(size)) OVER (ORDER BY key) AS ends FROM docs GROUP BY key),
g0 AS MATERIALIZED (SELECT i, ends FROM g UNION ALL SELECT 0, 0),
d1 AS MATERIALIZED (SELECT i, ends AS cap FROM g0){_STEPS},
best AS (SELECT cap FROM d{shards.SHARDS} ORDER BY i DESC LIMIT 1),
cuts AS (
  SELECT 0 AS k, CAST(0 AS HUGEINT) AS cut
  UNION ALL SELECT k + 1, (SELECT max(ends) FROM g0 WHERE ends <= cut + (SELECT cap FROM best)) FROM cuts WHERE k < {shards.SHARDS - 1}),
placed AS (
  SELECT d.*, (SELECT count(*) FROM cuts WHERE k > 0 AND g.ends > cut) AS shard FROM docs d JOIN g ON d.key = g.key)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY slot_key, p.key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed p JOIN crcs ON p.key = crcs.key"""

_OP3 = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok
  AND list_cosine_similarity(a.e, b.e) >= {nn_descent.THRESHOLD}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
parts AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN parts ON vec_id = parts.x LEFT JOIN degrees ON vec_id = degrees.x"""

# The trie by its paths of turn digests: sums over a subtree go to all beginnings of each path.
_OP12 = f"""
WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || ' ' || length(coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, hex(encode(CAST(conv_id AS VARCHAR))) AS h FROM turns),
crcs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % {prefix_trie.HEADS} AS heads FROM ids, crc_table),
joined AS (
  SELECT c.conv_id, 0 AS own, b.pos, b.t FROM crcs c JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % {prefix_trie.FAMILY} AND b.pos <= heads
  UNION ALL SELECT c.conv_id, 1, b.pos, b.t FROM crcs c JOIN turns b ON b.conv_id = c.conv_id AND b.pos > heads),
rebuilt AS (
  SELECT conv_id, coalesce(list(t ORDER BY own, pos) FILTER (WHERE t IS NOT NULL), []) AS path FROM (
    SELECT * FROM joined UNION ALL SELECT conv_id, 2, NULL, NULL FROM crcs) GROUP BY conv_id),
prefixes AS (SELECT conv_id, d, path[1:d] AS path, d = len(path) AS ends FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY path, d),
children AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
parts AS (
  SELECT nodes.path, nodes.d, (n_convs - 1) * CAST(split_part(nodes.path[nodes.d], ' ', 2) AS BIGINT) AS saved, children.n IS NULL AS leaf
  FROM nodes LEFT JOIN children ON nodes.path = children.path),
sums AS (
  SELECT path[1:j] AS path, sum(saved) AS saved, count_if(leaf) AS leaves
  FROM (SELECT *, unnest(range(d + 1)) AS j FROM parts) GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(coalesce(s.saved, 0) AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON n.path = s.path LEFT JOIN children c ON n.path = c.path LEFT JOIN nodes p ON n.d > 0 AND p.path = n.path[1:n.d - 1]"""

ORACLES = {"op2_minimax_shards": _OP2, "op3_nn_descent": _OP3, "op9_source_mix": _OP9, "op12_prefix_trie": _OP12}
