"""The queries of the corpus operators, over whole tables with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchyard.llm import jaccard, language, lm, mixing, packing, phrases, quality, slack, suffixes, tiles, topk, toxicity, tries
from matchyard.llm.base import documents
from matchyard.llm.vectors import embeddings


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(embeddings(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, documents(spark, sf_dir), sf_dir)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.near_duplicates(embeddings(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spark, documents(spark, sf_dir), sf_dir, spans=True)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op11_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack.pack(documents(spark, sf_dir))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_ngram_jaccard_join, op3_exact_topk, op4_language_id, op5_quality_classifier, op6_embedding_near_dedup, op7_suffix_dedup, op8_toxicity, op9_source_mixing, op10_lm_scoring, op11_phrase_collocation_mining, op12_packing, op13_conversation_prefix_trie)}

OP9_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(COALESCE(CAST(doc_id AS VARCHAR), '') || ':mix-1') AS key
  FROM documents),
s AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS ix
  FROM sizes GROUP BY source),
w AS (SELECT *, CASE ix % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
r AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio, SUM(source_size) OVER () AS total, SUM(weight) OVER () AS all_weight,
         COALESCE(SUM(cap) OVER e, 0) AS used, COALESCE(SUM(weight) OVER e, 0) AS gone
  FROM w WINDOW e AS (ORDER BY CAST(cap AS DOUBLE) / weight, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, ratio <= CAST(total - used AS DOUBLE) / (all_weight - gone) AS capped FROM r),
l AS (
  SELECT *, SUM(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS capped_size,
         SUM(CASE WHEN capped THEN weight ELSE 0 END) OVER () AS capped_weight FROM c),
t AS (
  SELECT source, ix, total, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
         ELSE CAST(total - capped_size AS DOUBLE) / NULLIF(all_weight - capped_weight, 0) * weight END AS target FROM l),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.ix, t.total, ROW_NUMBER() OVER () AS rowid,
         COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM sizes d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (  -- packets of three copies
  SELECT q.rowid, q.ix, q.target, q.total, c * q.source_size + q.b + k * 128 AS starts, LEAST(128, q.size - k * 128) AS length
  FROM q, UNNEST(range(3)) AS cs(c), UNNEST(range((q.size + 127) // 128)) AS ks(k) WHERE q.size > 0),
f AS (SELECT *, CAST(starts + length AS DOUBLE) / target AS finish FROM p),
g AS (  -- words of all sources that finish earlier
  SELECT rowid, length, total, COALESCE(SUM(length) OVER (ORDER BY finish, ix, starts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sooner
  FROM f),
k AS (SELECT rowid, SUM(GREATEST(0, LEAST(length, total - sooner))) AS taken FROM g GROUP BY rowid)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(COALESCE(k.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k USING (rowid)
"""

OP11_SQL = r"""
WITH w AS (
  SELECT COALESCE(lang, 'und') AS lang, regexp_extract_all(UNNEST(regexp_split_to_array(
         translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws
  FROM documents),
t AS (SELECT lang, CAST(SUM(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (  -- frequencies of one to five words
  SELECT lang, ph, COUNT(*) AS a
  FROM (SELECT lang, list_slice(ws, i, i + k - 1) AS ph FROM w, UNNEST(range(1, 6)) AS ks(k), UNNEST(range(1, len(ws) - k + 2)) AS s(i))
  GROUP BY lang, ph HAVING COUNT(*) >= 100),
c AS (
  SELECT f.lang, f.ph, f.a, x.a AS l, y.a AS r, t.n, k, CAST((1000::HUGEINT * f.a * t.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM f, UNNEST(range(1, len(f.ph))) AS ks(k), f AS x, f AS y, t
  WHERE x.lang = f.lang AND x.ph = list_slice(f.ph, 1, k) AND y.lang = f.lang AND y.ph = list_slice(f.ph, k + 1, len(f.ph)) AND t.lang = f.lang),
b AS (SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
held AS (  -- candidates inside longer ones
  SELECT DISTINCT g.lang, g.ph
  FROM f AS o, UNNEST(range(2, len(o.ph))) AS ks(k), UNNEST(range(1, len(o.ph) - k + 2)) AS s(i), f AS g
  WHERE g.lang = o.lang AND g.ph = list_slice(o.ph, i, i + k - 1) AND 100 * o.a >= 100 * g.a),
e AS (
  SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, b.a, l, r, n, score
  FROM b LEFT JOIN held ON held.lang = b.lang AND held.ph = b.ph WHERE held.ph IS NULL)
SELECT lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM e QUALIFY rank <= 2000
"""

OP13_SQL = r"""
WITH c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS own,
         -- crc32 of the id's digits, bit by bit
         xor(list_reduce(list_prepend(4294967295, flatten([[CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR d IN string_split(CAST(conv_id AS VARCHAR), '')])),
           lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295) % 6 AS h
  FROM (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(COALESCE(list_slice(b.own, 1, c.h), []), list_slice(c.own, c.h + 1, len(c.own))) AS turns
  FROM c LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, turns, d, list_slice(turns, 1, d) AS node FROM r, UNNEST(range(0, len(turns) + 1)) AS ds(d)),
n AS (
  SELECT d, node, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(turns) = d) AS ends
  FROM p GROUP BY d, node),
k AS (SELECT d - 1 AS d, list_slice(node, 1, d - 1) AS node, COUNT(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
v AS (
  SELECT n.*, COALESCE(k.n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * length(n.node[n.d].text) ELSE 0 END AS saved
  FROM n LEFT JOIN k ON k.d = n.d AND k.node = n.node),
s AS (  -- every node to all above it and itself
  SELECT up AS d, list_slice(node, 1, up) AS node, SUM(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, SUM(saved) AS saved_tokens
  FROM v, UNNEST(range(0, d + 1)) AS us(up) GROUP BY 1, 2)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(COALESCE(v.ends, '')) AS ends_sha256
FROM v JOIN s ON s.d = v.d AND s.node = v.node LEFT JOIN n AS u ON u.d = v.d - 1 AND u.node = list_slice(v.node, 1, v.d - 1) AND v.d > 0
"""

ORACLE_SQL = {"op9_source_mixing": OP9_SQL, "op11_phrase_collocation_mining": OP11_SQL, "op13_conversation_prefix_trie": OP13_SQL}
