"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dominance, hard_negatives, language_id, line_dedup, minhash, packing, pii, spherical, token_counts, url_filter, vamana, warc
from . import pipeline as stages
from .common import Workspace, bound_batches, table_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Verdict, host and path of the rules for addresses.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def op1_spherical_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.similar_vectors(_table(spark, sf_dir, "embeddings"), Workspace(spark, "op1"))


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), Workspace(spark, "op3"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, removed_lines (disjoint ranges a-b), text_sha256 of what is left (null text: empty)."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "op5"))
    return out.select("doc_id", "n_lines", F.col("removed_runs").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), Workspace(spark, "op6"), declared="lang", host="source")


def op7_vamana_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.nearest(_table(spark, sf_dir, "embeddings"), Workspace(spark, "op7"), F.col("vec_id") % 50 == 0)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), WORD_BPE)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), Workspace(spark, "op9"), size=4).drop("group_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), Workspace(spark, "op10"), BYTE_BPE)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [F.struct(*[F.lit(x).alias(name) for name, x in zip(("verdict", "host", "path"), rule, strict=True)]) for rule in RULES]
    rules = spark.range(1).select(F.inline(F.array(*rows)))
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules, Workspace(spark, "op11"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), Workspace(spark, "op12"), F.col("vec_id") % 100 == 0, label)


def op13_dominance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = _table(spark, sf_dir, "sales")
    day, level, weight = dominance.day_of("sold_at", sales), dominance.level_of(F.col("total")), dominance.repeats_of(F.col("sale_id"))
    found = dominance.count_above(sales.select("sale_id", "sold_at", "total"), Workspace(spark, "op13"), day, level, weight)
    return found.select("sale_id", "slot", "level", "n_sales", "n_rows")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and what op6 gives, over pages, which have markup, addresses and hosts."""
    html, url = F.col("html"), F.col("url")
    found = language_id.identify(_table(spark, sf_dir, "pages"), Workspace(spark, "op6-pages"), language_id.markup_language(html), language_id.host_of(url), url, "page_id", language_id.visible_text(html))
    return found.withColumnRenamed("doc_id", "page_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_spherical_near_dedup, op2_skip_chain_pii, op3_warc_round_trip, op4_bpe_round_trip, op5_line_dedup, op6_language_id, op7_vamana_neighbours, op8_token_counts, op9_minhash_near_dedup, op10_best_fit_packing, op11_url_filter, op12_hard_negatives, op13_dominance_counts, language_id_pages, pipeline)
    return {f.__name__: f for f in named}


#: Records of equal payloads of at least 1000 bytes refer to the one with the largest page_id.
OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
g AS (SELECT digest, max(page_id) AS whole FROM p WHERE n >= 1000 GROUP BY digest)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN g.whole IS NULL OR p.page_id = g.whole THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.whole IS NULL OR p.page_id = g.whole THEN NULL ELSE g.whole END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND p.n >= 1000
"""

#: All pairs of one label, components by repeated minima.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(coalesce(c.b, e.vec_id), e.vec_id) AS component_id,
       least(coalesce(c.b, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

#: Exact shingle sets and all pairs that share a shingle, components by reachability.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
k AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
x AS (SELECT id, n, unnest(s) AS g FROM k),
p AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
d AS (
  SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least(c.b, k.id), k.id, s.doc_id) AS component_id
  FROM s LEFT JOIN k ON k.s = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN c ON c.a = k.id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM d
"""

#: All rules beside each address.
OP11_SQL = """
WITH u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r FROM pages),
h AS (SELECT n, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(v, rh, rp) AS (VALUES RULES)
SELECT page_id, host, path, rh || rp AS rule, coalesce(v, 'allow') AS verdict
FROM h LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC NULLS LAST) = 1
""".replace("RULES", ", ".join(str(r) for r in RULES))

#: All anchors beside all rows.
OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""

#: Pairs of distinct points. A crc32 by its definition, byte by byte and bit by bit.
OP13_SQL = """
WITH k AS (
  SELECT sale_id, CAST(date_diff('day', DATE '1970-01-01', CAST(sold_at AS DATE)) AS BIGINT) AS slot, CAST(floor(floor(100 * total + 0.5) / 1000) AS BIGINT) AS level,
         list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))) AS crc FROM sales),
r AS (SELECT *, 1 + coalesce(xor(crc, CAST(4294967295 AS BIGINT)), 0) % 3 AS w FROM k),
p AS (SELECT slot, level, count(*) AS n, sum(w) AS w FROM r WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level),
a AS (SELECT p.slot, p.level, coalesce(sum(q.n), 0) AS n, coalesce(sum(q.w), 0) AS w FROM p LEFT JOIN p q ON q.slot <= p.slot AND q.level > p.level GROUP BY p.slot, p.level)
SELECT sale_id, r.slot, r.level, CAST(a.n AS BIGINT) AS n_sales, CAST(a.w AS BIGINT) AS n_rows FROM r LEFT JOIN a ON a.slot = r.slot AND a.level = r.level
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_spherical_near_dedup": OP1_SQL,
        "op3_warc_round_trip": OP3_SQL,
        "op9_minhash_near_dedup": OP9_SQL,
        "op11_url_filter": OP11_SQL,
        "op12_hard_negatives": OP12_SQL,
        "op13_dominance_counts": OP13_SQL,
    }
