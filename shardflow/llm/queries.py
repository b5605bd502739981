"""The registered queries of this folder, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.llm import bpe, fingerprints, mixing, near_dedup, perplexity, quality, secrets, sharding, suffix_dedup, token_counts
from shardflow.llm.common import documents

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

SHARDS = 24


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(documents(spark, sf_dir)).drop("removed")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), BPE_RANKS, public_tokenizers.PATTERN)


def held_out(name: str = "doc_id"):
    return F.crc32(F.col(name).cast("string")) % 3 == 1


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Learnt from the rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.fit(documents(spark, sf_dir), labels.where(~held_out()))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(documents(spark, sf_dir), quality_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), PIECES)


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), sharding.Tree.even(SHARDS))


def op9_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judged(documents(spark, sf_dir))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_byte_bpe, op3_quality_classifier, op4_source_mixing, op5_quartile_digest, op6_secret_scan, op7_token_counts, op8_hash_tree_sharding, op9_ngram_perplexity, op10_minhash_near_dedup)}


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents),
sums AS (SELECT src, CAST(SUM(size) AS BIGINT) AS total FROM sized GROUP BY src),
ordered AS (
  SELECT src, total, 3.0::DOUBLE * total AS lim,
         CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sums),
levels AS (
  SELECT *, (SUM(total) OVER () * 1.0::DOUBLE
             - COALESCE(SUM(lim) OVER (ORDER BY lim / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / SUM(w) OVER (ORDER BY lim / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ordered),
found AS (SELECT arg_min(level, (lim / w, src)) AS level FROM levels WHERE level <= lim / w),
aims AS (SELECT src, total, LEAST(lim, COALESCE((SELECT level FROM found) * w, lim)) AS target FROM levels),
placed AS (
  SELECT doc_id, size, total, target, LEAST(CAST(floor(target + 0.5) AS BIGINT), 3 * total) AS budget,
         CAST(COALESCE(SUM(size) OVER (PARTITION BY src ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM sized JOIN aims USING (src))
SELECT doc_id, size, total AS source_size, target,
       CAST(CASE WHEN total = 0 THEN 0 ELSE budget // greatest(total, 1) * size
            + GREATEST(0, LEAST(budget - budget // greatest(total, 1) * total - place, size)) END AS BIGINT) AS taken
FROM placed
"""


def _tree_sql(name: str, tree: sharding.Tree) -> str:
    """Tables with the shard of each key: three draws, each among the children of the node drawn before."""
    nodes = ", ".join(f"('{parent}', '{node}', {weight!r}::DOUBLE, {value})" for parent, node, weight, value in sharding.nodes_of(tree))
    draw = "-ln((CAST('0x' || substr(md5(n.node || ':' || d.k), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / n.weight"
    out = f"{name}_nodes(parent, node, weight, value) AS (VALUES {nodes}),\n{name}_0 AS (SELECT DISTINCT k, '' AS node, 0 AS value FROM keyed)"
    for level in (1, 2, 3):
        out += f",\n{name}_{level} AS (SELECT d.k, arg_min(n.node, {draw}) AS node, arg_min(n.value, {draw}) AS value FROM {name}_{level - 1} d JOIN {name}_nodes n ON n.parent = d.node GROUP BY d.k)"
    return out


def op8_sql(shards: int = SHARDS, buckets: int = 512) -> str:
    tree = sharding.Tree.even(shards)
    return f"""
WITH RECURSIVE steps AS (
  SELECT i, CAST(i AS BIGINT) AS v, 0 AS n FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM steps WHERE n < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE n = 8),
keyed AS (
  SELECT doc_id, COALESCE(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(COALESCE(text, ''))) AS h FROM documents),
{_tree_sql("now", tree)},
{_tree_sql("grown", tree.grown())},
sized AS (
  SELECT doc_id, k, CAST(len(h) // 2 + 8 AS BIGINT) AS size,
         xor(list_reduce(list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
                         lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM keyed, crc_table),
dealt AS (SELECT *, CAST('0x' || substr(md5('slot:' || k || ':' || CAST(text_crc32 AS VARCHAR)), 1, 7) AS BIGINT) % {buckets} AS bucket FROM sized)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(n.value AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY n.value ORDER BY bucket, k, size, text_crc32) - 1 AS slot,
       CAST(g.value AS INTEGER) AS grown_shard
FROM dealt JOIN now_3 n USING (k) JOIN grown_3 g USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mixing": OP4_SQL, "op8_hash_tree_sharding": op8_sql()}
