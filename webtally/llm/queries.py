"""The registered query of each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import anchors, bpe_codec, clustering, decontaminate, edit_embedding, negatives, pii, quality, repeats, sharding, simhash, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_run_length_index")
def _(spark, sf_dir):
    return repeats.without_repeats(table(spark, sf_dir, "documents"), 400).drop("spans")


@query("op2_token_counts")
def _(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


@query("op3_surrogates")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs, "corpus key 1").select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), F.array_join("entities", ",").alias("kinds"))


@query("op4_block_anchors")
def _(spark, sf_dir):
    return anchors.first_occurrences(table(spark, sf_dir, "documents")).drop("removed")


@query("op5_simhash_pivots")
def _(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUALITY_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
 list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM rows),
windows AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM parts)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT w) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS w FROM again) GROUP BY r),
measured AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM parts LEFT JOIN covered USING (r)),
bits AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (word_chars < 2 * n_words)::BIGINT
 + 8 * (word_chars > 20 * n_words)::BIGINT + 16 * (10 * n_symbols > n_words)::BIGINT + 32 * (10 * n_dup_lines > 3 * n_lines)::BIGINT AS failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, n_lines, failed FROM bits
"""


@query("op6_quality_rules", QUALITY_SQL)
def _(spark, sf_dir):
    rows = quality.judged(quality.ledger(table(spark, sf_dir, "documents")), "v2")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed"
    )


def _ablations_sql() -> str:
    counts = [
        f"SELECT '{policy}' AS policy, '{name}' AS rule, count(*) FILTER (failed & {bits} <> 0) AS rejected, count(*) FILTER (failed & {1 << bit} <> 0) AS failed_rule,"
        f" count(*) FILTER (failed & {bits} = {1 << bit}) AS only_this_rule FROM ledger"
        for policy, bits in quality.POLICIES.items() for bit, name in enumerate(quality.NAMES) if bits >> bit & 1
    ]
    return f"WITH ledger AS MATERIALIZED ({QUALITY_SQL}) " + " UNION ALL ".join(counts)


@query("op6_rule_ablations", _ablations_sql())
def _(spark, sf_dir):
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


@query("op7_sampled_splitters")
def _(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


@query("op8_fm_index")
def _(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@query("op9_bpe_codec")
def _(spark, sf_dir):
    return bpe_codec.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_toxicity")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), 0.3)


NEGATIVES_SQL = """
WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
 list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
 FROM kept a JOIN kept r ON r.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM near JOIN scored s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op11_multi_index", NEGATIVES_SQL)
def _(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query("op12_edit_embedding")
def _(spark, sf_dir):
    return edit_embedding.with_edits(table(spark, sf_dir, "documents"))


def _round(n: int) -> str:
    """One round of assignments to the centroids ``c{n}``, and the centroids after it."""
    return f"""
a{n} AS (SELECT v.vec_id, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT AS distance
 FROM kept v CROSS JOIN c{n} c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY distance, c.k) = 1),
m{n} AS (SELECT k, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{n} JOIN kept USING (vec_id) CROSS JOIN range(1, 65) t(i) GROUP BY k, i),
c{n + 1} AS (SELECT k, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN
 (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM m{n} GROUP BY k) m USING (k))"""


CLUSTERS_SQL = f"""
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
 WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, q FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16),
{",".join(_round(n) for n in range(4))}
SELECT vec_id, k::INT AS cluster, distance, sum(distance) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
 sha256(array_to_string(q, ',')) AS centroid_sha256 FROM a3 JOIN c3 USING (k)
"""


@query("op13_threshold_centroids", CLUSTERS_SQL)
def _(spark, sf_dir):
    return clustering.cluster(table(spark, sf_dir, "embeddings"))
