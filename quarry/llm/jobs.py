"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_path
from . import (bpe, collision_ann, exact_topk, langid, line_dedup, mixing, ngram_lm, sharding, simhash, suffix_dedup,
               token_output, whitening, zone_clustering)
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text, and the digest of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    done = bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to a mix of 150 % of all words, sources weighing 3, 1, 2."""
    plan = mixing.mix_decisions(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5, most=2.0)
    each = plan.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    copies = F.col("copies") + F.when(F.col("_row") <= F.col("extra"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: each document's place, length and checksum."""
    path = checkpoint_path(spark, "token-files", unique=True)
    token_output.write_tokens(table(spark, sf_dir, "documents"), path,
                              public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_output.token_index(spark, path)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole text under an n-gram model of nine tenths of the documents."""
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 10, 0)
    return ngram_lm.score_documents(docs.select("doc_id", held.alias("held_out"), "text"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors, as found, for every vector whose id is divisible by 20."""
    found = collision_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products for every vector whose id is divisible by 50."""
    found = exact_topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from two thirds of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of all documents by a permutation of their row numbers (law: rows)."""
    placed = sharding.document_shards(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left when strings of 100 bytes that start earlier are removed."""
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document, and the smallest doc_id reachable over links of 4 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of 40 code points that 5 documents hold, but for the last holder."""
    done = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=5, min_chars=40)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), spread AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.holder AS gone
  FROM k LEFT JOIN spread s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 centroids of all vectors of 64 components after 3 rounds, and each vector's nearest."""
    done = zone_clustering.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, seed=1)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return done.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _op12_sql(rounds: int = 3) -> str:
    near = """
  SELECT vec_id, dims, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.vec_id, v.dims, m.c,
           list_sum(list_transform(list_zip(v.dims, m.dims), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM v, {centroids} m) GROUP BY vec_id, dims"""
    steps = ["""v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS dims
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""", """m0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS c, dims FROM v
  QUALIFY c < 16
)"""]
    for i in range(rounds):
        steps.append(f"a{i} AS ({near.format(centroids=f'm{i}')})")
        steps.append(f"""m{i + 1} AS (
  SELECT o.c, coalesce(n.dims, o.dims) AS dims FROM m{i} o LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS dims FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n
      FROM (SELECT c, unnest(dims) AS x, generate_subscripts(dims, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c
  ) n ON n.c = o.c
)""")
    steps.append(f"a AS ({near.format(centroids=f'm{rounds}')})")
    return "WITH " + ", ".join(steps) + f"""
SELECT a.vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.dims, ',')) AS centroid_sha256
FROM a JOIN m{rounds} m ON m.c = a.c"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_bpe, op2_source_mixing, op3_token_output, op4_lm_scores, op5_ann, op6_exact_topk, op7_language, op8_sharding,
        op9_suffix_dedup, op10_simhash, op11_line_dedup, op12_centroids, op13_whitening)
}
ORACLE_SQL: dict[str, str] = {
    "op6_exact_topk": OP6_SQL, "op11_line_dedup": OP11_SQL, "op12_centroids": _op12_sql()}
