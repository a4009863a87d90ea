"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, langid, licenses, mixing, packing, pivots, rabitq, rans, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    drawn = mixing.mix(docs, mixing.word_count(F.col("text")), target_entropy=0.9, max_repeat=1.5, key=mixing.text_key())
    return drawn.select("doc_id", "source", "n_tokens", "epoch", "block", "block_rank", F.round("weight", 6).alias("weight"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivots.integers(table(spark, sf_dir, "embeddings"))
    return pivots.top_k(vectors.filter("key % 100 = 0"), vectors)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rans.archive(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_rabitq": op2_rabitq,
        "op3_mixing": op3_mixing,
        "op4_jaccard": op4_jaccard,
        "op5_langid": op5_langid,
        "op6_pivots": op6_pivots,
        "op7_warc": op7_warc,
        "op8_sharding": op8_sharding,
        "op9_rans": op9_rans,
        "op10_licenses": op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    digits = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT >> {s}) & 31)::INT, 1)" for i in range(8) for s in (15, 10, 5, 0)
    )
    number = lambda *parts: "('0x' || substr(md5(" + " || '/' || ".join(parts) + "), 1, 12))::BIGINT"
    return {
        "op3_mixing": f"""
            WITH RECURSIVE d AS (SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
                 s AS (SELECT source, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
                 p AS (SELECT tokens / (SELECT sum(tokens) FROM s) AS p FROM s WHERE tokens > 0),
                 e AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
                       UNION ALL
                       SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
                       FROM (SELECT i, lo, hi, ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * ln(pow(p, (lo + hi) / 2))) / sum(pow(p, (lo + hi) / 2)) >= 0.9 * ln(count(*)) - 1e-12 AS ok
                             FROM e, p WHERE i < 40 GROUP BY i, lo, hi)),
                 r AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
                       UNION ALL
                       SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
                       FROM (SELECT i, lo, hi, max(pow(p, (lo + hi) / 2) / p) * max(p / pow(p, (lo + hi) / 2)) <= 1.5 AS ok
                             FROM r, p WHERE i < 40 GROUP BY i, lo, hi)),
                 x AS (SELECT round(greatest((SELECT lo FROM e WHERE i = 40), (SELECT hi FROM r WHERE i = 40)), 6) AS x),
                 w AS (SELECT s.*, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM s), (SELECT x FROM x)) ELSE 0 END AS raw FROM s),
                 b AS (SELECT *, raw / (SELECT sum(raw) FROM w) AS weight, round(raw * (SELECT max(tokens / raw) FROM w WHERE raw > 0))::BIGINT AS budget, ceil(docs / 2000)::BIGINT AS blocks FROM w),
                 c AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM b),
                 n AS (SELECT d.doc_id, d.text, d.source, d.n_tokens, c.weight, c.whole, c.rest, {number("'block'", "coalesce(doc_id::VARCHAR, md5(text), '')")} % c.blocks AS block FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
                 k AS (SELECT n.*, unnest(range(whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM n),
                 o AS (SELECT *, {number("'rank'", "epoch::VARCHAR", "block::VARCHAR")} AS place, {number("'doc'", "epoch::VARCHAR", "coalesce(doc_id::VARCHAR, md5(text), '')")} AS own FROM k),
                 q AS (SELECT *, dense_rank() OVER (PARTITION BY source, epoch ORDER BY place, block) - 1 AS block_rank,
                              coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY place, block, own, coalesce(doc_id::VARCHAR, md5(text), ''), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
            SELECT doc_id, source, n_tokens, epoch, block, block_rank, round(weight, 6) AS weight FROM q WHERE epoch < whole OR before < rest""",
        "op6_pivots": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
                       FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
                 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
        "op7_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
                 o AS (SELECT h, min(page_id) AS owner FROM p GROUP BY h)
            SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {digits} AS payload_digest,
                   CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
            FROM p JOIN o USING (h)""",
    }
