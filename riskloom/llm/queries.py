"""The registered queries of the operators in this package."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (alignment, ann, langid, line_dedup, near_texts, near_vectors, packing, prefix_bpe,
                          quality, resample, token_counts, token_files, warc)
from riskloom.plans.registry import Query
from riskloom.session import scratch_path

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/documents.parquet")


ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS smallest FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN smallest IS NULL OR page_id IS NOT DISTINCT FROM smallest THEN 'response' ELSE 'revisit' END
           AS record_type,
       CASE WHEN page_id IS DISTINCT FROM smallest THEN smallest END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

ORACLES["op1_cross_polytope"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
  reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings
            UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
  roots AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
  degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, r.component_id,
       coalesce(e.vec_id = r.component_id, false) AS kept
FROM embeddings e LEFT JOIN roots r USING (vec_id) LEFT JOIN degrees d USING (vec_id)
"""

ORACLES["op11_line_dedup"] = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  l AS (SELECT doc_id, unnest(range(len(lines))) AS place, unnest(lines) AS line FROM d),
  k AS (SELECT doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
  m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS dropped FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLES["op13_resample"] = """
WITH RECURSIVE bits(b, k, v) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
    FROM bits WHERE k < 8),
  crcs AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
  texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
  words AS (SELECT side, doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
  counted AS (SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
  vocabulary AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM counted),
  hashed AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket FROM vocabulary, crcs),
  seen AS (SELECT side, doc_id, bucket, n FROM counted JOIN hashed USING (word)),
  sums AS (SELECT coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s,
                  coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM seen),
  buckets AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s,
                     coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM seen GROUP BY 1),
  gains AS (SELECT bucket, floor(1000 * ln((b.t + 1) * (a.s + 10000) / ((b.s + 1) * (a.t + 10000)))) AS gain
            FROM buckets b, sums a),
  weights AS (SELECT doc_id, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight
              FROM seen JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1),
  scored AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT
            AS score FROM documents LEFT JOIN weights USING (doc_id)),
  ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank,
                    count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


@query
def op1_cross_polytope(spark: SparkSession, base: str) -> DataFrame:
    return near_vectors.link_vectors(spark.read.parquet(f"{base}/embeddings.parquet"))


@query
def op2_token_files(spark: SparkSession, base: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write_corpus(documents(spark, base), public_tokenizers.path("byte_bpe_50k.json"), folder, 2)
    return token_files.read_corpus(spark, folder, "ids_crc32").withColumnRenamed("key", "doc_id")


@query
def op3_prefix_bpe(spark: SparkSession, base: str) -> DataFrame:
    return prefix_bpe.digest_texts(documents(spark, base), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_quality(spark: SparkSession, base: str) -> DataFrame:
    docs = documents(spark, base)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{base}/labels.parquet")))


@query
def op5_warc(spark: SparkSession, base: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = warc.archive(spark.read.parquet(f"{base}/pages.parquet"), folder)
    return warc.read_records(index, f"{folder}/warc")


@query
def op6_posting_lists(spark: SparkSession, base: str) -> DataFrame:
    vectors = spark.read.parquet(f"{base}/embeddings.parquet")
    return ann.search(vectors.where(F.col("vec_id") % 20 == 0), vectors)


@query
def op7_langid(spark: SparkSession, base: str) -> DataFrame:
    docs = documents(spark, base)
    return langid.identify(docs, langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model")))


@query
def op8_minhash(spark: SparkSession, base: str) -> DataFrame:
    return near_texts.near_duplicates(documents(spark, base))


@query
def op9_pattern_packing(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(documents(spark, base), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query
def op10_token_counts(spark: SparkSession, base: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, base), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_line_dedup(spark: SparkSession, base: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(documents(spark, base))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op12_alignment(spark: SparkSession, base: str) -> DataFrame:
    return alignment.align_tokenizers(documents(spark, base), public_tokenizers.path("byte_bpe_50k.json"),
                                      public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_resample(spark: SparkSession, base: str) -> DataFrame:
    return resample.resample(documents(spark, base), spark.read.parquet(f"{base}/benchmark.parquet"))


@query
def pipeline(spark: SparkSession, base: str) -> DataFrame:
    return corpus_pipeline.run(spark, base)
