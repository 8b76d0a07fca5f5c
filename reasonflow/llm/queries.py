"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import edited_fingerprints
from .langid import identify
from .media import media_columns
from .neardup import near_duplicates
from .packing import pack_documents
from .quality import quality
from .secrets import secret_report
from .sentencepieces import encode_and_decode
from .substring import substring_digests
from .tokenbin import token_binary


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(documents(spark, sf_dir), min_words=50)


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=1)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(documents(spark, sf_dir))


def op4_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality(documents(spark, sf_dir), labels)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))


def op7_one_permutation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end=2, capacity=1024)


def op9_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_script_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_token_binary, op3_secret_scan, op4_ftrl_quality, op5_sentencepiece, op6_media_chunks, op7_one_permutation_fingerprints, op8_best_two_fit, op9_setsketch_near_dedup, op10_script_viterbi_language)}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        win AS (
            SELECT doc_id, p, array_to_string(ws[p : p + 49], ' ') AS s
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)),
        first AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
        hit AS (SELECT doc_id, p FROM win JOIN first USING (s) WHERE doc_id > d),
        word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM hit),
        kept AS (
            SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
            FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op9_setsketch_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN ws ELSE ws[i : i + 2] END AS s
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (
            SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
            WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
        reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
        comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
        SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
        FROM comp c LEFT JOIN n USING (doc_id)""",
}
