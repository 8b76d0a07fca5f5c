"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, whole; all but the last return the columns of
``documents``.  ``run`` writes each stage's result to the cluster's shared folder, so
that the next one, which reads its input several times, doesn't compute it again and
lost executors cost one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonflow.llm.neardup import near_duplicates
from reasonflow.llm.packing import pack_documents
from reasonflow.llm.quality import fit_quality, score_quality
from reasonflow.llm.secrets import redact
from reasonflow.llm.substring import remove_repeats
from reasonflow.llm.workspace import materialise
from reasonflow.operators.ranks import with_rank

#: SQL can't express the classifier, the sketches or the tokens.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5 go.  The model learns from ``labels`` and the documents at hand."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    weights = fit_quality(docs, labels)
    return score_quality(docs, weights, into="__rf_score").where("__rf_score >= 0.5").drop("__rf_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least id (and text, where an id has several).

    Of rows that repeat an id and a text one stays, the one whose other columns have the least hash.  Rows
    with one id and unlike texts are documents of their own; rows without an id all stay.
    """
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80)
        gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__rf_gone")).distinct()
        return docs.join(gone, F.col("doc_id") == F.col("__rf_gone"), "left_anti")
    # ids repeat: each pair of id and text gets a number of its own, in order
    pairs = known.select(F.col("doc_id").alias("__rf_id"), F.col("text").alias("__rf_text")).distinct()
    numbered = materialise(with_rank(pairs, "__rf_id", "__rf_text").select("__rf_id", "__rf_text", F.col("_rn").alias("__rf_n")), "numbered")
    found = near_duplicates(numbered.select(F.col("__rf_n").alias("doc_id"), F.col("__rf_text").alias("text")), shingle=5, percent=80)
    stays = found.where("doc_id = component_id").select(F.col("doc_id").alias("__rf_n"))
    stays = numbered.join(stays, "__rf_n").select("__rf_id", "__rf_text")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = known.groupBy("doc_id", "text").agg(F.min_by(F.struct(F.lit(0).alias("__rf_0"), *others), F.xxhash64(F.lit(0), *others)).alias("__rf_row"))
    one = one.join(stays, (F.col("doc_id") == F.col("__rf_id")) & F.col("text").eqNullSafe(F.col("__rf_text")), "left_semi")
    kept = one.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__rf_row")[c].alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that an earlier document has too are cut out; no document goes."""
    return remove_repeats(docs, min_words=50)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids and their place in sequences of 1024 tokens (``packing.sequences`` joins them)."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2, capacity=1024, with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
