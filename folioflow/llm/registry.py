"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket, table


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store

    path = Scratch(spark, "op9").path("store")
    token_store.write(table(spark, sf_dir, "documents"), path)
    return token_store.read(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op6_ga_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import kd_shards

    return kd_shards.documents_sharded(table(spark, sf_dir, "documents"), shards=40)


def op8_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hd_language

    docs = table(spark, sf_dir, "documents")
    learned = hd_language.train(docs.filter(crc_bucket("doc_id", 3) != 1))
    return hd_language.predict(docs, learned).select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(crc_bucket("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "nearest", "cosine")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import multiset_hash

    return multiset_hash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.near_components(table(spark, sf_dir, "documents"), size=4, percent=85)


#: The key of the registered queries; a production run passes its own secret.
PII_KEY = b"folioflow registered query"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, PII_KEY)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import dialogue_repair

    return dialogue_repair.repair(table(spark, sf_dir, "conversations"))


def op12_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import learned_partitions

    return learned_partitions.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import importance

    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, buckets=10_000, longest=2, least_words=20, seed=7)


def queries() -> dict:
    import corpus_pipeline

    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    from . import sql

    found = {"op11_dialogue_repair": sql.dialogue_repair(), "op13_importance": sql.importance()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
