"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, pseudonymise, pack.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``.  A stage's decisions are anti joins by ``doc_id``, so rows with a
null id are judged by no stage and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontam, jaccard_join, packing, pii, toxicity
from folioflow.llm.common import Scratch, arrow_rows, table
from folioflow.llm.registry import PII_KEY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic (score of 0.5 or more) go."""
    with arrow_rows(spark, packing.BATCH):  # all Python work is written to tables in there
        model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
        bad = Scratch(spark, "toxic").keep(toxicity.score(docs, model).filter("score >= 0.5").select("doc_id"), "ids")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 over five-word shingles the smallest id stays."""
    groups = jaccard_join.near_components(docs, size=5, percent=80)
    copies = groups.filter("doc_id <> component_id").select("doc_id")
    return docs.join(Scratch(spark, "copies").keep(copies, "ids"), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a fifth of its words substituted, go."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(Scratch(spark, "leaks").keep(found, "ids"), "doc_id", "left_anti").select(*docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets keyed surrogates; ``n_chars`` follows the new text."""
    made = pii.pseudonymised(docs, PII_KEY)
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 4096 ids, placed in as few sequences as can be."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("benchmark", drop_contaminated), ("pii", replace_pii), ("packing", pack)]

#: Nearest-neighbour votes, keyed permutations and token ids are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, hold = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = hold.keep(stage(spark, docs, sf_dir), f"stage{k}")
        hold.drop(f"stage{k - 1}")
    return docs
