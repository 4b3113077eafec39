"""Stored tables go when their scope ends; the rule engine writes the texts twice at most."""

import os

from pyspark.sql import functions as F

from folioflow.plans import rule_pipeline, store
from folioflow.plans.synthetic import filings


def folder(spark):
    path = store.shared_folder(spark).removeprefix("file://")
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def test_nothing_is_left_behind_a_scope(spark, tmp_path):
    kept = store.written(spark.range(3), "kept")
    before = folder(spark)
    with store.scope():
        out = rule_pipeline.extract(filings(spark, "/root/testdata/sf0.001").limit(5))
        out.write.parquet(str(tmp_path / "out"))
        inside = folder(spark) - before
        texts = [n for n in inside if any(c in os.listdir(store.shared_folder(spark).removeprefix("file://") + "/" + n) for c in ["_SUCCESS"]) and "html" in spark.read.parquet(f"{store.shared_folder(spark)}/{n}").columns]
    assert folder(spark) == before and kept.count() == 3
    assert len(texts) == 2 and spark.read.parquet(str(tmp_path / "out")).filter(F.col("html").isNotNull()).count() > 20


def test_a_table_can_be_dropped_alone(spark):
    a, b = store.written(spark.range(3), "a"), store.written(spark.range(4), "b")
    store.drop(a)
    assert b.count() == 4 and not os.path.exists(a._folder.removeprefix("file://"))
    store.drop(a, b)
    assert not os.path.exists(b._folder.removeprefix("file://"))
