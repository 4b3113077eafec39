"""Shared plumbing: table access, cluster-shared scratch space, Arrow helpers."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2500, size: int = 8 << 20) -> None:
    """Lower the session's Arrow batches to ``rows`` rows and ``size`` bytes (one longer text is still one batch).

    The defaults (10,000 rows, 64 MB) hold a whole partition of texts at once, in the JVM and in the Python worker.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name, None)
        number = int(re.sub(r"\D", "", now)) if now else 0
        if not 0 < number <= most or now and not now.isdigit():
            spark.conf.set(name, str(most))


def tidy(keep_encoder: bool = False) -> None:
    """At the end of a Python task: what it has freed goes back to the system, for the worker is kept for later tasks.

    A tokenizer that the worker has from an earlier stage goes too, unless this stage uses it.
    """
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    if not keep_encoder and "tokenizers" in sys.modules:
        sys.modules["tokenizers"].__dict__.pop("_folioflow_encoders", None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def one_by_one(column):
    """The values of an Arrow column as Python objects, one at a time: a batch's texts are not held twice."""
    return (x.as_py() for x in column)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share.  Where none is named one is made, but only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        drop_path(spark, path)


class Scratch:
    """Tables of one call, written to the shared folder; what is left goes when the session ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        atexit.register(_drop_quietly, spark, self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: the lineage is cut and lost executors cost no recomputation."""
        path = self.path(f"{name}-{uuid.uuid4().hex[:6]}")
        self.paths[name] = path
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                drop_path(self.spark, path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows in what is executed inside: rows may be long texts or lists."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def crc_bucket(key: str, n: int):
    """crc32 of the id written as decimal text, modulo n (null ids count as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows that the driver holds, as a literal of the plan: no Python worker has to make them."""
    listed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(listed).alias("r")).select("r.*")


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, most: int = 1000) -> DataFrame:
    """``rows`` with the columns of their group (left join).  ``groups``: ``key``, ``size`` (rows of the group) and more.

    Groups that hold one in ``most`` of all ``total`` rows, or more, are at most ``most``: they are broadcast, so
    that no task gets all rows of a large group.  The others are joined by a shuffle, at every size.  ``groups`` is read twice.
    """
    limit = max(2, total // most)
    hot = groups.filter(F.col(size) >= limit).withColumn("_hot", F.lit(True))
    first = rows.join(F.broadcast(hot), key, "left")
    known = first.filter("_hot").drop("_hot")
    rest = first.filter("_hot is null").select(*rows.columns).join(groups.filter(F.col(size) < limit).hint("merge"), key, "left")
    return known.unionByName(rest)


def shuffle_parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
