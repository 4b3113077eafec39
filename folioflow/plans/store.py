"""Tables written once and read back, in a folder that all executors share.

A result reads its tables when it is used, so they outlive the call that wrote them: they go at the end of a ``scope``, or
with the session.  A table that no result needs any more is dropped at once.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that are still there, in the order in which they were written.
_TABLES: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the context's checkpoint folder; without either one is made, but only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a Parquet table: its work is done once, later plans start at a scan, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(drop)
    _TABLES[path] = spark
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._folder = path
    return made


def drop(*tables: DataFrame) -> None:
    """Delete what ``written`` returned; without arguments all tables that are left."""
    _delete([t._folder for t in tables] if tables else list(_TABLES))


def _delete(paths: list[str]) -> None:
    for path in paths:
        spark = _TABLES.pop(path, None)
        if spark is not None and spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope():
    """Tables written inside go at the end, so a result has to be stored or collected inside."""
    before = set(_TABLES)
    try:
        yield
    finally:
        _delete([p for p in _TABLES if p not in before])
