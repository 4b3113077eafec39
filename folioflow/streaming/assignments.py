"""Incremental forms: filings scored as files arrive, and live assignment state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import state
from folioflow.plans import rule_pipeline
from folioflow.streaming.processor import CHANGES, LOG, LiveAssignments, live, state_store

EVENTS = "accession string, turn int, ord int, action string, item string, anchor_id string, o long"


def extract_stream(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Sections of new filings (Parquet: accession, html) appended to ``out``; the checkpoint resumes after a stop."""
    src = spark.readStream.schema("accession string, html string").parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        rule_pipeline.extract(df).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_state(spark: SparkSession, folder: str, checkpoint: str, out: str, processor: LiveAssignments | None = None, files: int | None = None):
    """Live state of the logs in ``folder`` (Parquet, ``processor.LOG``, where columns may be missing); a batch's changes go to ``out``.

    Each batch writes one folder, whole: a batch that is run again after a stop replaces what it wrote.  ``files``: at most so many a batch.
    It ends when all files are read, but with timers (``processor.idle_ms``) it goes on until it is stopped, for they need a running query.
    """
    src = spark.readStream.schema(LOG)
    src = (src.option("maxFilesPerTrigger", files) if files else src).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/changes-{number:010d}")

    processor = processor or LiveAssignments()
    pace = {"availableNow": True} if processor.idle_ms is None else {"processingTime": "1 second"}
    with state_store(spark):
        return live(src, processor).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(**pace).start()


def _folders(spark: SparkSession, out: str) -> tuple[str | None, list[str]]:
    """The newest finished base and the change folders behind it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS"))
    base = max((n for n in names if n.startswith("base-") and done(n)), default=None)
    after = base.removeprefix("base-") if base else ""
    return base, [n for n in names if n.startswith("changes-") and n.removeprefix("changes-") > after]


def changes(spark: SparkSession, out: str) -> DataFrame:
    """All changes that hold: the newest base and what came behind it."""
    base, later = _folders(spark, out)
    return spark.read.schema(f"{CHANGES}, batch long").parquet(*(f"{out}/{n}" for n in ([base] if base else []) + later))


def current(spark: SparkSession, out: str) -> DataFrame:
    """accession, item, anchor_id, o, turn: the last change of each item that is no removal."""
    return state.fold(changes(spark, out).filter("kind = 'item'").select("accession", "turn", "ord", "action", "item", "anchor_id", "o"))


def stalled(spark: SparkSession, out: str) -> DataFrame:
    """accession, fired: the turns at which each conversation was found stalled."""
    return changes(spark, out).filter("kind = 'stall'").groupBy("accession").agg(F.array_sort(F.collect_set("turn")).alias("fired"))


def compact(spark: SparkSession, out: str) -> None:
    """Change folders become one base with an item's last event only, so reading does not slow down as batches go by.

    The base counts once it is finished; only then do the folders that it replaces go.  A stop in between loses nothing.
    """
    base, later = _folders(spark, out)
    if len(later) < 2:
        return
    rows = changes(spark, out)
    last = rows.filter("kind = 'item'").groupBy("accession", "kind", "item").agg(F.max_by(F.struct("anchor_id", "o", "turn", "ord", "action", "batch"), F.struct("turn", "ord")).alias("e")).select("accession", "kind", "item", "e.*")
    last.unionByName(rows.filter("kind <> 'item'").select(*last.columns)).select(*rows.columns).write.mode("overwrite").parquet(f"{out}/base-{later[-1].removeprefix('changes-')}")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n in later + ([base] if base else []):
        fs.delete(jvm.Path(f"{out}/{n}"), True)


def result_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, to_results, files: int | None = None):
    """Run-result rows of new filings as lines of JSON, each filing once; ``to_results``: sections of a batch to result rows.

    A batch owns a folder below ``out`` and writes it whole, so a batch that was written but not committed is replaced when it is
    run again after a stop.  ``results.read_results(spark, out)`` reads them all.
    """
    src = spark.readStream.schema("accession string, html string")
    src = (src.option("maxFilesPerTrigger", files) if files else src).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        made = to_results(rule_pipeline.extract(df))
        made.sortWithinPartitions("accession").write.mode("overwrite").json(f"{out}/batch={number}")

    return src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["EVENTS", "changes", "compact", "current", "extract_stream", "live_state", "result_stream", "stalled", "state"]
