"""Streams that are stopped, run again and fed late rows give what the batch operators give, once."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from folioflow.operators import state
from folioflow.sources import results
from folioflow.streaming import assignments
from folioflow.streaming.processor import LOG, LiveAssignments, live, state_store

ITEMS = ("item1", "item1a", "item7", "item8")


def log(spark, seed=1, filings=7, turns=12):
    """Events and reports of some filings, without ties of (turn, ord)."""
    rng, rows = random.Random(seed), []
    for a in range(filings):
        for t in range(turns):
            for k in range(rng.randint(0, 3)):
                rows.append((f"f{a}", t, k, rng.choice(["assign", "assign", "unassign"]), rng.choice(ITEMS), rng.choice(["x", None]), rng.choice([None, -1, 5, 900]), None))
            rows.append((f"f{a}", t, 9, "issues", None, None, None, rng.choice([0, 1, 2, 2, 3, 3])))
    return spark.createDataFrame(rows, LOG)


def expected(df):
    events, reports = df.filter("action <> 'issues'"), df.filter("action = 'issues'")
    return sorted(state.fold(events.select("accession", "turn", "ord", "action", "item", "anchor_id", "o")).collect(), key=str), {r.accession: r.fired for r in state.stalls(reports.select("accession", "turn", "n_issues")).collect() if r.fired}


def found(spark, out):
    return sorted(assignments.current(spark, out).collect(), key=str), {r.accession: r.fired for r in assignments.stalled(spark, out).collect()}


def uncommit(checkpoint):
    """As if the last batch had been written when the driver was lost before it committed."""
    done = f"{checkpoint}/commits"
    last = max((n for n in os.listdir(done) if n.isdigit()), key=int)
    for n in (last, f".{last}.crc"):
        if os.path.exists(f"{done}/{n}"):
            os.remove(f"{done}/{n}")


def test_live_state_survives_stops_and_replays(spark, tmp_path):
    df = log(spark)
    src, ck, out = (str(tmp_path / n) for n in ("in", "ck", "out"))
    for part in ("turn < 4", "turn between 4 and 7", "turn > 7"):
        df.filter(part).coalesce(1).write.mode("append").parquet(src)
        assignments.live_state(spark, src, ck, out, files=1).awaitTermination(120)
        uncommit(ck)
        assignments.live_state(spark, src, ck, out, files=1).awaitTermination(120)
    assert found(spark, out) == expected(df)
    before = assignments.changes(spark, out).count()
    assignments.compact(spark, out)
    assert [n for n in os.listdir(out) if n.startswith("changes-")] == [] and assignments.changes(spark, out).count() < before
    assert found(spark, out) == expected(df)
    more = spark.createDataFrame([("f0", 50, 0, "assign", "item3", "q", 7, None), ("f0", 1, 0, "assign", "item3", "late", 1, None), ("f0", 3, 9, "issues", None, None, None, 3)], LOG)
    more.coalesce(1).write.mode("append").parquet(src)
    assignments.live_state(spark, src, ck, out).awaitTermination(120)
    kept, fired = found(spark, out)
    assert [(r.anchor_id, r.o) for r in kept if r.accession == "f0" and r.item == "item3"] == [("q", 7)]
    assert fired == expected(df)[1]  # a report for a turn already counted changes nothing
    assert {(r.accession, r.turn) for r in assignments.changes(spark, out).filter("kind = 'limit'").collect()} == {("f0", 50)}


def test_unfinished_base_does_not_count(spark, tmp_path):
    out = str(tmp_path / "out")
    row = spark.createDataFrame([("a", "item", "item1", "x", 5, 1, 0, "assign", 0)], "accession string, kind string, item string, anchor_id string, o long, turn int, ord int, action string, batch long")
    row.write.parquet(f"{out}/changes-0000000000")
    os.makedirs(f"{out}/base-0000000000")
    assert [r.o for r in assignments.current(spark, out).collect()] == [5]


def test_processor_without_a_stream(spark):
    df = log(spark, 2).unionByName(log(spark, 2))  # every row twice
    with state_store(spark):
        rows = live(df, LiveAssignments(limit=3)).collect()
    want, fired = expected(log(spark, 2))
    kept = sorted((r.accession, r.item, r.anchor_id, None if r.o is not None and r.o < 0 else r.o, r.turn) for r in rows if r.kind == "item" and r.action == "assign")
    assert kept == sorted((tuple(r) for r in want), key=lambda r: (r[0], r[1]))
    assert {a: sorted(r.turn for r in rows if r.kind == "stall" and r.accession == a) for a in fired} == fired


def test_silent_filings_are_closed(spark, tmp_path):
    src, ck, out = (str(tmp_path / n) for n in ("in", "ck", "out"))
    log(spark, 3, filings=2).coalesce(1).write.parquet(src)
    running = assignments.live_state(spark, src, ck, out, LiveAssignments(idle_ms=1))
    closed, until = set(), time.time() + 90
    try:
        while closed != {"f0", "f1"} and time.time() < until:
            time.sleep(2)
            if assignments._folders(spark, out)[1][1:]:
                closed = {r.accession for r in assignments.changes(spark, out).filter("kind = 'closed'").collect()}
    finally:
        running.stop()
    assert closed == {"f0", "f1"}


def test_results_are_read_once_after_a_replay(spark, tmp_path):
    src, ck, out = (str(tmp_path / n) for n in ("in", "ck", "out"))

    def to_results(sections):
        shape = spark.createDataFrame([], results.SCHEMA)
        return shape.unionByName(sections.groupBy("accession").agg(F.count("*").alias("pred_items")), allowMissingColumns=True)

    from folioflow.plans import rule_pipeline
    from folioflow.plans.synthetic import filings

    pages = filings(spark, "/root/testdata/sf0.001").limit(6)
    for part in (0, 1):
        pages.filter(F.col("accession").cast("int") % 2 == part).coalesce(1).write.mode("append").parquet(src)
        assignments.result_stream(spark, src, out, ck, to_results, files=1).awaitTermination(240)
        uncommit(ck)
        assignments.result_stream(spark, src, out, ck, to_results, files=1).awaitTermination(240)
    rows = results.read_results(spark, out).collect()
    assert sorted(r.accession for r in rows) == sorted(r.accession for r in rule_pipeline.extract(pages).select("accession").distinct().collect())
    assert len(rows) >= 4
