"""Live assignment state with a state processor: one keyed state for each filing, idempotent under late rows and replays."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What goes in: assignment events, and reports (action ``issues``) of how many issues a turn left.
LOG = "accession string, turn int, ord int, action string, item string, anchor_id string, o long, n_issues long"
#: What comes out: items that changed (``kind`` item), turns at which the conversation stalled (stall) or ran out of turns (limit), filings that were closed.
CHANGES = "accession string, kind string, item string, anchor_id string, o long, turn int, ord int, action string"


class LiveAssignments(StatefulProcessor):
    """The last event of each item, the stall counter and the turn limit of one filing.

    ``items`` (map state) keeps for each item its event with the greatest (turn, ord): a row that comes late or twice changes nothing.
    ``run`` (value state) holds the last counted report, for how many turns issues have not become fewer, and whether
    the limit was told.  Reports count in order of turns; one for a turn already counted is passed over.  With ``idle_ms`` a
    timer closes a filing that has been silent for so long: its state goes and a row ``closed`` says so.
    """

    def __init__(self, limit: int = 3, max_turns: int = 30, idle_ms: int | None = None):
        self.limit, self.max_turns, self.idle_ms = limit, max_turns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item string", "turn int, ord int, action string, anchor_id string, o long")
        self.run = handle.getValueState("run", "turn int, issues long, run int, told boolean")
        self.wake = handle.getValueState("wake", "at long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        frame = pd.concat(list(rows)).sort_values(["turn", "ord"], kind="stable")
        none = lambda v: None if pd.isna(v) else v
        out, latest = [], {}
        for r in frame[frame.action != "issues"].itertuples():
            latest[r.item] = (int(r.turn), int(r.ord), r.action, none(r.anchor_id), None if pd.isna(r.o) else int(r.o))
        for item, new in latest.items():
            if self.items.containsKey((item,)) and tuple(self.items.getValue((item,)))[:2] >= new[:2]:
                continue
            self.items.updateValue((item,), new)
            out.append((key[0], "item", item, new[3], new[4], new[0], new[1], new[2]))
        turn, issues, run, told = tuple(self.run.get()) if self.run.exists() else (-(1 << 31), None, 0, False)
        for r in frame[frame.action == "issues"].itertuples():
            if r.turn <= turn:
                continue
            n = int(r.n_issues)
            run = run + 1 if n > 0 and issues is not None and n >= issues else 0
            turn, issues = int(r.turn), n
            if run >= self.limit:
                run = 0
                out.append((key[0], "stall", None, None, None, turn, 0, None))
        if not told and frame.turn.max() >= self.max_turns:
            told = True
            out.append((key[0], "limit", None, None, None, int(frame.turn.max()), 0, None))
        if issues is not None or told:
            self.run.update((turn, issues, run, told))
        if self.idle_ms is not None:
            if self.wake.exists():
                self.handle.deleteTimer(self.wake.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.wake.update((at,))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        for state in (self.items, self.run, self.wake):
            state.clear()
        yield self._frame([(key[0], "closed", None, None, None, None, None, None)])

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(rows: list):
        import pandas as pd

        names = [c.split()[0] for c in CHANGES.split(", ")]
        frame = pd.DataFrame(rows, columns=names, dtype=object)
        return frame.astype({"o": "Int64", "turn": "Int32", "ord": "Int32"})


@contextmanager
def state_store(spark: SparkSession):
    """Keyed processors need the RocksDB store; the session's own choice comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def live(log: DataFrame, processor: LiveAssignments) -> DataFrame:
    """The changes of a log (``LOG``), streaming or not."""
    mode = "None" if processor.idle_ms is None else "ProcessingTime"
    return log.groupBy("accession").transformWithStateInPandas(processor, CHANGES, "Update", mode)
