"""The tool protocol: named functions over an index, as DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import rules
from folioflow.functions import text as T
from folioflow.operators import anchors, candidates, selection, state


class Tools:
    """Tools over an index and an event table; ``call`` dispatches by name and turns errors into a message."""

    def __init__(self, index, events):
        self.index, self.events = index, events
        self.lengths = index.filings.select("accession", F.length("html").alias("html_len"))

    def call(self, name: str, **args):
        if name.startswith("_") or name == "call" or not hasattr(self, name):
            return {"error": f"unknown tool {name}"}
        try:
            return getattr(self, name)(**args)
        except Exception as e:  # the protocol reports any failure to the caller
            return {"error": str(e)}

    def get_filing_overview(self):
        return candidates.overview(self.index.candidates, self.index.links).join(self.index.incorporated, "accession", "left")

    def get_toc_links(self):
        return anchors.link_records(self.index.filings).withColumn("link_text", F.left("link_text", F.lit(150)))

    def get_item_candidates(self, item_name: str):
        return self.index.candidates.filter(F.col("item") == item_name)

    def read_text_at(self, position: int, length: int = 500):
        return self.index.filings.select("accession", T.read_text_at(F.col("html"), F.lit(position), F.lit(length)).alias("text"))

    def get_part_boundaries(self):
        return self.index.parts

    def classify_text(self, texts):
        low = F.lower("text")
        return texts.withColumn("heading", rules.heading_label(low)).withColumn("title", rules.title_label(low))

    def detect_incorporation(self, item_name: str):
        """accession, incorporated, evidence: only items 10 to 14 (or "part3") can be taken from another document."""
        if item_name != "part3" and item_name not in rules.SHARED[0]:
            return self.index.incorporated.select("accession", F.lit(False).alias("incorporated"), F.lit("only part III items are incorporated by reference").alias("evidence"))
        said = F.when(F.col("incorporated"), "part III names another document and none of its items was found").otherwise("no such reference near the part III heading, or items of it were found")
        return self.index.incorporated.select("accession", "incorporated", said.alias("evidence"))

    def _event(self, rows):
        self.events = self.events.unionByName(rows.select(*self.events.columns))
        return rows

    def assign_item(self, accession: str, turn: int, item: str, anchor_id: str | None, o: int | None):
        spark = self.events.sparkSession
        return self._event(spark.createDataFrame([(accession, turn, 0, "assign", item, anchor_id, o)], self.events.schema))

    def unassign_item(self, accession: str, turn: int, item: str):
        spark = self.events.sparkSession
        return self._event(spark.createDataFrame([(accession, turn, 0, "unassign", item, None, None)], self.events.schema))

    def batch_assign(self, batches):
        """The events of all entries that can be assigned; ``errors`` has the others with what is wrong with them."""
        rows = state.batch_events(batches)
        known = F.col("item").isin(*rules.LABELS)
        wrong = F.when(F.col("item").isNull(), "no item").when(~known, F.concat(F.lit("unknown item "), "item"))
        self.errors = rows.withColumn("error", wrong).filter("error is not null").select("accession", "turn", "ord", "item", "error")
        return self._event(rows.filter(known))

    def pre_populate(self):
        """Begins with the chosen chain."""
        return self._event(state.pre_populated(self.index.chosen))

    def get_current_assignments(self):
        return state.listed(state.fold(self.events))

    def validate_assignments(self):
        return state.issues(state.fold(self.events), self.lengths)

    def check_span_sizes(self):
        return state.spans(state.fold(self.events), self.lengths)

    def get_all_top_candidates(self):
        return candidates.top(self.index.candidates, 3)

    def refine_boundary(self, radius: int = 5000):
        return anchors.within(state.fold(self.events).filter("o is not null").select("accession", "item", "o"), self.index.anchors, radius)

    def scan_for_heading(self, item: str, start: int = 0, end: int | None = None):
        return anchors.heading_scan(self.index.filings, item, self.index.anchors, start, end)

    def finalize(self):
        return state.finalizable(self.lengths, self.validate_assignments())

    def slices(self):
        return selection.slices(self.index.filings, state.fold(self.events))
