"""The rule engine and the structural index as composed DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import rules
from folioflow.operators import anchors, candidates, selection, state
from folioflow.plans.store import written


@dataclass
class Index:
    """The tables of one corpus, all keyed by accession; only ``filings`` holds texts.

    They are written to the shared folder once, so every plan on them starts at a scan.
    """

    filings: DataFrame
    links: DataFrame
    anchors: DataFrame
    items: DataFrame
    labelled: DataFrame
    parts: DataFrame
    candidates: DataFrame
    incorporated: DataFrame
    chosen: DataFrame


def build_index(filings: DataFrame) -> Index:
    filings = written(filings, "filings")
    marks = written(anchors.structure(filings), "structure")
    links = written(anchors.links_of(marks), "links")
    found = written(anchors.anchors_of(marks), "anchors")
    items = written(anchors.anchor_items(links), "items")
    named = written(found.join(items, ["accession", "anchor_id"], "left"), "named")
    labelled = written(candidates.labelled(anchors.windows(filings, named)), "labelled")
    parts = written(anchors.parts_of(marks), "parts")
    cands = written(candidates.rescored(candidates.collect(labelled), parts), "candidates")
    inc = written(anchors.part_three_incorporated(filings, candidates.found_items(cands)), "incorporated")
    chosen = written(with_signatures(filings, selection.select_ordered(candidates.cascade(labelled))), "chosen")
    return Index(filings, links, found, items, labelled, parts, cands, inc, chosen)


def with_signatures(filings: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen places and, in filings without signatures among them, the heading behind the last."""
    chosen = written(chosen, "ordered")
    bare = chosen.join(chosen.filter("item = 'signatures'").select("accession"), "accession", "left_anti")
    more = anchors.signature_fallback(filings, bare)
    return chosen.unionByName(more.select("accession", F.lit("signatures").alias("item"), F.lit(None).cast("string").alias("anchor_id"), F.col("o").cast("long").alias("o"), F.lit(0).alias("confidence")))


def extract(filings: DataFrame, to_end_of_file: bool = True) -> DataFrame:
    """accession, item, html: the rule engine from filings to sections."""
    return sections(build_index(filings), to_end_of_file)


def sections(ix: Index, to_end_of_file: bool = True) -> DataFrame:
    listed = anchors.toc_first(ix.links).select("accession", "item")
    more = selection.heading_fallback(ix.filings, ix.chosen, listed)
    chosen = written(ix.chosen.select("accession", "item", "o").unionByName(more), "places")
    made = written(selection.rule_slices(ix.filings, chosen, to_end_of_file), "slices")
    named = ix.chosen.filter("item = 'signatures' and anchor_id is not null").select("accession").unionByName(listed.filter("item = 'signatures'").select("accession"))
    # a light plan over the written slices: what only asks for the items reads no text
    kept = selection.policy(made, named).unionByName(selection.placeholders(ix.items, made))
    third = anchors.part_three_incorporated(ix.filings, kept)
    return kept.unionByName(selection.part_three_placeholders(kept, third))


def assign_by_policy(index: Index, least: int = 7) -> DataFrame:
    """Deterministic stand-in for a model: sure candidates of the chosen chain; an incorporated part III without places."""
    lengths = index.filings.select("accession", F.length("html").alias("html_len"))
    sure = index.chosen.filter(F.col("confidence") >= least).select("accession", "item", "anchor_id", "o")
    third = index.incorporated.filter("incorporated").select("accession", F.explode(F.array(*map(F.lit, rules.SHARED[0]))).alias("item"), F.lit(None).cast("string").alias("anchor_id"), F.lit(None).cast("long").alias("o")).join(sure, ["accession", "item"], "left_anti")
    made = written(sure.unionByName(third), "assigned")
    bad = state.issues(made, lengths, null_breaks_order=False).filter("type in ('order_violation', 'non_monotonic', 'out_of_range')")
    return made.join(bad, ["accession", "item"], "left_anti")
