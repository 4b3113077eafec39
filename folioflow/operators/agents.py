"""Tool-calling conversations about all filings of a corpus, each in the task that holds its filing.

Spark builds the index and brings a filing's rows of it together with its text (one cogroup by accession);
a ``Desk`` answers the tools from them in memory and logs assignments as events, and ``resolver.converse`` runs the
conversation there.  What comes back are the runs with their event logs, so ``state.fold`` gives the
assignments.  A filing's text and index rows are what a task holds at a time.  ``operators.tools`` has the
same tools as plans over all filings.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import rules
from folioflow.operators import resolver

# Everything a task runs travels with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules["folioflow"])

RUNS = "accession string, turns int, tokens long, finalized boolean, issues int, error string, events array<struct<turn:int,ord:int,action:string,item:string,anchor_id:string,o:long,reasoning:string>>"


def entries(ix) -> DataFrame:
    """All index rows of ``rule_pipeline.Index`` but the texts: accession, kind, item, anchor_id, o, n, source, text, share."""
    def of(rows: DataFrame, kind: str, **given) -> DataFrame:
        kinds = {"item": "string", "anchor_id": "string", "o": "long", "n": "int", "source": "string", "text": "string", "share": "double"}
        return rows.select("accession", F.lit(kind).alias("kind"), *(given.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))

    c = F.col
    made = [
        of(ix.links, "link", item=c("item"), anchor_id=c("anchor_id"), o=c("o"), text=c("link_text")),
        of(ix.candidates, "candidate", item=c("item"), anchor_id=c("anchor_id"), o=c("o"), n=c("confidence"), source=c("source"), text=c("nearby_text"), share=c("rel")),
        of(ix.parts, "part", o=c("o"), n=c("part"), share=c("rel")),
        of(ix.anchors, "anchor", anchor_id=c("anchor_id"), o=c("o")),
        of(ix.chosen, "chosen", item=c("item"), anchor_id=c("anchor_id"), o=c("o"), n=c("confidence")),
        of(ix.incorporated.filter("incorporated"), "third"),
    ]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def plain_text(html: str) -> str:
    """``text.strip_html`` of a string."""
    from html import unescape

    return re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", " ", html)).replace(" ", " ")).strip(" ")


def pattern(java: str) -> re.Pattern:
    """A pattern of ``rules``: Python's classes know Unicode anyway, and the very end is written differently."""
    return re.compile(re.sub(r"^\(\?U(\w*)\)", lambda m: f"(?{m[1]})" if m[1] else "", java).replace(r"\z", r"\Z"))


class Desk:
    """One filing's index and assignments, and the tools on them.

    Every tool returns something JSON can hold; ``call`` makes errors of any kind part of the protocol.
    """

    TOOLS = (
        "get_filing_overview", "get_toc_links", "get_item_candidates", "read_text_at", "get_part_boundaries", "classify_text", "detect_incorporation", "assign_item", "unassign_item",
        "get_current_assignments", "validate_assignments", "check_span_sizes", "get_all_top_candidates", "batch_assign", "refine_boundary", "scan_for_heading", "finalize",
    )

    def __init__(self, accession: str, html: str, rows: list[dict], begun: bool = True):
        kind = lambda k, *order: sorted((r for r in rows if r["kind"] == k), key=lambda r: tuple((r[c] is not None, r[c]) for c in order))
        self.accession, self.html = accession, html
        self.links, self.parts, self.anchors = kind("link", "o", "anchor_id"), kind("part", "n"), kind("anchor", "o", "anchor_id")
        self.candidates = sorted(kind("candidate", "o", "anchor_id", "source"), key=lambda r: -r["n"])
        self.third, self.held, self.events, self.turn, self.done = bool(kind("third")), {}, [], 0, False
        if begun:
            chain = sorted(kind("chosen", "o"), key=lambda r: (r["o"], rules.SEQ[r["item"]]))
            for r in chain:
                self._log("assign", r["item"], r["anchor_id"], r["o"], "chosen by the rules")

    def call(self, name: str, args: dict) -> str:
        if name not in self.TOOLS:
            return json.dumps({"error": f"unknown tool {name}"})
        try:
            return json.dumps(getattr(self, name)(**args), ensure_ascii=False)
        except Exception as e:  # the protocol reports any failure to the caller
            return json.dumps({"error": str(e)})

    def _log(self, action: str, item: str, anchor_id=None, o=None, reasoning: str = "") -> None:
        place = None if o is None or o < 0 else int(o)
        now = sum(e[0] == self.turn for e in self.events)
        self.events.append((self.turn, now, action, item, anchor_id, o, reasoning))
        self.held.pop(item, None)
        if action == "assign":
            self.held[item] = (anchor_id, place, self.turn)

    def get_filing_overview(self) -> dict:
        n = len(self.candidates)
        return {"accession": self.accession, "html_len": len(self.html), "links": len(self.links), "classified": sum(r["item"] is not None for r in self.links), "candidates": n, "items": len({r["item"] for r in self.candidates}),
                "difficulty": "hard" if n > 100 else "medium" if n > 50 else "easy", "incorporated": self.third}

    def get_toc_links(self) -> list:
        return [{"anchor_id": r["anchor_id"], "link_text": (r["text"] or "")[:150], "item": r["item"]} for r in self.links]

    def _candidate(self, r: dict) -> dict:
        return {"item": r["item"], "anchor_id": r["anchor_id"], "o": r["o"], "rel": r["share"], "confidence": r["n"], "source": r["source"], "nearby_text": r["text"]}

    def get_item_candidates(self, item_name: str) -> list:
        return [self._candidate(r) for r in self.candidates if r["item"] == item_name]

    def get_all_top_candidates(self, most: int = 3) -> dict:
        return {i: found[:most] for i in rules.LABELS if (found := self.get_item_candidates(i))}

    def read_text_at(self, position: int, length: int = 500) -> str:
        at = max(0, min(position, len(self.html) - 1))
        return plain_text(self.html[at : at + min(length, 2000)])[:500]

    def get_part_boundaries(self) -> list:
        return [{"part": r["n"], "o": r["o"], "rel": r["share"]} for r in self.parts]

    def classify_text(self, text: str) -> dict:
        low = text.lower()
        head, title = pattern(rules.HEADING).search(low), pattern(rules.TITLE).search(low)
        return {"heading": head and self._item(head[0]), "title": title and self._title(title[0])}

    @staticmethod
    def _item(match: str) -> str:
        return "item" + re.sub("[^0-9a-c]", "", match[4:]) if match.startswith("item") else "signatures"

    @staticmethod
    def _title(match: str) -> str:
        word = re.search("[a-z]+|10", match)[0]
        if word != "financial":
            return rules.FIRST_WORD.get(word)
        return "item8" if re.match(r"financial\s+statements?\s+and", match) else "item15"

    def detect_incorporation(self, item_name: str) -> dict:
        if item_name != "part3" and item_name not in rules.SHARED[0]:
            return {"incorporated": False, "evidence": "only part III items are incorporated by reference"}
        return {"incorporated": self.third, "evidence": "part III names another document and none of its items was found" if self.third else "no such reference near the part III heading, or items of it were found"}

    def assign_item(self, item: str, anchor_id: str | None = None, o: int | None = None, reasoning: str = "") -> dict:
        if item not in rules.LABELS:
            return {"error": f"unknown item {item}"}
        self._log("assign", item, anchor_id, o, reasoning)
        return {"assigned": item}

    def unassign_item(self, item: str) -> dict:
        """Logged even where nothing is assigned."""
        was = item in self.held
        self._log("unassign", item)
        return {"unassigned": item, "was_assigned": was}

    def batch_assign(self, assignments: list) -> dict:
        said = [self.assign_item(**{k: a.get(k) for k in ("item", "anchor_id", "o")}) if a.get("item") else {"error": "no item"} for a in assignments]
        return {"assigned": sum("assigned" in x for x in said), "errors": [x["error"] for x in said if "error" in x]}

    def get_current_assignments(self) -> list:
        order = sorted(self.held, key=lambda i: (-1 if self.held[i][1] is None else self.held[i][1], self.held[i][2], i))
        return [{"item": i, "anchor_id": self.held[i][0], "o": self.held[i][1], "rank": k} for k, i in enumerate(order, 1)]

    def validate_assignments(self) -> list:
        """Rows without a place stand first and count as predecessors."""
        found, before, place = [], None, None
        for i in sorted(self.held, key=lambda i: (-1 if self.held[i][1] is None else self.held[i][1], rules.SEQ[i])):
            o = self.held[i][1]
            if o is not None:
                found += [{"type": "out_of_range", "item": i}] * (o >= len(self.html))
                found += [{"type": "order_violation", "item": i}] * (before is not None and rules.SEQ[i] < before)
                found += [{"type": "non_monotonic", "item": i}] * (place is not None and o <= place)
                place = o
            before = rules.SEQ[i]
        return found + [{"type": "missing_expected", "item": i} for i in rules.EXPECTED if i not in self.held]

    def check_span_sizes(self) -> list:
        placed = sorted((o, rules.SEQ[i], i) for i, (_, o, _) in self.held.items() if o is not None)
        ends, n, out = [o for o, _, _ in placed[1:]] + [len(self.html)], len(self.html), []
        for (o, _, i), end in zip(placed, ends, strict=True):
            share = (end - o) / n if n else 0.0
            out.append({"item": i, "span_chars": end - o, "span_pct": round(share, 4), "flag": "large" if share > 0.4 else "small" if end - o < 100 else "ok"})
        return out

    def refine_boundary(self, item: str, search_radius: int = 5000) -> dict:
        at = self.held.get(item, (None, None))[1]
        if at is None:
            return {"error": f"{item} has no place"}
        r = min(search_radius, 20_000)
        return {"o": at, "anchors": [{"anchor_id": a["anchor_id"], "o": a["o"], "delta": a["o"] - at} for a in self.anchors if abs(a["o"] - at) <= r]}

    def scan_for_heading(self, item: str, start: int = 0, end: int | None = None, most: int = 5) -> list:
        if item not in rules.HEADINGS:
            return []
        start = max(0, start)
        region = self.html[start : len(self.html) if end is None else max(start, end)]
        shown, out = plain_text(region), []
        for m in pattern(rules.HEADINGS[item]).finditer(shown):
            if len(out) == most:
                break
            o = start + int(m.start() / len(shown) * len(region))
            near = min(((abs(a["o"] - o), a["o"], a["anchor_id"]) for a in self.anchors if abs(a["o"] - o) < 2000), default=(None, None, None), key=lambda x: x[:2])
            out.append({"o": o, "context": shown[max(0, m.start() - 50) : m.start() + 150].strip(" "), "near_id": near[2], "near_o": near[1], "distance": near[0]})
        return out

    def finalize(self) -> dict:
        bad = self.validate_assignments()
        self.done = not bad
        return {"is_valid": self.done, "n_issues": len(bad), "issues": bad}


def conversations(ix, model: Callable, max_turns: int = 30, begun: bool = True) -> DataFrame:
    """One run for each filing: turns, tokens, finalized, issues left, error and the event log.

    ``model``: messages to (text, calls, tokens), a function that can be pickled; it is called in the executors.  ``begun``: start
    with the chosen chain as turn 0.  A filing whose conversation fails keeps its events and names the error.
    """
    import pyarrow as pa

    event = pa.struct([("turn", pa.int32()), ("ord", pa.int32()), ("action", pa.string()), ("item", pa.string()), ("anchor_id", pa.string()), ("o", pa.int64()), ("reasoning", pa.string())])
    schema = pa.schema([("accession", pa.string()), ("turns", pa.int32()), ("tokens", pa.int64()), ("finalized", pa.bool_()), ("issues", pa.int32()), ("error", pa.string()), ("events", pa.list_(event))])

    def run(filings, rows):
        out = []
        for f in filings.to_pylist():
            desk = Desk(f["accession"], f["html"] or "", rows.to_pylist(), begun)

            def turn(messages, desk=desk):
                desk.turn += 1
                return model(messages)

            start = [{"role": "system", "content": "Settle the section boundaries of one filing with the tools."}, {"role": "user", "content": json.dumps(desk.get_filing_overview())}]
            try:
                got = resolver.converse(turn, desk.call, lambda desk=desk: len(desk.validate_assignments()), lambda desk=desk: desk.done, start, max_turns)
            except Exception as e:  # one filing's failure is not the corpus's
                got = {"turns": desk.turn, "tokens": 0, "finalized": False, "error": f"{type(e).__name__}: {e}"}
            made = [dict(zip(("turn", "ord", "action", "item", "anchor_id", "o", "reasoning"), e, strict=True)) for e in desk.events]
            out.append({k: got[k] for k in ("turns", "tokens", "finalized", "error")} | {"accession": desk.accession, "issues": len(desk.validate_assignments()), "events": made})
        return pa.Table.from_pylist(out, schema)

    texts = ix.filings.select("accession", "html")
    return texts.groupBy("accession").cogroup(entries(ix).groupBy("accession")).applyInArrow(run, RUNS)


def events_of(runs: DataFrame) -> DataFrame:
    """The event log of all runs, as ``state.fold`` takes it."""
    return runs.select("accession", F.explode("events").alias("e")).select("accession", "e.turn", "e.ord", "e.action", "e.item", "e.anchor_id", "e.o")


MISPLACED = ("order_violation", "non_monotonic", "out_of_range")


def steward(messages: list[dict], least: int = 5) -> tuple[str, list, int]:
    """A scripted model: gives every open item its surest candidate of confidence ``least`` or more, takes misplaced items away until none is left, then finalizes.

    It knows only what the tools have said, as a model would.
    """
    said, tried = {}, set()
    for m in messages:
        for name, args in m.get("calls") or ():
            tried |= {a["item"] for a in args.get("assignments", ())}
        for line in m["content"].split("\n") if m["role"] == "user" else ():
            if shown := re.match(r"\[(\w+)\] (.*)", line):
                said[shown[1]] = json.loads(shown[2])
    tokens = sum(len(m["content"]) for m in messages[-2:]) // 4
    if "validate_assignments" not in said:
        return "first the state", [("get_current_assignments", {}), ("validate_assignments", {}), ("get_all_top_candidates", {})], tokens
    if "finalize" in said:
        return "nothing more to do", [], tokens
    tried |= {a["item"] for a in said["get_current_assignments"]}
    wrong = dict.fromkeys(x["item"] for x in said["validate_assignments"] if x["type"] in MISPLACED)
    new = [{k: found[0][k] for k in ("item", "anchor_id", "o")} for i, found in said["get_all_top_candidates"].items() if i not in tried and found[0]["confidence"] >= least]
    out = [("unassign_item", {"item": i}) for i in wrong] + ([("batch_assign", {"assignments": new})] if new else [])
    return "", [*out, ("validate_assignments", {})] if out else [("finalize", {})], tokens
