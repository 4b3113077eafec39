"""Conversations in the executors: every tool against the same tool as a plan, and runs against plain expectations."""

import json

import pytest

from folioflow.functions import rules
from folioflow.operators import agents, anchors, resolver, state
from folioflow.operators.tools import Tools
from folioflow.plans import rule_pipeline
from folioflow.plans.synthetic import filings
from test_engine import MADE, SF

EVENTS = "accession string, turn int, ord int, action string, item string, anchor_id string, o long"


@pytest.fixture(scope="module")
def corpus(spark):
    made = spark.createDataFrame([(f"made{k}", x) for k, x in enumerate(MADE)] + [("none", None), ("empty", "")], "accession string, html string")
    return rule_pipeline.build_index(filings(spark, SF).limit(12).unionByName(made))


@pytest.fixture(scope="module")
def desks(corpus):
    rows = {}
    for r in agents.entries(corpus).collect():
        rows.setdefault(r.accession, []).append(r.asDict())
    return {r.accession: agents.Desk(r.accession, r.html or "", rows.get(r.accession, [])) for r in corpus.filings.collect()}


@pytest.fixture(scope="module")
def tools(spark, corpus):
    made = Tools(corpus, spark.createDataFrame([], EVENTS))
    made.call("pre_populate")
    return made


def by_filing(df, *columns, drop=()):
    out = {}
    for r in df.collect():
        if r.accession not in drop:
            out.setdefault(r.accession, []).append(tuple(r[c] for c in columns))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def of_desks(desks, answer, *columns, drop=()):
    out = {a: sorted((tuple(r[c] for c in columns) for r in answer(d)), key=repr) for a, d in desks.items() if a not in drop}
    return {k: v for k, v in out.items() if v}


def test_reading_tools_equal_the_plans(tools, desks, corpus):
    ask = lambda name, **args: tools.call(name, **args)
    assert of_desks(desks, lambda d: [d.get_filing_overview()], "links", "classified", "candidates", "items", "incorporated", drop=[a for a, d in desks.items() if not d.links]) == by_filing(ask("get_filing_overview"), "links", "classified", "candidates", "items", "incorporated")
    assert of_desks(desks, lambda d: d.get_part_boundaries(), "part", "o", "rel") == by_filing(ask("get_part_boundaries"), "part", "o", "rel")
    for item in ("item1", "item2", "item8", "signatures", "nothing"):
        assert of_desks(desks, lambda d, i=item: d.get_item_candidates(i), "anchor_id", "o", "confidence", "source") == by_filing(ask("get_item_candidates", item_name=item), "anchor_id", "o", "confidence", "source")
    tops = {a: sorted((i, r["anchor_id"], r["confidence"], r["source"]) for i, found in d.get_all_top_candidates().items() for r in found) for a, d in desks.items()}
    assert {a: v for a, v in tops.items() if v} == {a: sorted(v) for a, v in by_filing(ask("get_all_top_candidates"), "item", "anchor_id", "confidence", "source").items()}
    for at, size in ((0, 500), (300, 2500), (1 << 20, 50)):
        assert {a: [(d.read_text_at(at, size),)] for a, d in desks.items() if a != "none"} == by_filing(ask("read_text_at", position=at, length=size), "text", drop=["none"])
    for item in ("part3", "item11", "item1"):
        assert of_desks(desks, lambda d, i=item: [d.detect_incorporation(i)], "incorporated", "evidence", drop=["none"]) == by_filing(ask("detect_incorporation", item_name=item), "incorporated", "evidence", drop=["none"])
    links = {a: {(r["anchor_id"], r["item"]) for r in d.get_toc_links()} for a, d in desks.items() if d.links}
    assert links == {a: set(v) for a, v in by_filing(corpus.links, "anchor_id", "item").items()}


def test_classifying_and_scanning_tools_equal_the_plans(spark, tools, desks):
    desk = desks["made0"]
    texts = ["Item 1.A. Risk", "item 9 c", "ITEM 7", "see signatures", "our properties", "Financial statements and exhibits", "financial statements and supplementary data", "management's discussion and analysis", "nothing", "", "item 16", "item 17", "10-K Summary", "selected consolidated financial data", "[reserved]", "x[reserved]"]
    got = {r.text: (r.heading, r.title) for r in tools.call("classify_text", texts=spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {t: tuple(desk.classify_text(t).values()) for t in texts}
    for item in ("item2", "item7", "item1a", "item10"):
        assert of_desks(desks, lambda d, i=item: d.scan_for_heading(i), "o", "context", "near_id", "near_o", "distance", drop=["none"]) == by_filing(tools.call("scan_for_heading", item=item), "o", "context", "near_id", "near_o", "distance", drop=["none"])
    assert of_desks(desks, lambda d: d.scan_for_heading("item3", 40, 900), "o", "distance", drop=["none"]) == by_filing(tools.call("scan_for_heading", item="item3", start=40, end=900), "o", "distance", drop=["none"])


def test_assignment_tools_equal_the_plans(spark, corpus, desks):
    """The same odd assignments in both: order broken, equal places, a place past the end, none at all, one taken away."""
    extra = [("item9", "q", 5), ("item3", "q", 5), ("item15", None, -1), ("item16", "z", 10**7), ("item2", "a", 50)]
    events, fresh = [], {}
    for a, d in desks.items():
        if a == "none":
            continue
        now = fresh[a] = agents.Desk(a, d.html, [])
        now.turn = 1
        now.batch_assign([{"item": i, "anchor_id": x, "o": o} for i, x, o in extra])
        now.turn = 2
        assert now.unassign_item("item2") == {"unassigned": "item2", "was_assigned": True}
        assert now.unassign_item("item4")["was_assigned"] is False
        events += [(a, *e[:6]) for e in now.events]
    tools = Tools(corpus, spark.createDataFrame(events, EVENTS))
    assert of_desks(fresh, lambda d: d.get_current_assignments(), "item", "anchor_id", "o", "rank") == by_filing(tools.call("get_current_assignments"), "item", "anchor_id", "o", "rank")
    assert of_desks(fresh, lambda d: d.validate_assignments(), "type", "item") == by_filing(tools.call("validate_assignments").filter("accession <> 'none'"), "type", "item")
    assert of_desks(fresh, lambda d: d.check_span_sizes(), "item", "span_chars", "span_pct", "flag") == by_filing(tools.call("check_span_sizes"), "item", "span_chars", "span_pct", "flag")
    near = {a: sorted((r["anchor_id"], r["delta"]) for r in d.refine_boundary("item9", 400)["anchors"]) for a, d in fresh.items()}
    assert {a: d for a, d in desks.items() if d.anchors}
    for a, d in fresh.items():
        d.anchors = desks[a].anchors
    near = {a: sorted((r["anchor_id"], r["delta"]) for r in d.refine_boundary("item9", 400)["anchors"]) for a, d in fresh.items()}
    points = state.fold(tools.events).filter("item = 'item9'").select("accession", "item", "o")
    assert {a: v for a, v in near.items() if v} == {a: sorted(v) for a, v in by_filing(anchors.within(points, corpus.anchors, 400), "anchor_id", "delta").items()}
    done = {r.accession: (r.is_valid, r.n_issues) for r in tools.call("finalize").collect() if r.accession != "none"}
    assert done == {a: ((x := d.finalize())["is_valid"], x["n_issues"]) for a, d in fresh.items()}


def test_the_protocol_reports_errors(desks):
    desk = agents.Desk("a", "<p>x</p>", [])
    say = lambda name, **args: json.loads(desk.call(name, args))
    assert "unknown tool" in say("_log")["error"] and "unknown tool" in say("call")["error"]
    assert "error" in say("read_text_at", nothing=1) and say("assign_item", item="item99") == {"error": "unknown item item99"}
    assert say("batch_assign", assignments=[{"item": "item2", "o": 3}, {"item": "zz"}, {"o": 1}]) == {"assigned": 1, "errors": ["unknown item zz", "no item"]}
    assert "error" in say("refine_boundary", item="item7") and say("scan_for_heading", item="signatures") == []
    assert set(agents.Desk.TOOLS) <= set(dir(agents.Desk)) and len(agents.Desk.TOOLS) == 17


def test_runs_equal_plain_conversations(corpus, desks):
    """The same conversations, one after the other, without Spark."""
    got = {r.accession: r for r in agents.conversations(corpus, agents.steward, begun=False).collect()}
    assert set(got) == set(desks)
    for a, d in desks.items():
        desk = agents.Desk(a, d.html, [], begun=False)
        desk.links, desk.candidates, desk.parts, desk.anchors, desk.third = d.links, d.candidates, d.parts, d.anchors, d.third
        place = {i: (r["anchor_id"], r["o"]) for i in rules.LABELS if (c := d.get_item_candidates(i)) and (r := c[0])["confidence"] >= 5}
        while True:
            order = sorted(place, key=lambda i: (place[i][1], rules.SEQ[i]))
            bad = [i for p, i in zip(order, order[1:], strict=False) if rules.SEQ[i] < rules.SEQ[p] or place[i][1] <= place[p][1]]
            if not bad:
                break
            for i in bad:
                del place[i]
        held = {}
        for e in got[a].events:
            held.pop(e.item, None)
            if e.action == "assign":
                held[e.item] = (e.anchor_id, e.o)
        assert held == place, a
        missing = sum(i not in place for i in rules.EXPECTED)
        assert (got[a].issues, got[a].finalized, got[a].error) == (missing, missing == 0, None)


def test_a_failed_conversation_keeps_the_others(corpus, desks):
    def fails_on_big(messages):
        if json.loads(messages[1]["content"])["html_len"] > 3000:
            raise resolver.ModelError("quota")
        return "", [("finalize", {})], 1

    def breaks(messages):
        raise RuntimeError("lost")

    got = {r.accession: r for r in agents.conversations(corpus, fails_on_big).collect()}
    for a, d in desks.items():
        assert got[a].error == ("quota" if len(d.html) > 3000 else None)
        assert [(e.item, e.o) for e in got[a].events] == [(e[3], e[5]) for e in d.events][: len(got[a].events)]
    assert {r.error for r in agents.conversations(corpus, breaks).collect()} == {"RuntimeError: lost"}


def test_runs_take_one_job_over_the_index(spark, corpus):
    plan = agents.conversations(corpus, agents.steward)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1
