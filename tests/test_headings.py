"""The heading fallback against a plain loop over strings."""

import html as entities
import re

from folioflow.functions import rules
from folioflow.operators import selection


def plain(html, want, have):
    at, out = dict(have), {}
    for item in sorted(want):
        if item in at or item not in rules.HEADINGS:
            continue
        x = rules.SEQ[item]
        lo = max([0, *(o for k, o in at.items() if rules.SEQ.get(k, -1) < x)])
        hi = min([len(html), *(o for k, o in at.items() if rules.SEQ.get(k, -1) > x)])
        text = re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]+>", " ", html[lo:max(lo, hi)])).replace(" ", " ")).strip().lower()
        m = re.search(rules.HEADINGS[item].replace("(?Ui)", ""), text)
        if m and m.start() > 20:
            at[item] = out[item] = lo + int(m.start() / len(text) * (hi - lo))
    return out


FILL = "<p>Some words &amp; marks \U0001f600 of a page</p> "
HEADS = ["Item&nbsp;1. Business", "<b>ITEM 1A.</b> Risk Factors", "Item 2. Properties", "Item 3 Legal Proceedings", "Item 7A. Quantitative", "Item 10. Directors"]
PAGE = "".join(FILL * (k + 1) + f"<h2>{h}</h2>" for k, h in enumerate(HEADS)) + FILL * 3

#: html, wanted items, chosen places
CASES = {
    "between": (PAGE, ["item1a", "item2", "item3", "item7a", "item10", "signatures"], [("item1", 40), ("item9", 1200)]),
    "narrowing": (PAGE, ["item10", "item2", "item3"], [("item1", 0)]),
    "too early": ("<p>Item 2. Properties</p>" + FILL, ["item2"], [("item1", 0)]),
    "crossed neighbours": (PAGE, ["item2"], [("item1", 900), ("item3", 100)]),
    "unknown label": (PAGE, ["item2", "item99"], [("exhibits", 300), ("item1", 5)]),
    "empty": ("", ["item2"], [("item1", 0)]),
    "astral": ("\U0001f600" * 60 + PAGE, ["item1a", "item2"], [("item1", 3)]),
    "chosen already": (PAGE, ["item2"], [("item2", 50)]),
    "no place": (PAGE, ["item2"], []),
    "long": (FILL * 5000 + "<p>Item 4. Mine Safety</p>" + FILL, ["item4"], [("item1", 0), ("item1", 0)]),
}


def test_heading_fallback_equals_plain_loop(spark):
    filings = spark.createDataFrame([(k, c[0]) for k, c in CASES.items()] + [("null", None)], "accession string, html string")
    # a wanted item may be listed twice
    wanted = spark.createDataFrame([(k, i) for k, c in CASES.items() for i in c[1] * 2] + [("null", "item2")], "accession string, item string")
    chosen = spark.createDataFrame([(k, *x) for k, c in CASES.items() for x in c[2]] + [("null", "item1", 0)], "accession string, item string, o int")
    found = selection.heading_fallback(filings, chosen, wanted)
    got = {(r.accession, r.item): r.o for r in found.collect()}
    want = {(k, i): o for k, (page, items, have) in CASES.items() if have for i, o in plain(page, items, have).items()}
    assert got == want and len(want) >= 8
    assert not {k for k, _ in got} & {"too early", "crossed neighbours", "empty", "chosen already", "no place", "null"}
    assert "Python" not in (shown := found._jdf.queryExecution().toString()) and "InArrow" not in shown


def test_heading_fallback_of_empty_tables(spark):
    none = spark.createDataFrame([], "accession string, item string, o int")
    assert selection.heading_fallback(spark.createDataFrame([], "accession string, html string"), none, none.drop("o")).count() == 0


def test_all_labels_together_find_what_each_finds_alone(spark):
    """One reading of a text gives the places of every label, also where mentions touch, overlap or stand at the end."""
    from folioflow.functions import rules
    from folioflow.operators import anchors

    texts = [
        "Item 1. Business Item 1A. Risk item1item 2 Item 7 - A ITEM 7A item 7 a item 7b Item 9 c Item 10 Item 1 0 item 16", "item 1" * 9, "Item 7A Item 7", "item item 7 item", "", None, "no mention",
        "é😀 Item 5 語 İtem 6 ıtem 6 item 8 item 9 item 1١ item 15x Item 15", " ".join(f"Item {n}{c}{s}" for n in range(18) for c in ("", "a", " B", "-c", " — c") for s in (".", " ", "x", "")) * 2,
    ]
    region = spark.createDataFrame([(str(k), len(t or "") * 3, t) for k, t in enumerate(texts)], "accession string, size int, t string")
    found = spark.createDataFrame([], "accession string, anchor_id string, o int")
    want = {(r.accession, label, r.ord, r.o) for label in rules.HEADINGS for r in anchors.scan_region(region, label, found).collect()}
    made = anchors.places(region, rules.HEADINGS)
    assert {tuple(r) for r in made.collect()} == want and len(want) > 100 and made.count() == len(want)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan


def test_heading_scan_reads_texts_once_for_all_labels(spark):
    """The query was a union of two readings of all texts for each label."""
    from folioflow import catalog

    plan = catalog.QUERIES["heading_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") <= 4


def test_candidates_ask_each_text_once(spark):
    """What a query leaves is not worked out, no rule is asked twice by a pushed filter, and no text is dealt out by anchor."""
    from folioflow.functions import rules
    from folioflow.functions import text as T
    from folioflow.operators import anchors, candidates

    html = "<p>Item 1. Business</p>" + "".join(f'<div><a id="a{k}"></a></div><p>Item {k}. Risk factors &amp; more {k}</p>' for k in range(1, 9))
    f = spark.createDataFrame([("1", html), ("2", "")], "accession string, html string")
    found = spark.createDataFrame([("1", f"a{k}", html.index(f'<a id="a{k}"'), "a", "id") for k in range(1, 9)], "accession string, anchor_id string, o int, tag string, attr string")
    items = spark.createDataFrame([("1", "a3", ["item3"], ["item3"])], "accession string, anchor_id string, items array<string>, firsts array<string>")
    apart = candidates.labelled(anchors.windows(f, found), items)
    joined = candidates.labelled(anchors.windows(f, found.join(items, ["accession", "anchor_id"], "left")))
    for step in (candidates.collect, candidates.cascade):
        rows = sorted(map(tuple, step(joined).collect()))
        assert rows == sorted(map(tuple, step(apart).collect())) and len(rows) >= 8
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    # three windows are normalised, each once
    assert plan(anchors.windows(f, found)).count(f", {T.SPACE}, ") == 3
    # cascade's filter stays above the rules: as many readings as its columns have, with or without it
    assert plan(candidates.cascade(joined)).count(f", {rules.TITLE}, ") == plan(joined.select("h150", "t150", "hfull", "tfull", "hboth", "tboth", "by_id", "shared", "toc", "firsts")).count(f", {rules.TITLE}, ")
    # tfull is left by collect
    assert plan(candidates.collect(joined)).count(f", {rules.TITLE}, ") < plan(candidates.cascade(joined)).count(f", {rules.TITLE}, ")


def test_settled_rules_are_not_asked(spark):
    from folioflow.operators import candidates

    w = spark.createDataFrame([("1", "a", 0, "a", 9, "x", "item 1. business risk factors", "item 2."), ("1", "b", 1, "a", 9, "x", "y " * 100 + "item 3. risk factors", "")], "accession string, anchor_id string, o int, tag string, html_len int, nearby string, ahead string, behind string")
    items = spark.createDataFrame([], "accession string, anchor_id string, items array<string>, firsts array<string>")
    got = {r.anchor_id: r for r in candidates.labelled(w, items).collect()}
    assert got["a"].h150.label == "item1" and got["a"].hfull is None and got["a"].tfull is None and got["a"].hboth is None and got["a"].tboth is not None
    assert got["b"].h150 is None and got["b"].hfull == "item3" and got["b"].tfull is None
