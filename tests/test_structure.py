"""One row of structure for each filing against the matches of plain patterns."""

import re

from folioflow.operators import anchors
from folioflow.plans.store import written

PAGES = {
    "a": '<a href="#x1">Item 1. Business</a><a href="#x2">12</a>\U0001f600<div id="x1"><b>PART I</b></div><p name="x2">t</p><div id="x1">PART</div><h1>Part II</h1>',
    "none": "no tags at all",
    "empty": "",
    "unclosed": '<a href="#x9">never ended <div id="x9">',
    "long": "<p>word</p>" * 3000 + '<A HREF="#Z">Risk <b>Factors</b></A>' + '<span id="Z">s</span>' * 200,
    "null": None,
}


def python(pattern):
    return re.compile(pattern)


def test_structure_equals_plain_matches(spark):
    filings = spark.createDataFrame(list(PAGES.items()), "accession string, html string")
    rows = {r.accession: r for r in anchors.structure(filings).collect()}
    for acc, page in PAGES.items():
        row = rows[acc]
        if page is None:
            assert row.links is row.marks is row.heads is row.refs is row.n is None
            continue
        assert row.n == len(page)
        assert [(x.o, x.m, x.before) for x in row.links] == [(m.start(), m[0], page[max(0, m.start() - 1000) : m.start()]) for m in python(anchors.LINK).finditer(page)]
        for got, pattern in ((row.marks, anchors.ANCHOR), (row.heads, anchors.PART)):
            assert [(x.o, x.m) for x in got] == [(m.start(), m[0]) for m in python(pattern).finditer(page)]
        assert row.refs == list(dict.fromkeys(python(anchors.REFERENCE).findall(page)))
    assert len(rows["a"].links) == 2 and len(rows["long"].marks) == 200 and len(rows["unclosed"].refs) == 1


def test_tables_of_written_structure_read_no_text(spark):
    filings = spark.createDataFrame(list(PAGES.items()), "accession string, html string")
    rows = written(anchors.structure(filings), "structure")
    for of, plain in ((anchors.links_of, anchors.toc_links), (anchors.anchors_of, anchors.anchors), (anchors.parts_of, anchors.part_boundaries), (anchors.records_of, anchors.link_records), (anchors.ids_of, anchors.referenced_ids)):
        made = of(rows)
        assert sorted(map(str, made.collect())) == sorted(map(str, plain(filings).collect())) and made.count()
        assert "html" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_not_asked_for_is_not_computed(spark):
    filings = spark.createDataFrame(list(PAGES.items()), "accession string, html string")
    shown = anchors.referenced_ids(filings)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("regexp_extract_all") == 1 and "split(" not in shown
