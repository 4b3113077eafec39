"""Results and reports, noise rules, the model in the loop and the learned scores."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import anchors, candidates, evaluation, rescoring, resolver, selection
from folioflow.plans import rule_pipeline
from folioflow.plans.synthetic import filings
from folioflow.sources import results, submissions

SF = "/root/testdata/sf0.001"


def test_noise_rules(spark):
    long = "x" * 1_000_001
    rows = [
        ("signatures", "missing", "", "", None, None, True), ("signatures", "missing", "s" * 500, "", 1000, False, True), ("signatures", "missing", "s" * 100, "", 1000, True, True), ("signatures", "missing", "s" * 100, "", 1000, False, False),
        ("item16", "missing", "<p>none</p>", "", None, None, True), ("item16", "missing", "word " * 50, "", None, None, False), ("item7", "missing", "", "", None, None, False), ("signatures", "fp", "", "z" * 9000, None, None, True),
        ("item16", "fp", "", "short", None, None, True), ("item16", "fp", "", "Item 16. None. " + "<br>" * 2000, None, None, True), ("item16", "fp", "", "Item 16. We sell things " + "a " * 2000, None, None, False), ("item2", "fp", "", "x", None, None, False),
        ("signatures", "boundary", long, "x", None, None, True), ("signatures", "boundary", "x" * 300, "y", None, None, False), ("item16", "boundary", "short", "other", None, None, True), ("item16", "boundary", long, "other", None, None, True),
        ("item16", "boundary", "word " * 50, "other", None, None, False), ("item8", "boundary", long, "x", None, None, False),
    ]
    df = spark.createDataFrame([(str(k), *r[:4], 0.25, *r[4:6]) for k, r in enumerate(rows)], "accession string, item string, kind string, truth string, pred string, f1 double, file_size long, detected boolean")
    got = {int(r.accession): r for r in evaluation.noise(df).collect()}
    assert [got[k].noisy for k in range(len(rows))] == [r[6] for r in rows]
    assert got[17].reason == "boundary item8 (F1=0.250)" and got[6].reason == "missing item7" and got[7].reason.startswith("FP signatures (")
    assert {r.reason for r in evaluation.reasons(evaluation.noise(df)).collect()} >= {"missing signatures", "FP item16", "boundary item8"}
    bare = evaluation.noise(df.drop("file_size", "detected"))
    assert bare.count() == len(rows) and evaluation.item_counts(df, 2).count() == 2
    # An accession with a golden item without text can only miss it.
    gold = spark.createDataFrame([("a", "item1", ""), ("a", "item2", "")], "accession string, item string, html string")
    pred = spark.createDataFrame([("a", "item1", "text"), ("a", "item3", "x")], "accession string, item string, html string")
    assert {(r.item, r.kind) for r in evaluation.failures(gold, pred).collect()} == {("item2", "missing"), ("item3", "fp")}


def test_results_and_report(spark, tmp_path):
    gold = spark.createDataFrame([("a", "item1", "abcdef"), ("a", "item2", "xyz"), ("b", "item1", "same")], "accession string, item string, html string")
    pred = spark.createDataFrame([("a", "item1", "abcdef"), ("b", "item1", "same"), ("a", "item9", "?")], "accession string, item string, html string")
    items, extra = evaluation.eval_items(gold, pred), evaluation.false_positives(gold, pred)
    docs = evaluation.eval_docs(items, extra)
    runs = spark.createDataFrame([("a", "m", 4, 1000, 5, True, None, 2, 9), ("b", "m", 2, 3000, 5, True, None, 1, 9), ("c", "m", 1, 0, 5, False, "API error: no answer", 0, 0)], "accession string, model string, turns int, tokens int, latency_ms int, finalized boolean, error string, pred_items int, candidates int")
    made = results.result_rows(items, docs, runs)
    results.write_results(made, str(tmp_path / "r"))
    back = results.read_results(spark, str(tmp_path / "r"))
    assert sorted(map(str, back.collect())) == sorted(map(str, made.collect())) and results.read_results(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "results.json").write_text('[{"accession": "q", "f1": 0.5, "failed_items": {"item1": {"f1": 0.1, "pred_len": 2, "truth_len": 3}}},\n {"accession": "r"}]')
    old = {r.accession: r for r in results.read_results(spark, str(tmp_path / "old")).collect()}
    assert set(old) == {"q", "r"} and old["q"].failed_items["item1"].truth_len == 3
    by = {r.accession: r for r in back.collect()}
    assert by["a"].failed_items["item2"].f1 == 0.0 and by["a"].false_positives == ["item9"] and by["b"].doc_retrieved and not by["a"].doc_retrieved
    left = submissions.unfinished(spark.createDataFrame([("a",), ("d",)], "accession string"), back)
    assert [r.accession for r in left.collect()] == ["d"]
    lines = results.report(back, "A run")
    text = [r.line for r in lines.orderBy("part", "accession", "n").collect()]
    assert text[0] == "# A run" and "| Document retrieval | 1/3 (33.3%) |" in text and "| b | 100.0% | yes | 2 | 3,000 |  |" in text
    assert "- item2: F1 0.000 (predicted 0, golden 3 characters)" in text and "- False positives: item9" in text and any(x.startswith("| c | 0.0% | no | 1 | 0 | error: API") for x in text)
    results.write_report(lines, str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).coalesce(1).collect()].count("# A run") == 1
    assert results.summary(back.limit(0)).first().filings == 0 and results.report(back.limit(0), "Empty").count() == 16


def test_discovery_takes_sets_in_order(spark):
    sources = spark.createDataFrame([("b", 1, "p"), ("a", 2, "q"), ("a", 1, "r"), ("c", 1, "s")], "accession string, folder int, path string")
    golden = spark.createDataFrame([("a", 2, False, "a#x"), ("b", 1, False, "b#x"), ("b", 1, False, "b#y"), ("c", 1, True, None)], "accession string, gt_set int, malformed boolean, key string")
    got = [(r.accession, r.path, r.gt_item_count) for r in submissions.discover(sources, golden, 2).collect()]
    assert got == [("b", "p", 2), ("a", "r", 1)] and submissions.discover(sources, golden, 1).first().accession == "b"


def test_doubtful_items_are_settled_by_the_model(spark):
    def answer(prompt):
        """A stand-in for a model: it moves one item, removes one, answers nonsense and fails."""
        for item, text in (("item2", '```json\n{"action": "move", "anchor_id": "z", "char_position": 42}\n```'), ("item3", '{"action": "remove"}'), ("item4", "no json"), ("item7", '{"action": "move", "char_position": -1}')):
            if f"Item: {item}\n" in prompt:
                return text, 10
        raise RuntimeError("down")

    f = spark.createDataFrame([("a", "<p>some text</p>" * 100)], "accession string, html string")
    chosen = spark.createDataFrame([("a", f"item{k}", f"x{k}", 100 * k) for k in (1, 2, 3, 4, 5, 7)], "accession string, item string, anchor_id string, o long")
    doubtful = spark.createDataFrame([("a", f"item{k}", "low confidence") for k in (2, 3, 4, 5, 7)] + [("a", "item8", "missing")], "accession string, item string, reasons string")
    cands = spark.createDataFrame([("a", "item2", f"c{k}", k, k, "tier1", "near") for k in range(8)], "accession string, item string, anchor_id string, o int, confidence int, source string, nearby_text string")
    asked = resolver.questions(f, chosen, doubtful, cands)
    text = {r.item: r.prompt for r in asked.collect()}
    assert len(text) == 6 and "anchor=c7" in text["item2"] and "anchor=c2" not in text["item2"] and "Place now: unassigned" in text["item8"] and "(none)" in text["item8"] and "some text" in text["item3"]
    got = resolver.decisions(asked, answer)
    by = {r.item: r for r in got.collect()}
    assert [by[f"item{k}"].action for k in (2, 3, 4, 5, 7, 8)] == ["move", "remove", "keep", "keep", "move", "keep"] and by["item5"].reasoning == "model error: down" and by["item2"].tokens == 10
    after = {r.item: (r.anchor_id, r.o) for r in resolver.resolved(chosen, got).collect()}
    assert after == {"item1": ("x1", 100), "item2": ("z", 42), "item4": ("x4", 400), "item5": ("x5", 500), "item7": ("", None)}


class Script:
    """A model that plays a list of answers."""

    def __init__(self, *steps):
        self.steps, self.seen = list(steps), []

    def __call__(self, messages):
        self.seen.append([m["content"] for m in messages])
        step = self.steps.pop(0) if len(self.steps) > 1 else self.steps[0]
        if isinstance(step, Exception):
            raise step
        return step


def run(model, issues, turns=30, done=lambda: False, **more):
    waits = []
    out = resolver.converse(model, lambda name, args: f"{name} ok", issues, done, [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}], max_turns=turns, wait=waits.append, **more)
    return out, waits


def test_conversation_rules():
    call = ("", [("validate_assignments", {})], 7)
    out, _ = run(Script(("bye", [], 3)), lambda: 0)
    assert (out["turns"], out["tokens"], out["finalized"], out["error"]) == (1, 3, False, None)
    out, waits = run(Script(resolver.ModelError("429", limited=True), resolver.ModelError("502", server=True), ("bye", [], 3)), lambda: 0)
    assert out["error"] is None and waits == [10, 6]
    out, waits = run(Script(resolver.ModelError("429", limited=True)), lambda: 0)
    assert out["error"] == "429 after 3 retries" and waits == [10, 20, 30] and out["turns"] == 0
    out, waits = run(Script(resolver.ModelError("bad request")), lambda: 0)
    assert out["error"] == "bad request" and waits == []
    out, _ = run(Script(call), lambda: 5)
    said = [m["content"] for m in out["messages"] if m["content"] in (resolver.NUDGE, resolver.STOP)]
    assert out["turns"] == 30 and said == [resolver.NUDGE] * 6 + [resolver.STOP] * 3
    left = iter(range(100, 0, -1))
    out, _ = run(Script(call), lambda: next(left))
    assert resolver.NUDGE not in [m["content"] for m in out["messages"]]
    state = {"n": 0}
    out, _ = run(Script(call), lambda: 1, done=lambda: state.update(n=state["n"] + 1) or state["n"] > 4)
    assert out["finalized"] and out["turns"] < 30
    big = ("x" * 30_000, [("t", {"a": "y" * 10})], 1)
    out, _ = run(Script(big), lambda: 0, turns=20)
    assert sum("left out" in m["content"] for m in out["messages"]) >= 1 and out["messages"][1]["content"] == "u"
    assert resolver.message_chars([{"content": "abc", "calls": [("t", {"a": 1})]}, {"content": None}]) == 3 + len("{'a': 1}")


def test_a_model_may_label_what_no_rule_can(spark):
    html = '<a href="#q">see</a><p id="q">' + "qqq words without any label " * 4 + "</p>"
    f = spark.createDataFrame([("a", html)], "accession string, html string")
    found = anchors.anchors(f)
    lab = candidates.labelled(anchors.windows(f, found), anchors.anchor_items(anchors.toc_links(f)))
    assert candidates.cascade(lab).count() == 0
    got = candidates.cascade(lab, lambda text: F.when(text.contains("qqq"), "item5")).collect()
    assert [(r.item, r.confidence) for r in got] == [("item5", 5)]


@pytest.fixture(scope="module")
def learned(spark):
    f = filings(spark, SF)
    ix = rule_pipeline.build_index(f)
    golden = selection.slices(ix.filings, ix.chosen)
    return ix, golden, rescoring.golden_places(ix.filings, golden)


def test_boundary_model(spark, learned):
    ix, golden, places = learned
    data = rescoring.boundary_dataset(rescoring.boundary_features(ix.filings, ix.anchors, ix.items), rescoring.boundary_labels(ix.anchors, places)).cache()
    train, test = data.filter("crc32(cast(accession as binary)) % 2 = 0"), data.filter("crc32(cast(accession as binary)) % 2 = 1")
    model = rescoring.fit_boundaries(train, trees=5)
    report = rescoring.boundary_report(model, test)
    assert report["n"] == test.count() and 0.5 <= report["auc"] <= 1 and 0 < report["precision"] <= 1
    top = rescoring.importances(model)
    assert len(top) == 10 and {k for k, _ in top} <= set(rescoring.BOUNDARY) and len(rescoring.BOUNDARY) == 27


def test_label_model(spark, learned):
    ix, golden, places = learned
    feats = rescoring.label_features(ix.filings, ix.anchors, ix.items)
    labels = rescoring.anchor_labels(ix.anchors, places)
    assert rescoring.class_counts(labels).count() == 5 and labels.count() == ix.anchors.count()
    model = rescoring.fit_labels(feats, labels, trees=10, depth=8)
    cands = rescoring.learned_candidates(model, feats)
    assert cands.filter("confidence < 0 or confidence > 10").count() == 0
    made = rescoring.learned_sections(model, ix.filings, feats)
    scored = evaluation.eval_items(golden.filter("html <> ''"), made).agg(F.avg("f1")).first()[0]
    assert scored > 0.5
    rows = spark.createDataFrame([(0.7, "t", "p"), (0.0, "", ""), (0.0, None, "p")], "f1 double, truth string, pred string")
    assert [r[0] for r in rows.select(rescoring.lenient_f1(F.col("f1"), F.col("truth"), F.col("pred"))).collect()] == [0.7, 1.0, 0.5]


def test_golden_places_take_the_shorter_needle(spark):
    text = "".join(chr(97 + k * 7 % 26) for k in range(300))
    f = spark.createDataFrame([("a", "0123" + text[:80] + "!" + text)], "accession string, html string")
    golden = spark.createDataFrame([("a", "item1", text), ("a", "item2", text[:60] + "?" * 200), ("a", "item3", "short"), ("a", "item4", "not there at all")], "accession string, item string, html string")
    assert {(r.item, r["at"]) for r in rescoring.golden_places(f, golden).collect()} == {("item1", 85), ("item2", 4)}


def test_trailing_marks_and_swapped_sections(spark):
    ends = ["<p>text</p>", "<p>text</p><hr/><p>&nbsp;</p>", "<p>text</p> <div><b>PART II</b></div> <hr><span> </span>", "<p>text</p><p>Table of Contents</p>", "<p>PART time</p>"]
    got = [r[0].strip() for r in spark.createDataFrame([(k, x) for k, x in enumerate(ends)], "k int, h string").coalesce(1).orderBy("k").select(selection.without_trailing_marks(F.col("h"))).collect()]
    assert got == ["<p>text</p>"] * 4 + ["<p>PART time</p>"]
    six = "a" * 250_000 + "<p><b>Item 7. MD and A</b></p>" + "b" * 50
    made = spark.createDataFrame([("x", "item6", six), ("x", "item7", "tail"), ("x", "item1", "one"), ("y", "item6", six), ("z", "item6", six[:1000]), ("z", "item7", "t")], "accession string, item string, html string")
    out = {(r.accession, r.item): r.html for r in selection.unswapped(made).collect()}
    assert out["x", "item6"] == "a" * 250_000 and out["x", "item7"] == six[250_000:] + "tail" and out["x", "item1"] == "one" and out["y", "item6"] == six and out["z", "item7"] == "t" and len(out) == 6
