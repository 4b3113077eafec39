"""Scoring of section texts against golden ones, and the accounts made from the scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.plans.store import written


def char_f1(pairs: DataFrame, keys: list[str], left: str = "pred", right: str = "truth") -> DataFrame:
    """``pairs`` with ``overlap`` and ``char_f1``: F1 of the two texts' character multisets after stripping.

    Counted inside the row: for each distinct character of one text, how often both have it.  Nothing is shuffled.
    """
    twice = lambda t: F.aggregate(F.array(F.lit(1), F.lit(2)), t, lambda html, _: T.strip_html(html))
    both = F.transform(F.array(F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))), twice)
    p = pairs.select(*keys, both.alias("t")).select(*keys, F.get("t", F.lit(0)).alias("p"), F.get("t", F.lit(1)).alias("g"))
    p = p.withColumns({"pred_len": F.length("p").cast("long"), "truth_len": F.length("g").cast("long")})
    times = lambda t, n, c: F.col(n) - F.length(F.replace(F.col(t), c, F.lit("")))
    shorter = F.when(F.col("pred_len") < F.col("truth_len"), F.col("p")).otherwise(F.col("g"))
    common = F.aggregate(F.filter(F.array_distinct(F.split(shorter, "")), lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: n + F.least(times("p", "pred_len", c), times("g", "truth_len", c)))
    both = p.select(*keys, "pred_len", "truth_len", (F.col("p") == F.col("g")).alias("exact_match"), common.alias("overlap"))
    f1 = F.when((F.col("pred_len") == 0) & (F.col("truth_len") == 0), 1.0).when((F.col("pred_len") == 0) | (F.col("truth_len") == 0), 0.0).otherwise(2 * F.col("overlap") / (F.col("pred_len") + F.col("truth_len")))
    return both.withColumn("f1", f1.cast("double"))


def eval_items(golden: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row for each golden item; a missing prediction is the empty text."""
    j = golden.select("accession", "item", F.col("html").alias("truth")).join(predicted.select("accession", "item", F.col("html").alias("pred"), F.lit(True).alias("has")), ["accession", "item"], "left")
    scored = char_f1(j, ["accession", "item"])
    return j.select("accession", "item", F.coalesce("has", F.lit(False)).alias("extracted")).join(scored, ["accession", "item"]).withColumn("char_f1", F.round("f1", 4))


def false_positives(golden: DataFrame, predicted: DataFrame) -> DataFrame:
    return predicted.select("accession", "item").join(golden, ["accession", "item"], "left_anti")


def missing_items(golden: DataFrame, predicted: DataFrame) -> DataFrame:
    return golden.select("accession", "item").join(predicted, ["accession", "item"], "left_anti")


def eval_docs(items: DataFrame, extra: DataFrame, least: float = 0.9) -> DataFrame:
    """Per filing: rates, mean F1 (unrounded), and whether every item was retrieved (rounded F1) and none added."""
    fp = extra.groupBy("accession").agg(F.array_sort(F.collect_set("item")).alias("false_positives"))
    d = items.groupBy("accession").agg(F.count("*").alias("truth_items"), F.avg(F.col("extracted").cast("double")).alias("extraction_rate"), F.avg(F.col("exact_match").cast("double")).alias("exact_match_rate"), F.avg("f1").alias("mean_char_f1"), F.every(F.col("extracted") & (F.col("char_f1") >= least)).alias("good"), F.every(F.col("extracted") & F.col("exact_match")).alias("exact"))
    d = d.join(fp, "accession", "left").withColumn("clean", F.col("false_positives").isNull())
    return d.select("accession", "truth_items", "extraction_rate", "exact_match_rate", "mean_char_f1", F.coalesce("false_positives", F.array().cast("array<string>")).alias("false_positives"), (F.col("good") & F.col("clean")).alias("doc_retrieved"), (F.col("exact") & F.col("clean")).alias("doc_retrieved_strict"))


def file_account(golden: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: golden files found, malformed, empty, skipped (no prediction; they count as filings with no score) and scored.

    ``golden``, ``predicted``: ``submissions.sections`` (accession, malformed, key); a malformed prediction is none.
    """
    g = golden.groupBy("accession").agg(F.bool_or("malformed").alias("malformed"), F.count("key").alias("n"))
    p = predicted.filter("not malformed").select("accession").distinct().withColumn("made", F.lit(True))
    state = F.when(F.col("malformed"), "malformed").when(F.col("n") == 0, "empty").when(F.col("made").isNull(), "skipped").otherwise("scored")
    return g.join(p, "accession", "left").select(state.alias("s")).agg(F.count("*").alias("files"), *(F.count_if(F.col("s") == k).alias(k) for k in ("malformed", "empty", "skipped", "scored")))


def corpus(items: DataFrame) -> DataFrame:
    """Means over all items and by item, in one pass."""
    return items.groupingSets([["item"], []], "item").agg(F.grouping("item").cast("int").alias("overall"), F.count("*").alias("n"), F.avg("f1").alias("mean_f1"), F.avg(F.col("extracted").cast("double")).alias("extraction_rate"), F.count_if(F.col("char_f1") < 0.9).alias("failures"))


def failure_type(pred_len, truth_len, f1, in_truth=None):
    """missing, gt_noise (golden text over a million characters), severe (F1 under 0.5), near_miss; false_positive without golden text."""
    known = F.lit(True) if in_truth is None else in_truth
    return F.when(~known, "false_positive").when(pred_len == 0, "missing").when(truth_len > 1_000_000, "gt_noise").when(f1 < 0.5, "severe").otherwise("near_miss")


def failures(golden: DataFrame, predicted: DataFrame, least: float = 0.9) -> DataFrame:
    """accession, item, kind (missing, fp or boundary), truth, pred, f1: what keeps a filing from being retrieved.

    A golden item without text can be missing but has no boundary to fail at.
    """
    g = golden.select("accession", "item", F.coalesce("html", F.lit("")).alias("truth"), F.lit(True).alias("wanted"))
    p = predicted.select("accession", "item", F.coalesce("html", F.lit("")).alias("pred"), F.lit(True).alias("made"))
    both = g.join(p, ["accession", "item"], "full")
    kind = F.when(F.col("made").isNull(), "missing").when(F.col("wanted").isNull(), "fp").when(F.col("truth") != "", "boundary")
    rows = both.select("accession", "item", kind.alias("kind"), "truth", "pred").filter("kind is not null")
    scored = char_f1(rows.filter("kind = 'boundary'"), ["accession", "item"]).select("accession", "item", "f1").filter(F.col("f1") < least)
    return rows.join(scored, ["accession", "item"], "left").filter("kind <> 'boundary' or f1 is not null")


def noise(rows: DataFrame) -> DataFrame:
    """Failures (accession, item, kind, truth, pred, f1, and where known file_size and detected) with ``noisy`` and ``reason``.

    Only signatures and item 16 can fail for the golden texts' sake.  ``detected``: the engine found signatures and left them out.
    """
    from folioflow.operators.selection import is_placeholder_item16

    for name, kind in (("file_size", "long"), ("detected", "boolean")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    truth, pred = F.coalesce("truth", F.lit("")), F.coalesce("pred", F.lit(""))
    shown = lambda html: F.length(T.strip_html(html))
    huge = F.length(truth) > 1_000_000
    is_ = lambda item, kind: (F.col("item") == item) & (F.col("kind") == kind)
    why = (
        F.when(is_("signatures", "missing") & (F.length(truth) < 100), "golden text empty or short")
        .when(is_("signatures", "missing") & (F.length(truth) > 0.3 * F.coalesce("file_size", F.lit(0))), "golden text of another source")
        .when(is_("signatures", "missing") & F.coalesce("detected", F.lit(False)), "found but left out")
        .when(is_("item16", "missing") & (shown(truth) < 100), "golden text short")
        .when(is_("signatures", "fp"), "heading there, golden key not")
        .when(is_("item16", "fp") & (is_placeholder_item16(pred) | (F.length(pred) < 3000)), "placeholder, golden key not there")
        .when(is_("signatures", "boundary") & huge, "golden text of another source")
        .when(is_("item16", "boundary") & (shown(truth) < 100) & (shown(pred) < 100), "both short")
        .when(is_("item16", "boundary") & huge, "golden text of another source")
    )
    head = F.concat_ws(" ", F.when(F.col("kind") == "fp", "FP").otherwise(F.col("kind")), "item")
    real = F.when(F.col("kind") == "boundary", F.concat(head, F.format_string(" (F1=%.3f)", F.coalesce("f1", F.lit(0.0))))).otherwise(head)
    out = rows.withColumn("_why", why)
    return out.withColumn("noisy", F.col("_why").isNotNull()).withColumn("reason", F.when(F.col("noisy"), F.concat(head, F.lit(" ("), "_why", F.lit(")"))).otherwise(real)).drop("_why")


def item_counts(rows: DataFrame, n: int = 12) -> DataFrame:
    """The most frequent (item, kind) of failures."""
    return rows.groupBy("item", "kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item", "kind").limit(n)


def noise_account(docs: DataFrame, failures: DataFrame) -> DataFrame:
    """Filings by kind (clean, all noise, mixed, real only) with the raw, adjusted and clean retrieval rates."""
    f = failures.groupBy("accession").agg(F.bool_or("noisy").alias("some"), F.every("noisy").alias("all"))
    d = docs.select("accession", "doc_retrieved").join(f, "accession", "left")
    kind = F.when(F.col("doc_retrieved"), "pass").when(F.col("all"), "noise").when(F.col("some"), "mixed").otherwise("real")
    c = d.select(kind.alias("kind")).agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("pass", "noise", "mixed", "real")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return c.withColumn("raw_rate", ratio(F.col("pass"), F.col("total"))).withColumn("adjusted_rate", ratio(F.col("pass") + F.col("noise"), F.col("total"))).withColumn("clean_rate", ratio(F.col("pass"), F.col("total") - F.col("noise") - F.col("mixed")))


def reasons(failures: DataFrame) -> DataFrame:
    prefix = F.trim(F.get(F.split("reason", r"\("), F.lit(0)))
    return failures.groupBy(prefix.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def worst(items: DataFrame, n: int = 10) -> DataFrame:
    return items.orderBy("char_f1", "accession", "item").limit(n)


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Bin number (from 0) and count; the upper end falls into the last bin."""
    k = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(value).between(lo, hi)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def medians(rows: DataFrame, keys: list[str], value: str, small: int = 100_000, bins: int = 1024) -> DataFrame:
    """``keys``, n and the exact median of ``value`` by group (null values don't count), without a group in one task.

    A mergeable sketch encloses the middle of every group; then histograms of all groups at once narrow the enclosure, whose
    ends are always values of the group, until at most ``small`` rows or one value are left inside.  Where the two middle rows fall into
    different bins, they are the greatest of the one and the least of the other.  Only what is left inside is sorted.
    """
    v = rows.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null")
    same = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys), F.lit(True))
    with_state = lambda r, s: r.join(s, same(r, s)).select(*(r[c] for c in r.columns), *(s[c] for c in s.columns if c not in keys))
    edge = F.percentile_approx("v", [0.45, 0.55], 10_000)
    first = v.groupBy(*keys).agg(F.count("*").alias("n"), edge.alias("e")).select(*keys, "n", F.get("e", F.lit(0)).alias("lo"), F.get("e", F.lit(1)).alias("hi"))
    state = written(first.withColumns({"a": F.floor((F.col("n") - 1) / 2), "b": F.floor(F.col("n") / 2), "m": F.col("n"), "median": F.lit(None).cast("double")}), "medians")
    if not keys and not state.filter("n > 0").count():
        return state.select("n", "median")
    done, turn = [], 0
    while True:
        # a, b: the ranks of the two middle rows among the rows from lo on; in the first round among all
        inside = with_state(v, state).filter("v <= hi")
        width = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
        cell = F.when(F.col("v") < F.col("lo"), -1).otherwise(F.least(F.floor(width * bins), F.lit(bins - 1))).alias("cell")
        counts = inside.groupBy(*keys, "n", "a", "b", cell).agg(F.count("*").alias("k"), F.min("v").alias("least"), F.max("v").alias("most"))
        if turn:
            counts = counts.filter("cell >= 0")
        before = F.sum("k").over(Window.partitionBy(*keys).orderBy("cell")) - F.col("k")
        hit = lambda c: (F.col(c) >= F.col("before")) & (F.col(c) < F.col("before") + F.col("k"))
        both = counts.withColumn("before", before).filter(hit("a") | hit("b")).withColumns({"has_a": hit("a"), "has_b": hit("b")})
        pick = lambda c, f: F.max(F.when(F.col(f), F.col(c)))
        met = both.groupBy(*keys, "n", "a", "b").agg(F.count("*").alias("cells"), pick("least", "has_a").alias("lo"), pick("most", "has_b").alias("hi"), pick("most", "has_a").alias("left"), pick("least", "has_b").alias("right"), pick("before", "has_a").alias("before"), F.sum("k").alias("m"))
        middle = F.when(F.col("cells") == 2, (F.col("left") + F.col("right")) / 2).when(F.col("lo") == F.col("hi"), F.col("lo"))
        turn += 1
        state = written(met.select(*keys, "n", "lo", "hi", (F.col("a") - F.col("before")).alias("a"), (F.col("b") - F.col("before")).alias("b"), "m", middle.alias("median")), "medians")
        done.append(state.filter(F.col("median").isNotNull()).select(*keys, "n", "median"))
        few = state.filter(F.col("median").isNull() & (F.col("m") <= small))
        left = with_state(v, few).filter("v between lo and hi").withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1)
        done.append(left.filter("r = a or r = b").groupBy(*keys, "n").agg(F.avg("v").alias("median")))
        state = state.filter(F.col("median").isNull() & (F.col("m") > small))
        if not state.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def run_summary(results: DataFrame) -> DataFrame:
    """Batch totals of run-result rows (set, f1, doc_retrieved, finalized, turns, tokens, error), by set and overall."""
    outcome = F.when(F.col("doc_retrieved"), "pass").when(F.col("finalized"), "finalized_fail").otherwise("stalled")
    return results.withColumn("outcome", outcome).rollup("set").agg(F.count("*").alias("n"), F.count_if("doc_retrieved").alias("retrieved"), F.avg("f1").alias("mean_f1"), F.avg("turns").alias("mean_turns"), F.sum("tokens").alias("tokens"), F.count_if(F.col("error").isNotNull()).alias("errors"), *(F.count_if(F.col("outcome") == k).alias(k) for k in ("finalized_fail", "stalled")))
