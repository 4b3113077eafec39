"""Learned boundary scores: features of anchors, labels from golden sections, boosted trees and forests, and their use in the selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import rules
from folioflow.functions import text as T
from folioflow.operators import selection

BOLD = r"(?i)font-weight\s*:\s*(?:bold|[6-9]\d{2})"
HEADING = r"(?i)<h[1-6][^>]*>"
FONT = r"(?i)font-size\s*:\s*(\d+)"
TAGS = ("a", "div", "p", "span", "td")
#: Features of ``boundary_features``, in the order of the vector.
BOUNDARY = (
    "rel_position", "abs_offset", *(f"tag_is_{t}" for t in TAGS), "attr_is_id", "id_len", "id_has_item", "id_has_toc", "id_has_sig", "tier0_match", "in_toc_mapping", "n_toc_items", "forward_text_len",
    "back_text_len", "n_item_mentions_fwd", "tier1_match_150", "tier2_match_150", "tier1_match_full", "tier2_match_full", "has_bold", "has_heading", "max_font_size", "starts_with_item", "has_part_header",
)
#: Words that speak for a label.
KEYWORDS = {
    "item1": ("business",), "item1a": ("risk", "factors"), "item1b": ("unresolved", "staff", "comments"), "item2": ("properties",), "item3": ("legal", "proceedings"), "item4": ("mine", "safety"), "item5": ("market", "registrant", "equity", "stock"),
    "item6": ("selected", "financial", "data", "reserved"), "item7": ("management", "discussion", "analysis"), "item7a": ("quantitative", "qualitative", "market", "risk"), "item8": ("financial", "statements", "supplementary"), "item9": ("changes", "disagreements", "accountants"),
    "item9a": ("controls", "procedures"), "item9b": ("other", "information"), "item10": ("directors", "officers", "governance"), "item11": ("executive", "compensation"), "item12": ("security", "ownership"), "item13": ("certain", "relationships"),
    "item14": ("principal", "accountant", "fees"), "item15": ("exhibits", "schedules"), "item16": ("summary", "10-k"), "signatures": ("signatures", "pursuant"),
}


def _flag(x):
    return F.coalesce(x, F.lit(False)).cast("int")


def _around(o, before: int, after: int):
    return F.substring(F.col("html"), F.greatest(F.lit(0), o - before) + 1, o + after - F.greatest(F.lit(0), o - before))


def _fonts(context):
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(context, F.lit(FONT), F.lit(1)), lambda x: x.cast("int"))), F.lit(0))


def _base(filings: DataFrame, anchors: DataFrame, items: DataFrame) -> DataFrame:
    """Each anchor with the text ahead (to the next anchor, 2000 at most), its labels there and the labels of its links."""
    ends = anchors.withColumn("next_o", F.lead("o").over(Window.partitionBy("accession").orderBy("o", "anchor_id")))
    joined = ends.join(items, ["accession", "anchor_id"], "left").join(filings.select("accession", "html"), "accession")
    size = F.least(F.lit(2000), F.coalesce(F.col("next_o") - F.col("o"), F.lit(2000)))
    return joined.withColumns({"ahead": T.normalize_text(F.substring(F.col("html"), F.col("o") + 1, size)), "n_html": F.length("html")})


def boundary_features(filings: DataFrame, anchors: DataFrame, items: DataFrame) -> DataFrame:
    """accession, anchor_id, o and the features named in ``BOUNDARY``; ``items``: the labels of the anchors' links."""
    b = _base(filings, anchors, items)
    o, ahead, aid = F.col("o"), F.col("ahead"), F.col("anchor_id")
    context, head = _around(o, 300, 300), F.left(ahead, F.lit(150))
    back = T.normalize_text(_around(o, 500, 0))
    said = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.left(ahead, F.lit(500)), F.lit(r"(?U)item\s*\d+"), F.lit(0)), rules.heading_label), lambda x: x.isNotNull()))
    made = {
        "rel_position": o / F.greatest(F.col("n_html"), F.lit(1)), "abs_offset": o, **{f"tag_is_{t}": _flag(F.col("tag") == t) for t in TAGS}, "attr_is_id": _flag(F.col("attr") == "id"), "id_len": F.length(aid),
        "id_has_item": _flag(aid.rlike("(?i)item")), "id_has_toc": _flag(aid.rlike("(?i)toc")), "id_has_sig": _flag(aid.rlike("(?i)sig")), "tier0_match": _flag(rules.id_label(aid).isNotNull()),
        "in_toc_mapping": _flag(F.size("firsts") > 0), "n_toc_items": F.coalesce(F.size(F.coalesce("items", F.array().cast("array<string>"))), F.lit(0)), "forward_text_len": F.length(ahead), "back_text_len": F.length(back), "n_item_mentions_fwd": F.size(said),
        "tier1_match_150": _flag(rules.heading_label(head).isNotNull()), "tier2_match_150": _flag(rules.title_label(head).isNotNull()), "tier1_match_full": _flag(rules.heading_label(ahead).isNotNull()), "tier2_match_full": _flag(rules.title_label(ahead).isNotNull()),
        "has_bold": _flag(context.rlike(BOLD)), "has_heading": _flag(context.rlike(HEADING)), "max_font_size": _fonts(context), "starts_with_item": _flag(ahead.rlike(r"(?U)\Aitem\s*\d")), "has_part_header": _flag(F.left(ahead, F.lit(200)).rlike(r"(?U)\bpart\s+[iv]+\b")),
    }
    return b.select("accession", "anchor_id", "o", *(made[k].cast("double").alias(k) for k in BOUNDARY))


def label_features(filings: DataFrame, anchors: DataFrame, items: DataFrame) -> DataFrame:
    """accession, anchor_id, o and ``features`` (array): position, tags, labels by id, heading and title as indicators, keywords, style."""
    b = _base(filings, anchors, items).withColumns({"_id": rules.id_label(F.col("anchor_id")), "_h": rules.heading_label(F.left("ahead", F.lit(150))), "_t": rules.title_label(F.left("ahead", F.lit(150)))})
    o, ahead = F.col("o"), F.col("ahead")
    context, head = _around(o, 200, 200), F.left(ahead, F.lit(300))
    share = lambda words: sum((_flag(F.contains(head, F.lit(w))) for w in words), F.lit(0)) / F.lit(len(words))
    values = [
        o / F.greatest(F.col("n_html"), F.lit(1)), *(_flag(F.col("tag") == t) for t in (*TAGS, "tr")), _flag(F.col("attr") == "id"), F.length("anchor_id"), _flag(F.col("anchor_id").rlike("(?i)item")),
        *(_flag(F.col(c) == x) for c in ("_id", "_h", "_t") for x in rules.LABELS), _flag(F.size("firsts") > 0), *(share(w) for w in KEYWORDS.values()),
        _flag(context.rlike(BOLD)), _flag(context.rlike(HEADING)), _fonts(context), F.length(ahead), _flag(F.left(ahead, F.lit(200)).rlike(r"(?U)\bpart\s+[iv]+\b")),
    ]
    return b.select("accession", "anchor_id", "o", F.array(*(v.cast("double") for v in values)).alias("features"))


def golden_places(filings: DataFrame, golden: DataFrame) -> DataFrame:
    """accession, item, at: where a golden section of 10 characters or more begins in the html, by its first 200 characters, else its first 50."""
    g = golden.filter(F.length("html") >= 10).select("accession", "item", F.left("html", F.lit(200)).alias("long"), F.left("html", F.lit(50)).alias("short"))
    both = g.join(filings.select("accession", "html"), "accession")
    find = lambda needle: F.nullif(F.instr(F.col("html"), F.col(needle)), F.lit(0)) - 1
    return both.select("accession", "item", F.coalesce(find("long"), find("short")).alias("at")).filter("at is not null")


def boundary_labels(anchors: DataFrame, places: DataFrame, radius: int = 500) -> DataFrame:
    """accession, anchor_id, item: for each golden place the nearest anchor within the radius; of several places of an anchor the last item in order."""
    near = _near(anchors, places, radius)
    best = near.groupBy("accession", "item").agg(F.min_by("anchor_id", F.struct("d", "o", "anchor_id")).alias("anchor_id"))
    return best.groupBy("accession", "anchor_id").agg(F.max_by("item", rules.seq_of(F.col("item"))).alias("item"))


def anchor_labels(anchors: DataFrame, places: DataFrame, radius: int = 500) -> DataFrame:
    """accession, anchor_id, item: for each anchor the golden place nearest to it, less than the radius away ("none" without one)."""
    best = _near(anchors, places, radius).groupBy("accession", "anchor_id").agg(F.min_by("item", F.struct("d", rules.seq_of(F.col("item")))).alias("item"))
    return anchors.select("accession", "anchor_id").join(best, ["accession", "anchor_id"], "left").withColumn("item", F.coalesce("item", F.lit("none")))


def _near(anchors: DataFrame, places: DataFrame, radius: int) -> DataFrame:
    """Pairs less than the radius apart: each looks only at its own and the neighbouring stretches of that length."""
    a = anchors.select("accession", "anchor_id", "o", F.floor(F.col("o") / radius).alias("cell"))
    p = places.withColumn("cell", F.explode(F.array(*(F.floor(F.col("at") / radius) + d for d in (-1, 0, 1)))))
    return p.join(a, ["accession", "cell"]).withColumn("d", F.abs(F.col("o") - F.col("at"))).filter(F.col("d") < radius)


def boundary_dataset(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with ``label`` (1: a golden boundary) and ``features``, the vector for learning."""
    from pyspark.ml.functions import array_to_vector

    rows = features.join(labels.select("accession", "anchor_id", F.lit(1.0).alias("label")), ["accession", "anchor_id"], "left")
    return rows.withColumn("label", F.coalesce("label", F.lit(0.0))).withColumn("features", array_to_vector(F.array(*BOUNDARY)))


def fit_boundaries(dataset: DataFrame, trees: int = 200, depth: int = 4, rate: float = 0.1, sample: float = 0.8, seed: int = 42):
    """Boosted trees over ``boundary_dataset``."""
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=sample, seed=seed).fit(dataset)


def boundary_report(model, dataset: DataFrame) -> dict:
    """ROC AUC, precision and recall of boundaries on rows that were not learned."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    scored = model.transform(dataset)
    c = scored.agg(F.count_if(F.expr("prediction = 1 and label = 1")).alias("hit"), F.count_if(F.expr("prediction = 1")).alias("said"), F.count_if(F.expr("label = 1")).alias("real"), F.count("*").alias("n")).first()
    return {"n": c["n"], "auc": BinaryClassificationEvaluator().evaluate(scored), "precision": c["hit"] / c["said"] if c["said"] else 0.0, "recall": c["hit"] / c["real"] if c["real"] else 0.0}


def importances(model, names=BOUNDARY, n: int = 10) -> list[tuple[str, float]]:
    return sorted(zip(names, model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))[:n]


def class_counts(labels: DataFrame, n: int = 5) -> DataFrame:
    return labels.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(n)


def fit_labels(features: DataFrame, labels: DataFrame, trees: int = 300, depth: int = 12, leaf: int = 3, seed: int = 42):
    """A forest over ``label_features``: one class for each label in canonical order, the last one for none."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    number = F.coalesce(rules.lookup(rules.SEQ, F.col("item")), F.lit(len(rules.LABELS))).cast("double")
    rows = features.join(labels, ["accession", "anchor_id"]).select(array_to_vector("features").alias("features"), number.alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed).fit(rows)


def learned_candidates(model, features: DataFrame, least: float = 0.05) -> DataFrame:
    """accession, item, anchor_id, o, confidence (ten times the probability, cut to an integer) of all labels that are likely enough."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(features.select("accession", "anchor_id", "o", array_to_vector("features").alias("features")))
    rows = scored.select("accession", "anchor_id", "o", F.posexplode(vector_to_array("probability")).alias("k", "p"))
    item = F.get(F.array(*map(F.lit, rules.LABELS)), F.col("k"))
    return rows.select("accession", item.alias("item"), "anchor_id", "o", F.col("p"), (F.col("p") * 10).cast("int").alias("confidence")).filter(F.col("item").isNotNull() & (F.col("p") >= least)).drop("p")


def learned_sections(model, filings: DataFrame, features: DataFrame) -> DataFrame:
    """Sections of the chain that the forest's candidates make; signatures are kept as empty texts."""
    made = selection.rule_slices(filings, selection.select_ordered(learned_candidates(model, features)).select("accession", "item", "o"))
    return made.withColumn("html", F.when(F.col("item") == "signatures", "").otherwise(F.col("html")))


def lenient_f1(f1, truth, pred):
    """The score of this evaluation: a golden item without text counts half when something was predicted."""
    return F.when(F.coalesce(truth, F.lit("")) != "", f1).when(F.coalesce(pred, F.lit("")) == "", 1.0).otherwise(0.5)
