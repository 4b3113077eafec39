"""Operator 5: benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are runs of letters and digits, lower-cased.  A seed is a fixed mask of five care positions
in a span of six to eight words; the words between are ignored, so a substituted word leaves some
seed intact.  Items of 5 to 12 words are too short for that, so they also have masks of four care positions in a span of four or
five; still shorter ones allow no substitution and have one seed of all their words.  With these, every
substitution that the similarity of 0.8 allows leaves a seed (tested for each set of places up to 14 words).
The seed hashes of all positions of the training texts join those of the benchmark
items; a hit names an alignment (training position minus item position).  Each distinct alignment
is then verified: the words that agree, place by place, over the whole item.  An item counts as
found when at least ``similarity`` of its words agree.

The benchmark's seeds are broadcast up to ``broadcast_rows`` rows (24 bytes each) and shuffled
beyond; so are the alignments that the verification filters the texts by.

Defined cases: null and empty texts and items have no words and match nothing; repeated items or documents are reported
each under its own id, and rows that share an id, or have none (null), under that one; of several alignments of one item in one
document the one with most agreeing words is kept, then the earliest; a very long text is an array of its words' hashes while
it is read; an empty side gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 6), (0, 2, 3, 5, 7))
#: For items of SHORT words or fewer; with fewer than five words no word may differ.
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4))
SHORT = 12


def words(col):
    """The words of a text; empty for null.  Marks between words are any run of other characters."""
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds(hashes, masks):
    """For every mask, an array with one seed hash for each position at which the mask fits."""
    return F.concat(*(seeds_of(hashes, k, m) for k, m in enumerate(masks)))


def seeds_of(hashes, k: int, mask: tuple[int, ...]):
    fits = F.greatest(F.size(hashes) - F.lit(mask[-1]), F.lit(0))
    return F.transform(F.slice(hashes, 1, fits), lambda h, i: F.struct(F.xxhash64(F.lit(k), h, *(F.get(hashes, i + j) for j in mask[1:])).alias("seed"), i.alias("at")))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = 0.8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, at (first word's place, from 0), item_words, agreeing, similarity: one row for each item found in a document."""
    spark = docs.sparkSession
    hold = Scratch(spark, "decontam")
    items = benchmark.select(F.col(item).alias("item_id"), words(F.col(item_text)).alias("iw")).filter(F.size("iw") > 0)
    items = hold.keep(items.withColumn("ih", F.transform("iw", lambda w: F.xxhash64(w))), "items")
    lengths = [r[0] for r in items.filter(F.size("iw") <= SHORT).select(F.size("iw")).distinct().collect()]  # twelve values at most
    # Every mask with the lengths of the items it is for (from, to).
    masks = [(m, 5, 1 << 30) for m in MASKS] + [(m, 5, SHORT) for m in SHORT_MASKS if max(lengths, default=0) >= 5] + [(tuple(range(n)), n, n) for n in sorted(lengths) if n < 5]
    fits = F.size("iw")
    of = [F.when(fits.between(lo, hi), seeds_of(F.col("ih"), k, m)).otherwise(F.array().cast("array<struct<seed:bigint,at:int>>")) for k, (m, lo, hi) in enumerate(masks)]
    item_seeds = items.select("item_id", F.explode(F.concat(*of)).alias("s")).select("item_id", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at"))
    item_seeds = hold.keep(item_seeds, "seeds")
    few = item_seeds.count() <= broadcast_rows
    hashed = docs.select(F.col(key).alias("doc_id"), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("h"))
    hits = hashed.select("doc_id", F.explode(seeds(F.col("h"), [m for m, _, _ in masks])).alias("s")).select("doc_id", F.col("s.seed").alias("seed"), F.col("s.at").alias("at"))
    met = hits.join(F.broadcast(item_seeds) if few else item_seeds, "seed")
    lines = hold.keep(met.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct(), "alignments")
    n = lines.count()
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    items = items.select(F.col("item_id").alias("own_id"), "iw")
    lines = lines.withColumnRenamed("doc_id", "line_id")
    found = texts.join(F.broadcast(lines) if n <= broadcast_rows else lines, texts.doc_id.eqNullSafe(lines.line_id)).select("doc_id", "item_id", "start", words(F.col("t")).alias("dw"))
    found = found.join(F.broadcast(items) if few else items, found.item_id.eqNullSafe(items.own_id))
    place = F.col("start")
    agrees = lambda q: (F.get(F.col("dw"), place + q) == F.get(F.col("iw"), q)).cast("int")  # noqa: E731  null outside the text
    same = F.aggregate(F.sequence(F.lit(0), F.size("iw") - 1), F.lit(0), lambda n, q: n + F.coalesce(agrees(q), F.lit(0)))
    scored = found.select("doc_id", "item_id", F.col("start").cast("long").alias("at"), F.size("iw").cast("long").alias("item_words"), same.cast("long").alias("agreeing"))
    kept = scored.filter(F.col("agreeing") >= F.lit(similarity) * F.col("item_words"))
    best = kept.groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.max(F.struct("agreeing", (-F.col("at")).alias("before"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.before")).alias("at"), "item_words", F.col("b.agreeing").alias("agreeing"), (F.col("b.agreeing") / F.col("item_words")).alias("similarity"))
