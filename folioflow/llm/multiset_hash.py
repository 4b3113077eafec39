"""Operator 3: homomorphic multiset hash of a document's paragraphs, in DataFrame functions only.

Paragraphs are the lines of a text.  Each one is hashed to a wide vector and a text's fingerprint is
the sum of its paragraphs' vectors, lane by lane, modulo a power of two:

* ``EXACT`` lanes of 32 random bits each, from four 64-bit hashes of the paragraph with seeds of their own, modulo 2^32: equal multisets
  of paragraphs have equal sums in any order, different ones differ but for chance in all 256 bits;
* 64 counting lanes modulo 2^32, kept two in a long: how many of the paragraph's word shingles have
  bit j of their hash set.  With the shingle count they are a linear sketch, whose cosine estimates
  that of the multisets (standard error 1/8);
* the shingle count.

Sums make it homomorphic: :func:`combined` inserts paragraphs into a fingerprint and :func:`removed`
takes them out, without the rest of the text.

Defined cases: a null text is the empty text, which is one empty paragraph; a paragraph with fewer
than three words is one shingle; a text without words has likeness 1 to an equal fingerprint and 0 to
others; rows with equal ids are ordered by their texts' hash; a null id counts as the smallest one; a lone document is
its own next one; an empty table gives an empty table; further columns are ignored.  A very long text is split into its paragraphs
and words in one row, with some 20 bytes for each of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_table

EXACT, PACKED = 8, 32
LANES = EXACT + PACKED + 1
LOW = (1 << 32) - 1
PAIR = (1 << 32) | 1


def _shingles(text):
    """Hashes of the three-word shingles inside each paragraph."""
    # The words are bound to a lambda's variable, so a paragraph is split once and not at every place.
    words = F.transform(F.split(text, "\n"), lambda p: F.split(p, " "))
    return F.flatten(F.transform(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(1))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))))


SEEDS = EXACT // 2


def _paragraphs(text, seed: int):
    return F.transform(F.split(text, "\n"), lambda p: F.xxhash64(F.lit(seed), p))


def _fold(a, b, sign: int):
    """Lane-wise sum or difference modulo 2^32 of each 32-bit half."""

    def lane(x, y):
        low = F.pmod(x.bitwiseAND(F.lit(LOW)) + sign * y.bitwiseAND(F.lit(LOW)), F.lit(LOW + 1))
        high = F.pmod(F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32), F.lit(LOW + 1))
        return F.shiftleft(high, 32).bitwiseOR(low)

    return F.zip_with(a, b, lane)


def combined(a, b):
    """The fingerprint lanes of both multisets together."""
    return _fold(a, b, 1)


def removed(a, b):
    """The fingerprint lanes of ``a`` without the paragraphs of ``b``."""
    return _fold(a, b, -1)


def likeness(a, b):
    """Cosine of the sketches, cut to [0, 1]; 1 for equal lanes."""

    def signed(x):
        n = F.get(x, F.lit(LANES - 1))
        packed = F.slice(x, EXACT + 1, PACKED)
        return F.concat(F.transform(packed, lambda v: (2 * v.bitwiseAND(F.lit(LOW)) - n).cast("double")), F.transform(packed, lambda v: (2 * F.shiftrightunsigned(v, 32) - n).cast("double")))

    def dot(x, y):
        return F.aggregate(F.zip_with(signed(x), signed(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a == b, 1.0).when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)


def text_form(lanes):
    return F.concat_ws("", F.transform(lanes, lambda x: F.lpad(F.hex(x), 16, "0")))


def lanes_of(texts: DataFrame, key: str | list[str], columns: list[str]) -> DataFrame:
    """The key columns and one array of lanes for each text column.

    The key must be unique.  Sums are shuffled, never texts; nothing is where the texts are already dealt by one of the key's columns.
    """
    keys = [key] if isinstance(key, str) else key

    def marked(hashes, of):
        return F.transform(hashes, lambda h: F.struct(F.lit(of).alias("of"), h.alias("h")))

    step = SEEDS + 1
    marks = [m for j, c in enumerate(columns) for m in (marked(_shingles(F.col(c)), step * j), *(marked(_paragraphs(F.col(c), q), step * j + 1 + q) for q in range(SEEDS)))]
    rows = texts.select(*keys, F.explode(F.concat(*marks)).alias("x")).select(*keys, F.col("x.of").alias("of"), F.col("x.h").alias("h"))

    def sums(j):
        shingle = F.col("of") == step * j
        half = lambda k: F.shiftrightunsigned(F.col("h"), 32) if k % 2 else F.col("h").bitwiseAND(F.lit(LOW))
        exact = [F.sum(F.when(F.col("of") == step * j + 1 + k // 2, half(k)).otherwise(0)) for k in range(EXACT)]
        packed = [F.sum(F.when(shingle, F.shiftrightunsigned(F.col("h"), b).bitwiseAND(F.lit(PAIR))).otherwise(0)) for b in range(PACKED)]
        return [s.alias(f"_{j}_{k}") for k, s in enumerate([*exact, *packed, F.sum(shingle.cast("long"))])]

    counted = rows.groupBy(*keys).agg(*(s for j in range(len(columns)) for s in sums(j)))
    lane = lambda j, k: F.col(f"_{j}_{k}").bitwiseAND(F.lit(LOW)) if k < EXACT else F.col(f"_{j}_{k}")
    return counted.select(*keys, *(F.array(*(lane(j, k) for k in range(LANES))).alias(c) for j, c in enumerate(columns)))


def below(bounds: list[int], value):
    """How many of the rising ``bounds`` are below the value, by halving steps over one literal array."""
    if not bounds:
        return F.lit(0)
    listed, n = F.from_json(F.lit(str(bounds)), "array<bigint>"), len(bounds)
    steps = F.array(*(F.lit(1 << j) for j in reversed(range(n.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(listed, at + step - 1) < value), at + step).otherwise(at))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and the text after it in descending key order (after the last: the first), by range buckets.

    The bucket bounds are quantiles of the key; the first row of each bucket is copied to the end of
    the one before, so a row and its successor always meet and the texts are shuffled once.
    """
    n = max(2, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    least = -(1 << 63)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(least)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = rows.agg(F.percentile_approx("k", [j / n for j in range(1, n)], 20 * n)).first()[0] or []
    bounds = sorted(set(bounds))
    rows = rows.withColumn("bucket", below(bounds, F.col("k")))
    heads = sorted((r["bucket"], r["k"]) for r in rows.groupBy("bucket").agg(F.max("k").alias("k")).collect())
    # One row for each bucket: where its first row is copied to.
    follows = small_table(docs.sparkSession, [{"k": k, "target": heads[(j + 1) % len(heads)][0]} for j, (_, k) in enumerate(heads)], "k:bigint,target:int")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost"))
    places = F.when(F.col("target").isNotNull(), F.array(own, F.struct(F.col("target").alias("bucket"), F.lit(1).alias("ghost")))).otherwise(F.array(own))
    placed = rows.join(F.broadcast(follows), "k", "left").select("doc_id", "k", "text", F.explode(places).alias("p")).select("doc_id", "k", "text", "p.bucket", "p.ghost")
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc("k"), F.xxhash64("text"))
    return placed.withColumn("next_k", F.lead("k").over(order)).withColumn("next_text", F.lead("text").over(order)).withColumn("turn", F.row_number().over(order)).filter("ghost = 0").drop("ghost")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form (second half from the next document), with their likeness."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, key, text).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.left(F.col("text"), F.col("n_chars").cast("int") - half), F.left(F.col("next_text"), half))
    sha = F.unhex(F.sha2(edited, 256)).alias("sha")
    # Dealt by bucket already, and the key has all that is wanted of a row: the texts are shuffled once and the sums not at all.
    keys = ["bucket", "turn", "doc_id", "n_chars", "me", "next", "sha"]
    rows = rows.select("bucket", "turn", "doc_id", "n_chars", F.xxhash64("k", "text").alias("me"), F.xxhash64("next_k", "next_text").alias("next"), sha, F.col("text").alias("a"), edited.alias("b"))
    # Written once: its two uses below don't repeat the work on the texts.
    made = Scratch(docs.sparkSession, "multiset").keep(lanes_of(rows, keys, ["a", "b"]).drop("bucket", "turn"), "lanes")
    following = made.groupBy(F.col("me").alias("next")).agg(F.max("a").alias("c"))
    out = made.join(following, "next")
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), text_form(F.col("a")).alias("fingerprint"), text_form(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
