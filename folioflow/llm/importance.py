"""Target-distribution importance resampling over hashed word n-grams, through an integer word dictionary.

Texts are read in blocks of at most ``BLOCK`` bytes (a longer text in several, which overlap by the words
that an n-gram can span).  A block's distinct words get integer ids; its n-grams are tuples of ids; the bytes
of each distinct tuple are put together and hashed once, and the buckets are joined back to all places of
the tuple.  The dictionary is a block's, not the corpus's: it is bounded at any size of the corpus, no word
is shuffled, and a tuple's bucket is the same in every block.  Counts by bucket meet in one grouping with at
most as many rows from a task as there are buckets.  Ranks come from one sort by range over the cluster.

Defined cases: a null or wordless text has no features and weight 0.  A null id counts as the empty text
in the draw's hash.  Repeated rows are documents of their own and share score and ties; ties go to the smaller
id, nulls first, and among the same id in a fixed order.  Empty tables give empty results, an empty target
counts nothing; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, shuffle_parts, tidy

BLOCK = 4 << 20
#: Bytes that end a word once A-Z are lower-cased: all of ASCII but digits and letters.
BETWEEN = rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]"


class Hasher:
    """``buckets(texts)``: for each text the number of its words and the buckets of all its n-grams up to ``longest`` words."""

    def __init__(self, buckets: int, longest: int, block: int = BLOCK):
        import re

        import numpy as np

        self.n, self.longest, self.block = buckets, longest, block
        self.kind = np.uint16 if buckets <= 1 << 16 else np.uint32
        self.between = re.compile(BETWEEN)
        self.letter = np.zeros(256, np.uint8)
        for lo, hi in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
            self.letter[lo : hi + 1] = np.arange(lo, hi + 1)
        self.letter[0x41:0x5B] = self.letter[0x61:0x7B]

    def grams(self, raw: bytes, starts, carried: int):
        """(document, bucket) of every n-gram that ends behind the first ``carried`` words, words by document, and the last words.

        ``starts``: where each document begins in ``raw``.
        """
        import zlib

        import numpy as np
        import pyarrow as pa

        a = self.letter[np.frombuffer(raw, np.uint8)]
        ink = a != 0
        edges = np.flatnonzero(np.diff(ink, prepend=False, append=False))
        begin, size = edges[::2], edges[1::2] - edges[::2]
        doc = np.searchsorted(starts, begin, "right") - 1
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(a[ink])]).dictionary_encode()
        ids, spelled = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        last = [spelled[k] for k in ids[len(ids) - min(len(ids), self.longest - 1) :]]
        docs, found, ends, tuples, listed = [], [], np.arange(len(ids)), ids, spelled
        for k in range(self.longest):
            if k:
                # tuples of k + 1 ids: the tuple of k that ends one word before, and the word; again numbered from 0
                inside = ends >= k
                inside[inside] = doc[ends[inside]] == doc[ends[inside] - k]
                whole = np.flatnonzero(inside)
                pairs, tuples = np.unique(tuples[whole - 1] * len(spelled) + ids[ends[whole]], return_inverse=True)
                heads, tails = np.divmod(pairs, max(1, len(spelled)))
                listed = [listed[h] + b" " + spelled[t] for h, t in zip(heads.tolist(), tails.tolist(), strict=True)]
                ends = ends[whole]
            bucket = np.fromiter((zlib.crc32(g) % self.n for g in listed), self.kind, len(listed))
            new = ends >= carried
            docs.append(doc[ends[new]])
            found.append(bucket[tuples[new]])
        return np.concatenate(docs), np.concatenate(found), np.bincount(doc[carried:], minlength=len(starts)), last

    def buckets(self, texts: list):
        todo, size = [], 0
        for text in texts:
            if len(text) > self.block:
                if todo:
                    yield from self._together(todo)
                todo, size = [], 0
                yield self._alone(text)
                continue
            if size + len(text) > self.block and todo:
                yield from self._together(todo)
                todo, size = [], 0
            todo.append(text)
            size += len(text) + 1
        if todo:
            yield from self._together(todo)

    def _together(self, texts: list):
        import numpy as np

        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
        doc, bucket, words, _ = self.grams(b"\n".join(texts), starts, 0)
        bucket = bucket[np.argsort(doc, kind="stable")]
        ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
        for n, lo, hi in zip(words.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            yield n, bucket[lo:hi]

    def _alone(self, text: bytes):
        import numpy as np

        at, last, n, made = 0, [], 0, []
        while at < len(text):
            cut = self.between.search(text, min(len(text), at + self.block))
            to = cut.start() if cut else len(text)
            _, bucket, words, tail = self.grams(b" ".join([*last, text[at:to]]), np.zeros(1, np.int64), len(last))
            made.append(bucket)
            n, at = n + int(words[0]), to + 1
            last = tail
        return n, np.concatenate(made)


def profiles(texts: DataFrame, key: str, buckets: int, longest: int) -> DataFrame:
    """(key, n_words, n_features, buckets): the buckets of all n-grams of each text as unsigned integers of 2 bytes (4 above 65,536 buckets)."""
    import pyarrow as pa

    def run(batches):
        hasher = Hasher(buckets, longest)
        for batch in batches:
            rows = [(n, len(b), b.tobytes()) for n, b in hasher.buckets([t or b"" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary())))], [key, "n_words", "n_features", "buckets"])
        tidy()

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col("text").cast("binary")).mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, buckets binary")


def counts(made: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of all profiles, summed in each task before the shuffle."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        kind, total = np.uint16 if buckets <= 1 << 16 else np.uint32, np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_py(), kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return made.filter("n_features > 0").select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """For each bucket floor(1000 ln of the ratio of its smoothed shares in target and corpus); as many numbers as there are buckets."""
    spark = corpus.sparkSession
    total = lambda c: c.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0]
    in_corpus, in_target = F.lit(total(corpus)), F.lit(total(target))
    joined = spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = ((t + 1) * (in_corpus + buckets)) / ((s + 1) * (in_target + buckets))
    rows = joined.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).collect()
    return [r.gain for r in sorted(rows, key=lambda r: r.bucket)]


def weighted(made: DataFrame, key: str, by_bucket: list[int]) -> DataFrame:
    """``made`` with ``weight``, the floored mean of its features' gains, in place of the buckets."""
    import numpy as np
    import pyarrow as pa

    table, kind = np.array(by_bucket, np.int64), np.uint16 if len(by_bucket) <= 1 << 16 else np.uint32
    rest = [c for c in made.columns if c != "buckets"]

    def run(batches):
        for batch in batches:
            found = []
            for b in batch.column("buckets"):
                at = np.frombuffer(b.as_py(), kind)
                found.append(int(table[at].sum()) // len(at) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found, pa.int64())], [*rest, "weight"])

    return made.mapInArrow(run, ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in rest) + ", weight long")


def ranked(rows: DataFrame, order: list, hold: Scratch) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the given order: one sort by range, then the counts of the ranges, one row each, are added up."""
    dealt = rows.repartitionByRange(shuffle_parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = hold.keep(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(before), "_part").withColumn("rank", place).drop("_at", "_part", "before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, buckets: int = 10_000, longest: int = 2, least_words: int = 20, seed: int = 7, key: str = "doc_id", target_key: str = "item_id") -> DataFrame:
    """(key, n_features, weight, score, rank) of every document.

    Of those with ``least_words`` words or more, ``percent`` of a hundred are drawn without replacement, by the highest
    weight plus Gumbel noise from the id's hash, both in thousandths; ``rank`` is null for the others.
    """
    hold = Scratch(docs.sparkSession, "importance")
    made = hold.keep(profiles(docs, key, buckets, longest).withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())), "profiles")
    table = gains(counts(made, buckets), counts(profiles(target, target_key, buckets, longest), buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = hold.keep(weighted(made, key, table).withColumn("score", F.col("weight") + noise), "scored")
    hold.drop("profiles")
    able = scored.filter(F.col("n_words") >= least_words)
    draws = percent * able.count() // 100
    placed = ranked(able, [F.desc("score"), F.asc(key), F.asc("_salt")], hold).withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    few = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(few).select(key, "n_features", "weight", "score", "rank")
