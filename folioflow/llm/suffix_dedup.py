"""Operator 2: removal of long repeated byte strings by rank doubling over sampled positions.

A byte goes when a string of ``length`` (100) bytes covers it that also starts earlier (smaller id, or
the same document further left).  Sorting (rank, rank) pairs of *every* position costs 16 bytes and a
sort for each byte of text and round.  Here the rounds run over *anchors* only: in each window of
``length`` bytes the position whose ``RANK1`` (32) bytes have the smallest hash, the leftmost of equals.
Equal windows have their anchor at the same place, so ranking anchors loses no repeat, and about 3 %
of the positions are anchors.

* Round 1 ranks anchors by their 32 bytes: Spark deals and sorts (rank, span rank, document, place).  Each batch of texts
  first settles what it can by itself, so a frequent line sends one row a batch to its rank's task.
  An anchor whose rank is unique is done.  One whose whole span (all its windows) has occurred before
  is done too: all of it repeats.  The first anchors of each span of a rank that has several go on.
* Round 2: a text is joined with its anchors that go on.  Their windows are cut into three slots, whose common 78 bytes are
  ranked by pairs: the rank at p and the rank 32 bytes on give 64 bytes, that pair and the one 14 bytes on give 78.
* Round 3, past the threshold: inside a group of equal 78 bytes the windows are ranked by the pair of 64-byte
  ranks at p and 36 bytes on, which is all 100 bytes; each window that isn't the first of its rank repeats.

Anchors of a frequent rank (a line of many texts in other surroundings) would all meet under one key.  Their windows are ranked by
all 100 bytes at once; which ranks are frequent shapes the work, never the result.

Ranks are 64-bit hashes.  What goes on is a table joined by document, so the work grows with the repeats and nothing is broadcast
but at most ``most`` frequent ranks.

Defined cases: a null text is the empty text; texts shorter than the threshold keep everything; a null id comes before
all others, and rows that share an id are taken one after the other in the order of their texts' hash (equal ones as they come), each
with a row of its own in the result; overlapping repeats inside one document count; an empty table gives an empty table; further
columns are ignored.  A very long text is read as a whole, with about ten 8-byte numbers for each of its bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_parts, tidy
from .shingles import Shingler, mix

LENGTH = 100
RANK1 = 32
REACH = LENGTH - RANK1  # an anchor lies 0..REACH bytes behind the start of its windows
SLOT = 23


class Anchors:
    """Hashes of any substring of a text in O(1), and its anchors."""

    def __init__(self):
        self.base = Shingler(1)

    def load(self, raw):
        import numpy as np

        b = self.base
        if len(raw) >= len(b.powers):
            b.grow(2 * len(raw))
        self.raw = raw
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(PLAIN()[raw] * b.powers[: len(raw)], out=self.total[1:])

    def rank(self, start, end):
        return mix((self.total[end] - self.total[start]) * self.base.inverses[start])

    def doubled(self, p):
        """Ranks of 64 bytes: pairs of the ranks of 32 bytes at p and 32 on."""
        return pair(self.rank(p, p + RANK1), self.rank(p + RANK1, p + 2 * RANK1))

    def reach(self, p, width: int):
        """Ranks of ``width`` bytes, 64 to 128: pairs of the ranks of 64 bytes that begin and end them."""
        return pair(self.doubled(p), self.doubled(p + width - 2 * RANK1))

    def find(self):
        """(anchor, first window start, last window start), one row for each anchor."""
        import numpy as np

        n = len(self.raw)
        if n < LENGTH:
            none = np.zeros(0, np.int64)
            return none, none, none
        at = np.arange(n - RANK1 + 1)
        v = ((self.rank(at, at + RANK1) >> np.uint64(32)) << np.uint64(32)) | at.astype(np.uint64)
        width = 1
        while 2 * width <= REACH + 1:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        rest = REACH + 1 - width
        v = np.minimum(v[: len(v) - rest], v[rest:]) if rest else v
        anchor = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(anchor, prepend=-1))
        return anchor[cuts], cuts, np.append(cuts[1:], len(anchor)) - 1


def pair(a, b):
    """The rank of a pair of ranks."""
    import numpy as np

    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(1)))


_TABLE: list = []


def PLAIN():
    """Random odd values of the 256 bytes, without the folding of case that word hashes use."""
    if not _TABLE:
        import numpy as np

        _TABLE.append(np.random.default_rng(271).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    return _TABLE[0]


def _raw(text):
    import numpy as np

    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _frame(columns, names):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def repeated_windows(rows: DataFrame, hold: Scratch, often: int = 1024, most: int = 4096) -> DataFrame:
    """(id, first, last): runs of window starts whose 100 bytes also start earlier.  ``rows``: id, t.

    The ``most`` ranks of which the most anchors go on, ``often`` or more, are *frequent*.
    """
    spark = rows.sparkSession
    parts = shuffle_parts(spark)

    def ranked(batches):
        """Anchors with their ranks.  kind 1: the span was there before in the same batch; kind 3: the rank has several spans there, of
        which these are the first anchors (they go on), and kind 2 says so to the rank's task, one row a rank and batch; kind 0: the others.
        """
        import numpy as np

        made, names = Anchors(), ["kind", "rank", "span", "id", "first", "more", "back"]
        for batch in batches:
            out = [[], [], [], [], [], []]
            for k, t in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist()):
                made.load(_raw(t))
                m, first, last = made.find()
                if len(m):
                    span = mix(made.rank(first, last + LENGTH) + ((m - first).astype(np.uint64) << np.uint64(8)) + (m - last).astype(np.uint64))
                    for o, c in zip(out, (made.rank(m, m + RANK1).view(np.int64), span.view(np.int64), np.full(len(m), k), first, (last - first).astype(np.int32), (m - first).astype(np.int8))):
                        o.append(c)
            if not out[0]:
                continue
            rank, span, doc, first, more, back = (np.concatenate(o) for o in out)
            order = np.lexsort((first, doc, span, rank))
            rank, span, doc, first, more, back = (c[order] for c in (rank, span, doc, first, more, back))
            same = np.concatenate([[False], rank[1:] == rank[:-1]])
            equal = same & np.concatenate([[False], span[1:] == span[:-1]])
            head = np.flatnonzero(~same)
            several = np.add.reduceat((same & ~equal).astype(np.int64), head) > 0
            mixed = np.repeat(several, np.diff(np.append(head, len(rank))))
            kind = np.where(equal, 1, np.where(mixed, 3, 0)).astype(np.int8)
            yield _frame([kind, rank, span, doc, first, more, back], names)
            mark = head[several]
            if len(mark):
                yield _frame([np.full(len(mark), 2, np.int8), *(c[mark] for c in (rank, span, doc, first, more, back))], names)
        tidy()

    def once(batches):
        """Anchors whose span was there before (on false); those that go on (on true): the first of each span of a rank with several.

        The rows of a rank come together, its marks first.  Of the last rank of a batch one row is kept until it is known what follows.
        """
        import numpy as np

        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, rank, span, doc, first, more, back = (np.asarray(batch.column(c)) for c in ("kind", "rank", "span", "id", "first", "more", "back"))
            done = (kind == 1) | (kind == 3)
            settled = [kind[done] == 3, rank[done], doc[done], first[done], (first + more)[done], back[done]]
            cols = [c[~done] for c in (kind, rank, span, doc, first, more, back)]
            cols.append(np.zeros(len(cols[0]), bool))  # told: the row has gone on already
            if kept is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(kept, cols)]
            kind, rank, span, doc, first, more, back, told = cols
            if len(rank):
                same = np.concatenate([[False], rank[1:] == rank[:-1]])
                plain = kind == 0
                again = plain & same & np.concatenate([[False], plain[:-1] & (span[1:] == span[:-1])])
                group = np.cumsum(~same) - 1
                new = plain & ~again
                mixed = (np.bincount(group, ~plain) > 0) | (np.bincount(group, new) > 1)
                on = new & mixed[group] & ~told
                settled = [np.concatenate([x, y]) for x, y in zip(settled, (on[again | on], *(c[again | on] for c in (rank, doc, first, first + more, back))))]
                tail = np.flatnonzero(group == group[-1])
                keep = tail[new[tail]][-1:] if not mixed[-1] else np.concatenate([tail[~plain[tail]][:1], tail[new[tail]][-1:]])
                kept = [c[keep] for c in cols]
                if mixed[-1]:
                    if plain[keep].all():  # mixed by its spans: a mark says so from now on
                        kept = [np.concatenate([c[:1], c]) for c in kept]
                        kept[0] = np.concatenate([[2], kept[0][1:]]).astype(np.int8)
                    kept[7] = np.ones(len(kept[0]), bool)
            yield _frame(settled, ["go", "rank", "id", "first", "last", "back"])
        tidy()

    # What a batch has settled goes anywhere; only the rest of a rank must meet.
    deal = F.when(F.col("kind").isin(0, 2), F.col("rank")).otherwise(F.xxhash64("rank", "id", "first"))
    dealt = rows.mapInArrow(ranked, "kind byte, rank long, span long, id long, first long, more int, back byte").repartition(parts, deal).sortWithinPartitions("rank", F.desc("kind"), "span", "id", "first")
    round1 = hold.keep(dealt.mapInArrow(once, "go boolean, rank long, id long, first long, last long, back byte"), "round1")
    whole = round1.filter("not go").select("id", "first", "last")
    onward = round1.filter("go")
    import numpy as np

    seen = onward.groupBy("rank").agg(F.count("*").alias("n")).filter(F.col("n") >= often).orderBy(F.desc("n"), "rank").limit(most)
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r["rank"] for r in seen.collect()], np.int64)))

    def slots(batches):
        """kind 0: rows that must meet others of their key; kind 1: runs of windows that are settled in this batch.

        Of a frequent rank each window is a row of its own under its 100 bytes, so that its anchors don't all meet under one key.
        """
        import numpy as np
        import pyarrow as pa

        made, hot = Anchors(), frequent.value
        names = ["kind", "key", "span", "id", "first", "low", "high", "bytes"]

        def again_of(key, span, doc, first):
            """Which rows have an earlier one with their key and span."""
            order = np.lexsort((first, doc, span, key))
            again = np.zeros(len(key), bool)
            again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (span[order[1:]] == span[order[:-1]])
            return again

        def frame(out, blobs, alone):
            parts = []
            if out[0]:
                key, span, doc, first, low, high = (np.concatenate(o) for o in out)
                again = again_of(key, span, doc, first)
                parts.append([again.astype(np.int8), key, span, doc, first, low, high, pa.array([None if g else b for g, b in zip(again.tolist(), blobs)], pa.binary())])
            if alone[0]:
                key, doc, first, anchor = (np.concatenate(o) for o in alone)
                again = again_of(key, key, doc, first)
                zero = np.zeros(int((~again).sum()), np.int64)
                parts.append([zero.astype(np.int8), key[~again], key[~again], doc[~again], first[~again], zero, zero, pa.nulls(len(zero), pa.binary())])
                key, doc, first, anchor = (c[again] for c in (key, doc, first, anchor))
                if len(key):  # settled windows next to each other are one run
                    head = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1] + 1) | (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])]))
                    size = np.diff(np.append(head, len(key)))
                    parts.append([np.ones(len(head), np.int8), key[head], key[head], doc[head], first[head], np.zeros(len(head), np.int64), size - 1, pa.nulls(len(head), pa.binary())])
            for p in parts:
                yield _frame(p, names)

        for batch in batches:
            out, blobs, alone, size = [[], [], [], [], [], []], [], [[], [], [], []], 0
            for k, t, go in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), batch.column("go")):
                raw = _raw(t)
                made.load(raw)
                first, last, back, rank = (np.asarray(go.values.field(c)) for c in ("first", "last", "back", "rank"))
                m, rank = first + back, rank.view(np.uint64)
                if len(hot) and len(m):
                    at = np.minimum(np.searchsorted(hot, rank.view(np.int64)), len(hot) - 1)
                    often = hot[at] == rank.view(np.int64)
                    if often.any():
                        count = (last - first + 1)[often]
                        p = np.repeat(first[often] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                        for o, c in zip(alone, (made.reach(p, LENGTH).view(np.int64), np.full(len(p), k), p, np.repeat(m[often], count))):
                            o.append(c)
                        size += len(p)
                        m, first, last, rank = m[~often], first[~often], last[~often], rank[~often]
                for s in range(0, REACH + 1, SLOT):
                    end = s + SLOT  # the slots fill REACH + 1 places exactly
                    low, high = np.maximum(m - last, s), np.minimum(m - first, end - 1)
                    here = low <= high
                    a, lo, hi = m[here], low[here], high[here]
                    if not len(a):
                        continue
                    key = mix(made.reach(a - s, LENGTH - SLOT + 1) + rank[here] + np.uint64(s))
                    span = mix(made.rank(a - hi, a - lo + LENGTH) + (hi.astype(np.uint64) << np.uint64(8)) + lo.astype(np.uint64))
                    for o, c in zip(out, (key.view(np.int64), span.view(np.int64), np.full(len(a), k), a - hi, lo, hi)):
                        o.append(c)
                    blobs += [raw[x:y].tobytes() for x, y in zip((a - hi).tolist(), (a - lo + LENGTH).tolist())]
                    size += len(a)
                if size > 20_000:
                    yield from frame(out, blobs, alone)
                    out, blobs, alone, size = [[], [], [], [], [], []], [], [[], [], [], []], 0
            if size:
                yield from frame(out, blobs, alone)
        tidy()

    def windows(batches):
        import numpy as np
        import pyarrow as pa

        names = ["key", "id", "first", "low", "high"]
        made = Anchors()

        def solve(cols, blobs):
            key, doc, first, low, high = cols
            _, group, sizes = np.unique(key, return_inverse=True, return_counts=True)
            keep = sizes[group] > 1
            key, doc, first, low, high = (c[keep] for c in (key, doc, first, low, high))
            blobs = [b or b"" for b, k in zip(blobs, keep.tolist()) if k]
            if not blobs:
                return None
            # All windows of all rows in one array: hash each from one running sum over the rows' bytes.
            raw = np.frombuffer(b"".join(blobs), np.uint8)
            starts = np.cumsum([0, *map(len, blobs)])[:-1]
            made.load(raw)
            count = high - low + 1
            row = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = starts[row] + step
            h = made.reach(at, LENGTH) ^ mix(key[row].view(np.uint64) + (high[row] - step).astype(np.uint64))
            p = first[row] + step
            order = np.lexsort((p, doc[row], h))
            again = np.zeros(len(row), bool)
            again[order[1:]] = h[order[1:]] == h[order[:-1]]
            edge = np.diff(again.astype(np.int8), prepend=0)
            new_row = np.concatenate([[True], row[1:] != row[:-1]])
            start = again & ((edge == 1) | new_row)
            stop = again & (np.concatenate([~again[1:], [True]]) | np.concatenate([new_row[1:], [True]]))
            return _frame([doc[row[start]], p[start], p[stop]], ["id", "first", "last"])

        held, blobs, n, before = [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            settled = np.asarray(batch.column("kind")) == 1
            if settled.any():
                first, low, high = (np.asarray(batch.column(c))[settled] for c in ("first", "low", "high"))
                yield _frame([np.asarray(batch.column("id"))[settled], first, first + high - low], ["id", "first", "last"])
                batch = batch.filter(pa.array(~settled))
            if not batch.num_rows:
                continue
            # A span that came before repeats as a whole: a hot group keeps one row for each different span.
            key, span = np.asarray(batch.column("key")), np.asarray(batch.column("span"))
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (span[1:] == span[:-1])
            again[0] = before == (key[0], span[0])
            before = key[-1], span[-1]
            if again.any():
                first, low, high = (np.asarray(batch.column(c))[again] for c in ("first", "low", "high"))
                yield _frame([np.asarray(batch.column("id"))[again], first, first + high - low], ["id", "first", "last"])
                batch = batch.filter(pa.array(~again))
            if not batch.num_rows:
                continue
            held.append([np.asarray(batch.column(c)) for c in names])
            blobs += batch.column("bytes").to_pylist()
            n += batch.num_rows
            if n < 40_000:
                continue
            cols = [np.concatenate([h[j] for h in held]) for j in range(5)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on in the next batch
            if cut:
                done = solve([c[:cut] for c in cols], blobs[:cut])
                if done is not None:
                    yield done
            held, blobs, n = [[c[cut:] for c in cols]], blobs[cut:], n - cut
        if n:
            done = solve([np.concatenate([h[j] for h in held]) for j in range(5)], blobs)
            if done is not None:
                yield done
        tidy()

    deal = F.when(F.col("kind") == 0, F.col("key")).otherwise(F.xxhash64("id", "first"))
    texts = rows.join(onward.groupBy("id").agg(F.collect_list(F.struct("first", "last", "back", "rank")).alias("go")), "id").select("id", "t", "go")
    round2 = texts.mapInArrow(slots, "kind byte, key long, span long, id long, first long, low long, high long, bytes binary").repartition(parts, deal).sortWithinPartitions("key", "span", "id", "first")
    partly = hold.keep(round2.mapInArrow(windows, "id long, first long, last long"), "round3")
    return whole.unionByName(partly)


def numbered(rows: DataFrame, hold: Scratch) -> DataFrame:
    """Numbers in place of ids that are null or stand on several rows: null first, then by id, text hash and place."""
    placed = rows.withColumn("h", F.xxhash64("t")).withColumn("p", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("p")]
    dealt = placed.repartitionByRange(shuffle_parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    return hold.keep(dealt.select(F.monotonically_increasing_id().alias("id"), "doc_id", "t"), "numbered")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, often: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    hold = Scratch(docs.sparkSession, "suffix")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).withColumn("doc_id", F.col("id"))
    if rows.groupBy("id").agg(F.count("*").alias("n")).filter("id is null or n > 1").limit(1).count():
        rows = numbered(rows, hold)
    spans = repeated_windows(rows.select("id", "t"), hold, often)
    mine = spans.groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # at most one run for every 34 bytes of the document

    def cut(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], [], []]
            for t, runs in zip(batch.column("t").to_pylist(), batch.column("runs")):
                raw = _raw(t)
                cover = np.zeros(len(raw) + 1, np.int32)
                if runs.is_valid and len(runs):
                    np.add.at(cover, np.asarray(runs.values.field("first")), 1)
                    np.add.at(cover, np.asarray(runs.values.field("last")) + LENGTH, -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = raw[~gone].tobytes()
                for o, x in zip(out, (len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None)):
                    o.append(x)
            yield _frame([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        tidy()

    joined = rows.join(mine, "id", "left").select("doc_id", "t", "runs")
    out = joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
