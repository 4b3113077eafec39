"""Operator 7: toxicity from the nearest labelled examples by exact TF-IDF cosine.

``fit`` draws at most ``max_examples`` labelled texts (by a hash of the id, one for each distinct text,
toxic ones half of them at most), keeps every word that occurs in two of them or more, and holds the
examples' TF-IDF vectors, toxic and clean, as an inverted index.  Its posting lists are cut into blocks of
128 examples with the largest weight of each; examples are ordered by their heaviest term, so that
blocks hold similar ones.  ``score`` finds the exact ``k`` nearest examples of each whole text: blocks
with the highest upper bounds (query weights times block maxima) are visited first, then all that can reach the k-th best of those.

A term's weight is ``(1 + ln tf) * idf * (share + (1 - share) * mark)``.  ``mark`` (0 to 1) is how far the Wilson lower
bound (z = 1.96) of the term's share of toxic examples lies over the examples' own share; with ``share = 1`` the
vectors are plain TF-IDF.

The nearest examples vote with their cosines (the distance being one minus it); a logistic curve over the vote makes the score.  It is fitted on
a fifth of the examples against an index of the others, each weighted by how many labelled rows it stands for.

Bounded memory: the examples, and so the broadcast index, are bounded by ``max_examples``; a task holds an
Arrow batch of texts and one text's term counts, also for very long texts, which are read whole.

Defined cases: a null, empty or termless text has no neighbour and gets the calibrated share of toxic examples;
null labels and null ids are not learned; an id with several labels counts as toxic if one is; equally near examples
count in the index order, which ``nearest`` shows; repeated rows get equal scores; without examples every score is
0; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, one_by_one, tidy

WORD = re.compile(r"[^\W\d_]+")
BLOCK = 128
FIRST_BLOCKS = 4


def features(text: str | None) -> Counter:
    """Counts of the lower-case words of a whole text."""
    return Counter(WORD.findall(text.lower())) if text else Counter()


def spans(starts, ends):
    """All integers of the ranges [start, end), one range after the other."""
    import numpy as np

    size = ends - starts
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class BlockMaxIndex:
    """Vectors of unit length as postings by term, cut into blocks of examples with the largest weight of each.

    ``rows``, ``terms``, ``weights``: the vectors' entries.  Lists that hold more than a quarter of all examples are kept dense.
    """

    def __init__(self, n: int, n_terms: int, rows, terms, weights, block: int = BLOCK):
        import numpy as np

        self.block, self.n, self.n_blocks, self.read = block, n, max(1, -(-n // block)), 0  # read: postings that searches have added up
        order = np.lexsort((rows, terms))
        self.rows, self.weights, terms = rows[order].astype(np.int64), weights[order].astype(np.float64), terms[order]
        count = np.bincount(terms, minlength=n_terms)
        heavy = np.flatnonzero(count > max(8, n // 4))
        self.dense_of = np.full(n_terms, -1)
        self.dense_of[heavy] = np.arange(len(heavy))
        self.dense = np.zeros((len(heavy), self.n_blocks * block))
        of = self.dense_of[terms]
        self.dense[of[of >= 0], self.rows[of >= 0]] = self.weights[of >= 0]
        self.dense_max = self.dense.reshape(len(heavy), self.n_blocks, block).max(2, initial=0.0)
        # One entry for each (term, block) of the other lists.
        cell = terms.astype(np.int64) * self.n_blocks + self.rows // block
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_block, self.cell_start = cell[first] % self.n_blocks, np.append(first, len(cell))
        self.cell_max = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.term_cells = np.searchsorted(cell[first], np.arange(n_terms + 1) * self.n_blocks)

    def top(self, terms, weights, k: int):
        """The k largest cosines over 0 and their examples, exactly: (cosines, indices); of equal ones the smaller index."""
        import numpy as np

        heavy = self.dense_of[terms]
        light = heavy < 0
        heavy, heavy_w, t = heavy[~light], weights[~light], terms[light]
        lo, hi = self.term_cells[t], self.term_cells[t + 1]
        cells, cell_w = spans(lo, hi), np.repeat(weights[light], hi - lo)
        bound = np.bincount(self.cell_block[cells], cell_w * self.cell_max[cells], self.n_blocks) + heavy_w @ self.dense_max[heavy]
        bound *= 1 + 1e-9  # sums in another order than the cosines'
        def sums(blocks):
            """Sums over the sparse lists of the examples in ``blocks`` (a mask): the postings of other blocks are not read."""
            mine = blocks[self.cell_block[cells]]
            start, end = self.cell_start[cells[mine]], self.cell_start[cells[mine] + 1]
            at = spans(start, end)
            self.read += len(at)
            return np.bincount(self.rows[at], np.repeat(cell_w[mine], end - start) * self.weights[at], self.n_blocks * self.block)

        first = np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]
        take = np.zeros(self.n_blocks, bool)
        take[first] = True
        best = self._best(take, sums(take), heavy, heavy_w, k, np.zeros(0), np.zeros(0, np.int64))
        # The blocks that can still reach the k-th best (of equal cosines the smaller index counts, so equal bounds are visited too).
        rest = ~take & (bound >= best[0][-1] if len(best[0]) == k else bound > 0)
        if rest.any():
            best = self._best(rest, sums(rest), heavy, heavy_w, k, *best)
        return best

    def _best(self, blocks, got, heavy, heavy_w, k: int, best_w, best_i):
        """The k best of those so far and the examples of ``blocks`` (a mask); ``got``: sums over the sparse lists."""
        import numpy as np

        here = (np.flatnonzero(blocks)[:, None] * self.block + np.arange(self.block)).ravel()
        got = got[here]
        if len(heavy):
            got = got + (heavy_w @ self.dense[heavy[:, None], here])
        hit = got > 0
        w, i = np.concatenate([best_w, got[hit]]), np.concatenate([best_i, here[hit]])
        if len(w) > 4 * k:  # those below the k-th can't stay
            keep = w >= np.partition(w, len(w) - k)[len(w) - k]
            w, i = w[keep], i[keep]
        keep = np.lexsort((i, -w))[:k]
        return w[keep], i[keep]


class Model:
    """The examples' index with the terms' weights; what ``fit`` broadcasts."""

    def __init__(self, words: list[str], idf, rows, terms, counts, labels, ids, prior: float):
        import numpy as np

        self.words, self.idf, self.prior, self.curve = words, idf, prior, (0.0, 1.0)
        w = (1 + np.log(counts)) * idf[terms]
        size = np.sqrt(np.bincount(rows, w * w, len(ids)))
        w = w / np.where(size[rows] > 0, size[rows], 1)
        # The index order: heaviest term, then id.
        lead = np.full(len(ids), len(words))
        falling = np.lexsort((terms, -w, rows))
        head = falling[np.flatnonzero(np.diff(rows[falling], prepend=-1))]
        lead[rows[head]] = terms[head]
        order = np.lexsort((ids, lead))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.rows, self.terms, self.weights = place[rows].astype(np.int32), np.asarray(terms, np.int32), w
        self.labels, self.ids = labels[order].astype(np.float64), ids[order]

    def open(self):
        """Index and word table, built once for each worker process: its tasks share the broadcast model."""
        if hasattr(self, "index"):
            return self
        self.index = BlockMaxIndex(len(self.ids), len(self.words), self.rows, self.terms, self.weights)
        self.known = {w: j for j, w in enumerate(self.words)}
        return self

    def vector(self, found: Counter):
        """(terms ascending, weights of unit length); empty if no term has weight."""
        import numpy as np

        known = self.known
        pairs = [(j, n) for w, n in found.items() if (j := known.get(w)) is not None]
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.array(pairs)
        at = at[np.argsort(at[:, 0])]
        w = (1 + np.log(at[:, 1])) * self.idf[at[:, 0]]
        size = math.sqrt(float(w @ w))
        return (at[:, 0], w / size) if size else (np.zeros(0, np.int64), np.zeros(0))

    def vote(self, found: Counter, k: int, smooth: float):
        """(vote from 0 to 1, indices of the nearest, cosines)."""
        terms, weights = self.vector(found)
        if not len(terms) or not len(self.ids):
            return self.prior, [], []
        cos, at = self.index.top(terms, weights, k)
        return float((cos @ self.labels[at] + smooth * self.prior) / (cos.sum() + smooth)), at, cos

    def calibrated(self, vote: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-(a * vote + b))) if a else vote


def weights_of_terms(df, toxic, n: int, share_toxic: float, share: float):
    """idf, raised for terms that mark the label."""
    import numpy as np

    z2 = 1.96**2
    p = toxic / df
    low = (p + z2 / (2 * df) - np.sqrt(z2 * (p * (1 - p) / df + z2 / (4 * df * df)))) / (1 + z2 / df)
    mark = np.clip((low - share_toxic) / max(1e-9, 1 - share_toxic), 0, 1)
    return np.log((1 + n) / (1 + df)) * (share + (1 - share) * mark)


def logistic(x, y, w):
    """(a, b) of 1 / (1 + exp(-(a x + b))), by Newton steps on smoothed targets; (0, 1) if one label is missing."""
    import numpy as np

    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    if not pos or not neg:
        return 0.0, 1.0
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(design @ beta)))
        curve = design.T @ (design * (w * p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, design.T @ (w * (t - p)) - 1e-6 * beta)
        beta = beta + np.clip(step, -8, 8)
        if np.abs(step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_examples: int = 2500, least_df: int = 2, share: float = 0.3, k: int = 15, smooth: float = 0.05) -> Model:
    """The model.  ``labels``: the rows that may be learned from (key, label)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    y = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    total = {int(r["y"] > 0): r["n"] for r in y.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    toxic = min(total.get(1, 0), max(max_examples // 2, max_examples - total.get(0, 0)))
    rate = {1: toxic / max(1, total.get(1, 0)), 0: min(1.0, (max_examples - toxic) / max(1, total.get(0, 0)))}
    dice = F.pmod(F.xxhash64(F.lit("toxic"), "k"), F.lit(1 << 30))
    drawn = y.withColumn("y", (F.col("y") > 0).cast("int")).filter(dice < F.when(F.col("y") == 1, int(rate[1] * (1 << 30))).otherwise(int(rate[0] * (1 << 30))))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(drawn), "k")  # max_examples rows
    examples = rows.groupBy(F.xxhash64(F.coalesce("t", F.lit(""))).alias("h")).agg(F.min(F.struct("k", "y", "t")).alias("r")).select("r.*")

    def counted(batches):
        for batch in batches:
            found = [features(t) for t in one_by_one(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], names=["k", "y", "w", "c"])
        tidy()

    hold = Scratch(docs.sparkSession, "toxicity")
    got = hold.keep(examples.mapInArrow(counted, "k long, y int, w array<string>, c array<int>"), "examples").orderBy("k").toArrow().combine_chunks()
    hold.drop("examples")
    ids, y = got.column("k").to_numpy(), got.column("y").to_numpy()
    lists = got.column("w").combine_chunks() if isinstance(got.column("w"), pa.ChunkedArray) else got.column("w")
    coded = pc.list_flatten(lists).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    at, terms = np.asarray(pc.list_parent_indices(lists)).astype(np.int64), np.asarray(coded.indices).astype(np.int64)
    counts = np.asarray(pc.list_flatten(got.column("c"))).astype(np.float64)
    names = coded.dictionary

    def built(mine):
        """A model of the chosen examples (a mask)."""
        place = np.cumsum(mine) - 1
        inside = mine[at]
        df = np.bincount(terms[inside], minlength=len(names))
        kept = np.flatnonzero(df >= least_df)
        new = np.full(len(names), -1)
        new[kept] = np.arange(len(kept))
        inside &= new[terms] >= 0
        marked = np.bincount(terms[inside & (y[at] == 1)], minlength=len(names))
        n, prior = int(mine.sum()), float(np.average(y[mine], weights=weight[mine])) if mine.any() else 0.0
        idf = weights_of_terms(df[kept].astype(np.float64), marked[kept], n, float(y[mine].mean()) if n else 0.0, share)
        return Model(names.take(pa.array(kept)).to_pylist(), idf, place[at[inside]], new[terms[inside]], counts[inside], y[mine], ids[mine], prior)

    weight = np.where(y == 1, 1 / max(1e-9, rate[1]), 1 / max(1e-9, rate[0]))
    model = built(np.ones(len(ids), bool))
    fold = ids % 5 == 0
    if fold.any() and (~fold).any():
        first = built(~fold).open()
        words, bounds = names.to_pylist(), np.searchsorted(at, np.arange(len(ids) + 1))
        votes = [first.vote(Counter({words[j]: int(c) for j, c in zip(terms[bounds[i] : bounds[i + 1]], counts[bounds[i] : bounds[i + 1]])}), k, smooth)[0] for i in np.flatnonzero(fold)]
        model.curve = logistic(np.array(votes), y[fold], weight[fold] / weight[fold].mean())
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", k: int = 15, smooth: float = 0.05) -> DataFrame:
    """doc_id, score, and as evidence the three nearest examples with their cosines."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = held.value.open()
        learned = len(m.ids) > 0
        for batch in batches:
            out = []
            for t in one_by_one(batch.column("t")):
                vote, at, cos = m.vote(features(t), k, smooth)
                out.append((m.calibrated(vote) if learned else 0.0, [int(m.ids[i]) for i in at[:3]], [float(c) for c in cos[:3]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))],
                names=["doc_id", "score", "nearest", "cosine"],
            )
        tidy()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double, nearest array<long>, cosine array<double>")
