"""Approximate nearest neighbours by learned partitions: a balanced cut of a neighbour graph and a classifier that routes.

On a bounded sample (``per_part`` vectors for each partition) the exact graph of nearest neighbours is cut into partitions of
nearly equal size: median splits along principal directions, then rounds in which vectors move to the partition
of most of their neighbours as long as there is room.  A small network (one hidden layer) learns from a vector the
distribution of its neighbours' partitions.  Every vector of the corpus is indexed under its most probable
partition; a query goes to its most probable partitions until their probabilities reach ``mass``, so a query inside a
cluster visits one or two and a query between clusters many, and its candidates are ranked by the exact cosine.

Partitions number the corpus over ``leaf``, up to ``fan``; a larger corpus gets a second level, in which each
partition is cut by a model of its own, fitted in parallel.  What is broadcast are the models, ``fan`` + 1 at most.
Candidates and queries of a partition meet in blocks of bounded size, so a crowded partition is many tasks.
Of equal vectors only the ``k`` + 1 smallest ids are indexed: no result can hold another.

Defined cases: vectors that are null, zero, hold null or non-finite components, or are not of the most frequent
length (ties: the longer), and rows with a null id, take no part.  An id with several rows is a query once, by its least vector;
a query never finds rows of its own id.  Rows repeated exactly are one candidate.  Ties go to the smaller id.  With at most ``leaf``
vectors there is one partition and the result is exact.  Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy

LEAF, FAN, PER_PART, MASS, NEAR = 2048, 64, 256, 0.96, 10
#: Rows of a block of candidates and of a block of queries.
BLOCK, QUERY_BLOCK = 1024, 512


def unit(x):
    """Rows of length one in double precision; the largest component is divided out first, so no square overflows."""
    import numpy as np

    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def neighbour_graph(x, k: int):
    """The exact ``k`` nearest others of each row (unit vectors), in blocks of rows."""
    import numpy as np

    out = np.zeros((len(x), k), np.int64)
    for lo in range(0, len(x), 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + 512] = np.argpartition(-s, k - 1, 1)[:, :k]
    return out


def median_splits(x, parts: int, rng):
    """Balanced first partitions: halves (in proportion) along the direction of largest spread, again and again."""
    import numpy as np

    label, todo, made = np.zeros(len(x), np.int64), [(np.arange(len(x)), parts)], 0
    while todo:
        rows, n = todo.pop()
        if n == 1:
            label[rows] = made
            made += 1
            continue
        y = x[rows] - x[rows].mean(0)
        v = rng.standard_normal(x.shape[1])
        for _ in range(12):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) or 1.0
        by, left = rows[np.argsort(y @ v, kind="stable")], n // 2
        cut = len(rows) * left // n
        todo += [(by[:cut], left), (by[cut:], n - left)]
    return label


def balanced_cut(graph, label, parts: int, slack: float = 1.1, rounds: int = 20):
    """Vertices move to the partition that most of their neighbours are in, the most gained first, while that has room."""
    import numpy as np

    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    most, least = int(np.ceil(n / parts * slack)), int(n / parts / slack)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (a, label[b]), 1)
        np.add.at(votes, (b, label[a]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        size, moved = np.bincount(label, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            to, old = best[v], label[v]
            if size[to] < most and size[old] > least:
                size[to] += 1
                size[old] -= 1
                label[v] = to
                moved += 1
        if moved < n // 200:
            break
    return label


def fitted(x, parts: int, seed: int = 11, hidden: int = 96, turns: int = 60):
    """Weights (w1, b1, w2, b2) of the network for unit vectors ``x``: neighbour graph, balanced cut, then Adam on the cross entropy."""
    import numpy as np

    rng = np.random.default_rng(seed)
    parts = max(1, min(parts, len(x) // 2))
    graph = neighbour_graph(x, min(NEAR, len(x) - 1)) if len(x) > 1 else np.zeros((len(x), 0), np.int64)
    label = median_splits(x, parts, rng)
    if parts > 1:
        label = balanced_cut(graph, label, parts)
    want = np.zeros((len(x), parts), np.float32)
    np.add.at(want, (np.arange(len(x)), label), 1)
    np.add.at(want, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1)
    want /= want.sum(1, keepdims=True)
    y, d = x.astype(np.float32), x.shape[1]
    w = [rng.standard_normal((d, hidden)).astype(np.float32) * np.float32((2 / d) ** 0.5 * d**0.5 / 2), np.zeros(hidden, np.float32), rng.standard_normal((hidden, parts)).astype(np.float32) * np.float32(0.1), np.zeros(parts, np.float32)]
    if parts == 1:
        return w
    first, second, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    steps = turns * max(1, len(x) // 256)
    for _ in range(turns):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            rows = order[lo : lo + 256]
            step += 1
            h = np.maximum(y[rows] @ w[0] + w[1], 0)
            g = (softmax(h @ w[2] + w[3]) - want[rows]) / len(rows)
            back = (g @ w[2].T) * (h > 0)
            rate = 0.01 * max(0.02, 1 - step / steps)
            for j, grad in enumerate((y[rows].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                first[j] = 0.9 * first[j] + 0.1 * grad
                second[j] = 0.99 * second[j] + 0.01 * grad * grad
                w[j] = w[j] - rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-8)
    return [p.astype(np.float32) for p in w]


def softmax(z):
    import numpy as np

    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def chances(x, w):
    import numpy as np

    return softmax(np.maximum(x.astype(np.float32) @ w[0] + w[1], 0) @ w[2] + w[3])


class Model:
    """One network at the root and, in large corpora, one for each of its partitions.  Leaves are numbered node * FAN + child."""

    def __init__(self, root, below: dict | None = None):
        self.root, self.below = root, below or {}

    def leaves(self, x):
        """(leaf ids, chances) over all leaves."""
        import numpy as np

        top = chances(x, self.root)
        ids, made = [], []
        for node in range(top.shape[1]):
            deep = chances(x, self.below[node]) if node in self.below else np.ones((len(x), 1), np.float32)
            ids += [node * FAN + c for c in range(deep.shape[1])]
            made.append(top[:, node : node + 1] * deep)
        return np.array(ids), np.concatenate(made, 1)

    def home(self, x):
        """The leaf of each vector: the most probable node, in it the most probable child."""
        import numpy as np

        node = chances(x, self.root).argmax(1)
        leaf = node * FAN
        for k in np.unique(node):
            if k in self.below:
                leaf[node == k] += chances(x[node == k], self.below[k]).argmax(1)
        return leaf


def matrix(column, d: int):
    """A list column as rows of ``d`` doubles."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, v as doubles."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("v") == (lengths.d if lengths else 0))


def fit_groups(sample: DataFrame, d: int) -> dict:
    """Node to weights, from (node, parts, v): each node is fitted in a task of its own on its bounded sample."""
    import pickle

    import pyarrow as pa

    def fit(keys, rows):
        x = unit(matrix(rows.column("v").combine_chunks(), d))
        return pa.table({"node": [keys[0].as_py()], "weights": pa.array([pickle.dumps(fitted(x, rows.column("parts")[0].as_py()))], pa.binary())})

    made = sample.groupBy("node").applyInArrow(fit, "node long, weights binary").collect()
    return {r.node: pickle.loads(r.weights) for r in made}


def sampled(rows: DataFrame, per_part: int) -> DataFrame:
    """Of each node (node, parts, size: its rows) ``per_part`` * parts rows, those with the least hash of the id.

    Before they are ordered, hashes beyond one and a half times the share that is needed (and 64 rows more) go.
    """
    need, share = F.col("parts") * per_part, F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    few = rows.filter(share * F.col("size") < 1.5 * need + 64)
    w = Window.partitionBy("node").orderBy(share, "id", "v")
    return few.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= need).select("node", "parts", "v")


def learned(rows: DataFrame, n: int, d: int, leaf: int, per_part: int) -> Model:
    """The model for ``n`` rows (id, v), a written table."""
    top = max(1, min(FAN, -(-n // leaf)))
    root = fit_groups(sampled(rows.withColumns({"node": F.lit(0).cast("long"), "parts": F.lit(top), "size": F.lit(n)}), per_part), d)[0]
    if n <= leaf * FAN:
        return Model(root)
    placed = homes(rows, Model(root), d).withColumn("node", F.floor(F.col("leaf") / FAN))
    sizes = placed.groupBy("node").agg(F.count("*").alias("size"))
    parts = F.least(F.lit(FAN), F.ceil(F.col("size") / leaf)).cast("int").alias("parts")
    return Model(root, fit_groups(sampled(placed.join(F.broadcast(sizes.select("node", "size", parts)), "node"), per_part), d))


def homes(rows: DataFrame, model: Model, d: int) -> DataFrame:
    """``rows`` (id, v) with ``leaf``."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            leaf = model.home(unit(matrix(batch.column(1), d))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], ["id", "v", "leaf"])
        tidy()

    return rows.select("id", "v").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, leaf long")


def routes(queries: DataFrame, model: Model, d: int, sizes: dict, mass: float, least: int) -> DataFrame:
    """(id, v, leaf): each query with its most probable leaves, until they have ``mass`` of the chances and hold ``least`` vectors."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, p = model.leaves(unit(matrix(batch.column(1), d)))
            held = np.array([sizes.get(int(k), 0) for k in ids])
            p = np.where(held > 0, p, 0)
            by = np.argsort(-p, 1, kind="stable")
            before = np.cumsum(np.take_along_axis(p, by, 1), 1) - np.take_along_axis(p, by, 1)
            seen = np.cumsum(held[by], 1) - held[by]
            visit = ((before < mass * p.sum(1, keepdims=True)) | (seen < least)) & (held[by] > 0)
            row, col = np.nonzero(visit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(ids[by[row, col]])], ["id", "v", "leaf"])
        tidy()

    return queries.select("id", "v").mapInArrow(run, f"id {queries.schema['id'].dataType.simpleString()}, v array<double>, leaf long")


def best_of_block(query_ids, q, ids, x, k: int):
    """(query id, id, cosine) of the ``k`` best others for each query.

    A product of matrices finds what may be among them; those cosines are then summed in one fixed order, so
    equal vectors get equal scores wherever they stand.
    """
    import numpy as np

    uq, ux = unit(q), unit(x)
    s = uq @ ux.T
    s[query_ids[:, None] == ids[None, :]] = -np.inf
    kth = -np.partition(-s, min(k, s.shape[1]) - 1, 1)[:, min(k, s.shape[1]) - 1]
    row, col = np.nonzero((s >= kth[:, None] - 1e-9) & (s > -np.inf))
    score = np.clip((uq[row] * ux[col]).sum(1), -1.0, 1.0)
    by = np.lexsort((ids[col], -score, row))
    row, col, score = row[by], col[by], score[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return query_ids[row[keep]], ids[col[keep]], score[keep]


def searched(routed: DataFrame, placed: DataFrame, sizes: DataFrame, d: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each block of candidates for each query routed to its leaf.

    Both sides are dealt into blocks by hashed ids; a candidate goes to each block of queries of its leaf and a query to each
    block of candidates, so what one task holds is bounded whatever a leaf holds.
    """
    import pyarrow as pa

    asked = routed.groupBy("leaf").agg(F.count("*").alias("asked"))
    blocks = sizes.join(asked, "leaf").select("leaf", F.ceil(F.col("size") / BLOCK).cast("long").alias("nc"), F.ceil(F.col("asked") / QUERY_BLOCK).cast("long").alias("nq"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    side = lambda rows, own, other, name, o: rows.join(F.broadcast(blocks), "leaf").select("leaf", "id", "v", F.pmod(F.xxhash64("id", F.lit(5)), F.col(own)).alias(name), every(other).alias(o))
    held, asks = side(placed, "nc", "nq", "c", "q"), side(routed, "nq", "nc", "q", "c")

    def run(left, right):
        import numpy as np

        ids, qs = left.column("id").to_numpy(), right.column("id").to_numpy()
        made = (np.array([], np.int64), np.array([], np.int64), np.array([], np.float64))
        if len(ids) and len(qs):
            made = best_of_block(qs, matrix(right.column("v").combine_chunks(), d), ids, matrix(left.column("v").combine_chunks(), d), k)
        return pa.table([pa.array(m, t) for m, t in zip(made, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    keys = ["leaf", "c", "q"]
    return held.groupBy(keys).cogroup(asks.groupBy(keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, leaf: int = LEAF, per_part: int = PER_PART, mass: float = MASS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` the ``k`` nearest other rows that the index finds."""
    hold = Scratch(vectors.sparkSession, "partitions")
    rows = hold.keep(usable(vectors, key, vector).withColumn("id", F.col("id").cast("long")), "rows")
    first = rows.select(F.size("v").alias("d")).first()
    if first is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    d = first.d
    # only the smallest ids of equal vectors, and each (id, vector) once
    few = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).filter(f"r <= {k + 1}").select("id", "v").distinct()
    few = hold.keep(few, "few")
    model = learned(few, few.count(), d, leaf, per_part)
    placed = hold.keep(homes(few, model, d), "placed")
    sizes = hold.keep(placed.groupBy("leaf").agg(F.count("*").alias("size")), "sizes")
    by_leaf = {r.leaf: r["size"] for r in sizes.collect()}  # at most FAN * FAN
    queries = rows.filter(F.col("id") % every == 0).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("v"))).filter("r = 1")
    routed = hold.keep(routes(queries, model, d, by_leaf, mass, 2 * k + 2), "routed")
    found = searched(routed, placed, sizes, d, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # an id with several vectors may be found more than once: the nearest counts
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
