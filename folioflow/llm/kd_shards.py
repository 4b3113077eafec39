"""Operator 10: k-d tree sharding by distributed weighted medians.

Rows with equal texts form one *group*, which has a point in a few metadata dimensions (each a
number in [0, 1]) and a weight in bytes.  A node of the tree that is to hold ``k`` shards is cut
along its widest dimension at the weighted ``floor(k/2)/k`` quantile, and so on until each leaf is
one shard.  The quantile is found by histograms: every pass adds up the weights of 4096 bins between
the current bounds for all nodes of the level at once and narrows the bounds to the bin that holds
the quantile, until that bin is one sort key.  The driver sees only these sums and the tree.

Order keys are ``floor(2^20 * dimension) * 2^40 + hash of the group``, so ties in a dimension are cut
by the hash and a key is in effect one group, which goes whole to the side that leaves the cut nearest to its target.

Groups that would spoil a cut are settled first: each one over ``large`` of a shard (or one in ``most_rows`` of all rows) is
placed whole, the heaviest first, into the shard with the least so far, and the cuts fill what room that leaves.  Those are at
most ``shards / large + most_rows`` groups, which the driver and a broadcast hold.  Only a group heavier than a whole
shard is dealt over several, by a hash of its rows.

Defined cases: a null text has no bytes and forms a group with the other null texts; null metadata
counts as 0; repeated rows stay and are ordered by all their columns' hash; very long texts are only measured and hashed; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_table

BINS = 4096
KEY_BITS = 60


def unit_hash(col):
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) / F.lit(float(1 << 32)), F.lit(0.0))


def sharded(rows: DataFrame, dims: list[str], shards: int, weight: str = "size", group: str = "group_key", salt: str = "row_key", large: float = 0.02, most_rows: int = 2000) -> DataFrame:
    """``rows`` with ``shard``.  ``group``/``salt``: 64-bit hashes of the group and of the row; ``dims``: numbers in [0, 1]."""
    spark = rows.sparkSession
    hold = Scratch(spark, "kd")
    names = rows.columns
    sums = hold.keep(rows.groupBy(group).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"), *(F.min(d).alias(f"_{d}") for d in dims)), "groups")
    total, n = sums.agg(F.sum("_w"), F.sum("_n")).first()
    total, n = total or 0, n or 0
    share = total / shards
    # At most shards / large groups by weight and most_rows by number.
    big = sums.filter((F.col("_w") > large * share) | (F.col("_n") > max(1, n // most_rows))).select(group, "_w").collect()
    place, load = {}, [0] * shards
    heap = [(0, s) for s in range(shards)]
    for r in sorted((r for r in big if r["_w"] <= share), key=lambda r: (-r["_w"], r[group])):
        filled, s = heapq.heappop(heap)
        place[r[group]] = s
        load[s] = filled + r["_w"]
        heapq.heappush(heap, (load[s], s))
    room = [max(0.0, share - x) for x in load]
    kind = rows.schema[group].dataType.simpleString()
    whole = small_table(spark, [{group: g, "_shard": s} for g, s in place.items()], f"{group}:{kind},_shard:int")
    split = small_table(spark, [{group: r[group], "_split": True} for r in big if r["_w"] > share], f"{group}:{kind},_split:boolean")
    marked = rows.join(F.broadcast(whole), group, "left").join(F.broadcast(split), group, "left")
    settled = marked.filter("_shard is not null").select(*names, F.col("_shard").alias("shard"))
    # The rows of a group that is split are units of their own, next to each other in every order.
    rest = marked.filter("_shard is null").select(*names, F.coalesce("_split", F.lit(False)).alias("_split"))
    several = sums.filter((F.col("_n") > 1) & (F.col("_w") <= large * share) & (F.col("_n") <= max(1, n // most_rows))).select(group, *(f"_{d}" for d in dims))
    units = rest.join(several, group, "left")
    tie = F.pmod(F.col(group), F.lit(1 << 24)) * F.lit(1 << 16) + F.when(F.col("_split"), F.pmod(F.col(salt), F.lit(1 << 16))).otherwise(F.lit(0))
    units = units.withColumns({f"_k{j}": F.floor(F.when(F.col("_split"), 0.0).otherwise(F.coalesce(f"_{d}", d)) * F.lit((1 << 20) - 1)).cast("long") * F.lit(1 << 40) + tie for j, d in enumerate(dims)})
    flat = hold.keep(units.select(*names, *(f"_k{j}" for j in range(len(dims)))), "units")
    keys = [f"_k{j}" for j in range(len(dims))]
    points = hold.keep(flat.groupBy(*keys).agg(F.sum(weight).alias("w")), "points")

    tree: dict[int, tuple[int, int]] = {}  # node -> (dimension, last key of its left side)
    open_nodes, leaves = {1: (0, shards)}, {}
    while any(k > 1 for _, k in open_nodes.values()):
        leaves |= {n: s for n, (s, k) in open_nodes.items() if k == 1}
        open_nodes = {n: x for n, x in open_nodes.items() if x[1] > 1}
        here = points.withColumn("node", node_of(tree, keys)).filter(F.col("node").isin(*open_nodes))
        level = {r["node"]: r for r in here.groupBy("node").agg(F.sum("w").alias("w"), *(F.min(k).alias(f"lo{k}") for k in keys), *(F.max(k).alias(f"hi{k}") for k in keys)).collect()}
        search = {}
        for n, (first, k) in open_nodes.items():
            r = level.get(n)
            if r is None:  # fewer units than shards: the rest of the shards stay empty
                tree[n] = (0, (1 << KEY_BITS) - 1)
                continue
            j = max(range(len(keys)), key=lambda j: (r[f"hi_k{j}"] - r[f"lo_k{j}"], -j))
            search[n] = {"dim": j, "lo": r[f"lo_k{j}"], "hi": r[f"hi_k{j}"], "below": 0, "goal": r["w"] * (sum(room[first : first + k // 2]) / (sum(room[first : first + k]) or 1.0))}
        while search:
            step = {n: max(1, -(-(s["hi"] - s["lo"] + 1) // BINS)) for n, s in search.items()}
            key = F.col("key")
            narrowed = here.select("node", "w", pick({n: keys[s["dim"]] for n, s in search.items()}).alias("key")).select("*", number({n: s["lo"] for n, s in search.items()}).alias("lo"), number({n: s["hi"] for n, s in search.items()}).alias("hi"), number(step).alias("step")).filter(key.between(F.col("lo"), F.col("hi")))
            bins: dict[int, list] = {}
            for r in narrowed.groupBy("node", F.expr("(key - lo) div step").alias("bin")).agg(F.sum("w").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect():
                bins.setdefault(r["node"], []).append((r["bin"], r["w"], r["lo"], r["hi"]))
            for n, s in list(search.items()):
                at = s["below"]
                for b, w, lo, hi in sorted(bins[n]):
                    if at + w >= s["goal"] or (b, w, lo, hi) == max(bins[n]):
                        if lo == hi:  # one unit: it goes to the side that is nearer to the goal
                            tree[n] = (s["dim"], hi if at + w - s["goal"] <= s["goal"] - at else lo - 1)
                            del search[n]
                        else:
                            s |= {"lo": lo, "hi": hi, "below": at}
                        break
                    at += w
        open_nodes = {c: x for n, (first, k) in open_nodes.items() for c, x in ((2 * n, (first, k // 2)), (2 * n + 1, (first + k // 2, k - k // 2)))}
    leaves |= {n: s for n, (s, _) in open_nodes.items()}
    return flat.withColumn("shard", number(leaves, node_of(tree, keys)).cast("int")).select(*names, "shard").unionByName(settled)


def number(values: dict, node=None):
    return F.element_at(F.create_map(*(F.lit(x) for n, v in values.items() for x in (n, v))), F.col("node") if node is None else node)


def pick(columns: dict[int, str]):
    """For each row the order key of the dimension along which its node is cut."""
    out, by = None, {}
    for n, c in columns.items():
        by.setdefault(c, []).append(n)
    for c, nodes in by.items():
        out = (F if out is None else out).when(F.col("node").isin(*nodes), F.col(c))
    return out


def node_of(tree: dict[int, tuple[int, int]], keys: list[str]):
    """The node a row lies in: a walk down the tree, one step for each level."""
    depth = max((n.bit_length() for n in tree), default=0)
    if not depth:
        return F.lit(1)
    dims = F.create_map(*(F.lit(x) for n, v in tree.items() for x in (n, v[0] + 1)))
    cuts = F.create_map(*(F.lit(x) for n, v in tree.items() for x in (n, v[1])))
    own = F.array(*keys)

    def step(node, _):
        right = (F.element_at(own, F.element_at(dims, node)) > F.element_at(cuts, node)).cast("int")
        return F.when(F.map_contains_key(dims, node), 2 * node + right).otherwise(node)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)


def documents_sharded(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", meta: tuple[str, ...] = ("lang", "source"), block_rows: int = 50_000) -> DataFrame:
    """Documents by bytes into ``shards``: doc_id, size, text_crc32, shard and a gapless slot in the shard."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = (F.octet_length(body) + 16).cast("long")
    rows = docs.select(
        F.col(key).alias("doc_id"), size.alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(text).alias("group_key"), F.xxhash64(F.col(key), *meta).alias("row_key"),
        *(unit_hash(F.col(m)).alias(f"d_{m}") for m in meta), F.least(F.log2(size) / F.lit(40.0), F.lit(1.0)).alias("d_size"),
    )
    out = sharded(rows, [*(f"d_{m}" for m in meta), "d_size"], shards)
    # Slots: a shard is numbered block by block, so no task needs a whole shard.
    n = out.count()
    blocks = max(1, -(-n // block_rows))
    out = out.withColumn("block", F.pmod(F.col("row_key"), F.lit(blocks)))
    counts = out.groupBy("shard", "block").agg(F.count("*").alias("n"))
    first = counts.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "row_key", "text_crc32")) - 1
    return out.withColumn("within", within).join(first, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
