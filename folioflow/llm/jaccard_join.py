"""Operator 4: n-gram Jaccard join with signature trees.

Each text's distinct word shingles are hashed to 64 bits.  Equal sets are one *class*, represented
by its smallest id.  A pair with similarity ``t`` shares one of the first ``n - ceil(t n) + 1``
hashes of either set in any one order of all hashes, so a *cell* for each such hash holds every linked pair.
The order is rare before frequent, then ascending: what many texts share stands last and makes no
large cells.  Frequent are the ``FREQUENT`` hashes most often seen at least four times in a run of
texts; which ones are found shapes the cells only, never the result.
Cells with the same members count once, and one of more than ``cell_rows`` members is dealt into pairs
of blocks, which are joined in parallel.

In a cell (or pair of blocks) the sets are the leaves of a signature tree: nodes hold the OR of their
sets' 1024-bit token bitmaps, the size range and the smallest number of set bits.  The dual traversal
drops a node pair when the sizes cannot meet the threshold or when the largest possible overlap,
``max size - (min bits - bits common to both ORs)``, is below the overlap that its smallest sizes need.
Pairs of sets that remain are compared exactly.

Linked sets also share many of those first hashes: at least ``need - max(ceil(t n)) + 1`` of them.
Every set brings along its first hashes that other sets have too (31 bits of each, in order, and one that says whether
two such hashes have these 31 in common), so a task counts what two sets share of them before it gives out the pair; 31 bits can only count
too much, so the test drops no link.  A pair is given out by the cell of its first common hash that its 31 bits tell from all others, and by cells of hashes that they don't.

A large group of near copies must not be spelled out pair by pair.  So the trees are
traversed twice: first each set keeps only its most promising partner (in cells of more than ``small`` members one before it, by the bound alone); the confirmed links
are closed to components; then all remaining pairs *between different components* are compared.  No
link that could join two components is lost, and pairs inside one are not needed.  A small cell whose every pair was given out
the first time says nothing and is not joined again; one that left pairs out is named.
All cells of up to ``FLAT`` members of an Arrow batch are joined at once, without a tree: the same tests on arrays of their pairs.

Bounded memory: a task holds ``BATCH`` texts, pairs of sets or cells (of two blocks each) at once; the broadcast id lists are size-checked.
A very long text is hashed as a whole, with some 60 bytes of numbers for each of its own.

Defined cases: null and empty texts have the empty set and link with nothing; fewer words than the
shingle size are one shingle; ties and repeated rows fall into one class; ids are keys (rows that
repeat an id with another text share that id's component); a null id has a null component; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, tidy, with_group
from .components import components
from .shingles import Shingler

BITS = 1024
FREQUENT = 1 << 17
BATCH = 256
LEAF = 16
FAN = 8
FLAT = 64
SHIFT = 33


def least_common(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def shared_first(n, m, percent: int):
    """How many of their first hashes linked sets of n and m elements share at least (numbers, arrays or columns)."""
    need = -((-percent * (n + m)) // (100 + percent))
    longest = -((-percent * np_max(n, m)) // 100)
    return need - longest + 1


def np_max(n, m):
    import numpy as np

    return np.maximum(n, m)


def frequent_shingles(texts: DataFrame, size: int):
    """The most frequent shingle hashes, ascending, and their counts: two arrays of at most FREQUENT elements."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        def often(sets):
            found, seen = np.unique(np.concatenate(sets), return_counts=True)
            found, seen = found[seen >= 4], seen[seen >= 4]
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(seen)], names=["h", "seen"])

        made, sets, held = Shingler(size), [], 0
        for batch in batches:
            for t in batch.column("t").to_pylist():
                sets.append(made.sets(t))
                held += len(sets[-1])
                if held > 1 << 19:  # 4 MB
                    yield often(sets)
                    sets, held = [], 0
        if sets:
            yield often(sets)

    top = texts.mapInArrow(run, "h long, seen long").groupBy("h").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "h").limit(FREQUENT).toArrow()
    hashes, seen = top.column("h").to_numpy().view(np.uint64), top.column("seen").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], seen[order]


def rare_first(s, hashes, seen):
    """The set ``s`` (ascending) with its frequent hashes last, the rarer of them first."""
    import numpy as np

    if not len(hashes):
        return s
    spot = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
    count = np.where(hashes[spot] == s, seen[spot], 0)
    return s[np.argsort(count, kind="stable")] if count.any() else s


def shingle_table(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``texts``: id, t.  Size, digest, first hashes and bitmap of every text's set."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts, size))  # 2 MB at most

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        made = Shingler(size)
        for batch in batches:
            n, digest, prefix, bits = [], [], [], []
            for t in batch.column("t").to_pylist():
                s = made.sets(t)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                prefix.append(rare_first(s, *shared.value)[: len(s) - least_common(len(s), percent) + 1].view(np.int64) if len(s) else s.view(np.int64))
                flags = np.zeros(BITS, np.uint8)
                flags[s & np.uint64(BITS - 1)] = 1
                bits.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["id", "n", "digest", "prefix", "bits"])
        tidy()

    return texts.mapInArrow(run, "id long, n long, digest binary, prefix array<long>, bits binary")


class SignatureTree:
    """Sets of a cell ordered by size; levels[0] are the sets themselves, the last level is the root."""

    def __init__(self, sizes, bits, comps, hot):
        import numpy as np

        count = np.bitwise_count(bits).sum(1).astype(np.int64)
        self.hot = hot  # the set's hashes in larger cells; a very large number switches the test off
        self.levels = [(bits, sizes, sizes, count, comps, comps)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, c, c0, c1 = self.levels[-1]
            cuts = np.arange(0, len(b), width)
            self.levels.append((np.bitwise_or.reduceat(b, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.minimum.reduceat(c, cuts), np.minimum.reduceat(c0, cuts), np.maximum.reduceat(c1, cuts)))
            width = FAN

    def fan(self, level: int) -> int:
        return LEAF if level == 1 else FAN


def traverse(a: SignatureTree, b: SignatureTree, percent: int, same: bool, chunk: int = 16_384):
    """Pairs (i, j, bound) of leaves that the node bounds leave over; i < j where both trees are one."""
    import numpy as np

    top = max(len(a.levels), len(b.levels)) - 1

    def at(tree, level):
        return tree.levels[min(level, len(tree.levels) - 1)]

    def children(tree, level, nodes):
        """(repeat of the parent's place, child) one level down."""
        if level > len(tree.levels) - 1:
            return np.arange(len(nodes)), nodes
        fan, below = tree.fan(level), len(tree.levels[level - 1][0])
        child = nodes[:, None] * fan + np.arange(fan)
        keep = child < below
        return np.nonzero(keep)[0], child[keep]

    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        for lo in range(0, len(i), chunk):
            p, q = i[lo : lo + chunk], j[lo : lo + chunk]
            bi, lo_i, hi_i, c_i, m_i, x_i = (v[p] for v in at(a, level))
            bj, lo_j, hi_j, c_j, m_j, x_j = (v[q] for v in at(b, level))
            common = np.bitwise_count(bi & bj).sum(1).astype(np.int64)
            bound = np.minimum(hi_i - np.maximum(0, c_i - common), hi_j - np.maximum(0, c_j - common))
            need = -(-percent * (lo_i + lo_j) // (100 + percent))
            ok = (bound >= need) & (100 * hi_i >= percent * lo_j) & (100 * hi_j >= percent * lo_i)
            ok &= ~((m_i == x_i) & (m_j == x_j) & (m_i == m_j))  # all of one component
            if same:
                ok &= (p <= q) if level else (p < q)
            p, q = p[ok], q[ok]
            if not len(p):
                continue
            if level == 0:
                share = np.minimum(a.hot[p], b.hot[q]) >= shared_first(lo_i[ok], lo_j[ok], percent)
                if share.any():
                    yield p[share], q[share], (bound[ok] / (lo_i[ok] + lo_j[ok]))[share]
                continue
            r, child = children(a, level, p)
            q = q[r]
            r, other = children(b, level, q)
            stack.append((level - 1, child[r], other))


def numbered(lists, place):
    """First hashes of many sets: ascending (place << 32) + hash, and how many each place has and where they begin.  ``place``: each list's."""
    import numpy as np

    sizes = np.asarray(lists.value_lengths(), np.int64)
    keys = np.repeat(place << 32, sizes) + np.asarray(lists.flatten(), np.int64) + (1 << 31)
    keys.sort()
    held = np.empty(len(sizes), np.int64)
    held[place] = sizes
    return keys, held, np.cumsum(held) - held


def shared_hashes(first, second, p, q, most: int = 1 << 20):
    """How many hashes of the sets ``p`` of ``first`` those ``q`` of ``second`` have too, and the least of them (none: the largest number), pair by pair.

    Hashes of a set with equal bits all count: never too few.  The least is one of the even hashes: only these are told from all others.
    """
    import numpy as np

    count, least = np.zeros(len(p), np.int64), np.full(len(p), np.iinfo(np.int64).max)
    (keys, held, begin), others = first, second[0]
    ends, lo = np.cumsum(held[p]), 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - held[p[lo]] + most, "right")))
        n = held[p[lo:hi]]
        pair = np.repeat(np.arange(lo, hi), n)
        h = keys[np.arange(len(pair)) + np.repeat(begin[p[lo:hi]] - np.cumsum(n) + n, n)] & 0xFFFFFFFF
        want = (q[pair] << 32) + h
        hit = others[np.minimum(np.searchsorted(others, want), len(others) - 1)] == want
        pair, h = pair[hit], h[hit]
        count[lo:hi] = np.bincount(pair - lo, minlength=hi - lo)
        pair, h = pair[h % 2 == 0], h[h % 2 == 0]
        head = np.flatnonzero(np.diff(pair, prepend=-1))
        least[pair[head]] = h[head]
        lo = hi
    return count, least


def flat_pairs(members, sizes, h, percent: int, chunk: int = 1 << 15):
    """Pairs of many small cells at once: the members' ids by place, then (cell, p, q, likeness) of places p < q.

    ``members``: those of all cells, one cell after the other; ``sizes`` and ``h``: how many a cell has, and its hash.
    """
    import numpy as np

    ids, n, comp = (np.asarray(members.field(c), np.int64) for c in ("id", "n", "comp"))
    bits = np.frombuffer(b"".join(members.field("bits").to_pylist()), np.uint64).reshape(len(ids), BITS // 64)
    cell = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((ids, n, cell))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    first = numbered(members.field("first"), place)
    ids, n, comp, bits = ids[order], n[order], comp[order], bits[order]
    ones = np.bitwise_count(bits).sum(1).astype(np.int64)
    keys, held, begin = first
    head = keys[np.minimum(begin, len(keys) - 1)] & 0xFFFFFFFF

    def run():
        after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids)) - 1  # members of the cell behind each
        ends, lo = np.cumsum(after), 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - after[lo] + chunk, "right")))
            k = after[lo:hi]
            p = np.repeat(np.arange(lo, hi), k)
            q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(k) - k, k)
            lo = hi
            least = shared_first(n[p], n[q], percent)
            ok = (100 * n[p] >= percent * n[q]) & (comp[p] != comp[q]) & (np.minimum(held[p], held[q]) >= least)
            ok &= (head[p] != head[q]) | (head[p] == h[cell[p]]) | ((head[p] | h[cell[p]]) % 2 == 1)  # another cell has a lesser hash of both
            p, q, least = p[ok], q[ok], least[ok]
            need = -(-percent * (n[p] + n[q]) // (100 + percent))
            common = np.bitwise_count(bits[p] & bits[q]).sum(1).astype(np.int64)
            ok = np.minimum(n[p] - np.maximum(0, ones[p] - common), n[q] - np.maximum(0, ones[q] - common)) >= need
            p, q, least = p[ok], q[ok], least[ok]
            turn = held[p] > held[q]
            count, met = shared_hashes(first, first, np.where(turn, q, p), np.where(turn, p, q))
            ok = (count >= least) & ((met == h[cell[p]]) | (h[cell[p]] % 2 == 1))
            p, q = p[ok], q[ok]
            if len(p):
                yield cell[p], p, q, count[ok] / (n[p] + n[q])

    return ids, run()


def most_promising(p, q, likeness):
    """Of the pairs (p, q), q's partner of the largest likeness, then of the smallest place: places in the arrays."""
    import numpy as np

    order = np.lexsort((p, -likeness, q))
    return order[np.diff(q[order], prepend=-1) != 0]


def cell_pairs(cells: DataFrame, percent: int, spanning: bool, counted: bool = True) -> DataFrame:
    """Candidate pairs (a, b) of cells: rows with the cell's hash ``token``, its short form ``h`` and ``left`` and ``right`` arrays of members; ``right`` null: a self join.

    ``counted``: only pairs that share enough of their first hashes, in the cell of the least common one.  ``spanning``: of each set's pairs
    only the most promising; without ``counted`` the one before it.  Where both leave pairs out, a row of nulls and the cell's ``token`` says so.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def tree(members):
            ids = np.asarray(members.field("id"), np.int64)
            sizes, comps, hot = (np.asarray(members.field(c), np.int64) for c in ("n", "comp", "hot"))
            bits = np.frombuffer(b"".join(members.field("bits").to_pylist()), np.uint64).reshape(len(ids), BITS // 64)
            order = np.lexsort((ids, sizes))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            first = numbered(members.field("first"), place) if counted else None
            return ids[order], first, SignatureTree(sizes[order], bits[order], comps[order], first[1] if counted else hot[order])

        def one(left, right, h):
            """(ids of p, ids of q, pairs as in ``flat_pairs``) of one cell, or of two blocks."""
            ids, first, a = tree(left)
            jds, second, b = (ids, first, a) if right is None else tree(right)

            def pairs():
                for p, q, bound in traverse(a, b, percent, right is None):
                    if counted:
                        n, m = a.levels[0][1][p], b.levels[0][1][q]
                        count, least = shared_hashes(first, second, p, q)
                        ok = (count >= shared_first(n, m, percent)) & ((least == h) | (h % 2 == 1))
                        p, q, bound = p[ok], q[ok], (count / (n + m))[ok]
                    if len(p):
                        yield np.zeros(len(p), np.int64), p, q, bound

            return ids, jds, pairs()

        def joined(batch):
            """(tokens, ids of p, ids of q, pairs, whether all are of one list) of all cells of up to FLAT members, then of every other one."""
            left, right = batch.column("left"), batch.column("right")
            tokens = np.asarray(batch.column("token"), np.int64)
            h = np.asarray(batch.column("h"), np.int64) + (1 << 31)
            flat = counted & np.asarray(right.is_null()) & (np.asarray(left.value_lengths()) <= FLAT)
            if flat.any():
                few = left.filter(pa.array(flat))
                ids, pairs = flat_pairs(few.flatten(), np.asarray(few.value_lengths(), np.int64), h[flat], percent)
                yield tokens[flat], ids, ids, pairs, True
            for k in np.flatnonzero(~flat).tolist():
                same = not right[k].is_valid
                yield tokens[k : k + 1], *one(left[k].values, None if same else right[k].values, h[k]), same

        def chosen(pairs, same):
            """Places p and q of the pairs to give out (``spanning``: each set's best ones), and the cells with more."""
            kept, seen = [], np.zeros(0, np.int64)
            for found in pairs:
                if not spanning:
                    kept.append(found)
                    continue
                seen = np.concatenate([seen, found[0]])
                found = tuple(np.concatenate(v) for v in zip(*kept, found))
                cell, p, q, likeness = found
                if counted and same:
                    best = np.unique(most_promising(np.concatenate([p, q]), np.concatenate([q, p]), np.tile(likeness, 2)) % len(p))
                else:
                    best = most_promising(p, q, likeness)
                kept = [tuple(v[best] for v in found)]
            if not kept:
                return seen, seen, seen
            cell, p, q, _ = (np.concatenate(v) for v in zip(*kept))
            if not (spanning and counted):
                return p, q, seen[:0]
            more = np.bincount(seen)
            return p, q, np.flatnonzero(more > np.bincount(cell, minlength=len(more)))

        for batch in batches:
            found = []
            for tokens, ids, jds, pairs, same in joined(batch):
                p, q, more = chosen(pairs, same)
                found += [(np.minimum(ids[p], jds[q]), np.maximum(ids[p], jds[q]), np.zeros(len(p), np.int64), np.zeros(len(p), bool)), (more, more, tokens[more], np.ones(len(more), bool))]
            if found:
                x, y, token, none = (np.concatenate(v) for v in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(x, mask=none), pa.array(y, mask=none), pa.array(token, mask=~none)], names=["a", "b", "token"])
        tidy()

    return cells.mapInArrow(run, "a long, b long, token long").filter("a <> b or token is not null")


def verified(pairs: DataFrame, texts: DataFrame, hold: Scratch, size: int, percent: int, name: str, broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold, by exact intersection."""
    ids = hold.keep(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), f"{name}_ids")
    few = ids.count() <= broadcast_rows

    def sets(batches):
        import pyarrow as pa

        made = Shingler(size)
        for batch in batches:
            found = [made.sets(t).tobytes() for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "s"])

    own = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    made = hold.keep(own.mapInArrow(sets, "id long, s binary"), f"{name}_sets")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                both = np.frombuffer(x + y, np.uint64)
                both = np.sort(both)
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(both) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        tidy()

    wide = pairs.join(made.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(made.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return hold.keep(wide.mapInArrow(compare, "a long, b long"), f"{name}_links")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, cell_rows: int = 1024, small: int = 48, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, rep (smallest id with the same set) and component_id (smallest id reachable by links)."""
    with arrow_rows(docs.sparkSession, BATCH):  # all Python work is written to tables in there
        return _near_components(docs, key, text, size, percent, cell_rows, small, broadcast_rows)


def _near_components(docs: DataFrame, key: str, text: str, size: int, percent: int, cell_rows: int, small: int, broadcast_rows: int) -> DataFrame:
    hold = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    made = hold.keep(shingle_table(texts, size, percent), "shingles")
    # Only classes of several rows need a look-up; the largest may hold a third of all rows.
    classes = hold.keep(made.filter("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"), "classes")
    own = F.col("id").eqNullSafe(F.coalesce("rep", "id")) & (F.col("n") > 0)
    known = with_group(made, classes, "digest", "copies", made.count())
    known = hold.keep(known.select("id", "n", F.coalesce("rep", "id").alias("rep"), own.alias("own"), *(F.when(own, F.col(c)).alias(c) for c in ("prefix", "bits"))), "members")
    hold.drop("shingles", "classes")
    member, made = known.select("id", "n", "rep"), known.filter("own and id is not null")
    rows = made.select("id", "n", F.explode("prefix").alias("token"))
    shared = hold.keep(rows.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1"), "tokens")
    # The short form of a hash: its upper bits in order, and a last one where another hash has the same.
    part = F.shiftright("token", SHIFT)
    twice = shared.groupBy(part.alias("part")).agg(F.count("*").alias("k")).filter("k > 1").select("part", F.lit(1).alias("twin"))
    named = shared.withColumn("part", part).join(twice, "part", "left").select("token", "m", (F.shiftleft("part", 1) + F.coalesce("twin", F.lit(0))).cast("int").alias("h"))
    met = hold.keep(rows.join(hold.keep(named, "named"), "token"), "met")
    # Cells with the same members are one cell, named by the least of their hashes.
    mark = F.xxhash64("id")
    name = met.groupBy("token", "m").agg(F.bit_xor(mark).alias("x"), F.sum(mark.bitwiseAND(F.lit((1 << 31) - 1))).alias("s"), F.min("id").alias("lo"))
    cells = name.groupBy("m", "x", "s", "lo").agg(F.min("token").alias("token")).select("token")
    inside = hold.keep(met.join(cells, "token"), "inside")
    first = met.groupBy("id").agg(F.count_if(F.col("m") > small).alias("hot"), F.collect_list("h").alias("first"))
    marks = hold.keep(made.select("id", "bits").join(first.select("id", "hot", "first"), "id"), "marks")
    hold.drop("tokens", "named", "met")

    def paired(rows: DataFrame, spanning: bool, counted: bool = True) -> DataFrame:
        """``rows``: token, h, m, id, n, comp."""
        full = rows.join(marks, "id").select("token", "h", "m", "id", "n", "comp", "hot", "bits", *(["first"] if counted else [])).withColumn("blocks", F.ceil(F.col("m") / cell_rows).cast("int"))
        one = F.struct("id", "n", "comp", "hot", "bits", *(["first"] if counted else []))
        spot = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        alone = full.filter("blocks = 1").groupBy("token", "h").agg(F.collect_list(one).alias("left"))
        alone = alone.select("token", "h", "left", F.when(F.lit(False), F.col("left")).alias("right"))
        placed = full.filter("blocks > 1").withColumn("own", spot).select("token", "h", "own", one.alias("member"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        placed = placed.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
        large = placed.groupBy("token", "h", "lo", "hi").agg(F.collect_list(F.when(F.col("own") == F.col("lo"), F.col("member"))).alias("left"), F.collect_list(F.when((F.col("own") == F.col("hi")) & (F.col("lo") < F.col("hi")), F.col("member"))).alias("right"))
        large = large.filter(F.size("left") > 0).select("token", "h", "left", F.when(F.col("lo") < F.col("hi"), F.col("right")).alias("right")).filter("right is null or size(right) > 0")
        return cell_pairs(alone.unionByName(large), percent, spanning, counted)

    # Every set its own component, and each keeps its most promising partner.
    single = inside.withColumn("comp", F.col("id"))
    given = hold.keep(paired(single.filter(F.col("m") <= small), True).unionByName(paired(single.filter(F.col("m") > small), True, False)).distinct(), "first")
    first = given.filter("token is null").select("a", "b")
    links = verified(first, texts, hold, size, percent, "first", broadcast_rows)
    known = components(links, hold, "cc1")
    # Small cells that have given out all their pairs are done.
    more = inside.filter(F.col("m") <= small).join(given.select("token").filter("token is not null"), "token", "left_semi")
    labelled = hold.keep(inside.filter(F.col("m") > small).unionByName(more.select(*inside.columns)).join(known.select(F.col("v").alias("id"), F.col("c")), "id", "left").select("token", "h", "m", "id", "n", F.coalesce("c", "id").alias("comp")), "labelled")
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("token")
    # Written between: Spark would push the anti join below the distinct, to every cell's own mention of a pair.
    met = hold.keep(paired(labelled.join(mixed, "token", "left_semi"), False).select("a", "b").distinct(), "remaining")
    second = hold.keep(met.join(first, ["a", "b"], "left_anti"), "second")
    more = verified(second, texts, hold, size, percent, "second", broadcast_rows)
    final = components(links.unionByName(more), hold, "cc2")
    hold.drop(*(name for name in hold.paths if name != "members" and not name.startswith("cc2")))
    out = member.join(final.select(F.col("v").alias("rep"), F.col("c")), "rep", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "rep", F.coalesce("c", "rep").alias("component_id"))
