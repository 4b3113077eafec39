"""Operator 6: best-fit packing by a grouping genetic algorithm on islands.

``token_pieces`` turns documents into pieces of at most ``capacity`` token ids; ``pack`` places
sized items into as few bins as it can.  Items are dealt at random into blocks of about
``block_items``; every block is evolved on ``islands`` islands.  A chromosome is a set of bins.
Crossover injects whole well-filled bins of one parent into the other, removes the bins that hold
the same items, and best-fits the displaced items in decreasing order.  After an epoch each island
gets the elite of its block's other islands.  Bins that stay below ``keep_fill`` are opened again
and their items dealt into fewer, mixed blocks, so that blocks don't each leave a half-empty bin.
That goes on until one block is left, no block is saved, or ``rounds`` are over; the last round keeps
all its bins, however full, so every item is placed.

Bounded memory: a task holds one block's sizes and a few chromosomes, whatever the corpus.  The tokenizer reads Arrow
batches of ``BATCH`` texts in parts of about a million characters; one longer text is a part by itself (below the 2 GB of an Arrow string).

Defined cases: a null or empty text is one piece holding only the end id; repeated rows are separate
items; items larger than the capacity are an error of the caller (``token_pieces`` makes none); an
empty table packs to an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, arrow_rows, tidy

BATCH = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = 4096, vocabulary: str = tokens.VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' ids, each with the end id, cut into pieces of ``capacity`` ids; only longer documents are cut."""

    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        coder = tokens.encoder(vocabulary)
        for batch in batches:
            for part in tokens.pieces_of(batch, "t"):
                ids, sizes = coder.flat(part.column("t"))
                out: list[list] = [[], [], [], [], []]
                hi = 0
                for k, n in zip(part.column("k").to_pylist(), sizes.tolist()):
                    own = np.append(ids[hi : hi + n], np.uint32(tokens.END_ID))
                    hi += n
                    for p, lo in enumerate(range(0, n + 1, capacity)):
                        some = own[lo : lo + capacity]
                        for column, value in zip(out, (k, p, lo, len(some), zlib.crc32(some.tobytes()))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        tidy(keep_encoder=True)

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(cut, PIECES)


def best_fit(bins: list[list[int]], room: list[int], items, sizes, capacity: int) -> None:
    """Put ``items`` (largest first) into the fullest bin with room for them; opens bins as needed."""
    free = sorted((r, b) for b, r in enumerate(room))
    for i in items:
        k = bisect_left(free, (sizes[i], -1))
        if k == len(free):
            b, left = len(bins), capacity
            bins.append([])
            room.append(capacity)
        else:
            left, b = free.pop(k)
        bins[b].append(i)
        room[b] = left - sizes[i]
        insort(free, (room[b], b))


def fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square of the fill (a few full bins beat many half-full ones)."""
    return -len(room), sum((1 - r / capacity) ** 2 for r in room) / max(1, len(room))


def crossover(a, b, sizes, capacity: int, rng):
    """Inject well-filled bins of ``b`` into ``a``; displaced items are best-fitted again."""
    order = sorted(range(len(b[0])), key=lambda k: (b[1][k], rng.random()))
    taken = [b[0][k] for k in order[: max(1, len(order) // 2)] if rng.random() < 0.6] or [b[0][order[0]]]
    moved = {i for group in taken for i in group}
    bins, loose = [list(g) for g in taken], []
    for group in a[0]:
        if moved.isdisjoint(group):
            bins.append(list(group))
        else:
            loose += [i for i in group if i not in moved]
    room = [capacity - sum(sizes[i] for i in g) for g in bins]
    worst = sorted(range(len(bins)), key=lambda k: -room[k])[: max(1, len(bins) // 20)]  # mutation: the emptiest bins are opened
    for k in sorted(worst, reverse=True):
        loose += bins.pop(k)
        room.pop(k)
    best_fit(bins, room, sorted(loose, key=lambda i: -sizes[i]), sizes, capacity)
    return bins, room


def evolve(sizes: list[int], migrants, seed: int, capacity: int, population: int, generations: int) -> list[int]:
    """One island's epoch; returns the elite as the bin number of each item."""
    import random

    rng, least = random.Random(seed), -(-sum(sizes) // capacity)

    def grown(order):
        bins, room = [], []
        best_fit(bins, room, order, sizes, capacity)
        return bins, room

    def decoded(labels):
        groups: dict[int, list[int]] = {}
        for i, b in enumerate(labels):
            groups.setdefault(b, []).append(i)
        bins = list(groups.values())
        return bins, [capacity - sum(sizes[i] for i in g) for g in bins]

    down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    pool = [decoded(m) for m in migrants] or [grown(down)]
    best = max(pool, key=lambda c: fitness(c[1], capacity))
    if len(best[0]) > least:
        while len(pool) < population:
            jitter = {i: sizes[i] * rng.uniform(0.8, 1.2) for i in down}
            pool.append(grown(sorted(down, key=lambda i: -jitter[i])))
        for _ in range(generations):
            pool.sort(key=lambda c: fitness(c[1], capacity), reverse=True)
            if len(pool[0][0]) <= least:
                break
            half = max(2, population // 2)
            pool = pool[:half] + [crossover(*rng.sample(pool[:half], 2), sizes, capacity, rng) for _ in range(population - half)]
        best = max(pool, key=lambda c: fitness(c[1], capacity))
    label = [0] * len(sizes)
    for b, group in enumerate(best[0]):
        for i in group:
            label[i] = b
    return label


def pack(items: DataFrame, size: str = "length", capacity: int = 4096, block_items: int = 2000, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 4, keep_fill: float = 0.999, seed: int = 7, rounds: int = 12) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence)."""
    spark = items.sparkSession
    hold = Scratch(spark, "pack")
    names = items.columns
    item = F.struct(F.col(size).cast("int").alias("_size"), F.struct(*names).alias("_row"))
    with arrow_rows(spark, BATCH):  # the tokenizer runs in here
        todo = hold.keep(items.select(item.alias("i")), "items0")
    done: list[DataFrame] = []

    def epoch(number: int):
        def run(frames):
            import pandas as pd

            for pdf in frames:
                yield pd.DataFrame({"block": pdf.block, "island": pdf.island, "elite": [evolve(list(s), [list(m) for m in ms], seed * 1_000_003 + 7919 * number + 31 * int(b) + int(k), capacity, population, generations) for b, k, s, ms in zip(pdf.block, pdf.island, pdf.sizes, pdf.migrants)]})
            tidy()

        return run

    def placed(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for block, sizes, elite in zip(pdf.block, pdf.sizes, pdf.elite):
                fill: dict[int, int] = {}
                for k, (s, b) in enumerate(zip(sizes, elite)):
                    out.append((block, k, int(b), fill.get(b, 0)))
                    fill[b] = fill.get(b, 0) + int(s)
                n = len(sizes)
                out[-n:] = [(*x, fill[x[2]]) for x in out[-n:]]
            yield pd.DataFrame(out, columns=["block", "k", "bin", "offset", "fill"])
        tidy()

    full = todo.filter(F.col("i._size") >= capacity)
    # Ids from 1 << 62 up; those of bins stay below.
    done.append(full.select("i", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    todo, base, last = todo.filter(F.col("i._size") < capacity), 1, None
    wide = max(13, (4 * block_items).bit_length())
    for turn in range(rounds):
        left = todo.count()
        n_blocks = max(1, -(-left // block_items))
        if not left:
            break
        dealt = todo.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(n_blocks)))
        # About block_items rows in every block, by construction.
        blocks = hold.keep(dealt.groupBy("block").agg(F.collect_list("i").alias("items")).withColumn("sizes", F.col("items._size")), f"blocks{turn}")
        state = blocks.select("block", "sizes", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), F.array().cast("array<array<int>>").alias("migrants"))
        for e in range(epochs):
            elites = hold.keep(state.repartition(F.col("block"), F.col("island")).mapInPandas(epoch(turn * epochs + e), "block long, island int, elite array<int>"), f"elite{turn}_{e}")
            met = elites.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("island", "elite"))).alias("all"))
            state = met.join(blocks.select("block", "sizes"), "block").select("block", "sizes", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), F.col("all.elite").alias("migrants"))
        fewest = elites.groupBy("block").agg(F.min_by("elite", F.struct(F.array_max("elite"), "island")).alias("elite"))
        spots = fewest.join(blocks.select("block", "sizes"), "block").mapInPandas(placed, "block long, k int, bin int, offset long, fill long")
        out = hold.keep(
            blocks.select("block", F.posexplode("items").alias("k", "i")).join(spots, ["block", "k"]),
            f"placed{turn}",
        )
        number = (F.lit(base << (27 + wide)) + F.col("block") * F.lit(1 << wide) + F.col("bin")).alias("sequence_id")
        final = n_blocks == 1 or last == n_blocks or turn == rounds - 1
        settled = out if final else out.filter(F.col("fill") >= keep_fill * capacity)
        done.append(settled.select("i", number, "offset"))
        if final:
            break
        todo, base, last = out.filter(F.col("fill") < keep_fill * capacity).select("i"), base + 1, n_blocks
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select(*(F.col("i._row")[c].alias(c) for c in names), "sequence_id", "offset")
