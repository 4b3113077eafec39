"""Operator 9: a token-id store with Elias-Fano coded document boundaries.

The store is a folder of Parquet files (so any file system that Spark reads will do).
One row is a *segment*: consecutive documents in ascending key order with

* ``ids``      all their token ids one after the other, 2 or 4 bytes each (``width``),
* ``ends``     the Elias-Fano code of the documents' end offsets inside the segment,
* ``keys``     the Elias-Fano code of the keys' distances from ``first_key``,
* ``part``, ``seq``, ``seq_start``, ``n_docs``, ``n_ids``   the segment's place, the ids before it in its part, and its totals;
  ``last_key`` lets a search pass over segments from both sides.

A code is ``n, low_bits`` and two bit strings: the low bits packed, the high bits in unary.
``select(i)`` finds the i-th one of the high bits through samples of the popcount and adds the
low bits, so an offset costs about ``2 + log2(ids / docs)`` bits and no 64-bit table is kept.

Defined cases: a null text is the empty text (only the end id is written); null keys come
first and are stored apart by ``n_null``; rows with equal keys all stay, next to each other, in the order of their texts' hash;
an empty table gives a store without segments.  A very long text is a segment by itself, below the 2 GB that an Arrow binary holds.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import shuffle_parts, tidy

STORE = (
    "part int, seq int, seq_start long, n_docs int, n_null int, n_ids long, width int, first_key long, last_key long, "
    "ids binary, ends_low int, ends binary, keys_low int, keys binary"
)
#: Ids in one segment, about: bounds the memory of a reader and of a writer.
SEGMENT_IDS = 1_000_000


def ef_encode(values) -> tuple[int, bytes]:
    """Elias-Fano code of non-decreasing, non-negative integers: (low bits per value, bytes)."""
    import numpy as np

    v = np.asarray(values, np.uint64)
    n = len(v)
    if not n:
        return 0, b""
    low = max(0, int(int(v[-1]) // n).bit_length() - 1)
    high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(high[-1]) + 1, np.uint8)
    upper[high] = 1
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    return low, np.packbits(bits, bitorder="little").tobytes() + np.packbits(upper, bitorder="little").tobytes()


class EliasFano:
    """Random access to a code: ``select(i)`` for one position, ``all()`` for every value."""

    SAMPLE = 64  # bytes of the high bits between two sampled counts

    def __init__(self, n: int, low: int, code: bytes):
        import numpy as np

        self.n, self.low = n, low
        cut = (n * low + 7) // 8
        self.lower = np.frombuffer(code[:cut], np.uint8)
        self.upper = np.frombuffer(code[cut:], np.uint8)
        ones = np.bitwise_count(self.upper).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), self.SAMPLE)))]) if len(ones) else np.zeros(1, np.int64)

    def select(self, i: int) -> int:
        import numpy as np

        block = int(np.searchsorted(self.ranks, i, "right")) - 1
        bits = np.unpackbits(self.upper[block * self.SAMPLE : (block + 1) * self.SAMPLE], bitorder="little")
        high = block * self.SAMPLE * 8 + int(np.flatnonzero(bits)[i - int(self.ranks[block])]) - i
        first = i * self.low
        raw = int.from_bytes(self.lower[first // 8 : (first + self.low + 7) // 8].tobytes(), "little")
        return (high << self.low) | ((raw >> (first % 8)) & ((1 << self.low) - 1))

    def all(self):
        import numpy as np

        high = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.lower, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        lows = bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64)) if self.low else 0
        return (high.astype(np.int64) << self.low) + lows


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str = tokens.VOCABULARY, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``text`` and write the store: one range shuffle of the texts, nothing on the driver."""

    def segment(part, seq, before, rows):
        import numpy as np

        keys = [k for k, _ in rows]
        null = sum(k is None for k in keys)
        known = np.array(keys[null:], np.int64)
        sizes = np.array([len(ids) for _, ids in rows], np.int64)
        flat = np.concatenate([ids for _, ids in rows])
        width = 2 if flat.max(initial=0) < 1 << 16 else 4
        first = int(known[0]) if len(known) else 0
        ends_low, ends = ef_encode(np.cumsum(sizes))
        keys_low, coded = ef_encode(known.astype(object) - first if len(known) and int(known[-1]) - first >= 1 << 63 else known - first)
        last = int(known[-1]) if len(known) else 0
        return part, seq, before, len(rows), null, int(sizes.sum()), width, first, last, flat.astype(f"<u{width}").tobytes(), ends_low, ends, keys_low, coded

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        names = [f.split()[0] for f in STORE.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in STORE.split(", ")])

        def out(rows):
            return pa.RecordBatch.from_pylist([dict(zip(names, segment(part, seq, before, rows)))], schema=schema)

        coder = tokens.encoder(vocabulary)
        for batch in batches:
            for piece in tokens.pieces_of(batch, "t", chars=8_000_000):
                ids, sizes = coder.flat(piece.column("t"))
                cuts = np.cumsum(sizes)
                for k, hi, n in zip(piece.column("k").to_pylist(), cuts.tolist(), sizes.tolist()):
                    held.append((k, np.append(ids[hi - n : hi], np.uint32(tokens.END_ID))))
                    size += n + 1
                    if size >= segment_ids:
                        yield out(held)
                        held, size, seq, before = [], 0, seq + 1, before + size
        if held:
            yield out(held)
        tidy(keep_encoder=True)

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), F.monotonically_increasing_id().alias("p"))
    n = shuffle_parts(docs.sparkSession)
    # null and repeated ids are spread over the parts too: rows of one id stand in the order of their texts' hash
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t"), F.xxhash64("p")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("k", "t")
    ordered.mapInArrow(encode, STORE).write.option("compression", "lz4").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: key, start (ids before it), n_tokens, ids (binary, 4 bytes each) and their crc32."""
    store = spark.read.schema(STORE).parquet(path)
    # One total per written part, and each segment knows what its part has before it: nothing is joined.
    base, total = {}, 0
    for r in store.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        base[r["part"]] = total
        total += r["n"]

    def decode(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                ends = EliasFano(r["n_docs"], r["ends_low"], r["ends"])
                known = EliasFano(r["n_docs"] - r["n_null"], r["keys_low"], r["keys"]).all() if r["n_docs"] > r["n_null"] else np.zeros(0, np.int64)
                hi = ends.all()
                lo = np.concatenate([[0], hi[:-1]])
                blobs = [ids[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist())]
                keys = [None] * r["n_null"] + (known + r["first_key"]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(lo + base[r["part"]] + r["seq_start"], pa.int64()), pa.array(hi - lo, pa.int64()), pa.array(map(zlib.crc32, blobs), pa.int64()), pa.array(blobs, pa.binary())],
                    names=["key", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return store.mapInArrow(decode, "key long, start long, n_tokens long, ids_crc32 long, ids binary")


def offset(segment: dict, i: int) -> tuple[int, int]:
    """(first id, end) of the segment's i-th document by two selects, without decoding the others."""
    ends = EliasFano(segment["n_docs"], segment["ends_low"], segment["ends"])
    return (ends.select(i - 1) if i else 0), ends.select(i)


def places_of(segment: dict, key: int) -> range:
    """Which documents of a segment have the key, by binary search over selects."""
    n = segment["n_docs"] - segment["n_null"]
    known = EliasFano(n, segment["keys_low"], segment["keys"])

    def below(value: int) -> int:
        lo, hi = 0, n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if known.select(mid) < value else (lo, mid)
        return lo

    want = key - segment["first_key"]
    return range(0) if want < 0 else range(segment["n_null"] + below(want), segment["n_null"] + below(want + 1))


def fetch(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """key, ids (binary, 4 bytes each) of the documents with some keys: random access through the select structures."""
    wanted = sorted(set(keys))

    def find(batches):
        from bisect import bisect_left, bisect_right

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['width']}")
                mine = wanted[bisect_left(wanted, r["first_key"]) : bisect_right(wanted, r["last_key"])]
                for k in mine if r["n_docs"] > r["n_null"] else ():
                    for i in places_of(r, k):
                        lo, hi = offset(r, i)
                        out.append((k, ids[lo:hi].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["key", "ids"])

    return spark.read.schema(STORE).parquet(path).filter((F.col("first_key") <= max(wanted, default=0)) & (F.col("last_key") >= min(wanted, default=0))).mapInArrow(find, "key long, ids binary")
