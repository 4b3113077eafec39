"""Operator 8: language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1 (seeded by its code point).  A letter n-gram is
the product (binding) of its letters' vectors, the j-th one rotated by j places (permutation); a
text is the sum (bundle) of its n-grams' vectors.  The prototype of a language is the bundle of a
bounded number of its training texts, each scaled to unit length; a text's language is the prototype
with the largest cosine.  What all languages share is taken off first: the mean prototype is
subtracted from prototypes and texts, so the cosines spread over the differences.

Training reads at most ``train_per_language`` texts of each language (those with the smallest hash
of the id); every text is scored as a whole, a very long one in one bundle of counts (some 40 bytes a character while it is read).

Defined cases: a null text or one without a letter gets ``und`` with score 0; null languages are never
learned; ties go to the language that sorts first; without any labelled text all get ``und``; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1024
NGRAM = 3


class Profiles:
    """Bundles of texts; n-gram vectors are made once for each worker process and kept in a bounded table."""

    def __init__(self, dim: int = DIM, n: int = NGRAM, seed: int = 20_011, limit: int = 60_000):
        self.dim, self.n, self.seed, self.limit = dim, n, seed, limit
        self.rows: dict[int, int] = {}
        self.letters: dict[int, object] = {}
        import numpy as np

        self.bank = np.zeros((4096, dim), np.int8)

    def letter(self, code: int):
        if code not in self.letters:
            import numpy as np

            self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, np.int8) * 2 - 1
        return self.letters[code]

    def _row(self, gram: int) -> int:
        import numpy as np

        if len(self.rows) >= self.limit:
            self.rows.clear()
        k = self.rows[gram] = len(self.rows)
        if k >= len(self.bank):
            self.bank = np.concatenate([self.bank, np.zeros_like(self.bank)])
        bound = np.ones(self.dim, np.int8)
        for j in range(self.n):
            bound = bound * np.roll(self.letter((gram >> (21 * j)) & 0x1FFFFF), j)
        self.bank[k] = bound
        return k

    def bundle(self, text: str | None):
        """The sum of the n-grams' vectors, or None without a letter.  Runs of non-letters count as one blank."""
        import numpy as np

        kept = "".join(c if c.isalpha() else " " for c in text.lower()) if text and not text.isascii() else text.lower() if text else ""
        codes = np.frombuffer(kept.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        if text and text.isascii():
            codes = np.where((codes >= 97) & (codes <= 122), codes, 32)
        if not (codes != 32).any():
            return None
        codes = np.concatenate([[32], codes, [32]])
        codes = codes[~((codes == 32) & (np.concatenate([[0], codes[:-1]]) == 32))]
        grams = codes[: len(codes) - self.n + 1].copy()
        for j in range(1, self.n):
            grams |= codes[j : len(codes) - self.n + 1 + j] << (21 * j)
        found, counts = np.unique(grams, return_counts=True)
        total = np.zeros(self.dim, np.float32)
        for lo in range(0, len(found), 4096):
            some, get = found[lo : lo + 4096].tolist(), self.rows.get
            if len(self.rows) + len(some) > self.limit:
                self.rows.clear()
            at = [k if (k := get(g)) is not None else self._row(g) for g in some]
            total += counts[lo : lo + 4096].astype(np.float32) @ self.bank[at].astype(np.float32)
        return total


def profiles(dim: int, n: int) -> Profiles:
    """The worker process's own table, warm for later tasks."""
    import numpy

    kept = numpy.__dict__.setdefault("_folioflow_profiles", {})
    if (dim, n) not in kept:
        kept[dim, n] = Profiles(dim, n)
    return kept[dim, n]


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", dim: int = DIM, n: int = NGRAM, train_per_language: int = 2000) -> dict[str, object]:
    """Language -> prototype.  ``docs`` holds the rows that may be learned from."""
    own = docs.filter(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"))
    # The ids are picked from the narrow columns; only picked texts are bundled.
    share = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    keep = F.create_map(*(F.lit(x) for g, c in share.items() for x in (g, min(1.0, train_per_language / c))))
    dice = F.pmod(F.xxhash64(F.lit("language"), F.col(key)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = docs.filter(F.col(lang).isNotNull() & (dice < F.element_at(keep, F.col(lang).cast("string")))).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def bundles(batches):
        import numpy as np
        import pyarrow as pa

        made, sums = profiles(dim, n), {}
        for batch in batches:
            for g, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                v = made.bundle(t)
                if v is not None and (size := float(np.linalg.norm(v))):
                    sums[g] = sums.get(g, 0) + v / size
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.astype(np.float64).tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    import numpy as np

    parts = picked.mapInArrow(bundles, "lang string, v array<double>").select("lang", F.posexplode("v").alias("j", "x")).groupBy("lang", "j").agg(F.sum("x").alias("x"))
    out: dict[str, object] = {}
    for r in parts.collect():  # languages times dimensions
        out.setdefault(r["lang"], np.zeros(dim))[r["j"]] = r["x"]
    return out


def predict(docs: DataFrame, prototypes: dict[str, object], key: str = "doc_id", text: str = "text", dim: int = DIM, n: int = NGRAM) -> DataFrame:
    """doc_id, lang_pred and score: the winner's share of exp(16 * cosine), 0 to 1."""
    import numpy as np

    names = sorted(prototypes)
    if names:
        base = np.stack([prototypes[g] / max(1e-12, np.linalg.norm(prototypes[g])) for g in names])
        mean = base.mean(axis=0) if len(names) > 1 else np.zeros(dim)
        centred = base - mean
        centred /= np.maximum(1e-12, np.linalg.norm(centred, axis=1, keepdims=True))

    def score(batches):
        import numpy as np
        import pyarrow as pa

        made = profiles(dim, n)
        for batch in batches:
            got, value = [], []
            for t in batch.column("text").to_pylist():
                v = made.bundle(t) if names and t else None
                if v is None:
                    got.append("und")
                    value.append(0.0)
                    continue
                v = v / max(1e-12, np.linalg.norm(v)) - mean
                cos = centred @ (v / max(1e-12, np.linalg.norm(v)))
                share = np.exp(16 * (cos - cos.max()))
                k = int(np.argmax(cos))
                got.append(names[k])
                value.append(float(share[k] / share.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.string()), pa.array(value, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(score, "doc_id long, lang_pred string, score double")
