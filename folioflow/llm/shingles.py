"""Word-shingle sets as sorted 64-bit hashes, computed from the UTF-8 bytes with numpy."""

from __future__ import annotations


class Shingler:
    """``sets(text)``: the distinct hashes of a text's word shingles, ascending.

    Words are runs of bytes other than blank and 0x09-0x0D after lower-casing A-Z.  A word's hash is
    a polynomial over random byte values modulo 2^64, taken from one running sum over the text; a
    shingle's hash mixes its words'.  A text with fewer words than ``size`` is one shingle.
    """

    ROOT = 0x9E3779B97F4A7C15 | 1

    def __init__(self, size: int):
        import numpy as np

        self.size = size
        rng = np.random.default_rng(4099)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.byte[65:91] = self.byte[97:123]
        self.factors = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.blank = np.zeros(256, bool)
        self.blank[[32, 9, 10, 11, 12, 13]] = True
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        import numpy as np

        inverse = pow(self.ROOT, -1, 1 << 64)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(self.ROOT))]), dtype=np.uint64)
        self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(inverse))]), dtype=np.uint64)

    def words(self, text: str | None):
        import numpy as np

        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw) >= len(self.powers):
            self.grow(2 * len(raw))
        ink = ~self.blank[raw]
        edges = np.flatnonzero(np.diff(ink, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.byte[raw] * self.powers[: len(raw)], dtype=np.uint64)])
        return mix((total[ends] - total[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def sets(self, text: str | None):
        import numpy as np

        w = self.words(text)
        if not len(w):
            return w
        k = min(self.size, len(w))
        n = len(w) - k + 1
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h += w[j : j + n] * self.factors[j]
        return np.unique(mix(h + np.uint64(k)))


def mix(h):
    """The finalizer of splitmix64."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
