"""Exact token ids through the ``tokenizers`` library, with a bounded cache of text chunks.

The pre-tokenizer of ``word_bpe_49k.json`` never matches across white space, NFC never
composes across an ASCII blank and lower-casing looks at one code point at a time.  So
the ids of a text are the ids of its blank-separated chunks in order.  Each distinct chunk
of a part of about a million characters is split once; a chunk of Latin-1 letters and ASCII marks is two units,
its letters in lower case and its marks, which the pre-tokenizer separates as well.  Arrow does the splitting, so that
Python looks up each distinct unit of a part once.
"""

from __future__ import annotations

from array import array

END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Letters of ASCII and Latin-1 (inert under NFC before an ASCII mark), then marks without the apostrophe.
SIMPLE = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)\z"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Batches of texts to ids; one object per worker process and vocabulary (see :func:`encoder`)."""

    def __init__(self, vocabulary: str = VOCABULARY, cache_chunks: int = 120_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.letters = {b: c for b, c in _byte_letters().items()}
        self.words: dict[str, bytes] = {"": b""}
        self.limit = cache_chunks

    def _units(self, units) -> list[bytes]:
        """Ids of distinct units, straight from the library's model."""
        if len(self.words) > self.limit:
            self.words = {"": b""}
        known, letters, tokenize = self.words, self.letters, self.tokenizer.model.tokenize
        out = []
        for unit in units.to_pylist():
            got = known.get(unit)
            if got is None:
                mapped = unit if unit.isascii() else "".join(map(letters.__getitem__, unit.encode()))
                got = known[unit] = array("I", [t.id for t in tokenize(mapped)]).tobytes()
            out.append(got)
        return out

    def _chunks(self, chunks):
        """Ids of distinct chunks one after the other, and the number of ids of each."""
        import numpy as np
        import pyarrow.compute as pc

        split = pc.extract_regex(chunks, SIMPLE)
        easy = np.asarray(split.is_valid())
        split = split.drop_null()
        words = pc.utf8_lower(split.field("word")).dictionary_encode()
        marks = split.field("marks").dictionary_encode()
        hard = self.tokenizer.encode_batch_fast(chunks.filter(~easy).to_pylist(), add_special_tokens=False)
        found = [b"", *self._units(words.dictionary), *self._units(marks.dictionary), *(array("I", x.ids).tobytes() for x in hard)]
        pool, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        unit = np.zeros((len(chunks), 2), np.int64)
        n = 1 + len(words.dictionary)
        unit[easy, 0], unit[easy, 1] = 1 + np.asarray(words.indices), n + np.asarray(marks.indices)
        unit[~easy, 0] = n + len(marks.dictionary) + np.arange(len(hard))
        return gathered(pool, size, unit.ravel()), size[unit].sum(axis=1)

    def flat(self, texts):
        """(ids of all texts one after the other as ``<u4``, number of ids of each); null texts have none."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        parts = pc.split_pattern(texts, " ")
        coded = pc.list_flatten(parts).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        pool, size = self._chunks(coded.dictionary)
        at = np.asarray(coded.indices)
        ids, ends = gathered(pool, size, at), np.cumsum(size[at])
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(parts)))])]
        return ids, np.diff(edges)


def gathered(pool, size, at):
    """The runs ``at`` of ``pool``, whose runs of ``size`` stand one after the other, in the order of ``at``."""
    import numpy as np

    sizes = size[at]
    return pool[np.repeat((np.cumsum(size) - size)[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The worker process's own encoder: Spark reuses its Python workers, so later tasks find the cache warm."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_folioflow_encoders", {})
    if vocabulary not in kept:
        kept[vocabulary] = Encoder(vocabulary)
    return kept[vocabulary]


def pieces_of(batch, text: str, chars: int = 1_000_000):
    """Cut an Arrow batch into parts of about ``chars`` characters (one long text may exceed it)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    group = np.cumsum(size) // chars
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)
