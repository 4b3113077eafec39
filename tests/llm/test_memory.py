"""What a Python worker holds at once does not grow with an Arrow batch, and does not stand twice."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from folioflow.llm import packing, tokens, toxicity
from folioflow.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"


def test_tokenizer_reads_parts_of_a_million_characters():
    texts = [f"word{k} and été{k % 7}! " * 900 for k in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = list(tokens.pieces_of(batch, "t"))
    longest = max(len(t.encode()) for t in texts)
    assert max(sum(len(t.encode()) for t in p.column("t").to_pylist()) for p in parts) <= 1_000_000 + longest
    assert [t for p in parts for t in p.column("t").to_pylist()] == texts
    coder = tokens.Encoder()
    whole, sizes = coder.flat(batch.column("t"))
    found = [coder.flat(p.column("t")) for p in parts]
    assert np.array_equal(np.concatenate([ids for ids, _ in found]), whole)
    assert np.array_equal(np.concatenate([n for _, n in found]), sizes)


def test_kept_units_are_bounded():
    coder = tokens.Encoder()
    for part in range(5):
        coder.flat(pa.array([" ".join(f"{'abcdefghij'[part]}{a}{b}{c}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz" * 2)] * 2))
        coder.flat(pa.array([" ".join(f"{'klmnopqrst'[part]}{a}{b}{c}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz")]))
    assert len(coder.words) < 140_000


def batches_seen(monkeypatch, spark):
    """Rows of the Arrow batches at each table that is written."""
    seen, keep = {}, Scratch.keep

    def noted(self, df, name):
        seen[self.base.rsplit("/", 1)[1].split("-")[0], name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", noted)
    return seen


def test_packing_and_toxicity_get_small_batches(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = batches_seen(monkeypatch, spark)
    packed = packing.pack(packing.token_pieces(docs))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    corpus_pipeline.drop_toxic(spark, docs, SF)
    assert seen["pack", "items0"] <= 256 and seen["toxicity", "examples"] <= 256 and seen["toxic", "ids"] <= 256
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_model_is_opened_once(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    index = model.open().index
    assert model.open().index is index
    assert model.rows.dtype == np.int32 and model.terms.dtype == np.int32
