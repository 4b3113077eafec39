"""The token store's plans and the block-max search's work."""

import numpy as np

from folioflow.llm import token_store
from folioflow.llm.toxicity import BlockMaxIndex


def test_store_is_read_without_a_join(spark, tmp_path):
    path = str(tmp_path / "store")
    texts = [(k, f"document {k} " * (k % 7)) for k in range(300)]
    token_store.write(spark.createDataFrame(texts, "doc_id long, text string"), path, segment_ids=200)
    out = token_store.read(spark, path)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    rows = out.orderBy("key").collect()
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    store = spark.read.parquet(path)
    assert store.filter("last_key < first_key").count() == 0 and store.agg({"seq_start": "max"}).first()[0] > 0
    by = {r.key: r.ids for r in rows}
    assert {r.key: r.ids for r in token_store.fetch(spark, path, [5, 299, 150, 1000, -1]).collect()} == {k: by[k] for k in (5, 150, 299)}
    assert token_store.fetch(spark, path, []).collect() == []


def test_repeated_ids_are_spread_and_kept(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(7, f"text number {k}") for k in range(400)] + [(None, f"null {k}") for k in range(400)] + [(8, "same")] * 50 + [(1, "one")]
    token_store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, segment_ids=100)
    parts = {r.part: r.n for r in spark.read.parquet(path).groupBy("part").agg({"n_docs": "sum"}).withColumnRenamed("sum(n_docs)", "n").collect()}
    assert len(parts) > 1 and max(parts.values()) < 600
    got = token_store.read(spark, path).orderBy("start").collect()
    assert [r.key for r in got] == [None] * 400 + [1] + [7] * 400 + [8] * 50
    assert len({r.ids for r in got if r.key == 7}) == 400 and token_store.fetch(spark, path, [7]).count() == 400


def test_search_reads_only_blocks_that_may_hold_a_better_one():
    """Examples of one block share their terms: a query for some of them must not add up the postings of all blocks."""
    rng = np.random.default_rng(0)
    n, block, per = 6400, 64, 20
    rows = np.repeat(np.arange(n), per)
    terms = (rows // block) * 30 + rng.integers(0, 30, n * per)
    terms[rng.random(n * per) < 0.3] = 0  # and some words stand in all blocks
    pairs = np.unique(np.stack([rows, terms]), axis=1)
    weights = rng.random(pairs.shape[1]) + 0.1
    weights[pairs[1] == 0] *= 0.01
    weights /= np.sqrt(np.bincount(pairs[0], weights**2, n))[pairs[0]]
    index = BlockMaxIndex(n, 30 * n // block + 1, pairs[0], pairs[1], weights, block)
    dense = np.zeros((n, 30 * n // block + 1))
    dense[pairs[0], pairs[1]] = weights
    total = 0
    for k in rng.integers(0, n, 20):
        mine = pairs[0] == k
        terms, w = pairs[1][mine], weights[mine]
        cosines, found = index.top(terms, w, 10)
        exact = dense[:, terms] @ w
        want = np.lexsort((np.arange(n), -exact))[:10]
        assert found.tolist() == want.tolist() and np.allclose(cosines, exact[want])
        total += np.isin(pairs[1], terms).sum()
    assert index.read < total / 3
