"""Conversation repair, nearest neighbours and importance resampling against plain versions."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from folioflow.llm import dialogue_repair, importance, learned_partitions

BLANK = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """conv_id to rows (turn, role, text) in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        said = lambda v: " " if v is None else str(v)
        hit = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        kept = out.setdefault(conv, [])
        order = (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest())
        new = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(hit, text)
        kept += [(*order, k, turn, "user" if hit == 4 else role, new) for k in range({0: 0, 3: 2}.get(hit, 1))]
    return {c: [r[5:] for r in sorted(v)] for c, v in out.items()}


def plain_edits(rows):
    """All cheapest (cost, audit, lines) by a search from the end, independent of layers and tries."""
    signs, seen = [], set()
    for _, role, text in rows:
        ink = text.rstrip(BLANK)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
        seen.add((role, text))
        signs.append((role, text, fault))
    from functools import cache

    @cache
    def best(k, state, inserted=0):
        """The cheapest from row k on; at most three insertions in a row."""
        found = [(0, "", ())] if k == len(signs) and state in ("", "a") else []
        to = "assistant" if state == "u" else "user"
        if k < len(signs):
            role, text, fault = signs[k]
            c, a, lines = best(k + 1, state)
            found.append((c + 3, "D" + a, lines))
            if fault not in ("blank", "duplicate"):
                more, i = fault == "truncated", role[:1]
                if (state, i) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    c, a, lines = best(k + 1, i)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                c, a, lines = best(k + 1, to[0])
                found.append((c + 2 + more, "R" + a, (f"{to}:{text}", *lines)))
        if inserted < 3:
            c, a, lines = best(k, to[0], inserted + 1)
            found.append((c + 2, "I" + a, (f"{to}:", *lines)))
        return min(found, default=(math.inf, "", ()), key=lambda x: x[:2])

    counts = {f: sum(s[2] == f for s in signs) for f in ("blank", "duplicate", "truncated")}
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(signs)]
    cost, audit, lines = best(0, "")
    return counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows):
    out = {}
    for conv, kept in plain_damage(rows).items():
        turns = [t for t, _, _ in kept if t is not None]
        counts, illegal, cost, audit, digest = plain_edits(kept)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


def conversations(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8, 30])):
            if rng.random() < 0.1:
                continue
            turn = None if rng.random() < 0.05 else turn // rng.choice([1, 1, 2])
            rows.append((conv, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["Hello there.", "yes", "  \n", "", None, "Done!", "é 語?", "Wait"])))
    return rows


@pytest.mark.parametrize("piece", [8, 1, 2])
def test_repair_equals_plain_search(spark, monkeypatch, piece):
    monkeypatch.setattr(dialogue_repair, "PIECE", piece)
    rows = conversations(piece)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, key int")
    got = {r.conv_id: tuple(r)[1:] for r in dialogue_repair.repair(df).collect()}
    want = expected(rows)
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        assert row == want.get(conv, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())), conv


def test_repair_of_one_long_conversation_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(dialogue_repair, "PIECE", 3)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", f"{t}."])) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = dialogue_repair.repair(df).collect()
    import sys

    sys.setrecursionlimit(20_000)
    assert [tuple(r) for r in got] == [(7, *expected(rows)[7])]
    assert dialogue_repair.repair(df.limit(0)).collect() == []


def test_signatures_share_layers(monkeypatch):
    """A prefix is computed once: the walk makes one layer for each new character of the sorted keys."""
    import pyarrow as pa

    calls = []
    plain = dialogue_repair.after
    monkeypatch.setattr(dialogue_repair, "after", lambda s, c: calls.append(c) or plain(s, c))
    keys = sorted(["0" + "".join(p) for p in itertools.product("uax", repeat=3)] + ["0uaua"])
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([1] * len(keys), pa.int64())], ["key", "size"])
    out = [r for b in dialogue_repair.walk([batch]) for r in b.to_pylist()]
    assert len(calls) == 3 + 9 + 27 + 1
    assert {r["key"]: (r["cost"], r["audit"]) for r in out}["0uaua"] == (0, "KKKK")


def brute(ids, x, every=50, k=5):
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (u * u[q]).sum(1)
        out[int(ids[q])] = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
    return out


def test_nearest_is_exact_with_one_partition(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8))
    x[50:70] = x[0]  # ties of equal vectors, more than k
    rows = [(k, v.tolist(), 1.0) for k, v in enumerate(x)]
    odd = [(1000, None, 1.0), (1050, [0.0] * 8, 1.0), (1100, [float("nan")] + [1.0] * 7, 1.0), (1150, [None] + [1.0] * 7, 1.0), (1200, [1.0] * 3, 1.0), (None, [1.0] * 8, 1.0), (3, x[3].tolist(), 1.0)]
    got = {}
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score double")
    for r in learned_partitions.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(np.arange(400), x)
    assert learned_partitions.nearest(df.limit(0)).collect() == []
    few = learned_partitions.nearest(df.filter("vec_id < 3")).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("fan", [64, 3])
def test_nearest_recall_through_partitions(spark, monkeypatch, fan):
    """At least 0.9 of the true neighbours, with one level of partitions and with two; a crowded cluster is cut too."""
    monkeypatch.setattr(learned_partitions, "FAN", fan)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 24))
    x = centres[rng.integers(0, 30, 3000)] + 0.3 * rng.standard_normal((3000, 24))
    x[:900] = centres[0] + 0.05 * rng.standard_normal((900, 24))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in learned_partitions.nearest(df, leaf=400).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(np.arange(3000), x)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_cut_is_balanced():
    rng = np.random.default_rng(2)
    x = learned_partitions.unit(np.concatenate([rng.standard_normal((300, 6)) * 0.01 + 1, rng.standard_normal((700, 6))]))
    graph = learned_partitions.neighbour_graph(x, 10)
    label = learned_partitions.median_splits(x, 7, rng)
    cut = lambda y: (y[graph] != y[:, None]).mean()
    before = cut(label)
    label = learned_partitions.balanced_cut(graph, label.copy(), 7)
    size = np.bincount(label, minlength=7)
    assert size.max() <= math.ceil(1000 / 7 * 1.1) and size.min() >= int(1000 / 7 / 1.1) - 1
    assert cut(label) <= before


def plain_words(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text):
    w = plain_words(text)
    return [f.encode() for f in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]]


TEXTS = ["The quick-brown FOX; 9 foxes!", "", None, "É été Ünder ÀB " * 30, "one", "the the the the " * 40, "a_b\tc\n" * 500, "语言 模型 abc " * 25]


@pytest.mark.parametrize("block", [1 << 22, 64, 7])
def test_hasher_equals_plain_features(block):
    """Blocks of any size, also such that cut texts."""
    h = importance.Hasher(1000, 2, block)
    made = list(h.buckets([(t or "").encode() for t in TEXTS]))
    assert [n for n, _ in made] == [len(plain_words(t)) for t in TEXTS]
    assert [sorted(b.tolist()) for _, b in made] == [sorted(zlib.crc32(f) % 1000 for f in plain_features(t)) for t in TEXTS]


def test_hasher_makes_longer_tuples():
    words = "a b a b a c".split()
    want = sorted(zlib.crc32(" ".join(words[k : k + n]).encode()) % 997 for n in (1, 2, 3) for k in range(len(words) - n + 1))
    assert sorted(next(iter(importance.Hasher(997, 3).buckets([b"a b a b a c"])))[1].tolist()) == want


def test_resampled_equals_plain_version(spark):
    rng = random.Random(4)
    vocab = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta9", "eta"]
    rows = [(k, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for k in range(120)] + [(200 + k, t) for k, t in enumerate(TEXTS)] + [(None, "alpha beta " * 15), (None, "alpha beta " * 15), (5, "zeta9 " * 25)]
    target = [(1, "alpha beta gamma " * 5), (2, None), (None, "eta")]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, weight int, buckets string")
    got = importance.resampled(docs, spark.createDataFrame(target, "item_id long, text string")).collect()
    bucket = lambda f: zlib.crc32(f) % 10_000
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, text in rows:
        for f in plain_features(text):
            s[bucket(f)] += 1
    for _, text in target:
        for f in plain_features(text):
            t[bucket(f)] += 1
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000))))
    made = []
    for k, text in rows:
        f = plain_features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        made.append((k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_words(text)) >= 20))
    able = sorted((m for m in made if m[4]), key=lambda m: (-m[3], m[0] is not None, m[0] or 0))
    full = lambda v: tuple((x is not None, x or 0) for x in v)
    assert sorted((tuple(r)[:4] for r in got), key=full) == sorted((m[:4] for m in made), key=full)
    assert sorted((r["rank"], r.doc_id) for r in got if r["rank"]) == sorted((r, m[0]) for r, m in enumerate(able[: 25 * len(able) // 100], 1))
    assert importance.resampled(docs.limit(0), spark.createDataFrame(target, "item_id long, text string")).collect() == []
