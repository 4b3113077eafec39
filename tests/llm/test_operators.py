"""The training-data operators against brute force on small tables, with nulls, ties and odd columns."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.llm import decontam, hd_language, jaccard_join, kd_shards, multiset_hash, packing, pii, registry, suffix_dedup, token_store, toxicity
from folioflow.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, token string"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and clashing column names."""
    texts = [None, "", "a", LONG, LONG, "same text of some words here", "same text of some words here", "  \n\t ", "é😀 ß " * 40]
    rows = [(k, x, "en" if k % 2 else None, None, None, "x", "y", "z") for k, x in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_pii_keeps_shape_and_distinctness(spark, odd, none):
    docs = spark.createDataFrame([(1, "mail a.b@c.example.com or +1 (017) 555-7713, 10.0.0.1; Mr. James met Mary 4111111111111111"), (2, "A.B@c.example.com and 10.0.0.2"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(docs, b"k").collect()}
    assert "a.b@c" not in got[1].text and "555-7713" not in got[1].text and "10.0.0.1" not in got[1].text
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text) and got[1].n_entities == 6 and got[3].text is None
    assert "Mary" not in got[1].text and "James" not in got[1].text
    mails = [re.search(r"\S+@\S+", got[k].text)[0].lower() for k in (1, 2)]
    assert mails[0] == mails[1]
    keyed = pii.Keyed(b"k")
    assert len({pii.surrogate(keyed, "card", f"{k:016d}") for k in range(2000)}) == 2000
    names = pii.NAMES["female", "latin"]
    assert {pii.surrogate(keyed, "name", n) for n in names} == set(names)
    assert pii.pseudonymised(odd, b"k").count() == 10 and pii.pseudonymised(none, b"k").count() == 0


def test_pii_names_and_national_numbers(spark):
    texts = ["then Mary Smith came", "Mr. John Smith, 555-123-4567", "пришла Мария Иванова домой", "James F. O'Brien Jones-Lee", "Dr. Smith 555.123.4567", "Mary Smith", "version 1.555-123-4567-8"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(docs, b"k").collect()}
    assert [got[k].n_entities for k in range(7)] == [2, 3, 2, 3, 2, 2, 0]
    for k, words in enumerate([["Mary", "Smith"], ["John", "Smith", "555-123-4567"], ["Мария", "Иванова"], ["James", "Brien", "Jones", "Lee"], ["Smith", "555.123.4567"], ["Mary", "Smith"]]):
        assert not any(w in got[k].text for w in words)
    smith = got[0].text.split()[2]
    assert got[1].text.startswith("Mr. ") and smith == got[1].text.split()[2].rstrip(",") == got[4].text.split()[1] == got[5].text.split()[1]
    assert re.fullmatch(r"пришла [А-Я][а-я]+ [А-Я][а-я]{6} домой", got[2].text) and got[6].text == texts[6]
    assert got[1].text[-12:].replace("-", "") == got[4].text[-12:].replace(".", "")


def test_pii_surrogates_differ_and_are_one_for_an_entity(spark):
    keyed = pii.Keyed(registry.PII_KEY)
    for names in pii.NAMES.values():
        made = [pii.surrogate(keyed, "name", n) for n in names]
        assert sorted(made) == sorted(names) and not any(a == b for a, b in zip(names, made))
    for bound in (2, 3, 10, 97, 1000):
        images = [keyed.permute(b"x", x, bound) for x in range(bound)]
        assert sorted(images) == list(range(bound)) and not any(x == y for x, y in enumerate(images))
    digits = lambda x: re.sub(r"\D", "", x)
    forms = [["+44 20 7946 0958", "+442079460958", "+44 (20) 7946-0958"], ["+493012345678", "+49 30 1234 5678"], ["555-123-4567", "555.123.4567", "(555) 123-4567"], ["4111 1111 1111 1111", "4111111111111111"]]
    for group in forms:
        kind = "card" if group[0][0] == "4" and group[0][1] == "1" else "phone"
        made = [pii.surrogate(keyed, kind, x) for x in group]
        assert len({digits(x) for x in made}) == 1 and digits(made[0]) != digits(group[0])
        assert [re.sub(r"\d", "0", x) for x in made] == [re.sub(r"\d", "0", x) for x in group]
    assert pii.surrogate(keyed, "phone", "+493012345678").startswith("+49") and pii.surrogate(keyed, "phone", "+442079460958").startswith("+44")
    for number in ("4111111111111111", "5500005555555559", "4111111111111112"):
        new = pii.surrogate(keyed, "card", number)
        assert (pii.check_digit(new[:-1]) == int(new[-1])) == (pii.check_digit(number[:-1]) == int(number[-1]))
    assert pii.check_digit("411111111111111") == 1 and pii.check_digit("7992739871") == 3


def test_pii_coreference_across_a_corpus(spark):
    """Every mention of an entity gets its one surrogate, other entities other ones, and none stays."""
    import random

    rng = random.Random(4)
    people = [f"{a} {b}" for a in ("Mary", "James", "Linda", "Анна") for b in ("Smith", "Garcia")]
    people[6:] = ["Анна Иванова", "Анна Петрова"]
    mails = [f"user{k}@mail{k % 3}.example.org" for k in range(40)]
    phones = [f"+1 (201) 555-{k:04d}" for k in range(40)]
    rows = [(k, f"{rng.choice(people)} wrote to {rng.choice(mails)} and {rng.choice(people).split()[0]} called {rng.choice(phones)}.") for k in range(300)]
    got = pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), b"corpus").collect()
    by = {r.doc_id: r for r in got}
    shape = re.compile(r"(\S+) (\S+) wrote to (\S+) and (\S+) called (.+)\.")
    pairs = defaultdict(set)
    for k, t in rows:
        old, new = shape.fullmatch(t).groups(), shape.fullmatch(by[k].text).groups()
        for kind, x, y in zip(("name", "last", "mail", "name", "phone"), old, new):
            pairs[kind, x].add(y)
            assert x != y
        assert by[k].n_entities == 5
    assert all(len(v) == 1 for v in pairs.values())
    for kind in ("name", "last", "mail", "phone"):
        made = [next(iter(v)) for (k, _), v in pairs.items() if k == kind]
        assert len(set(made)) == len(made)
    originals = {x for kind, x in pairs if kind != "name"}
    assert not any(x in r.text for r in got for x in originals)


@pytest.mark.parametrize("walk_rows", [0, 10_000])
def test_pii_draws_again_what_is_taken(spark, walk_rows):
    """First surrogates that are originals are drawn again, by look-up or join; all stay distinct and none is an original."""
    have = [f"+1 (201) 555-{k:04d}" for k in range(3000)]
    keyed = pii.Keyed(b"w")
    have += [pii.surrogate(keyed, "phone", x) for x in have[:50]]
    df = spark.createDataFrame([(k if k % 10 else None, x) for k, x in enumerate(have)], "doc_id long, text string")
    made = [r.text for r in pii.pseudonymised(df, b"w", walk_rows=walk_rows).collect()]
    assert len(set(made)) == len(have) and not set(made) & set(have)


def test_pii_of_names_whose_length_is_used_up(spark):
    """All surnames of two letters are in the corpus: their surrogates get longer, and stay distinct."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    have = [f"Mr. {a.upper()}{b}" for a in letters for b in letters]
    made = [r.text for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(have)), "doc_id long, text string"), b"w").collect()]
    assert len(set(made)) == len(have) and not set(made) & set(have) and all(re.fullmatch("Mr. [A-Z][a-z]{1,9}", x) for x in made)


def test_pii_defined_cases(spark, odd, none):
    clash = spark.createDataFrame([(1, "Mary", 7, "q", "r"), (None, None, 8, "q", "r")], "doc_id long, text string, n_entities long, n_distinct string, kind string")
    got = pii.pseudonymised(clash, b"k")
    assert got.columns == ["doc_id", "text", "kind", "n_entities", "n_distinct"]
    assert {(r.doc_id, r.n_entities) for r in got.collect()} == {(1, 1), (None, 0)}
    assert pii.pseudonymised(odd, b"k").count() == 10 and pii.pseudonymised(none, b"k").count() == 0


def all_windows(texts):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, in order, by every 100-byte window seen before."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def removed(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_suffix_dedup_equals_all_windows(spark, odd, none):
    docs = texts_of(spark)
    want = dict(zip(sorted(docs), all_windows(docs[i] for i in sorted(docs))))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.op2_suffix_dedup(spark, SF).collect()} == want
    by = {r.doc_id: r for r in suffix_dedup.deduplicated(odd.dropDuplicates(["doc_id"])).collect()}
    assert by[4].n_removed == by[4].n_bytes and by[0].n_bytes == 0 and suffix_dedup.deduplicated(none).count() == 0


@pytest.mark.parametrize(("batch", "often"), [(3, 32), (1000, 32), (3, 1), (7, 4), (1000, 1)])
def test_suffix_dedup_of_frequent_passages(spark, batch, often):
    """One line in many texts with other surroundings, copies, repeats inside a text; batches of three texts and of all, few and many frequent ranks."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passage = prose(25), prose(60)
    texts = [prose(rng.randrange(40)) + line + prose(rng.randrange(40)) for _ in range(60)]
    texts += [texts[3]] * 20 + [passage[k:] + line + passage for k in range(8)] + ["ab" * 300, line * 4]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch"]
    before = spark.conf.get(names[0])
    spark.conf.set(names[0], str(batch))
    try:
        assert removed(suffix_dedup.deduplicated(df, often=often)) == sorted((i, *w) for i, w in enumerate(all_windows(texts)))
    finally:
        spark.conf.set(names[0], before)


def test_suffix_dedup_of_repeated_and_null_ids(spark):
    a, b, c = (f"{x} " + " ".join(f"{x}{k * k}" for k in range(60)) for x in "abc")
    rows = [(7, a), (7, b), (7, a), (None, c), (3, b + c), (None, None)]
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in got) == sorted((k or 0, len(t or "")) for k, t in rows)
    by = {(r.doc_id, r.n_bytes, r.n_removed) for r in got}
    # The null id comes first and keeps its text; 3 keeps b; 7 has b again, and of its two equal texts one stays.
    assert (None, len(c), 0) in by and (7, len(b), len(b)) in by and {(7, len(a), 0), (7, len(a), len(a))} <= by
    assert [r.n_removed for r in got if r.doc_id == 3] == [len(c)]


def test_multiset_hash(spark, odd, none):
    docs = sorted(texts_of(spark).items(), reverse=True)
    got = {r.doc_id: r for r in registry.op3_multiset_hash(spark, SF).collect()}
    for j, (i, t) in enumerate(docs):
        other, h = docs[(j + 1) % len(docs)][1], len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + other[:h]).encode()).hexdigest()
    assert len({r.fingerprint for r in got.values()}) == len({t for _, t in docs})
    pair = spark.createDataFrame([(1, "a b c\nd e f"), (2, "d e f\na b c"), (3, "a b c"), (4, "d e f")], "k long, text string")
    lanes = {r.k: r.text for r in multiset_hash.lanes_of(pair, "k", ["text"]).collect()}
    assert lanes[1] == lanes[2] != lanes[3]
    both = spark.createDataFrame([(lanes[1], lanes[3], lanes[4])], "x array<long>, a array<long>, b array<long>")
    r = both.select(multiset_hash.combined(F.col("a"), F.col("b")).alias("s"), multiset_hash.removed(F.col("x"), F.col("b")).alias("d")).first()
    assert r.s == lanes[1] and r.d == lanes[3]
    assert multiset_hash.edited_fingerprints(odd).count() == 10 and multiset_hash.edited_fingerprints(none).count() == 0


def test_multiset_hash_likeness(spark):
    """Likeness 1 for equal texts, near the shingles' own cosine for others, and the whole query's columns on a fixture."""
    import math
    import random
    from collections import Counter

    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    texts = ["\n".join(" ".join(word() for _ in range(rng.randrange(3, 12))) for _ in range(20)) for _ in range(12)]
    texts += [texts[0], texts[1] + "\nand one more line", ""]
    got = {r.doc_id: r for r in multiset_hash.edited_fingerprints(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}

    def grams(t):
        out = Counter()
        for line in t.split("\n"):
            w = line.split(" ")
            out.update(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2)))
        return out

    def cosine(x, y):
        return sum(n * y[g] for g, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))

    order = sorted(got, reverse=True)
    for j, i in enumerate(order):
        after = texts[order[(j + 1) % len(order)]]
        h = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - h] + after[:h]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(got[i].near_edited - cosine(grams(texts[i]), grams(edited))) < 0.45 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[12].fingerprint != got[1].fingerprint
    empty = multiset_hash.edited_fingerprints(spark.createDataFrame([(1, "a b"), (None, "a b"), (-(1 << 63), None), (1, "c")], "doc_id long, text string")).collect()
    assert len(empty) == 4 and {r.fingerprint for r in empty if r.n_chars == 3} and sum(r.n_chars for r in empty) == 7


def components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_copies_are_not_spelled_out_pair_by_pair(spark, monkeypatch):
    made, pairs = [], jaccard_join.cell_pairs

    def counted(*args):
        out = pairs(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "cell_pairs", counted)
    rows = [(k, " ".join(f"w{j}" for j in range(60)) + f" end{k}") for k in range(40)]  # one small cell of 40 members: 780 pairs
    rows += [(100 + k, " ".join(f"s{j}" for j in range(6)) + " " + " ".join(f"x{k}y{j}" for j in range(30))) for k in range(40)]  # what they share makes no link
    got = {r.doc_id: r.component_id for r in jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(40)} == {0} and all(got[100 + k] == 100 + k for k in range(40))
    assert sum(made) <= 80


def test_cells_that_gave_out_all_their_pairs_are_not_joined_again(spark, monkeypatch):
    joined, pairs = [], jaccard_join.cell_pairs

    def counted(cells, *args):
        joined.append(cells.count())
        return pairs(cells, *args)

    monkeypatch.setattr(jaccard_join, "cell_pairs", counted)
    rows = [(3 * g + k, " ".join(f"s{g}w{j}" for j in range(20)) + " " + " ".join(f"x{g}y{k}z{j}" for j in range(40))) for g in range(20) for k in range(3)]  # a passage in common, but no link
    got = {r.doc_id: r.component_id for r in jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == k for k in range(60))
    assert joined[0] >= 20 and joined[-1] == 0


def test_small_cells_at_once_equal_cells_one_by_one(monkeypatch):
    import random

    import pyarrow as pa

    class Cells:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def filter(self, condition):
            return self

    rng, cells, expected = random.Random(3), [], set()
    for c in range(40):
        h, base = rng.randrange(-200, -120, 2), rng.sample(range(-160, 200, 2), 12)
        left = []
        for k in range(rng.randrange(2, 12)):
            first = sorted({h} | {x for x in base if rng.random() < 0.9} | {rng.randrange(-200, 200)})
            left.append({"id": 100 * c + k, "n": 60 + rng.randrange(6), "comp": 100 * c + k, "hot": 0, "bits": b"\xff" * 128, "first": first})
        cells.append({"token": c, "h": h, "left": left, "right": None})
        for a in left:
            for b in left:
                both = set(a["first"]) & set(b["first"])
                if a["id"] < b["id"] and min(x for x in both if x % 2 == 0) == h and len(both) >= jaccard_join.shared_first(a["n"], b["n"], 85):
                    expected.add((a["id"], b["id"]))
    kind = pa.struct([("id", pa.int64()), ("n", pa.int64()), ("comp", pa.int64()), ("hot", pa.int64()), ("bits", pa.binary()), ("first", pa.list_(pa.int32()))])
    batch = pa.RecordBatch.from_pylist(cells, schema=pa.schema([("token", pa.int64()), ("h", pa.int32()), ("left", pa.list_(kind)), ("right", pa.list_(kind))]))
    found = {}
    for spanning in (False, True):
        for flat in (64, 0):
            monkeypatch.setattr(jaccard_join, "FLAT", flat)
            rows = [r for b in jaccard_join.cell_pairs(Cells(), 85, spanning).run(iter([batch])) for r in b.to_pylist()]
            found[spanning, flat] = {(r["a"], r["b"]) for r in rows if r["token"] is None}, {r["token"] for r in rows if r["token"] is not None}
    assert found[False, 64] == found[False, 0] == (expected, set()) and len(expected) > 20
    assert found[True, 64] == found[True, 0]
    some, more = found[True, 64]
    assert some < expected and {a // 100 for a, _ in expected - some} == more


def test_links_are_kept_where_short_hashes_are_equal(spark, monkeypatch):
    import random

    monkeypatch.setattr(jaccard_join, "SHIFT", 57)  # 128 short hashes for all
    rng, sets, rows = random.Random(5), {}, []
    for g in range(40):
        base = [f"g{g}w{j}" for j in range(60)]
        for k in range(3):
            words = [w if rng.random() > 0.02 else f"x{g}y{k}" for w in base]
            rows.append((3 * g + k, " ".join(words)))
            sets[3 * g + k] = {tuple(words[j : j + 4]) for j in range(57)}
    got = {r.doc_id: r.component_id for r in jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = components(sets, 85)
    assert got == expected and len(set(expected.values())) < 110


def test_shared_hashes_with_equal_upper_halves_all_count():
    import numpy as np
    import pyarrow as pa

    held = jaccard_join.numbered(pa.array([[3, 6, 6, 8], [-4], [8, 6, 6, 3]], pa.list_(pa.int32())), np.array([2, 0, 1]))
    count, least = jaccard_join.shared_hashes(held, held, np.array([2, 1, 0]), np.array([1, 2, 1]))
    assert count.tolist() == [4, 4, 0] and (least[:2] == 6 + (1 << 31)).all()


@pytest.mark.parametrize("cell_rows", [1024, 4])
def test_jaccard_join_equals_all_pairs(spark, odd, none, cell_rows):
    import random

    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    data = {1000 + k: " ".join(w if rng.random() > 0.01 else f"x{k}" for w in base) for k in range(60)} | texts_of(spark)
    df = spark.createDataFrame([(k, v, "a") for k, v in data.items()], "doc_id long, text string, token string")
    sets = {}
    for i, t in data.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(df, size=4, percent=85, cell_rows=cell_rows, small=3 if cell_rows == 4 else 48).collect()}
    assert got == {i: (len(sets[i]), c) for i, c in components(sets, 85).items()}
    if cell_rows == 4:
        by = {r.doc_id: r for r in jaccard_join.near_components(odd).collect()}
        assert by[4].component_id == 3 and by[0].n_shingles == 0 and jaccard_join.near_components(none).count() == 0


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "Red Fox"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x One two, three FOUR five SIX? seven eight nine ten y"), (2, "one two XX four five six seven YY nine ten"), (3, "one two three"), (4, "a red fox!"), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.agreeing for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 1): 10, (2, 1): 8, (4, 2): 2}
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.contaminated(none, bench).count() == 0


def test_decontamination_recall_of_each_length(spark):
    """Every allowed set of substituted places of items of 3 to 14 words, and a draw of longer ones, is found."""
    import random
    from itertools import combinations

    rng = random.Random(12)
    items, docs, want = [], [], set()
    for n in [*range(1, 15), 20, 30]:
        words = [f"w{n}x{j}" for j in range(n)]
        items.append((n, " ".join(words)))
        most = n // 5
        places = [c for s in range(most + 1) for c in combinations(range(n), s)] if n <= 14 else [tuple(rng.sample(range(n), most)) for _ in range(60)]
        for gone in places:
            k = len(docs)
            docs.append((k, " ".join(["before", *("other" if j in gone else w for j, w in enumerate(words)), "after"])))
            want.add((k, n))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_decontamination_equals_every_alignment(spark):
    """The query on the given tables against all alignments of all items, and cases with null and repeated ids."""
    docs, bench = texts_of(spark), {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    want = {}
    items = {i: cut(t) for i, t in bench.items()}
    for d, t in docs.items():
        w = cut(t)
        for i, q in items.items():
            for at in range(1 - len(q), len(w)) if q else ():
                same = sum(at + j >= 0 and at + j < len(w) and w[at + j] == x for j, x in enumerate(q))
                if same >= 0.8 * len(q) and (same, -at) > want.get((d, i), (0, 0)):
                    want[d, i] = (same, -at)
    got = {(r.doc_id, r.item_id): (r.agreeing, -r.at) for r in registry.op5_decontamination(spark, SF).collect()}
    assert got == want and got
    item = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (1, "x y z"), (None, "one two three")], "item_id long, text string")
    rows = spark.createDataFrame([(None, "alpha beta gamma delta epsilon zeta eta theta"), (5, "x y z"), (5, "one two three"), (5, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.item_words) for r in decontam.contaminated(rows, item).collect()} == {(None, 1, 8), (5, 1, 3), (5, None, 3)}


def test_packing(spark, odd, none):
    got = registry.op6_ga_packing(spark, SF).toPandas()
    load = got.groupby("sequence_id").length.sum()
    assert load.max() <= 4096 and len(load) <= -(-got.length.sum() // 4096) + 1
    q = got.sort_values(["sequence_id", "offset"])
    assert ((q.groupby("sequence_id").length.cumsum() - q.length) == q.offset).all()
    assert packing.pack(packing.token_pieces(none)).count() == 0
    assert packing.pack(packing.token_pieces(odd)).filter("doc_id = 0").first().length == 1


def test_packing_places_every_item(spark):
    """More blocks than rounds can settle: the items still open in the last round are placed too."""
    import random

    rng = random.Random(11)
    sizes = {k: min(1000, max(1, int(rng.lognormvariate(5.5, 1)))) for k in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, length long")
    got = packing.pack(df, capacity=1000, block_items=6, islands=1, epochs=1, generations=1).toPandas()
    assert sorted(got.doc_id) == sorted(sizes) and got.groupby("sequence_id").length.sum().max() <= 1000


def test_packing_ids_of_full_pieces_are_their_own(spark):
    df = spark.range(0, 300, 1, 300).select("id", F.when(F.col("id") < 290, 10).otherwise(3).alias("length"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        got = packing.pack(df, capacity=10, islands=1, epochs=1).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 300 and got.groupby("sequence_id").length.sum().max() <= 10


def plain_vote(model, counts, k=15, smooth=0.05):
    """Cosines with every example one by one, of equal ones the smaller index."""
    import math

    known = {w: j for j, w in enumerate(model.words)}
    q = {known[w]: (1 + math.log(n)) * model.idf[known[w]] for w, n in counts.items() if w in known}
    size = math.sqrt(sum(x * x for x in q.values()))
    if not size or not len(model.ids):
        return model.prior, []
    cos = [0.0] * len(model.ids)
    for i, t, w in zip(model.rows.tolist(), model.terms.tolist(), model.weights.tolist()):
        cos[i] += q.get(t, 0) / size * w
    near = [i for i in sorted(range(len(cos)), key=lambda i: (-round(cos[i], 12), i)) if cos[i] > 0][:k]
    total = sum(cos[i] for i in near)
    return (sum(cos[i] * model.labels[i] for i in near) + smooth * model.prior) / (total + smooth), [cos[i] for i in near]


def test_toxicity_equals_plain_search(spark, odd, none):
    import math

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    learnable = labels.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0")
    model = toxicity.fit(docs, learnable)
    a, b = model.curve
    texts = texts_of(spark)
    got = {r.doc_id: r for r in registry.op7_toxicity(spark, SF).collect()}
    assert set(got) == set(texts) and len({x for x in model.labels.tolist()}) == 2
    for i, t in texts.items():
        counts = defaultdict(int)
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            counts[w] += 1
        vote, cos = plain_vote(model, counts)
        want = 1 / (1 + math.exp(-(a * vote + b))) if a else vote
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].cosine == pytest.approx(cos[:3], abs=1e-9)
        assert got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert toxicity.score(odd, model).count() == 10 and toxicity.score(none, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(none, labels)).filter("score > 0").count() == 0
    assert len({r.score for r in toxicity.score(odd, model).filter("doc_id in (0, 1, 7)").collect()}) == 1


def test_block_max_search_is_exact_with_ties():
    import random

    import numpy as np

    rng = random.Random(5)
    sets = [tuple(sorted(rng.sample(range(30), rng.randrange(1, 6)))) for _ in range(500)]
    rows = np.array([i for i, s in enumerate(sets) for _ in s])
    terms = np.array([t for s in sets for t in s])
    weights = np.array([1 / len(s) ** 0.5 for s in sets for _ in s])
    index = toxicity.BlockMaxIndex(500, 30, rows, terms, weights, 16)
    for _ in range(200):
        q = np.sort(np.array(rng.sample(range(30), 3)))
        w = np.full(3, 3**-0.5)
        brute = {i: sum(3**-0.5 / len(s) ** 0.5 for t in q.tolist() if t in s) for i, s in enumerate(sets)}
        want = sorted((i for i in brute if brute[i] > 0), key=lambda i: (-round(brute[i], 12), i))[:10]
        cos, at = index.top(q, w, 10)
        assert cos == pytest.approx([brute[i] for i in want], abs=1e-12) and at.tolist() == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the larger tables are not here")
def test_toxicity_held_out_quality(spark):
    """On rows never learned from: precision, recall, and scores that agree with the shares of toxic texts."""
    sf = "/root/testdata/sf0.1"
    rows = registry.op7_toxicity(spark, sf).filter("held_out").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").select("score", "predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.85 * sum(r.toxic for r in rows) and hit >= 0.97 * sum(r.predicted for r in rows)
    for lo, hi in ((0, 0.05), (0.95, 1.01)):
        some = [r for r in rows if lo <= r.score < hi]
        assert abs(sum(r.score for r in some) - sum(r.toxic for r in some)) <= 0.03 * len(some)


def test_language(spark, odd, none):
    got = registry.op8_hd_language(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    by = {r.doc_id: r.lang_pred for r in hd_language.predict(odd, hd_language.train(odd)).collect()}
    assert by[0] == by[1] == by[7] == "und" and hd_language.predict(none, hd_language.train(none)).count() == 0


def test_token_store_round_trip(spark, odd, none):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = {}, 0
    for i, x in sorted(texts_of(spark).items()):
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in registry.op9_token_store(spark, SF).collect()} == want
    for df, n in ((odd, 10), (none, 0)):
        path = Scratch(spark, "t").path("s")
        token_store.write(df, path)
        assert token_store.read(spark, path).count() == n
    path = Scratch(spark, "t").path("few")
    docs = table(spark, SF, "documents").unionByName(table(spark, SF, "documents").filter("doc_id = 5")).unionByName(table(spark, SF, "documents").limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    token_store.write(docs, path, segment_ids=5000)
    whole = sorted((r.key, bytes(r.ids)) for r in token_store.read(spark, path).filter("key in (0, 5, 77, 199)").collect())
    got = sorted((r.key, bytes(r.ids)) for r in token_store.fetch(spark, path, [5, 77, 0, 199, 10**9, -4]).collect())
    assert got == whole and [k for k, _ in got].count(5) == 2 and token_store.fetch(spark, path, []).count() == 0


def test_added_tokens_are_encoded_as_by_the_library(spark):
    import numpy as np
    import pyarrow as pa
    import public_tokenizers
    from folioflow.llm import tokens
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    added = [a.content for a in t.get_added_tokens_decoder().values()]
    texts = ["a <|endoftext|> b", *(x for a in added for x in (a, f"word{a}word", f"A  {a}, {a}{a}\n{a.upper()} end", f"{a[:-1]} {a[-1]}"))]
    ids, sizes = tokens.encoder().flat(pa.array(texts))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == [320, 49407, 321]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


@pytest.mark.parametrize("values", [[0], [5, 5, 5], list(range(0, 10_000, 7)), [0, 0, 1 << 40], [3] * 1000 + [10**9]])
def test_elias_fano(values):
    low, code = token_store.ef_encode(values)
    ef = token_store.EliasFano(len(values), low, code)
    assert ef.all().tolist() == values and [ef.select(i) for i in range(0, len(values), 97)] == values[::97]


def test_shards(spark, odd, none):
    texts = texts_of(spark)
    got = registry.op10_kd_shards(spark, SF).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert set(got.shard) <= set(range(40)) and sizes.max() - sizes.mean() <= got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert {r.doc_id: (r["size"], r.text_crc32) for _, r in got.iterrows()} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    for df, n in ((odd, 10), (none, 0)):
        rows = kd_shards.documents_sharded(df, shards=3).collect()
        assert len(rows) == n
        for s in range(3):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_keep_equal_texts_together(spark):
    """Sizes near equal; no group of equal texts is split that fits into a shard; a group of a third of all rows is."""
    import random

    rng = random.Random(8)
    rows = [(k, f"text {k} " + "x" * rng.randrange(200), rng.choice("abc"), rng.choice("st")) for k in range(4000)]
    for j, copies in enumerate([2200, 30, 25, 20, 9, 5, 3, 2]):
        rows += [(len(rows) + k, f"copy {j} " + "y" * 150, rng.choice("abc"), rng.choice("st")) for k in range(copies)]
    rows += [(len(rows) + k, None if k % 2 else "", "a", None) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = kd_shards.documents_sharded(df, shards=8).join(df.select("doc_id", "text"), "doc_id").toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() < 1.02 * sizes.mean() and sizes.min() > 0.98 * sizes.mean()
    where = got.groupby("text").agg(shards=("shard", "nunique"), size=("size", "sum"))
    assert (where[where["size"] <= sizes.mean()].shards == 1).all() and where.shards.max() > 1


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_odd_tables(spark, odd, none, stage):
    """Nulls, empty and long texts, repeated rows, clashing columns and the empty table in every stage."""
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    got, empty = run(spark, odd, SF), run(spark, none, SF)
    rows = got.collect()
    assert empty.count() == 0
    if name == "packing":
        assert {r.doc_id for r in rows} == set(range(9)) and sum(r.length for r in rows if r.doc_id == 0) == 1
        return
    assert got.columns == odd.columns == empty.columns
    ids = sorted(r.doc_id for r in rows)
    # One row of each group of equal texts stays; rows that repeat an id stand and fall together.
    assert ids == ([0, 1, 2, 3, 5, 7, 8, 8] if name == "near copies" else [*range(9), 8])
    if name == "pii":
        assert {r.doc_id: r.n_chars for r in rows}[3] == len(LONG) and {r.doc_id: r.text for r in rows}[0] is None


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {0: {r.doc_id for r in docs.select("doc_id").collect()}}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = Scratch(spark, "test").keep(stage(spark, docs, SF), "d")
        assert docs.columns == columns
        kept[k + 1] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] == kept[4]
    bench = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert not any(b in (r.text or "") for r in docs.collect() for b in bench)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text].append(r.doc_id)
    assert all(len(v) == 1 for t, v in groups.items() if t)
