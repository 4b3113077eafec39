"""Submissions read block by block, folders listed and golden files counted, against whole files and plain loops."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import evaluation
from folioflow.sources import submissions
from test_live import uncommit

HEAD = "<SEC-HEADER>é</SEC-HEADER>\n"


def block(kind, text, end="</DOCUMENT>"):
    return f"<DOCUMENT>\n<TYPE>{kind}\n<TEXT>{text}</TEXT>\n{end}"


FILES = {
    "plain": HEAD + block("EX-1", "exhibit 語") + "\n" + block("10-K", "the 😀 main") + "\n" + block("10-K", "second") + "\n",
    "ended": HEAD + block("EX-1", "x") + block("10-K/A", "amended"),
    "amended_first": block("10-K/A", "a") + block("10-K", "b"),
    "no_main": HEAD + block("EX-1", "only exhibits") + block("10-KT", "other kind") + " rest",
    "no_main_ended": block("EX-1", "only exhibits"),
    "bare": "no tags at all, 10-K",
    "unclosed": HEAD + block("EX-1", "x") + block("10-K", "cut off", end=""),
    "lower_end": block("10-K", "lower", end="</document>") + " between " + block("EX-9", "y"),
    "lower_all": block("EX-1", "x", end="</Document>") + block("10-K", "both", end="</document>") + " z",
    "no_text": "<DOCUMENT>\n<TYPE>10-K\nnothing</DOCUMENT>" + block("10-K", "later"),
    "type_outside": "<TYPE>10-K\n" + block("EX-1", "x") + block("10-K", "in"),
    "empty": "",
    "nested": "<DOCUMENT><DOCUMENT>\n<TYPE>10-K\n<TEXT>twice</TEXT></DOCUMENT></DOCUMENT>",
    "long": HEAD + "".join(block("EX-1", "x" * 3000 + "é") for _ in range(40)) + block("10-K", "w " * 5000) + block("EX-2", "y" * 4000),
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in FILES.items():
        (tmp_path / "in" / f"{name}.txt").write_text(text)
    return str(tmp_path / "in")


def test_blocks_give_what_whole_files_give(spark, folder):
    want = {r.accession: (r.html, r.text_start) for r in submissions.submissions(spark, folder).collect()}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for cut in (size, "7000"):  # the second one reads the long file in many tasks
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        try:
            got = {r.path.split("/")[-1][:-4]: (r.html, r.text_start) for r in submissions.main_documents(submissions.records(spark, [folder])).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert got == {k: v for k, v in want.items() if k != "empty"}  # a file of no bytes has no record
    assert want["plain"][0].startswith("the 😀 main") and FILES["plain"][want["plain"][1] :].startswith("the 😀 main")


def test_no_record_is_longer_than_a_block(spark, folder):
    longest = submissions.records(spark, [folder]).agg(F.max(F.length("value"))).first()[0]
    assert longest < len(FILES["long"]) / 10


def test_stream_of_submissions_resumes_and_replays(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    names = [n for n in FILES if n != "empty"]
    for part in (names[:6], names[6:]):
        for name in part:
            (tmp_path / "in" / f"{name}.txt").write_text(FILES[name])
        submissions.stream_main_documents(spark, src, out, ck, files=4).awaitTermination(120)
        uncommit(ck)
        submissions.stream_main_documents(spark, src, out, ck, files=4).awaitTermination(120)
    got = sorted((r.accession, r.html, r.text_start) for r in spark.read.parquet(out).collect())
    assert got == sorted((r.accession, r.html, r.text_start) for r in submissions.submissions(spark, src).collect())


def test_discovery_over_folders(spark, tmp_path):
    rng, sets, folders = random.Random(1), 3, 3
    golden = {(s, a): rng.choice(['{"%s#item1": "x", "%s#item2": ""}' % (a, a), "{}", "broken", '{"k": "v"}']) for s in range(sets) for a in "abcdefgh" if rng.random() < 0.6}
    bold = '<span style="font-weight: bold">Item 1</span><span style="FONT-WEIGHT:700;x">item\t2</span>'
    source = {(f, a): block("10-K", bold * rng.choice([0, 2, 6]) + "t" * 3000) for f in range(folders) for a in "abcdefgi" if rng.random() < 0.5}
    for (s, a), text in golden.items():
        (tmp_path / f"g{s}").mkdir(exist_ok=True)
        (tmp_path / f"g{s}" / f"{a}.json").write_text(text)
    for (f, a), text in source.items():
        (tmp_path / f"f{f}").mkdir(exist_ok=True)
        (tmp_path / f"f{f}" / f"{a}.txt").write_text(text)
    want = []
    for s, a in sorted(golden):
        at = next((f for f in range(folders) if (f, a) in source), None)
        items = {"broken": 0, "{}": 0, '{"k": "v"}': 1}.get(golden[s, a], 2)
        if at is None or not items:
            continue
        html = submissions_main(source[at, a])
        n = html[: len(html) // 3].lower().count("item")
        want.append((a, s, f"f{at}/{a}.txt", f"g{s}/{a}.json", len(html), items, "easy" if n >= 10 else "medium" if n >= 3 else "hard"))
    places = lambda n, c: [str(tmp_path / f"{c}{k}") for k in range(n)]
    for limit in (None, 4):
        rows = submissions.find_filings(spark, [*places(folders, "f"), str(tmp_path / "gone")], places(sets + 1, "g"), limit).collect()
        got = [(r.accession, r.gt_set, "/".join(r.source_path.split("/")[-2:]), "/".join(r.gt_path.split("/")[-2:]), r.html_size, r.gt_item_count, r.difficulty) for r in rows]
        assert sorted(got, key=lambda r: (r[1], r[0])) == want[:limit]
    assert len({r[-1] for r in want}) > 1
    assert submissions.find_filings(spark, [], []).count() == 0


def submissions_main(text):
    return text.split("<TEXT>")[1].split("</DOCUMENT>")[0]


def test_golden_files_are_counted(spark):
    shape = "accession string, malformed boolean, key string"
    golden = spark.createDataFrame([("a", False, "a#item1"), ("a", False, "a#item2"), ("b", False, None), ("c", True, None), ("d", False, "d#item1"), ("e", False, "e#item1")], shape)
    made = spark.createDataFrame([("a", False, "a#item1"), ("d", True, None), ("z", False, "z#item1")], shape)
    assert evaluation.file_account(golden, made).first().asDict() == {"files": 5, "malformed": 1, "empty": 1, "skipped": 2, "scored": 1}
    assert evaluation.file_account(golden.limit(0), made).first().files == 0


def test_bundles_give_what_files_give(spark, tmp_path):
    """Many submissions in few files, in which a record is still a block, also where files are cut."""
    texts = FILES | {"only_end": "</DOCUMENT>", "two_ends": "</DOCUMENT></DOCUMENT>", "end_first": "</DOCUMENT>abc", "tabs": "\ta\tb\n" + block("10-K", "\tx\t") + "\t"}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / f"{name}.txt").write_text(text)
    want = {r.path.split("/")[-1][:-4]: (r.html, r.text_start) for r in submissions.main_documents(submissions.records(spark, [str(tmp_path / "in")])).collect()}
    assert len(want) == len(texts) - 1  # all but the file of no bytes
    out = str(tmp_path / "out")
    submissions.bundle(spark.createDataFrame([*texts.items(), ("null", None)], "accession string, content string").repartition(2), out)
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.endswith(".txt")]) <= 2
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for cut in (size, "7000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        try:
            rows = submissions.bundled(spark, [out])
            assert {r.path: (r.html, r.text_start) for r in submissions.main_documents(rows).collect()} == want
            assert rows.agg(F.max(F.length("value"))).first()[0] < len(FILES["long"]) / 10
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_submission_blocks_needs_no_file_for_each_submission(spark, tmp_path):
    """The number of files goes with the tasks and not with the submissions."""
    from folioflow import catalog
    from folioflow.plans.store import shared_folder

    before = set(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/submissions-*"))
    rows = catalog.QUERIES["submission_blocks"](spark, "/root/testdata/sf0.01").count()
    (made,) = set(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/submissions-*")) - before
    assert rows > 20 and len(glob.glob(f"{made}/**/*.txt", recursive=True)) <= 4
