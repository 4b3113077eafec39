"""Exact medians by narrowing, and sweeps by stretches, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from folioflow.operators import anchors, evaluation


@pytest.mark.parametrize(("small", "bins"), [(100_000, 1024), (3, 4), (1, 2)])
def test_medians_equal_plain_sorting(spark, small, bins):
    rng = random.Random(small)
    groups = {
        "one": [4.5], "two": [1.0, 2.0], "ties": [7.0] * 900 + [1.0, 9.0], "halves": [0.0] * 250 + [10.0] * 250, "tails": [rng.gauss(0, 1) * 10 ** rng.randint(-300, 300) for _ in range(401)],
        "even": [rng.random() for _ in range(300)], "odd": [float(rng.randint(0, 9)) for _ in range(301)], None: [3.0, 1.0, 2.0], "negative": [-rng.random() for _ in range(50)],
    }
    rows = [(g, x) for g, v in groups.items() for x in v] + [("ties", None), ("nothing", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.n, r["median"]) for r in evaluation.medians(df, ["g"], "v", small, bins).collect()}
    assert got == {g: (len(v), pytest.approx(statistics.median(v), rel=1e-12)) for g, v in groups.items()}


def test_median_of_everything_and_of_nothing(spark):
    df = spark.range(1001).select((F.col("id") * 2 % 1001).alias("v"))
    assert [tuple(r) for r in evaluation.medians(df, [], "v", 10).collect()] == [(1001, 500.0)]
    assert evaluation.medians(df.limit(0).withColumn("g", F.lit("x")), ["g"], "v").collect() == []
    assert [tuple(r) for r in evaluation.medians(df.limit(0), [], "v").collect()] == [(0, None)]


@pytest.mark.parametrize("radius", [0, 7, 50, 30_000])
def test_anchors_within_equal_all_pairs(spark, radius):
    rng = random.Random(radius)
    points = [(rng.choice("ab"), f"item{k}", rng.choice([None, rng.randint(0, 60_000), rng.randint(0, 90)])) for k in range(40)]
    places = [(rng.choice("abc"), f"x{k}", rng.choice([rng.randint(0, 60_000), rng.randint(0, 90)])) for k in range(60)]
    made = anchors.within(spark.createDataFrame(points, "accession string, item string, o long"), spark.createDataFrame(places, "accession string, anchor_id string, o long"), radius)
    r = min(radius, 20_000)
    want = sorted((a, i, x, q - o) for a, i, o in points if o is not None for b, x, q in places if a == b and abs(q - o) <= r)
    assert sorted((p.accession, p.item, p.anchor_id, p.delta) for p in made.collect()) == want
    assert "Cartesian" not in made._jdf.queryExecution().executedPlan().toString()
