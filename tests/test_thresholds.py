"""Exact nearest-rank against sorting, also when every pass has to be a search step."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import thresholds
from factloom.functions.spec import measure


def sorted_rank(values, q):
    known = sorted(v for v in values if v is not None)
    return known[thresholds.rank_of(len(known), q)] if known else None


def shapes():
    r = random.Random(7)
    return {
        "uniform": [r.uniform(-5, 5) for _ in range(3000)],
        "hot": [1.0] * 1500 + [r.choice([0.0, 2.0, 3.5]) for _ in range(700)] + [None] * 50,
        "skewed": [10.0 ** r.uniform(-300, 300) for _ in range(2000)],
        "two ends": [0.0] * 900 + [9.0] * 900 + [r.uniform(0, 9) for _ in range(300)],
        "one": [4.0],
        "none": [None, None],
    }


@pytest.mark.parametrize("shape", shapes())
@pytest.mark.parametrize("small", [20_000, 3, 4])
def test_rank_search(spark, monkeypatch, shape, small):
    monkeypatch.setattr(thresholds, "EXACT_DISTINCT", small)
    monkeypatch.setattr(thresholds, "COARSE", thresholds.Sketch(10, 1, 50))
    monkeypatch.setattr(thresholds, "FINE", thresholds.Sketch(20, 1, 50))
    if small == 4:
        monkeypatch.setattr(thresholds, "SAMPLE", 40)
    values = shapes()[shape]
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    for q in (0.0, 0.333, 0.5, 0.9, 1.0):
        assert thresholds.nearest_rank(frame, "v", q) == sorted_rank(values, q), q


def test_a_wrong_guess_is_noticed(spark, monkeypatch):
    """With a useless sketch the counts still lead to the right value."""
    monkeypatch.setattr(thresholds, "EXACT_DISTINCT", 2)
    for name in ("COARSE", "FINE"):
        monkeypatch.setattr(thresholds, name, thresholds.Sketch(4, 0, 1))
    monkeypatch.setattr(thresholds, "SAMPLE", 1)
    values = [float(i * i % 101) for i in range(200)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert thresholds.nearest_rank(frame, "v", 0.7) == sorted_rank(values, 0.7)


def test_many_requests_share_passes(spark, monkeypatch):
    values = [float(i) for i in range(100)]
    frame = spark.createDataFrame(
        [(i, (v if i % 4 else None, -v)) for i, v in enumerate(values)],
        "id int, f struct<a:double,b:double>")
    a, b = measure("f.a"), measure("f.b")
    odd = F.col("id") % 2 == 1
    ask = [thresholds.Request("all", a, "mean"), thresholds.Request("all", a, "median"),
           thresholds.Request("odd", a, "percentile", 90.0),
           thresholds.Request("odd", b, "min"), thresholds.Request("all", b, "max"),
           thresholds.Request("all", a, "median")]
    got = thresholds.compute(frame, ask, {"odd": odd})
    known = [v for i, v in enumerate(values) if i % 4]
    assert got == {
        ask[0]: sum(known) / len(known), ask[1]: sorted_rank(known, 0.5),
        ask[2]: sorted_rank([v for v in known if v % 2 == 1], 0.9),
        ask[3]: -99.0, ask[4]: 0.0}
    assert thresholds.compute(frame, []) == {}
