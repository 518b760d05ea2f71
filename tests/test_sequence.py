"""Sequence operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sparkweave.operators import sequence
from sparkweave.operators.scan import prefix_scan


@pytest.fixture(scope="module")
def values():
    rng = random.Random(1)
    return [(i, rng.randrange(-50, 50)) for i in range(200)]


@pytest.fixture(scope="module")
def seq(spark, values):
    return spark.createDataFrame(values, "idx long, value long").repartition(7)


def rows(df):
    return sorted(map(tuple, df.select("idx", "value").collect()))


def test_scans(seq, values):
    for op, f, start in (("sum", sum, 0), ("min", min, None), ("max", max, None)):
        for inclusive in (False, True):
            for backward in (False, True):
                want = []
                for i in range(len(values)):
                    part = values[i + (not inclusive) :] if backward else values[: i + inclusive]
                    want.append((i, f([v for _, v in part]) if part else start))
                assert rows(sequence.scan(seq, op, inclusive, backward)) == want, (op, inclusive, backward)


def test_packs(seq, values):
    flag = F.col("value") > 10
    kept = [v for _, v in values if v > 10]
    rest = [v for _, v in values if v <= 10]
    assert rows(sequence.pack(seq, flag)) == list(enumerate(kept))
    assert rows(sequence.pack2(seq, flag, ~flag)) == list(enumerate(kept + rest))
    assert rows(sequence.pack_index(seq, flag)) == list(enumerate(i for i, v in values if v > 10))
    assert rows(sequence.filter_seq(seq, flag)) == [x for x in values if x[1] > 10]
    assert sequence.sum_flags(seq, flag).first()["value"] == len(kept)
    assert rows(sequence.enumerate_flags(seq, flag)) == [(i, sum(v > 10 for _, v in values[:i])) for i in range(200)]


def test_reductions(spark, seq, values):
    only = [v for _, v in values]
    assert sequence.reduce(seq).first()["value"] == sum(only)
    assert sequence.map_reduce(seq, F.abs, "max").first()["value"] == max(map(abs, only))
    assert sequence.max_index(seq).first()["idx"] == only.index(max(only))
    assert rows(sequence.new_array(spark, 3, 7)) == [(0, 7), (1, 7), (2, 7)]


def test_general_reductions(spark, monkeypatch):
    """Any associative function, in order, over places that lie far apart; chunks of three."""
    monkeypatch.setattr(sequence, "CHUNK", 3)
    rng = random.Random(5)
    places = sorted(rng.sample(range(-40, 1000), 90))
    words = [(i, rng.choice("abc")) for i in places]
    text = spark.createDataFrame(words, "idx long, value string").repartition(5)
    assert sequence.reduce(text, F.concat).first()["value"] == "".join(w for _, w in words)
    assert sequence.max_index(text, lambda a, b: a > b).first()["idx"] == next(i for i, w in words if w == "c")
    assert sequence.max_index(text, lambda a, b: a < b).first()["idx"] == next(i for i, w in words if w == "a")
    none = text.where("idx > 5000")
    assert sequence.reduce(none, F.concat).collect() == [(None,)] and sequence.max_index(none, lambda a, b: a > b).collect() == [(None,)]
    holes = spark.createDataFrame([(1, None), (2, 5), (3, None)], "idx long, value long")
    assert sequence.reduce(holes, lambda a, b: F.coalesce(b, a)).first()["value"] == 5
    assert sequence.max_index(holes, lambda a, b: a > b).first()["idx"] == 2


def test_gather_and_scatter(spark, seq, values):
    a = dict(values)
    rng = random.Random(3)
    where = [(i, rng.randrange(0, 220)) for i in range(500)]
    probes = spark.createDataFrame(where, "idx long, value long").repartition(5)
    b, c = {}, {}
    for i, r in where:
        if r in a:
            b[i % 50] = a[r]
        c[r] = a[i % 200]
    assert rows(sequence.gather(seq, probes, 50)) == sorted(b.items())
    assert rows(sequence.scatter(seq, probes, 200)) == sorted(c.items())


def test_nothing_nulls_and_clashing_names(spark):
    empty = spark.createDataFrame([], "idx long, value long")
    assert rows(sequence.scan(empty)) == [] and rows(sequence.pack(empty, F.lit(True))) == []
    assert sequence.reduce(empty).first()["value"] is None and sequence.max_index(empty).first()["idx"] is None
    holes = spark.createDataFrame([(0, 1), (1, None), (2, 5)], "idx long, value long")
    assert rows(sequence.scan(holes, inclusive=True)) == [(0, 1), (1, 1), (2, 6)]
    odd = spark.createDataFrame([(2, 1.5, "x"), (1, 2.0, "y")], "`a.b` int, value double, before string")
    out = prefix_scan(odd, [F.col("`a.b`")], {"out": "value"})
    assert [tuple(r) for r in out.orderBy("out").collect()] == [(1, 2.0, "y", 0.0), (2, 1.5, "x", 2.0)]
