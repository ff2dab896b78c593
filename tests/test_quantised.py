"""Compressed search against exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import quantised, search


def table(spark, x, name="key"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} bigint, vec array<double>").repartition(4)


def rows(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").collect()]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    return np.repeat(rng.normal(size=(60, 24)), 20, axis=0) + 0.05 * rng.normal(size=(1200, 24))


@pytest.mark.parametrize("which", ["cos", "l2sq"])
@pytest.mark.parametrize("limit", [20_000, 5])
def test_clusters_are_proven_by_bounds(spark, tmp_path, monkeypatch, clustered, which, limit):
    monkeypatch.setattr(quantised, "BROADCAST_QUERIES", limit)
    monkeypatch.setattr(quantised, "BROADCAST_CANDIDATES", limit)
    monkeypatch.setattr(quantised, "GRID", (10, 100))
    items, q = table(spark, clustered), table(spark, clustered[::40] + 0.01, "query_id")
    made = quantised.build(items, str(tmp_path / "i"), 24, which, pieces=6, cells=8)
    again, stats = quantised.load(spark, str(tmp_path / "i")), {}
    assert again.ndim == 24 and all((a == b).all() for a, b in zip(again.books, made.books))
    got = rows(quantised.knn_quantised(q, again, 5, rerank=60, digits=6, stats=stats))
    assert got == rows(search.knn(q, items, which, 5, digits=6))
    assert stats["proven"] == 30 and stats["candidates"] == 30 * 60


@pytest.mark.parametrize("which", ["cos", "l2sq"])
def test_noise_is_exact_where_asked(spark, tmp_path, which):
    x = np.random.default_rng(4).normal(size=(3000, 32))
    items, q = table(spark, x), table(spark, x[:40], "query_id")
    made, stats = quantised.build(items, str(tmp_path / "i"), 32, which), {}
    want = rows(search.knn(q, items, which, 10, digits=6))
    got = rows(quantised.knn_quantised(q, made, 10, rerank=100, digits=6, stats=stats))
    assert len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.9 * len(want) == 360
    assert rows(quantised.knn_quantised(q, made, 10, rerank=10, exact=True, digits=6)) == want


def test_bounds_hold_and_codes_alone_are_scanned(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(2000, 16)).astype(np.float32).astype(float)
    made = quantised.build(table(spark, x), str(tmp_path / "i"), 16, "l2sq", pieces=4)
    found = quantised._candidates(table(spark, x[:20], "query_id"), made, 50)
    for r in found.collect():
        assert r.bound <= np.linalg.norm(x[r.query_id] - x[r.key]) + 1e-9
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<key:bigint,code:binary,far:float>" in plan


def test_copies_odd_vectors_and_nothing(spark, tmp_path):
    same = [1.0, 2.0, 3.0, 4.0]
    odd = [(900, None), (901, []), (902, [0.0] * 4), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan"), 1.0, 1.0, 1.0]), (905, [1.0, 2.0]), (906, [1e200, 0.0, 0.0, 0.0]), (907, [float("inf"), 0.0, 0.0, 0.0])]
    items = spark.createDataFrame([*((i, same) for i in range(300)), *odd, (5, same)], "key bigint, vec array<double>").withColumn("cell", F.lit("theirs"))
    q = spark.createDataFrame([(1, same), (2, [0.0] * 4), (3, None), (4, [1.0, 2.0])], "query_id bigint, vec array<double>")
    for which in ("cos", "l2sq"):
        made = quantised.build(items, str(tmp_path / which), 4, which, pieces=2)
        want = [r for r in rows(search.knn(q, items, which, 7)) if r[0] < 3]
        got = rows(quantised.knn_quantised(q, made, 7, rerank=20, exact=True))
        assert [r[:3] for r in got if r[0] == 1] == [r[:3] for r in want if r[0] == 1] == [(1, i + 1, k) for i, k in enumerate([0, 1, 2, 3, 4, 5, 5])]
        assert not [r for r in got if r[0] in (3, 4)]
    none = quantised.build(items.limit(0), str(tmp_path / "none"), 4, pieces=2)
    assert rows(quantised.knn_quantised(q, none, 3, exact=True)) == []
    for bad in (dict(which="hamming"), dict(pieces=5), dict(cells=0)):
        with pytest.raises(ValueError):
            quantised.build(items, str(tmp_path / "bad"), 4, **bad)
    with pytest.raises(ValueError):
        quantised.load(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        quantised.knn_quantised(q, made, 7, rerank=5)
