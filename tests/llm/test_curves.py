import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import curves, queries


def brute(rows, asked, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in zip(ids, x):
        if asked(i):
            d = np.sqrt(((x - v) ** 2).cumsum(1)[:, -1])
            near = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(d[j])) for j in near]
    return out


def lists(df, q="query", i="id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[q], r["rank"])):
        out.setdefault(r[q], []).append((r[i], r.score))
        assert r["rank"] == len(out[r[q]])
    return out


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_hilbert_keys_visit_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = curves.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(curves, "BLOCK", 64)
    monkeypatch.setattr(curves, "WINDOW", 16)
    monkeypatch.setattr(curves, "BATCH", 3)
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    got = lists(queries.op10_neighbours(spark, sf), "query_id", "vec_id")
    assert got == want


def test_clusters_ties_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(curves, "BLOCK", 50)
    monkeypatch.setattr(curves, "WINDOW", 20)
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 6)) * 50
    rows = [(i, (centres[i % 12] + r.normal(size=6)).round(2).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 6) for i in range(60)]
    bad = [(-100, None), (-200, [0.0] * 6), (-300, [float("nan")] * 6), (-400, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (-500, [1.0]), (None, [1.0] * 6), (-600, [float("inf")] * 6), (-700, [])]
    table = spark.createDataFrame([(*x, 1) for x in rows + bad], "vec_id bigint, embedding array<double>, rank int")
    asked = lambda i: i % 5 == 0
    got = lists(curves.search(table, F.col("id") % 5 == 0))
    assert got == brute(rows, asked)
    near = lists(curves.search(table, F.col("id") % 5 == 0, complete=False))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in near.get(q, [])}) for q in got) / sum(map(len, got.values()))
    assert hits > 0.8
    assert curves.search(table.where("vec_id < 0"), F.lit(True)).where("id <> -500").count() == 0
    assert lists(curves.search(table.where("vec_id in (5, 6)"), F.lit(True))).keys() == {5, 6}
    assert curves.search(table.where("false"), F.lit(True)).count() == 0


def brute_ids(rows, asked, k=10):
    """As brute, where ids repeat: the distance of two ids is that of their nearest rows."""
    by = {}
    for i, v in rows:
        by.setdefault(i, []).append(np.array(v, np.float64))
    d = lambda a, b: min(float(np.sqrt(((y - x) ** 2).cumsum()[-1])) for x in by[a] for y in by[b])
    return {i: [(j, s) for s, j in sorted((d(i, j), j) for j in by if j != i)[:k]] for i in by if asked(i)}


@pytest.mark.parametrize("block", [4096, 32])
def test_repeated_ids_leave_room_for_others(spark, monkeypatch, block):
    monkeypatch.setattr(curves, "BLOCK", block)
    monkeypatch.setattr(curves, "WINDOW", 16)
    r = np.random.default_rng(7)
    rows = [(i, r.normal(size=6).round(3).tolist()) for i in range(120)]
    rows += rows * 11 + [rows[7]] * 40  # copies, also of the queries
    rows += [(i, r.normal(size=6).round(3).tolist()) for i in range(0, 120, 3)]  # other vectors of the same ids
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert lists(curves.search(table, F.col("id") % 5 == 0)) == brute_ids(rows, lambda i: i % 5 == 0)


def test_nearest_counts_ids():
    rows = np.array([[1.0], [1.0], [1.0], [2.0], [3.0], [1.5]])
    at, ids, d = curves.nearest(np.array([[0.0]]), np.array([9]), rows, np.array([4, 4, 4, 2, 3, 2]), 3)
    assert (at.tolist(), ids.tolist(), d.tolist()) == ([0, 0, 0], [4, 2, 3], [1.0, 1.5, 3.0])
