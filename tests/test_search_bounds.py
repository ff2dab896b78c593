"""What searches give out and move: bounded by the input and the result, not by all pairs."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from halyard.functions import codes, metrics
from halyard.operators import candidates, search
from halyard.plans import catalogue

SF = "/root/testdata/sf0.1"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def noise(spark):
    x = np.random.default_rng(1).normal(size=(3000, 12))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key bigint, vec array<double>").repartition(3)


def given_out(monkeypatch, run):
    """The rows that tasks give out before ranking."""
    seen = []
    top = search.top
    monkeypatch.setattr(search, "top", lambda df, n: seen.append(df) or top(df, n))
    found = rows(run())
    return found, seen[0].count()


def test_tasks_give_out_one_list_a_query(spark, noise, monkeypatch):
    q = noise.where("key < 40").withColumnRenamed("key", "query_id")
    monkeypatch.setattr(search, "STEP", (16, 64))
    found, n = given_out(monkeypatch, lambda: search.knn(q, noise, "l2sq", 5, digits=6))
    assert len(found) == 200 and n <= 200 * spark.sparkContext.defaultParallelism


def test_vote_ranks_where_distances_are(spark, monkeypatch):
    found, n = given_out(monkeypatch, lambda: catalogue.QUERIES["q44_multi_query_vote"](spark, SF))
    assert sum(r[1] for r in found) == 1000 and n <= 1000 * spark.sparkContext.defaultParallelism < 200_000


def test_long_lists_come_by_a_reach(spark, noise, monkeypatch):
    q = noise.where("key < 30").withColumnRenamed("key", "query_id")
    want = rows(search.knn(q, noise, "cos", 150, digits=6))
    monkeypatch.setattr(search, "LONG", 100)
    found, n = given_out(monkeypatch, lambda: search.knn(q, noise, "cos", 150, digits=6))
    assert found == want and n < 1.2 * 30 * 150
    # More than there are.
    assert len(rows(search.knn(q, noise, "cos", 5000))) == 30 * 3000


@pytest.mark.parametrize("which", ["nphd", "hamming"])
def test_codes_of_all_lengths_equal_columns(spark, monkeypatch, which):
    rng = np.random.default_rng(2)
    raw = [(i, bytes(rng.integers(0, 256, 8 if which == "hamming" else int(rng.integers(0, 33))).tolist())) for i in range(300)]
    items = spark.createDataFrame(raw, "key bigint, raw binary").select("key", codes.pack(F.col("raw")).alias("vec"))
    q = items.where("key % 7 = 0").withColumnRenamed("key", "query_id")
    want = rows(search.knn(q, items, lambda a, b: metrics.METRICS[which](a, b), 6, digits=6))
    assert rows(search.knn(q, items, which, 6, digits=6)) == want
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 5)
    for name in ("QUERY_BLOCK", "ITEM_BLOCK"):
        monkeypatch.setattr(search, name, {"vec": 13, "code": 13})
    assert rows(search.knn(q, items, which, 6, digits=6)) == want
    monkeypatch.setattr(search, "LONG", 3)
    assert rows(search.knn(q, items, which, 6, digits=6)) == want


def test_own_metric_as_arrays(spark, noise, monkeypatch):
    q = noise.where("key < 20").withColumnRenamed("key", "query_id")
    ip = lambda a, b: -metrics.dot(a, b)
    want = rows(search.knn(q, noise, ip, 7, digits=6))
    metrics.register("ip-arrays", lambda a, b: -metrics.dot(a, b), lambda q, x: -q @ x.T)
    monkeypatch.setattr(search, "_by_column", None)
    assert rows(search.knn(q, noise, "ip-arrays", 7, digits=6)) == want


def test_cells_apply_the_radius_where_distances_are(spark, noise):
    centres = candidates.cells(noise, 4)
    q = noise.where("key < 20").withColumnRenamed("key", "query_id")
    want = rows(search.knn(q, noise, "cos", 3000, radius=0.3))
    found = rows(candidates.knn_cells(q, noise, centres, 3000, 4, 0.3))
    assert [r[:3] for r in found] == [r[:3] for r in want]


def test_pairs_shuffle_rows_once(spark, noise):
    df = search.range_pairs(noise, "cos", 0.05, digits=6, block=100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and df.count() > 0


def test_all_pairs_come_nearest_first(spark):
    found = catalogue.QUERIES["q46_stale_suppression"](spark, SF).select(F.spark_partition_id(), "distance").collect()
    parts = {}
    for p, d in found:
        parts.setdefault(p, []).append(d)
    assert len(found) == 100 * sum(k % 7 != 0 or k % 10 == 0 for k in range(2_000)) and all(d == sorted(d) for d in parts.values())


def test_files_of_all_pairs_are_small(spark, monkeypatch, tmp_path):
    # One block of queries and one of items: 3.5 million pairs took 8.6 bytes each, query by query.
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 100)
    x = np.random.default_rng(3).normal(size=(9_000, 64)).astype(np.float32)
    table = pa.table({"vec_id": pa.array(range(9_000), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array([0] * 9_000, pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    catalogue.QUERIES["q46_stale_suppression"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    n = sum(pq.read_metadata(p).num_rows for p in files)
    assert n == 450 * sum(k % 7 != 0 or k % 10 == 0 for k in range(9_000)) and sum(p.stat().st_size for p in files) < 6 * n


@pytest.mark.parametrize("blocked", [False, True])
def test_ordered_rows_equal_others(spark, noise, monkeypatch, blocked):
    odd = spark.createDataFrame([(5_000, [0.0] * 12), (5_001, None), (5_002, [1.0, None] * 6), (5_003, [1.0] * 5), (5_004, [-1.0] * 12), (5_005, [1.0] * 12)], noise.schema)
    items = noise.where("key < 100").unionByName(odd)
    q = items.where("key % 5 = 0 or key > 4000").withColumnRenamed("key", "query_id")
    codes_ = items.where("key < 4000").select("key", codes.pack(F.substring(F.unhex(F.sha2(F.col("key").cast("string").cast("binary"), 256)), F.lit(1), (1 + F.col("key") % 4).cast("int"))).alias("vec"))
    asked = codes_.where("key % 5 = 0").withColumnRenamed("key", "query_id")
    if blocked:
        monkeypatch.setattr(search, "BROADCAST_QUERIES", 5)
        for name in ("QUERY_BLOCK", "ITEM_BLOCK"):
            monkeypatch.setattr(search, name, {"vec": 37, "code": 37})
    for which, a, b, radius, digits in (("cos", q, items, 2.0, 6), ("cos", q, items, 0.7, 3), ("cos", q, items, -1.0, 6), ("nphd", asked, codes_, 0.5, 6), ("hamming", asked, codes_, 256.0, 0)):
        want = rows(search.range_search(a, b, which, radius, digits=digits))
        for most in (50, 1 << 25):
            monkeypatch.setattr(search, "ORDERED", most)
            assert rows(search.range_search(a, b, which, radius, digits=digits, ordered=True)) == want
        assert want or radius < 0


def test_only_rounded_distances_of_a_known_range_are_ordered(noise):
    q = noise.withColumnRenamed("key", "query_id")
    for which, digits in (("l2sq", 6), ("cos", None), ("cos", 10), (metrics.dot, 6)):
        with pytest.raises(ValueError, match="ordered"):
            search.range_search(q, noise, which, 1.0, digits=digits, ordered=True)
