"""The radius join by pivots against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from halyard.functions import codes
from halyard.operators import candidates, search


def found(df):
    got = sorted(tuple(r) for r in df.collect())
    assert len({r[:2] for r in got}) == len(got)
    return got


@pytest.mark.parametrize("which, radius", [("cos", 0.002), ("cos", 0.3), ("l2sq", 0.5), ("l2sq", 30.0), ("cos", 2.0)])
def test_vectors(spark, which, radius):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(20, 8)), 15, axis=0) + 0.03 * rng.normal(size=(300, 8))
    x[:9] = x[0]
    odd = [(400, None), (401, [0.0] * 8), (402, [1.0, 2.0]), (403, [1.0, 2.1]), (404, [None] * 8), (405, [float("nan")] * 8), (406, [])]
    items = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *odd], "key bigint, vec array<double>").withColumn("cell", F.lit(1))
    stats = {}
    got = found(candidates.pivot_pairs(items, which, radius, digits=6, block=16, stats=stats))
    assert got == found(search.range_pairs(items, which, radius, digits=6)) and got
    if radius in (0.002, 0.5):
        # Few copies where clusters are far from each other.
        assert stats["cells"] > 10 and stats["rows"] < 2 * 305


@pytest.mark.parametrize("radius", [0, 3, 12])
def test_codes(spark, radius):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(0, 256, (12, 8)), 20, axis=0)
    for i in range(len(x)):
        for at in rng.integers(0, 64, rng.integers(0, 4)):
            x[i, at // 8] ^= 1 << (at % 8)
    df = spark.createDataFrame([*((i, bytes(v.tolist())) for i, v in enumerate(x)), (500, None)], "key bigint, raw binary").select("key", codes.pack(F.col("raw")).alias("vec"))
    got = found(candidates.pivot_pairs(df, "hamming", radius, block=24))
    assert got == found(search.range_pairs(df, "hamming", radius)) and got


@pytest.mark.parametrize("radius", [0.05, 0.65])
def test_rows_are_dealt_once_whatever_the_radius(spark, monkeypatch, tmp_path, radius):
    """Noise, where most cells meet: rows aren't copied to the cells that they visit."""
    monkeypatch.setattr(candidates, "PACK", 40)
    monkeypatch.setattr(candidates, "AROUND", 64)
    monkeypatch.setattr(candidates.files, "shared", lambda _: str(tmp_path))
    x = np.random.default_rng(6).normal(size=(600, 16))
    x[:200] = x[0] + 0.01 * x[:200]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key bigint, vec array<double>").repartition(3)
    stats = {}
    got = found(candidates.pivot_pairs(items, "cos", radius, digits=6, block=16, stats=stats))
    assert got == found(search.range_pairs(items, "cos", radius, digits=6, block=100)) and got
    (folder,) = (tmp_path / "halyard").glob("pivots-*")
    assert stats["rows"] > 1000 and spark.read.parquet(f"{folder}/dealt").where("size is null").count() == 600
    blocks = [search.unpacked(pa.scalar(bytes(r.body))).num_rows for r in spark.read.parquet(f"{folder}/blocks").collect()]
    assert sum(blocks) == 600 and len(blocks) > 10


def test_nothing_and_wrong_arguments(spark):
    none = spark.createDataFrame([], "key bigint, vec array<double>")
    assert found(candidates.pivot_pairs(none, "cos", 0.1)) == []
    with pytest.raises(ValueError):
        candidates.pivot_pairs(none, "nphd", 0.1)
    with pytest.raises(ValueError):
        candidates.pivot_pairs(none, "cos", -1.0)
