"""Candidate joins against brute force."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from halyard.functions import codes
from halyard.operators import candidates


def prefix_distance(x: bytes, y: bytes) -> Fraction:
    n = min(len(x), len(y))
    return Fraction(sum((a ^ b).bit_count() for a, b in zip(x, y)), 8 * n)


@pytest.mark.parametrize("radius", [0.0, 0.1, 0.25])
def test_prefix_join_equals_brute_force(spark, radius):
    rng = random.Random(5)
    base = [rng.randbytes(32) for _ in range(12)]
    rows = [(0, None), (1, b""), (2, base[0]), (3, base[0])]
    for key in range(4, 160):
        x = bytearray(rng.choice(base)[: rng.choice([1, 2, 5, 8, 9, 16, 24, 32])])
        for _ in range(rng.randrange(4)):
            x[rng.randrange(len(x))] ^= 1 << rng.randrange(8)
        rows.append((key, bytes(x)))
    df = spark.createDataFrame(rows, "key bigint, raw binary").select("key", codes.pack(F.col("raw")).alias("code"))
    found = candidates.nphd_join(df, radius)
    want = {(a, b): d for a, x in rows for b, y in rows if a < b and x and y and (d := prefix_distance(x, y)) <= Fraction(str(radius))}
    got = [((r.a, r.b), r.distance) for r in found.collect()]
    assert len(got) == len(want) > 0 and dict(got) == {k: pytest.approx(float(d)) for k, d in want.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_prefix_join_of_nothing(spark):
    none = spark.createDataFrame([(1, None), (2, b"")], "key bigint, raw binary").select("key", codes.pack(F.col("raw")).alias("code"))
    assert candidates.nphd_join(none, 0.1).count() == 0 == candidates.nphd_join(none.limit(0), 0.1).count()
    with pytest.raises(ValueError):
        candidates.nphd_join(none, 1.0)
