"""What the bench measures of the training-data operators besides seconds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import curves
from halyard.llm.common import table


def clusters(spark: SparkSession, rows: int = 10_000, kinds: int = 500, dim: int = 64, seed: int = 0) -> DataFrame:
    """(vec_id, embedding): vectors in tight clusters of about rows / kinds."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(kinds, dim))[r.integers(0, kinds, rows)] + 0.05 * r.normal(size=(rows, dim))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").cache()


def recalls(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """The share of the ten nearest that op10's windows find by themselves, and that its whole search finds, against all distances."""
    out = {}
    for name, vectors in (("given", table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), ("clustered", clusters(spark))):
        pdf = vectors.toPandas()
        ids, x = pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(np.float64)
        want = set()
        for i in np.flatnonzero(ids % 100 == 0):
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            want |= {(int(ids[i]), int(ids[j])) for j in np.argsort(d, kind="stable")[:10]}
        for form, complete in (("windows", False), ("complete", True)):
            got = {(r.query, r.id) for r in curves.search(vectors, F.col("id") % 100 == 0, k=10, complete=complete).collect()}
            out[f"op10_{form}_{name}"] = round(len(got & want) / len(want), 4)
    return out
