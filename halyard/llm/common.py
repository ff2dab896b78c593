"""What the training-data operators share: words, batches, and the shared scratch folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.sources import files

#: A word is a run of characters other than space and the ASCII controls 0x09 to 0x0D.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Text bytes that one numpy step works on, so that its arrays stay within some tens of MB.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: The cluster's shared folder.
scratch = files.shared


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: what follows reads replicated files and outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/halyard/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.halyard_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialise` wrote, once nothing that is still to be computed reads them."""
    for t in tables:
        files.delete(t.sparkSession, t.halyard_path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` has about `limit` bytes in each; a longer row stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; then give the memory back that Arrow holds for later, as the worker may idle beside others."""
    yield from batches
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift), vectorised."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def join_size_checked(big: DataFrame, ids: DataFrame, key: str, limit: int, how: str = "left_semi") -> DataFrame:
    """Join on `key`; broadcast `ids` only if its counted rows stay within `limit`, else shuffle both sides."""
    small = ids.limit(limit + 1).count() <= limit
    return big.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)


#: Keys that `frequent` gives at most.
FREQUENT_KEYS = 1 << 16


def frequent(sample: DataFrame, key: str, least: int = 8) -> DataFrame:
    """(key): the keys of `least` rows of a sample or more, and of a FREQUENT_KEYSth of all; so there are no more than FREQUENT_KEYS.

    For dealing hot keys apart: what is found here changes where rows go, never what comes out.
    """
    counts = materialise(sample.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where(F.col("n") >= total / FREQUENT_KEYS).select(key)
