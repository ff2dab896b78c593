"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, once for each curve and with another shift, and ordered by the
Hilbert key of the cell they fall in; Spark range-partitions and sorts these orders. A curve's order is cut
into blocks of equal size, whatever the keys' frequencies, so that a query's neighbouring key windows are its
own block and the ones beside it. The windows of all curves are searched, merged and reranked by exact
distance.

A curve's order holds ids only; vectors, in the type they came in, meet their places once for the windows and once
for what follows.

With `complete`, the windows then widen until nothing nearer can be left out: a block has a centre and a
radius, a batch of queries likewise, and a block is searched for a batch if the triangle inequality lets it
hold a vector nearer than the batch's worst k-th neighbour so far. On clustered vectors few blocks are; on
noise of many dimensions all are, and the search is then the stated queries against all rows, in blocks: a
block is sent once for each BATCH queries that need it.

Defined cases: vectors that are null, zero, of another length than most, or hold a null, NaN or infinite
component take no part, nor do null ids; an id that comes more than once counts by its nearest vector and
isn't its own neighbour; rows alike in both go once; ties go to the smaller id; an empty table gives an empty
one; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import col, materialise

#: Curves, projected dimensions, bits of each, rows of a window block, and of a block and a batch of the complete search.
CURVES, DIMS, BITS, WINDOW, BLOCK, BATCH = 4, 8, 7, 256, 32_768, 8_192


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert keys of rows of cell numbers (each of `bits` bits; at most 63 in all)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work, from the highest bit
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, distance) of the k nearest ids of each query, by their nearest rows; products choose, differences measure."""
    places, found, scores = [], [], []
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    last = min(k, len(first)) - 1
    norms, largest = (rows * rows).sum(1), None
    for lo in range(0, len(queries), 128):
        part = queries[lo : lo + 128]
        size = (part * part).sum(1)
        rough = size[:, None] + norms[None] - 2 * part @ rows.T
        rough[own[lo : lo + 128, None] == ids[None]] = np.inf
        largest = 1e-9 * (size + norms.max())
        # The k-th nearest id, not row: copies of one id must not use up the places of others.
        each = rough if len(first) == len(ids) else np.minimum.reduceat(rough, first, axis=1)
        kth = np.partition(each, last, axis=1)[:, last]
        for i, limit in enumerate(np.where(np.isfinite(kth), kth + largest, np.finfo(float).max)):
            near = np.flatnonzero(rough[i] <= limit)
            # Running sums add in the components' order, as a plain loop would.
            d = np.sqrt(((rows[near] - part[i]) ** 2).cumsum(1)[:, -1])
            best = np.lexsort((ids[near], d))
            if len(first) < len(ids):
                best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])]
            best = best[:k]
            places.append(np.full(len(best), lo + i))
            found.append(ids[near][best])
            scores.append(d[best])
    return np.concatenate(places), np.concatenate(found), np.concatenate(scores)


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, h, vec) of the usable rows, h a hash of the vector, and its length."""
    v = col(vec_col)
    kind = vectors.select(v.alias("v")).schema["v"].dataType.elementType.simpleString()
    sound = ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(col(id_col).isNotNull() & v.isNotNull() & sound).select(col(id_col).cast("bigint").alias("id"), F.xxhash64(v).alias("h"), v.cast(f"array<{'float' if kind == 'float' else 'double'}>").alias("vec"))
    most = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = most.n if most else 1
    return rows.where(F.size("vec") == dim), dim


def _orders(rows: DataFrame, dim: int, curves: int, seed: int) -> DataFrame:
    """(curve, rank, id, h): every different row's place in each curve's order."""
    r = np.random.default_rng(seed)
    dims = min(DIMS, dim)
    project, shifts = r.normal(size=(curves, dim, dims)), r.random((curves, dims))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate(list(_matrix(b.column("vec"), dim) @ project), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([p.sum(0)], pa.list_(pa.float64())), pa.array([(p * p).sum(0)], pa.list_(pa.float64()))], ["n", "s", "q"])

    parts = rows.mapInArrow(sums, "n bigint, s array<double>, q array<double>").select("n", F.posexplode(F.arrays_zip("s", "q")).alias("i", "x"))
    scale = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.q").alias("q")).orderBy("i").collect()
    mean = np.array([x.s / x.n for x in scale] or [0.0] * curves * dims).reshape(curves, dims)
    spread = np.sqrt(np.maximum(np.array([x.q / x.n for x in scale] or [1.0] * curves * dims).reshape(curves, dims) - mean**2, 1e-300))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec"), dim)
            for c in range(curves):
                even = 1 / (1 + np.exp(np.clip(-1.702 * (x @ project[c] - mean[c]) / spread[c], -700, 700)))
                cells = np.minimum((even + shifts[c]) / 2 * (1 << BITS), (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert(cells, BITS)), b.column("id"), b.column("h")], ["curve", "cell", "id", "h"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = TaskContext.get().partitionId(), np.zeros(curves, np.int64), None
        for b in batches:
            keys = np.stack([b.column(x).to_numpy().astype(np.int64) for x in ("curve", "id", "h")], axis=1)
            # Rows alike lie together, and count once.
            new = np.any(keys != np.concatenate([keys[:1] - 1 if last is None else last[None], keys[:-1]]), axis=1)
            last, b, c = keys[-1] if len(keys) else last, b.filter(pa.array(new)), keys[new, 0]
            pos = np.zeros(len(c), np.int64)
            for i in np.unique(c):
                own = c == i
                pos[own] = at[i] + np.arange(own.sum())
                at[i] += own.sum()
            yield pa.RecordBatch.from_arrays([b.column("curve"), pa.array(np.full(len(c), part, np.int32)), pa.array(pos), b.column("id"), b.column("h")], ["curve", "part", "pos", "id", "h"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["curve", "cell", "id", "h"]
    order = rows.mapInArrow(keyed, "curve int, cell bigint, id bigint, h bigint").repartitionByRange(parts, *by).sortWithinPartitions(*by)
    order = materialise(order.select("curve", "id", "h").mapInArrow(placed, "curve int, part int, pos bigint, id bigint, h bigint"), "order")
    # One row for each curve and partition.
    offset = F.coalesce(F.sum("count").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = order.groupBy("curve", "part").count().withColumn("offset", offset).drop("count")
    return order.join(F.broadcast(offsets), ["curve", "part"]).select("curve", (F.col("pos") + F.col("offset")).alias("rank"), "id", "h")


def _search(rows: DataFrame, queries: DataFrame, keys: list[str], dim: int, k: int) -> DataFrame:
    """(query, id, score): in each group of `keys`, the k nearest of rows (id, vec) to each of queries (query, vec)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        own = right.column("query").to_numpy()
        at, ids, scores = nearest(_matrix(right.column("qvec").combine_chunks(), dim), own, _matrix(left.column("vec").combine_chunks(), dim), left.column("id").to_numpy(), k)
        other = ids != own[at]
        return pa.table({"query": own[at][other], "id": ids[other], "score": scores[other]})

    left = rows.select(*[F.col(x).alias(f"row_{x}") for x in keys], "id", "vec")
    right = queries.select(*[F.col(x).alias(f"query_{x}") for x in keys], F.col("query"), F.col("vec").alias("qvec"))
    return left.groupBy(*[f"row_{x}" for x in keys]).cogroup(right.groupBy(*[f"query_{x}" for x in keys])).applyInArrow(run, "query bigint, id bigint, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query", "id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))).where(F.col("rank") <= k)


def _balls(rows: DataFrame, dim: int, name: str) -> DataFrame:
    """(name, centre, radius, reach) of each group by `name`; reach is the largest of the rows' `reach`."""

    def ball(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("vec").combine_chunks(), dim)
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max())
        return pa.table({name: t.column(name).slice(0, 1), "centre": pa.array([centre], pa.list_(pa.float64())), "radius": pa.array([radius]), "reach": pa.array([float(np.max(t.column("reach").to_numpy()))])})

    return rows.groupBy(name).applyInArrow(ball, f"{name} bigint, centre array<double>, radius double, reach double")


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, curves: int = CURVES, complete: bool = True, seed: int = 0) -> DataFrame:
    """(query, rank, id, score): the k nearest of all other vectors to each that `is_query` (a condition on `id`) picks."""
    rows, dim = _usable(vectors, id_col, vec_col)
    order = _orders(rows, dim, curves, seed)
    once = rows.dropDuplicates(["id", "h"])
    block = F.floor(F.col("rank") / WINDOW)
    placed = order.join(once, ["id", "h"])
    asked = order.where(is_query).join(once.where(is_query), ["id", "h"]).select("curve", F.explode(F.array(block - 1, block, block + 1)).alias("block"), F.col("id").alias("query"), "vec")
    found = materialise(_best(_search(placed.select("curve", block.alias("block"), "id", "vec"), asked, ["curve", "block"], dim, k), k), "windows")
    if complete:
        far = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).otherwise(float("inf")).alias("reach"))
        first = order.where("curve = 0")
        blocks = first.join(once, ["id", "h"]).select(F.floor(F.col("rank") / BLOCK).alias("block"), "id", "vec")
        span = F.floor(F.col("rank") / (BATCH * 128))
        asked = first.where(is_query).withColumn("sub", F.floor((F.row_number().over(Window.partitionBy(span).orderBy("rank")) - 1) / BATCH)).select("id", "h", (span * 1024 + F.col("sub")).cast("bigint").alias("batch"))
        asked = asked.join(once.where(is_query), ["id", "h"]).join(far.withColumnRenamed("query", "id"), "id", "left")
        asked = materialise(asked.select("batch", F.col("id").alias("query"), "vec", F.coalesce("reach", F.lit(float("inf"))).alias("reach")), "batches")
        a = _balls(asked, dim, "batch")
        b = _balls(blocks.withColumn("reach", F.lit(0.0)), dim, "block").drop("reach").toDF("block", "other", "size")
        apart = F.sqrt(F.aggregate(F.zip_with("centre", "other", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        # A row for each batch of queries and block of rows: the stated queries against all rows, in blocks.
        pairs = materialise(a.crossJoin(b).where(apart - F.col("radius") - F.col("size") <= F.col("reach") * (1 + 1e-9)).select("batch", "block"), "pairs")
        more = _search(blocks.join(pairs, "block"), asked.select("batch", "query", "vec").join(pairs, "batch"), ["batch", "block"], dim, k)
        found = _best(found.select("query", "id", "score").unionByName(more), k)
    return found.select("query", "rank", "id", "score")
