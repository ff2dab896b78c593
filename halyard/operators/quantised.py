"""Compressed search: product-quantised residuals are scanned, and the best of them reranked by exact distances.

An index is one Parquet table with a folder for each cell: key, vec, a code of one byte for each piece of the vector,
and how far the decoded vector is from the vector. A search reads codes and these errors alone, some 24 bytes a row
beside the key, and bounds each distance from below: decoded distance minus error. The `rerank` items of least bound
are measured, for which only the cells that hold some of them are read. A query whose `count`-th measured distance is
under its last bound is proven: no other item can be nearer. With `exact`, what isn't proven is compared with every item.

Codebooks are fitted on at most `sample` vectors (the first by a hash of the key), everything else covers all rows.
Vectors that are null, of another length, hold a null, NaN or infinite component, have squares beyond a double or, for
cos, no direction aren't in the index and find nothing. Rows of one key and cell come out together, as many as there are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.operators.search import BROADCAST_QUERIES, GRID, blocks, check_count, knn, spread, top
from halyard.sources import files

#: Candidates that go to every task at most.
BROADCAST_CANDIDATES = 1 << 20
#: Queries and codes of one numpy step.
STEP = (128, 1 << 15)


@dataclass(frozen=True)
class Quantised:
    """An index at `folder`: centres of the cells, and a codebook for each piece of what is left after the centre."""

    folder: str
    which: str
    centres: np.ndarray
    books: list[np.ndarray]
    #: The table's columns and their types.
    kinds: str

    @property
    def ndim(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def rows(self, spark: SparkSession, *columns: str) -> DataFrame:
        return spark.read.schema(self.kinds).parquet(f"{self.folder}/rows").select(*columns)

    def decoded(self, code: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.concatenate([b[code[:, i]] for i, b in enumerate(self.books)], axis=1)

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, cells and errors of some vectors."""
        cell = _nearest(x, self.centres)
        rest, at, code = x - self.centres[cell], 0, []
        for b in self.books:
            code.append(_nearest(rest[:, at : at + b.shape[1]], b))
            at += b.shape[1]
        code = np.stack(code, axis=1).astype(np.uint8)
        far = np.sqrt(((x - self.decoded(code, cell)) ** 2).sum(axis=1))
        # Rounded upwards, so that bounds hold.
        return code, cell, np.nextafter(far.astype(np.float32), np.float32(np.inf))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, size = np.empty(len(x), np.int64), (centres**2).sum(axis=1)
    for lo in range(0, len(x), 8192):
        out[lo : lo + 8192] = (size - 2 * x[lo : lo + 8192] @ centres.T).argmin(axis=1)
    return out


def _means(x: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """`count` means of `x`, at most as many as it has rows."""
    centres = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(12):
        at = _nearest(x, centres)
        n, sums = np.bincount(at, minlength=len(centres))[:, None], np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _points(column: pa.Array, which: str, ndim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a column that can be indexed, and their vectors; of length 1 for cos."""
    own = blocks(column, "l2sq").get(ndim)
    if own is None:
        return np.zeros(0, np.int64), np.zeros((0, ndim))
    if which == "l2sq":
        there = np.isfinite(own.size)
        return own.rows[there], own.data[there]
    most = np.abs(own.data).max(axis=1)
    x = own.data[most > 0] / most[most > 0, None]
    return own.rows[most > 0], x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def build(items: DataFrame, folder: str, ndim: int, which: str = "cos", *, pieces: int = 16, cells: int = 16, sample: int = 20_000, seed: int = 0) -> Quantised:
    """Write an index of items (key, vec) for `which` (cos or l2sq) to a new folder."""
    if which not in ("cos", "l2sq"):
        raise ValueError("an index is for cos or l2sq")
    if not 1 <= pieces <= ndim or cells < 1:
        raise ValueError("pieces must be from 1 to ndim, cells at least 1")
    spark, rng = items.sparkSession, np.random.default_rng(seed)
    items = items.select("key", "vec")
    held = items.where("vec is not null").orderBy(F.xxhash64("key"), "key").limit(sample).select("vec").toArrow()
    x = _points(held.column("vec").combine_chunks(), which, ndim)[1]
    x = x if len(x) else np.zeros((1, ndim))
    centres = _means(x, cells, rng)
    rest = x - centres[_nearest(x, centres)]
    books = [_means(rest[:, p], 256, rng) for p in np.array_split(np.arange(ndim), pieces)]
    kinds = ", ".join([*(f"{c} {items.schema[c].dataType.simpleString()}" for c in items.columns), "code binary", "far float", "cell int"])
    made = Quantised(folder, which, centres, books, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, own = _points(b.column("vec"), which, ndim)
            if len(at):
                code, cell, far = made.encoded(own)
                offsets = np.arange(0, code.size + 1, pieces, dtype=np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(code.tobytes())])
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, raw, pa.array(far), pa.array(cell.astype(np.int32))], [*b.schema.names, "code", "far", "cell"])

    # No row has to be read for the codes' sake: each column lies apart. Large cells are cut into several files.
    items.mapInArrow(run, kinds).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/rows")
    text = {"which": which, "centres": centres.tolist(), "books": [b.tolist() for b in books], "kinds": kinds}
    files.write(spark, f"{folder}/index.json", json.dumps(text).encode())
    return made


def load(spark: SparkSession, folder: str) -> Quantised:
    """The index at `folder`; ValueError where there is none or it wasn't finished."""
    text = files.read(spark, f"{folder}/index.json")
    if text is None:
        raise ValueError(f"no index at {folder}")
    d = json.loads(text)
    return Quantised(folder, d["which"], np.array(d["centres"]), [np.array(b) for b in d["books"]], d["kinds"])


def _scan(index: Quantised, tables: Iterator[pa.Table], ids: pa.Array, asked: np.ndarray, rerank: int) -> Iterator[pa.RecordBatch]:
    """(query_id, key, cell, bound): step by step what may still be among the `rerank` least bounds of a query."""
    best, size = np.full((len(asked), rerank), np.inf), (asked**2).sum(axis=1)
    for t in tables:
        t = t.take(pc.sort_indices(t.column("key"))).combine_chunks()
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, len(index.books))
        x, far = index.decoded(code, t.column("cell").to_numpy()), t.column("far").to_numpy().astype(np.float64)
        sizes = (x**2).sum(axis=1)
        for lo in range(0, len(asked), STEP[0]):
            q, n = asked[lo : lo + STEP[0]], size[lo : lo + STEP[0], None]
            # The product's rounding must not lift a bound.
            bound = np.sqrt(np.maximum(n + sizes - 2 * q @ x.T - 1e-12 * (n + sizes), 0)) - far
            every = np.concatenate([best[lo : lo + STEP[0]], bound], axis=1)
            held = np.partition(every, rerank - 1, axis=1)[:, :rerank]
            r, c = np.nonzero(bound <= held.max(axis=1)[:, None])
            best[lo : lo + STEP[0]] = held
            order = np.lexsort((c, bound[r, c], r))
            r, c = r[order], c[order]
            start = np.flatnonzero(np.concatenate([[True], np.diff(r) != 0])) if len(r) else np.zeros(0, np.int64)
            first = np.arange(len(r)) - np.repeat(start, np.diff([*start, len(r)])) < rerank
            r, c = r[first], c[first]
            if len(r):
                key, cell = (t.column(n).take(pa.array(c)).combine_chunks() for n in ("key", "cell"))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r + lo)), key, cell, pa.array(bound[r, c])], ["query_id", "key", "cell", "bound"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to tables of about STEP[1] rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= STEP[1]:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _candidates(queries: DataFrame, index: Quantised, rerank: int) -> DataFrame:
    """(query_id, key, cell, bound): the `rerank` least bounds of each query; ties to the smaller key."""
    spark = queries.sparkSession
    codes = index.rows(spark, "key", "code", "far", "cell")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {codes.schema['key'].dataType.simpleString()}, cell int, bound double"
    held = queries.limit(BROADCAST_QUERIES + 1).toArrow()
    if held.num_rows <= BROADCAST_QUERIES:
        ids, vectors = held.column("query_id").combine_chunks(), held.column("vec").combine_chunks()

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, asked = _points(vectors, index.which, index.ndim)
            yield from _scan(index, _gathered(batches), ids.take(pa.array(at)), asked, rerank)

        found = spread(codes).mapInArrow(here, kinds)
    else:
        # Codes are small: they are what is sent to each block of queries.
        wide, deep = GRID
        g, h = -(-queries.count() // wide), max(1, -(-codes.count() // (4 * deep)))
        left = queries.select("query_id", "vec", F.pmod(F.xxhash64("query_id"), F.lit(g)).alias("_g"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("_h"))
        right = codes.withColumn("_h", F.pmod(F.xxhash64("key"), F.lit(h)).cast("int")).withColumn("_g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(g - 1).cast("bigint"))))

        def pair(a: pa.Table, b: pa.Table) -> pa.Table:
            empty = pa.schema([a.schema.field("query_id"), b.schema.field("key"), ("cell", pa.int32()), ("bound", pa.float64())])
            at, asked = _points(a.column("vec").combine_chunks(), index.which, index.ndim) if a.num_rows and b.num_rows else ([], [])
            steps = (b.slice(lo, STEP[1]) for lo in range(0, b.num_rows, STEP[1]))
            return pa.Table.from_batches(list(_scan(index, steps, a.column("query_id").take(pa.array(at)).combine_chunks(), asked, rerank)) if len(at) else [], empty)

        found = left.groupBy("_g", "_h").cogroup(right.groupBy("_g", "_h")).applyInArrow(pair, kinds)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("bound", "key"))
    return found.withColumn("_place", place).where(F.col("_place") <= rerank).drop("_place")


def _measured(pairs: DataFrame, which: str, ndim: int, digits: int | None) -> DataFrame:
    """(query_id, key, distance) of pairs (query_id, key, _query, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, x = (b.column(n).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, ndim) for n in ("_query", "vec"))
            if which == "l2sq":
                d = ((q - x) ** 2).sum(axis=1)
            else:
                q, x = (a / np.abs(a).max(axis=1, keepdims=True) for a in (q, x))
                d = 1 - (q * x).sum(axis=1) / np.sqrt((q**2).sum(axis=1) * (x**2).sum(axis=1))
            d = (np.floor(d * 10**digits + 0.5) / 10**digits if digits is not None else d) + 0.0
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("key"), pa.array(d)], ["query_id", "key", "distance"])

    kinds = ", ".join([*(f"{n} {pairs.schema[n].dataType.simpleString()}" for n in ("query_id", "key")), "distance double"])
    return pairs.select("query_id", "key", "_query", "vec").mapInArrow(run, kinds)


def knn_quantised(queries: DataFrame, index: Quantised, count: int = 10, *, rerank: int = 200, exact: bool = False, digits: int | None = None, stats: dict | None = None) -> DataFrame:
    """(query_id, rank, key, distance), as `knn`: the nearest among the `rerank` items of least bound for each query (query_id, vec).

    Approximate, and its recall grows with `rerank`; with `exact`, queries that the bounds don't prove are compared with
    every item. Query ids are distinct. `stats` gets the numbers of candidates, of cells read for them and of proven queries.
    """
    check_count(count)
    if rerank < count:
        raise ValueError("rerank must be at least count")
    spark, queries = queries.sparkSession, queries.select("query_id", "vec")
    folder = f"{files.shared(spark)}/halyard/quantised-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    found = kept(_candidates(queries, index, rerank), "candidates")
    n, cells = found.count(), sorted(r.cell for r in found.select("cell").distinct().collect())
    asked = found.select("query_id", "key", "cell").distinct()
    near = index.rows(spark, "key", "vec", "cell").where(F.col("cell").isin(cells))
    pairs = near.join(F.broadcast(asked) if n <= BROADCAST_CANDIDATES else asked, ["key", "cell"])
    pairs = pairs.join(queries.withColumnRenamed("vec", "_query"), "query_id")
    best = kept(top(_measured(pairs, index.which, index.ndim, digits), count), "best").drop("rank")
    if exact or stats is not None:
        slack = 1e-12 + (10.0**-digits if digits is not None else 0)
        reach = F.sqrt((2.0 if index.which == "cos" else 1.0) * (F.greatest(F.max("distance"), F.lit(0.0)) * (1 + 1e-9) + slack))
        last = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("bound").alias("bound"))
        sure = best.groupBy("query_id").agg(reach.alias("reach"), F.count(F.lit(1)).alias("own")).join(last, "query_id")
        proven = kept(sure.where((F.col("n") < rerank) | (F.col("own") >= count) & (F.col("reach") < F.col("bound"))).select("query_id"), "proven")
        if stats is not None:
            stats |= {"candidates": n, "cells": len(cells), "proven": proven.count()}
        if exact:
            open_ = queries.join(proven, "query_id", "left_anti")
            rest = knn(open_, index.rows(spark, "key", "vec"), index.which, count, digits=digits).drop("rank")
            best = best.join(proven, "query_id", "left_semi").unionByName(rest)
    return top(best, count).select("query_id", "rank", "key", "distance")
