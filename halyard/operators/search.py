"""Nearest-neighbour and radius joins, exact by default.

Results have a row for each match: query_id, rank, key, distance. Ties go to the smaller key. A query without
matches has no row; nothing is padded.

The named distances run block by block in numpy, inside Spark's tasks: up to BROADCAST_QUERIES queries (counted)
go to every task and meet the items where these lie; more are packed, like the items, to blocks of bounded size,
and tasks read pairs of these. A task holds the nearest of its queries and gives out no others. A distance of your own
runs so too if it is registered with a function of arrays; else it is a Column expression over a cross join with
the queries, evaluated once for each pair. A vector that is null or holds a null, NaN or
infinite component has no distance to anything, nor have vectors of different lengths to each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions import metrics
from halyard.functions.metrics import Metric, metric
from halyard.sources import files

#: Queries that go to every task at most.
BROADCAST_QUERIES = 20_000
#: Beyond, queries and items of a pair of blocks; where all pairs within a radius are wanted, smaller ones.
GRID, RADIUS_GRID = (20_000, 65_536), (2_048, 8_192)
#: Queries and items of one numpy step.
STEP = (256, 2_048)
#: Distances that run in blocks.
BLOCKS = {metrics.cos: "cos", metrics.l2sq: "l2sq", metrics.hamming: "hamming", metrics.nphd: "nphd"}


def _kind(which: Metric) -> str | Callable | None:
    """How a distance runs in blocks, None where it only runs as a Column."""
    return BLOCKS.get(which) or metrics.ARRAYS.get(which)



def check_count(count: int) -> None:
    if count < 1:
        raise ValueError(f"`count` must be >= 1, got {count}")


# Blocks


@dataclass
class Block:
    """Vectors or codes of one block, as arrays; `rows` says which of the block's rows they are."""

    rows: np.ndarray
    data: np.ndarray
    #: Sums of squares, or numbers of bits.
    size: np.ndarray


def blocks(column: pa.Array, which: str) -> dict[int, Block]:
    """The usable vectors of a column by length (codes: all under 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.take(pa.array(there))
    if which in ("hamming", "nphd"):
        words = column.field("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, 4)
        return {0: Block(there, words, column.field("bits").to_numpy(zero_copy_only=False).astype(np.int64))} if len(there) else {}
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    found = {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        own = np.flatnonzero(lengths == n)
        x = column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        good = np.isfinite(x).all(axis=1)
        found[n] = Block(there[own[good]], x[good], (x[good] ** 2).sum(axis=1))
    return found


def distances(q: Block, x: Block, which: str | Callable) -> np.ndarray:
    """The distance of each query to each item; NaN where there is none."""
    if callable(which):
        return which(q.data, x.data)
    if which == "cos":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - q.data @ x.data.T / (np.sqrt(q.size)[:, None] * np.sqrt(x.size)[None])
    if which == "l2sq":
        return np.maximum(q.size[:, None] + x.size[None] - 2 * q.data @ x.data.T, 0)
    return _differing(q.data, x.data, 256).astype(np.float64)


def _differing(q: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    """How many of their first `bits` bits each query and item differ in."""
    out = None
    for w in range(-(-bits // 64)):
        a, b = q[:, w], x[:, w]
        if bits - 64 * w < 64:
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(64 - (bits - 64 * w))
            a, b = a & mask, b & mask
        if w == 0:
            out = np.bitwise_count(a[:, None] ^ b[None]).astype(np.uint16)
        elif a.any() or b.any():
            out += np.bitwise_count(a[:, None] ^ b[None])
    return out


def _classes(x: Block) -> list[Block]:
    """Codes by their number of bits, none for empty ones."""
    return [Block(x.rows[x.size == n], x.data[x.size == n], x.size[x.size == n]) for n in np.unique(x.size[x.size > 0])]


def _together(q: dict[int, Block], x: dict[int, Block], which: str | Callable) -> Iterator[tuple[Block, Block]]:
    """Queries and items that have distances: vectors of one length, codes of any two."""
    for n in q.keys() & x.keys():
        if which == "nphd":
            others = _classes(x[n])
            yield from ((a, b) for a in _classes(q[n]) for b in others)
        else:
            yield q[n], x[n]


def _matches(q: dict[int, Block], x: dict[int, Block], which: str | Callable, first: np.ndarray | None, count: int | None, radius: float | None, digits: int | None, best: np.ndarray | None = None, reach: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the query, row of the item, distance), step by step: the `count` nearest, or all within `radius`.

    Items lie in the order of their keys. `first` has, for a step's items, the place of each key's first row:
    then a key counts by its nearest row, and the `count` nearest keys' rows come out. `best` holds the `count` least
    distances of each query so far, and gets those of the step: what can't be among them doesn't come out. `reach`
    has a radius of each query's own.
    """
    for asked_, items_ in _together(q, x, which):
        bits = int(min(asked_.size[0], items_.size[0])) if which == "nphd" and len(asked_.rows) and len(items_.rows) else None
        for lo in range(0, len(items_.rows), STEP[1]):
            items = Block(*(a[lo : lo + STEP[1]] for a in (items_.rows, items_.data, items_.size)))
            for at in range(0, len(asked_.rows), STEP[0]):
                asked = Block(*(a[at : at + STEP[0]] for a in (asked_.rows, asked_.data, asked_.size)))
                # Of codes, the number of bits is compared, not its share.
                unit = bits or 1
                d = _differing(asked.data, items.data, bits) if bits else distances(asked, items, which)
                if which == "hamming" or bits:
                    ok = None
                else:
                    ok = np.isfinite(d)
                    d = d if ok.all() else np.where(ok, d, np.inf)
                # Products choose, differences measure; both and the rounding may move the border by this much.
                loose = 1e-9 * (1 + (asked.size[:, None] if which == "l2sq" else 0) + (items.size.max() if which == "l2sq" else 0)) + (10.0**-digits if digits is not None else 0)
                if callable(which):
                    loose = loose + 1e-9 * np.sqrt(asked.size)[:, None] * np.sqrt(items.size.max())
                limit = np.full((len(asked.rows), 1), np.inf) if radius is None else np.full((len(asked.rows), 1), radius + loose)
                if reach is not None:
                    limit = np.minimum(limit, reach[asked.rows][:, None] + loose)
                if count is not None and best is None:
                    each = d if first is None else np.minimum.reduceat(d, np.flatnonzero(np.concatenate([[True], np.diff(first[items.rows]) != 0])), axis=1)
                    kth = np.partition(each, min(count, each.shape[1]) - 1, axis=1)[:, min(count, each.shape[1]) - 1, None]
                    limit = np.minimum(limit, kth / unit + loose)
                elif count is not None:
                    limit = np.minimum(limit, best[asked.rows].max(axis=1)[:, None] + loose)
                border = np.floor(np.minimum(limit * unit + 1e-6, 60_000)).astype(np.uint16) if bits else limit
                r, c = _within(d, border)
                if best is not None and count is not None and len(r):
                    own = d[r, c] / unit
                    # Ties come out, but improve nothing.
                    less = own < best[asked.rows].max(axis=1)[r]
                    if less.any():
                        _improve(best, asked.rows, r[less], own[less], count)
                    keep = own <= best[asked.rows].max(axis=1)[r] + (loose if np.ndim(loose) == 0 else loose[r, 0])
                    r, c = r[keep], c[keep]
                if ok is not None and len(r):
                    keep = np.isfinite(d[r, c])
                    r, c = r[keep], c[keep]
                own = ((asked.data[r] - items.data[c]) ** 2).sum(axis=1) if which == "l2sq" else d[r, c] / unit
                own = (np.floor(own * 10**digits + 0.5) / 10**digits if digits is not None else own) + 0.0
                keep = np.ones(len(r), bool) if radius is None else own <= radius
                if count is not None and first is None:
                    order = np.lexsort((c, own, r))
                    order = order[keep[order]]
                    start = np.flatnonzero(np.concatenate([[True], np.diff(r[order]) != 0])) if len(order) else np.zeros(0, np.int64)
                    place = np.arange(len(order)) - np.repeat(start, np.diff([*start, len(order)]))
                    order = order[place < count]
                else:
                    order = np.flatnonzero(keep)
                yield asked.rows[r[order]], items.rows[c[order]], own[order]


def _within(d: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where d is at most its row's border."""
    at = np.flatnonzero(d <= border)
    return at // d.shape[1], at % d.shape[1]


def _improve(best: np.ndarray, rows: np.ndarray, r: np.ndarray, d: np.ndarray, count: int) -> None:
    """Put distances d of the step's rows r (in order) among the least of each."""
    some, start, n = np.unique(r, return_index=True, return_counts=True)
    more = np.full((len(some), n.max()), np.inf)
    more[np.repeat(np.arange(len(some)), n), np.arange(len(r)) - np.repeat(start, n)] = d
    at = rows[some]
    best[at] = np.partition(np.concatenate([best[at], more], axis=1), count - 1, axis=1)[:, :count]


#: Matches of a task that are ordered at once, at most: 8 bytes each.
ORDERED = 1 << 25


def _nearest_first(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], queries: int, items: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The matches of so many queries and items by distance, then by their rows: each is one whole number while it is held and sorted."""
    held, n, scale = np.empty(queries * items, np.int64), 0, 10**digits
    for r, c, d in found:
        held[n : n + len(r)] = np.rint(d * scale).astype(np.int64) * (queries * items) + r * items + c
        n += len(r)
    held = held[:n]
    held.sort()
    for lo in range(0, n, 1 << 16):
        d, at = np.divmod(held[lo : lo + (1 << 16)], queries * items)
        yield at // items, at % items, d / scale


#: Distances held of all queries of a task at most.
HELD = 1 << 23


def _kernel(which: str | Callable, names: list[str], count: int | None, radius: float | None, digits: int | None, multi: bool, counted: bool = False, ordered: bool = False) -> Callable[[pa.Table | pa.RecordBatch, dict[int, Block], pa.Array], Iterator[pa.RecordBatch]]:
    """Batches (query_id, the items' columns `names`, distance) of one batch of items and the queries' blocks.

    With `counted`, also a column `pairs`: null for matches, and one row for each batch with the distances computed.
    With `ordered`, the batch's matches come nearest first.
    """

    def run(items: pa.Table | pa.RecordBatch, asked: dict[int, Block], ids: pa.Array, best: np.ndarray | None = None, reach: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if "key" in names:
            items = items.take(pc.sort_indices(items.column("key")))
        first = None
        if multi:
            key = items.column("key").combine_chunks() if isinstance(items, pa.Table) else items.column("key")
            first = np.concatenate([[0], np.cumsum(pc.not_equal(key.slice(1), key.slice(0, max(0, len(key) - 1))).to_numpy(zero_copy_only=False))]) if len(key) else np.zeros(0, np.int64)
        own = blocks(items.column("vec"), "l2sq" if callable(which) else which)
        more = ["pairs"] if counted else []
        found = _matches(asked, own, which, first, count, radius, digits, best, reach)
        for r, c, d in _nearest_first(found, len(ids), items.num_rows, digits) if ordered else found:
            if len(r):
                cols = [items.column(n).take(pa.array(c)) for n in names]
                cols = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in cols]
                nothing = [pa.nulls(len(r), pa.int64())] if counted else []
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), *cols, pa.array(d), *nothing], ["query_id", *names, "distance", *more])
        if counted:
            n = sum(len(asked[k].rows) * len(own[k].rows) for k in asked.keys() & own.keys())
            kinds = [ids.type, *(items.schema.field(x).type for x in names), pa.float64()]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([n], pa.int64())], ["query_id", *names, "distance", *more])

    return run


def spread(df: DataFrame) -> DataFrame:
    """Small inputs (by the optimizer's estimate), which may lie in one split, over all cores; large ones stay as they are."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(parts) if size <= parts << 27 else df


#: Files of a table of packed blocks at most: pairs of files are tasks.
FILES = 64


def packed(rows: DataFrame, folder: str, count: int) -> DataFrame:
    """`rows` with their column `block` (0 to `count` - 1), written as one row (block, body) for each block; `unpacked` reads a body.

    A cross join of such tables reads its pairs of blocks where they lie: rows are shuffled and written once, however
    many blocks theirs is compared with.
    """

    def pack(t: pa.Table) -> pa.Table:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, t.schema) as w:
            w.write_table(t.combine_chunks())
        return pa.table({"block": t.column("block").slice(0, 1), "body": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    kind = f"block {rows.schema['block'].dataType.simpleString()}, body binary"
    rows.repartition(max(1, min(count, FILES)), "block").groupBy("block").applyInArrow(pack, kind).write.parquet(folder)
    return rows.sparkSession.read.schema(kind).parquet(folder)


def crossed(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of packed blocks; each pair of their files is a task, which has the pairs of one block after another."""
    return a.hint("shuffle_replicate_nl").crossJoin(b)


def unpacked(body: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(body.as_buffer()).read_all()


def block_pairs(batches: Iterator[pa.RecordBatch], *, apart: bool = False) -> Iterator[tuple[int, int, pa.Table, pa.Table]]:
    """(lo, hi, rows of the one, rows of the other) of each pair of blocks (lo, x, hi, y), of one table or, `apart`, of two; a block is read once for a row of pairs."""
    at, x = None, None
    for b in batches:
        for i in range(b.num_rows):
            lo, hi = b.column("lo")[i].as_py(), b.column("hi")[i].as_py()
            if lo != at:
                at, x = lo, unpacked(b.column("x")[i])
            yield lo, hi, x, x if lo == hi and not apart else unpacked(b.column("y")[i])


#: Rows of a packed block of queries, and of items: vectors, codes.
QUERY_BLOCK, ITEM_BLOCK = {"vec": 4_096, "code": 8_192}, {"vec": 8_192, "code": 16_384}


def _meet(queries: DataFrame, items: DataFrame, make: Callable[[pa.Table], tuple[Callable, Callable]], kind: str, size: str = "vec") -> DataFrame:
    """Queries against all items: `make` of some queries gives what to do with a batch of items, and what to do at the end.

    Up to BROADCAST_QUERIES queries (counted) go to every task; more are packed to blocks, as are the items, and each
    task reads some blocks of both: no row is shuffled more often than once.
    """
    held = queries.limit(BROADCAST_QUERIES + 1).toArrow()
    if held.num_rows <= BROADCAST_QUERIES:

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step, end = make(held)
            for b in batches:
                yield from step(b)
            yield from end()

        return spread(items).mapInArrow(here, kind)
    folder = f"{files.shared(items.sparkSession)}/halyard/blocks-{uuid.uuid4().hex}"
    g, h = max(1, -(-queries.count() // QUERY_BLOCK[size])), max(1, -(-items.count() // ITEM_BLOCK[size]))
    left = packed(queries.withColumn("block", F.pmod(F.xxhash64(*queries.columns), F.lit(g)).cast("int")), f"{folder}/queries", g)
    right = packed(items.withColumn("block", F.pmod(F.xxhash64(*items.columns), F.lit(h)).cast("int")), f"{folder}/items", h)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step, end = None, None, tuple
        for lo, _, x, y in block_pairs(batches, apart=True):
            if lo != at:
                yield from end()
                at, (step, end) = lo, make(x)
            yield from step(y)
        yield from end()

    return crossed(left.toDF("lo", "x"), right.toDF("hi", "y")).mapInArrow(cross, kind)


def _in_blocks(queries: DataFrame, items: DataFrame, which: str | Callable, *, count: int | None = None, radius: float | None = None, digits: int | None = None, multi: bool = False, counted: bool = False, ordered: bool = False) -> DataFrame:
    """(query_id, items' columns but vec, distance, with `counted` pairs): the `count` nearest that a task finds, or all within `radius`."""
    names = [c for c in items.columns if c != "vec"]
    own = [c for c in ("query_id", "vec", "reach") if c in queries.columns]
    q = queries.select(*own)
    kind = ", ".join([f"query_id {q.schema['query_id'].dataType.simpleString()}", *(f"{n} {items.schema[n].dataType.simpleString()}" for n in names), "distance double", *(["pairs bigint"] if counted else [])])
    run, shape = _kernel(which, names, count, radius, digits, multi, counted, ordered), "l2sq" if callable(which) else which
    most = ORDERED

    def make(t: pa.Table) -> tuple[Callable, Callable]:
        ids, asked = t.column("query_id").combine_chunks(), blocks(t.column("vec"), shape)
        if ordered:

            def parts(b: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
                n = max(1, -(-b.num_rows // max(1, -(-b.num_rows * len(ids) // most))))
                for lo in range(0, b.num_rows, n):
                    yield from run(b.slice(lo, n), asked, ids)

            return parts, tuple
        reach = t.column("reach").to_numpy() if "reach" in own else None
        keep = count is not None and not multi and len(ids) * count <= HELD
        best = np.full((len(ids), count), np.inf) if keep else None
        if not keep or counted or "key" not in names:
            return (lambda b: run(b, asked, ids, best, reach)), tuple
        # What is held: the rows of all steps, cut to the nearest ones whenever there are many.
        rows, held, n = pa.array(np.arange(len(ids))), [], 0

        def cut() -> list[pa.RecordBatch]:
            if not held:
                return []
            t = pa.Table.from_batches(held)
            t = t.take(pc.sort_indices(t, [("query_id", "ascending"), ("distance", "ascending"), ("key", "ascending")])).combine_chunks()
            r = t.column("query_id").to_numpy()
            start = np.flatnonzero(np.concatenate([[True], np.diff(r) != 0]))
            place = np.arange(len(r)) - np.repeat(start, np.diff([*start, len(r)]))
            return t.take(pa.array(np.flatnonzero(place < count))).combine_chunks().to_batches()

        def step(b: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            for found in run(b, asked, rows, best, reach):
                held.append(found)
                n += found.num_rows
            if n > 4 * len(ids) * count + 100_000:
                held = cut()
                n = sum(x.num_rows for x in held)
            return iter(())

        def end() -> Iterator[pa.RecordBatch]:
            for b in cut():
                yield pa.RecordBatch.from_arrays([ids.take(b.column("query_id")), *b.columns[1:]], b.schema.names)

        return step, end

    return _meet(q, items, make, kind, "code" if which in ("hamming", "nphd") else "vec")


#: Steps of a distance's range by which a query's reach is found.
BINS = 1_024
#: Ranges of the distances that have one.
RANGES = {"cos": 2.0, "hamming": 256.0, "nphd": 1.0}


def reaches(queries: DataFrame, items: DataFrame, which: str, count: int) -> DataFrame:
    """`queries` with `reach`, within which each has its `count` nearest items, and few more: from counts of all distances by steps."""
    top_, kind = RANGES[which], queries.schema["query_id"].dataType.simpleString()

    def make(t: pa.Table) -> tuple[Callable, Callable]:
        ids, asked = t.column("query_id").combine_chunks(), blocks(t.column("vec"), which)
        seen = np.zeros((len(ids), BINS), np.int32)

        def step(b: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
            own = blocks(b.column("vec"), which)
            for q, x in _together(asked, own, which):
                for lo in range(0, len(x.rows), STEP[1]):
                    for at in range(0, len(q.rows), STEP[0]):
                        one, some = (Block(*(a[i : i + k] for a in (y.rows, y.data, y.size))) for y, i, k in ((q, at, STEP[0]), (x, lo, STEP[1])))
                        d = _differing(one.data, some.data, int(min(q.size[0], x.size[0]))) / min(q.size[0], x.size[0]) if which == "nphd" else distances(one, some, which)
                        there = np.isfinite(d)
                        place = np.minimum(np.where(there, np.maximum(d, 0), 0) * (BINS / top_), BINS - 1).astype(np.int64)
                        place += np.arange(len(d))[:, None] * BINS
                        seen[one.rows] += np.bincount(place[there], minlength=len(d) * BINS).reshape(len(d), BINS).astype(np.int32)
            return iter(())

        def end() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(ids), 1_024):
                own = seen[lo : lo + 1_024]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, BINS, dtype=np.int32)), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 1_024), flat], ["query_id", "seen"])

        return step, end

    found = _meet(queries, items, make, f"query_id {kind}, seen array<int>", "code" if which in ("hamming", "nphd") else "vec")

    def reach(t: pa.Table) -> pa.Table:
        ids, own = t.column("query_id").combine_chunks().dictionary_encode(), t.column("seen").combine_chunks().flatten().to_numpy().reshape(-1, BINS)
        total = np.zeros((len(ids.dictionary), BINS), np.int64)
        np.add.at(total, ids.indices.to_numpy(), own)
        full = total.cumsum(axis=1) >= count
        end = np.where(full.any(axis=1), full.argmax(axis=1) + 1, BINS)
        # The last step holds all that is beyond, too.
        return pa.table({"query_id": ids.dictionary, "reach": pa.array(np.where(end < BINS, end * (top_ / BINS) * (1 + 1e-9), np.inf))})

    n = max(1, -(-queries.count() // 4_096))
    own = found.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("part")).applyInArrow(reach, f"query_id {kind}, reach double")
    folder = f"{files.shared(items.sparkSession)}/halyard/reaches-{uuid.uuid4().hex}"
    own.write.parquet(folder)
    return queries.join(items.sparkSession.read.schema(own.schema).parquet(folder), "query_id")


def _by_column(queries: DataFrame, items: DataFrame, which: Metric, radius: float | None, digits: int | None) -> DataFrame:
    q = queries.select("query_id", F.col("vec").alias("_query"))
    few = q.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    d = which(F.col("_query"), F.col("vec"))
    d = (F.round(d, digits) if digits is not None else d) + F.lit(0.0)
    # Exploded, so that no condition on the distance is pushed below it and evaluated again.
    out = spread(items).crossJoin(F.broadcast(q) if few else q).withColumn("distance", F.explode(F.array(d))).where(F.col("distance").isNotNull())
    return (out if radius is None else out.where(F.col("distance") <= radius)).drop("_query", "vec")


def pairs(queries: DataFrame, items: DataFrame, which: str | Metric, *, radius: float | None = None, digits: int | None = None, ordered: bool = False) -> DataFrame:
    """(query_id, key, ..., distance) of all pairs of queries (query_id, vec) and items (key, vec, ...) within `radius`, inclusive.

    With `ordered` a task gives out up to ORDERED matches at a time nearest first, not query by query. Equal distances then
    lie together, and a Parquet file of many matches takes less than half the space. It is for distances of a known range, rounded.
    """
    found = metric(which)
    if ordered and (_kind(found) not in RANGES or digits is None or not 0 <= digits <= 9):
        raise ValueError(f"`ordered` needs one of {', '.join(RANGES)} and 0 to 9 `digits`")
    if _kind(found):
        return _in_blocks(queries, items, _kind(found), radius=radius, digits=digits, ordered=ordered)
    return _by_column(queries, items, found, radius, digits)


def top(matches: DataFrame, count: int) -> DataFrame:
    """The `count` nearest of each query; Spark limits each group before and after the shuffle."""
    check_count(count)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "key"))
    return matches.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= count)


#: Beyond so many, nearest items come by a radius of each query's own.
LONG = 400


def nearest(queries: DataFrame, items: DataFrame, which: str | Metric, count: int, *, digits: int | None = None) -> DataFrame:
    """(query_id, items' columns but vec, distance, rank): as `knn`, with all that the items bring."""
    check_count(count)
    kind = _kind(metric(which))
    return top(_in_blocks(queries, items, kind, count=count, digits=digits) if kind else _by_column(queries, items, metric(which), None, digits), count)


def knn(queries: DataFrame, items: DataFrame, which: str | Metric = "cos", count: int = 10, *, radius: float | None = None, digits: int | None = None, multi: bool = False, seen: Observation | None = None) -> DataFrame:
    """(query_id, rank, key, distance): the `count` nearest items of each query; with `multi`, a key counts by its nearest vector.

    `seen` observes `pairs`, the number of distances computed: the blocks' kernels count them, no pair gets a row for that.
    """
    check_count(count)
    kind, items = _kind(metric(which)), items.select("key", "vec")
    if kind in RANGES and seen is None and not multi and count > LONG:
        queries = reaches(queries.select("query_id", "vec"), items, kind, count)
        found = _in_blocks(queries, items, kind, radius=radius, digits=digits)
    elif kind:
        found = _in_blocks(queries, items, kind, count=count, radius=radius, digits=digits, multi=multi, counted=seen is not None)
        if seen is not None:
            found = found.observe(seen, F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).where("pairs is null").drop("pairs")
    elif seen is not None:
        raise ValueError("only the named distances are counted")
    else:
        found = _by_column(queries, items, metric(which), radius, digits)
    if multi:
        found = found.groupBy("query_id", "key").agg(F.min("distance").alias("distance"))
    return top(found, count).select("query_id", "rank", "key", "distance")


def range_search(queries: DataFrame, items: DataFrame, which: str | Metric, radius: float, *, digits: int | None = None, ordered: bool = False) -> DataFrame:
    """(query_id, key, distance) of all items within `radius` of each query; `ordered` as in `pairs`."""
    return pairs(queries, items.select("key", "vec"), which, radius=radius, digits=digits, ordered=ordered).select("query_id", "key", "distance")


def range_pairs(items: DataFrame, which: str, radius: float, *, digits: int | None = None, block: int = RADIUS_GRID[0]) -> DataFrame:
    """(a, b, distance) of all pairs a < b of items (key, vec) within `radius`: each pair of blocks once, none the other way round."""
    name = BLOCKS[metric(which)]
    n = max(1, -(-items.count() // block))
    rows = items.select("key", "vec", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("block"))
    table = packed(rows, f"{files.shared(items.sparkSession)}/halyard/blocks-{uuid.uuid4().hex}", n)
    met, kind = pairs_of(name, items.schema["key"].dataType, radius, digits), items.schema["key"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lo, hi, x, y in block_pairs(batches):
            yield from met(x, y, once=lo == hi)

    both = crossed(table.toDF("lo", "x"), table.toDF("hi", "y")).where("lo <= hi")
    return both.mapInArrow(compare, f"a {kind}, b {kind}, distance double")


def pairs_of(name: str, key: T.DataType, radius: float, digits: int | None) -> Callable[..., Iterator[pa.RecordBatch]]:
    """Batches (a, b, distance), a < b, of the near rows (key, vec) of two tables; with `once`, of a table with itself."""
    run = _kernel(name, ["key"], None, radius, digits, False)

    def met(x: pa.Table, y: pa.Table, *, once: bool = False) -> Iterator[pa.RecordBatch]:
        for found in run(y, blocks(x.column("vec"), name), x.column("key").combine_chunks()) if x.num_rows and y.num_rows else ():
            a, b, d = found.columns
            swap = pc.greater(a, b)
            out = pa.RecordBatch.from_arrays([pc.if_else(swap, b, a), pc.if_else(swap, a, b), d], ["a", "b", "distance"])
            # Within one block, each pair came in both orders.
            out = out.filter(pc.and_(pc.not_equal(a, b), pc.invert(swap)) if once else pc.not_equal(a, b))
            if out.num_rows:
                yield out

    return met


def merge(parts: DataFrame, count: int) -> DataFrame:
    """The nearest `count` over several partial results (query_id, key, distance) of the same queries."""
    return top(parts, count).select("query_id", "rank", "key", "distance")


def knn_dense(queries: DataFrame, items: DataFrame, which: str = "cos", count: int = 10, *, radius: float | None = None) -> DataFrame:
    """`knn` under one of the distances that run in blocks."""
    return knn(queries, items, which, count, radius=radius)


@dataclass
class Matches:
    """One query's matches, as lists, nearest first."""

    keys: list
    distances: list[float]

    def __len__(self) -> int:
        return len(self.keys)

    def __getitem__(self, i: int) -> tuple:
        return self.keys[i], self.distances[i]

    def to_list(self) -> list[tuple]:
        return list(zip(self.keys, self.distances))


def collect(result: DataFrame) -> dict[object, Matches]:
    """The matches by query, on the driver: for results of a few queries."""
    out: dict[object, Matches] = {}
    for r in result.orderBy("query_id", "rank").toLocalIterator():
        m = out.setdefault(r.query_id, Matches([], []))
        m.keys.append(bytes(r.key) if isinstance(r.key, bytearray) else r.key)
        m.distances.append(r.distance)
    return out
