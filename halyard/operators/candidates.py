"""Candidate joins for near codes and vectors: exact banding, sub-code tables, pivots, and cells around centres."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from halyard.functions.metrics import cos, hamming, metric, nphd
from halyard.operators.quantised import _means, _nearest, _points
from halyard.operators.search import BLOCKS, BROADCAST_QUERIES, RADIUS_GRID, Block, _kernel, block_pairs, blocks, check_count, crossed, distances, knn, packed, pairs_of, spread, top
from halyard.sources import files

#: Probes that go to every task at most; beyond, probes and pieces are shuffled by content.
BROADCAST_PROBES = 1 << 20


def bands(code: F.Column, radius: int, bits: int) -> F.Column:
    """array<struct<band, content>>: radius + 1 pieces of a packed code's first `bits` bits; codes within `radius` agree on one."""
    out = []
    for i in range(radius + 1):
        lo, hi = i * bits // (radius + 1), (i + 1) * bits // (radius + 1)
        parts = []
        for w in range(lo // 64, -(-hi // 64)):
            a, b = max(lo, 64 * w) - 64 * w, min(hi, 64 * w + 64) - 64 * w
            parts.append(F.call_function("shiftrightunsigned", F.shiftleft(code["words"][w], a), F.lit(64 - (b - a))))
        out.append(F.struct(F.lit(i).alias("band"), F.array(*parts).alias("content")))
    return F.array(*out)


def hamming_join(codes: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """(a, b, distance) of all pairs a < b of codes (key, code) of `bits` bits that differ in at most `radius`: exact, by pigeonhole."""
    if not 0 <= radius < bits:
        raise ValueError("radius must be from 0 to bits - 1")
    rows = codes.select("key", "code", F.explode(bands(F.col("code"), radius, bits)).alias("at"))
    a, b = rows.toDF("a", "ca", "at"), rows.toDF("b", "cb", "at")
    near = a.join(b, "at").where("a < b").select("a", "b", hamming(F.col("ca"), F.col("cb")).alias("distance"))
    return near.where(F.col("distance") <= radius).distinct()


def nphd_join(codes: DataFrame, radius: float) -> DataFrame:
    """(a, b, distance) of all pairs a < b of codes (key, code) of any lengths whose normalised prefix distance is at most `radius`: exact.

    Two codes are compared on m bits, the length of the shorter one, and differ there in at most floor(radius * m). So
    a code has pieces for each length that occurs and isn't above its own (256 at most), and those of its own length
    meet the pieces that codes of at least that length have for it. Null and empty codes have no distance. For
    radii at which a piece still has many bits: short codes share pieces often.
    """
    if not 0 <= radius < 1:
        raise ValueError("radius must be from 0 to below 1")
    bits = F.col("code.bits")
    lengths = sorted(r[0] for r in codes.where(bits > 0).select(bits).distinct().collect())
    none = F.expr("cast(array() as array<struct<common: int, band: int, content: array<bigint>>>)")

    def of(m: int) -> F.Column:
        # A little more than the product, which may come out under the whole number that it stands for.
        own = F.transform(bands(F.col("code"), int(radius * m + 1e-9), m), lambda x: F.struct(F.lit(m).alias("common"), x["band"].alias("band"), x["content"].alias("content")))
        return F.when(bits >= m, own).otherwise(none)

    rows = codes.where(bits > 0).select("key", "code", F.explode(F.concat(none, *map(of, lengths))).alias("at"))
    short, long = rows.where(bits == F.col("at.common")).toDF("a", "ca", "at"), rows.toDF("b", "cb", "at")
    met = short.join(long, "at").where((F.col("a") < F.col("b")) | ((F.col("cb.bits") > F.col("ca.bits")) & (F.col("a") != F.col("b"))))
    near = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), nphd(F.col("ca"), F.col("cb")).alias("distance"))
    return near.where(F.col("distance") <= radius).distinct()


def pieces(code: F.Column, bits: int, width: int) -> list[F.Column]:
    """A packed code's first `bits` bits as whole numbers of `width` bits each (a divisor of 64)."""
    mask = F.lit((1 << width) - 1).cast("bigint")
    return [F.shiftright(code["words"][at // 64], 64 - width - at % 64).bitwiseAND(mask) for at in range(0, bits, width)]


def knn_hamming(queries: DataFrame, items: DataFrame, count: int = 10, *, bits: int = 64, width: int = 16, rounds: int = 2, counts: list[int] | None = None) -> DataFrame:
    """(query_id, rank, key, distance), as `knn` under hamming: exact, by tables of sub-codes and a radius that grows.

    Codes are cut into m pieces of `width` bits. In round s, queries (query_id, vec) probe for items (key, vec) that
    agree with a piece in all but s bits. What a round finds is new: a pair counts at its best piece, the first of
    these. All items within m * (s + 1) - 1 have then been met, so a query whose `count`-th match is as near is
    proven and leaves; what is open after the rounds is compared with every item. For codes of `bits` bits, in
    which near ones are rare among many far ones; `counts` gets the candidates of each round and the queries left.
    """
    check_count(count)
    if bits % width or 64 % width:
        raise ValueError("width must divide 64 and the number of bits")
    spark, m = queries.sparkSession, bits // width
    folder = f"{files.shared(spark)}/halyard/subcodes-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    usable = F.col("vec").isNotNull()
    x = items.where(usable).select("key", "vec", F.posexplode(F.array(*pieces(F.col("vec"), bits, width))).alias("piece", "content"))
    everyone = queries.select("query_id", "vec").where(usable)
    open_, best, done = everyone, None, []
    for s in range(rounds):
        flips = F.array(*[F.lit(sum(1 << i for i in c)).cast("bigint") for c in combinations(range(width), s)])
        asked = open_.select("query_id", F.col("vec").alias("_query"), F.posexplode(F.array(*pieces(F.col("vec"), bits, width))).alias("piece", "own"))
        asked = asked.select("query_id", "_query", "piece", F.explode(F.transform(flips, lambda f: F.col("own").bitwiseXOR(f))).alias("content"))
        few = asked.limit(BROADCAST_PROBES + 1).count() <= BROADCAST_PROBES
        met = x.join(F.broadcast(asked) if few else asked, ["piece", "content"])
        apart = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(pieces(F.col("vec"), bits, width), pieces(F.col("_query"), bits, width))]
        first = F.lit(True)
        for i, d in enumerate(apart):
            first &= F.when(F.col("piece") > i, d > s).when(F.col("piece") < i, d >= s).otherwise(True)
        found = met.where(first).select("query_id", "key", hamming(F.col("_query"), F.col("vec")).alias("distance"))
        if counts is not None:
            found = kept(found, f"found-{s}")
            counts.append(found.count())
        best = found if best is None else best.unionByName(found)
        best = kept(top(best, count), f"best-{s}").drop("rank")
        proven = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).where((F.col("n") >= count) & (F.col("far") <= m * (s + 1) - 1)).select("query_id")
        done.append(kept(best.join(proven, "query_id", "left_semi"), f"done-{s}"))
        open_ = kept(open_.join(proven, "query_id", "left_anti"), f"open-{s}")
        best = best.join(proven, "query_id", "left_anti")
        if open_.isEmpty():
            break
    if counts is not None:
        counts.append(open_.count())
    rest = knn(open_, items, "hamming", count).drop("rank")
    for d in done:
        rest = rest.unionByName(d)
    return top(rest, count).select("query_id", "rank", "key", "distance")


def cells(items: DataFrame, count: int, seed: int = 0, sample: int = 10_000) -> np.ndarray:
    """Centres of `count` cells, by spherical k-means over at most `sample` of the items' vectors (the first by a hash of the key)."""
    rows = items.orderBy(F.xxhash64("key"), "key").limit(sample).select("vec").toPandas().vec
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[np.random.default_rng(seed).choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(10):
        at = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return centres


def assign(rows: DataFrame, centres: np.ndarray, probes: int = 1, *, every: bool = False) -> DataFrame:
    """`rows` (with `vec`) once for each of their `probes` nearest cells, with column `cell`; rows without a direction are left out, with `every` in cell -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                b = batch.slice(lo, 4096)
                own = blocks(b.column("vec"), "cos").get(centres.shape[1])
                there = own.size > 0 if own else None
                if every:
                    apart = np.ones(b.num_rows, bool)
                    if own:
                        apart[own.rows[there]] = False
                    rest = b.filter(pa.array(apart))
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.full(rest.num_rows, -1, np.int32))], [*b.schema.names, "cell"])
                if own is None:
                    continue
                near = own.data[there] @ centres.T
                at = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                out = b.take(pa.array(np.repeat(own.rows[there], at.shape[1])))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(at.ravel().astype(np.int32))], [*out.schema.names, "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def knn_cells(queries: DataFrame, items: DataFrame, centres: np.ndarray, count: int = 10, probes: int = 4, radius: float | None = None) -> DataFrame:
    """As `knn` under cos (within `radius`), only within the `probes` cells nearest to each query: approximate, its recall grows with `probes`.

    Items may bring a column `cell` (of `assign`); if that is what their files are partitioned by, only the cells
    that queries ask for are read. Up to BROADCAST_QUERIES queries go to every task; more are joined by cell.
    """
    q = assign(queries.select("query_id", "vec"), centres, probes)
    rows = items if "cell" in items.columns else assign(items.select("key", "vec"), centres)
    held = q.limit(probes * BROADCAST_QUERIES + 1).toArrow()
    if held.num_rows > probes * BROADCAST_QUERIES:
        near = rows.join(q.withColumnRenamed("vec", "_query"), "cell").select("query_id", "key", F.explode(F.array(cos(F.col("_query"), F.col("vec")))).alias("distance"))
        near = near.where("distance is not null" if radius is None else F.col("distance") <= radius)
        return top(near, count).select("query_id", "rank", "key", "distance")
    held = held.combine_chunks().to_batches()[0] if held.num_rows else None
    asked = np.unique(held.column("cell").to_numpy()).tolist() if held else []
    run = _kernel("cos", ["key"], count, radius, None, False)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.column("cell").to_numpy()
        for b in batches:
            own = b.column("cell").to_numpy()
            for c in np.unique(own):
                part = held.take(pa.array(np.flatnonzero(cells == c)))
                yield from run(b.take(pa.array(np.flatnonzero(own == c))), blocks(part.column("vec"), "cos"), part.column("query_id"))

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {items.schema['key'].dataType.simpleString()}, distance double"
    found = rows.where(F.col("cell").isin(asked)).select("key", "vec", "cell").mapInArrow(search, kinds)
    return top(found, count).select("query_id", "rank", "key", "distance")


#: Pivots at most; each row is compared with all of them.
PIVOTS = 4_096


def _around(column: pa.Array, which: str, pivots: Block, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, their own cells, row by row the cells of smaller number in which they must be met) of a column."""
    if which == "hamming":
        own = blocks(column, which).get(0)
        if own is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(pivots.data)), bool)
        rows, far = own.rows, distances(own, pivots, which)
        home = far.argmin(axis=1)
        # Whoever is within reach of a row at home around p is, by two triangles, no more than 2 * reach farther from p than from its own pivot.
        near = far - far[np.arange(len(rows)), home][:, None] <= 2 * reach
    else:
        rows, x = _points(column, which, pivots.data.shape[1])
        far = (x**2).sum(axis=1)[:, None] + pivots.size[None] - 2 * x @ pivots.data.T
        home = far.argmin(axis=1)
        # Beyond the plane between two pivots lies what is nearer to the other one: the way to that plane is the least distance.
        apart = np.sqrt(np.maximum(distances(Block(home, pivots.data[home], pivots.size[home]), pivots, "l2sq"), 0))
        scale = (x**2).sum(axis=1)[:, None] + pivots.size[None]
        near = far - far[np.arange(len(rows)), home][:, None] - 1e-9 * scale <= 2 * reach * apart
    near &= np.arange(len(pivots.data)) < home[:, None]
    return rows, home, near


#: Rows of a step against all pivots, and rows that lie in one block.
AROUND, PACK = 512, RADIUS_GRID[0]


def pivot_pairs(items: DataFrame, which: str, radius: float, *, digits: int | None = None, block: int = RADIUS_GRID[0], sample: int = 20_000, seed: int = 0, stats: dict | None = None) -> DataFrame:
    """(a, b, distance) of all pairs a < b of items (key, vec) within `radius`, as `range_pairs`: exact, by cells around pivots.

    For cos, l2sq and hamming. A row lies in the cell of its nearest pivot. Two cells meet where a row of the one of
    larger number has the other's border within the radius: no other cells can hold a pair. There is a pivot for each
    `block` rows, PIVOTS at most, chosen from `sample` rows by a hash of the key. Neighbouring cells are packed to
    blocks of PACK rows, larger ones cut; rows are dealt and written once, and pairs of blocks with cells that
    meet are read where they lie, in bounded memory. Linear where the radius is small beside the distances between
    clusters; on noise, or with large radii, most cells meet, and the arithmetic is that of all pairs. `stats` gets
    the numbers of cells and of rows with those that visit other cells.
    """
    name = BLOCKS[metric(which)]
    if name == "nphd":
        raise ValueError("the prefix distance has no triangles: use nphd_join")
    if radius < 0:
        raise ValueError("radius must be at least 0")
    spark, items = items.sparkSession, items.select("key", "vec")
    slack = 10.0**-digits if digits is not None else 0
    reach = {"hamming": radius + slack, "l2sq": (radius + slack + 1e-12) ** 0.5, "cos": (2 * (radius + slack) + 1e-12) ** 0.5}[name]
    count = min(PIVOTS, max(1, -(-items.count() // block)))
    held = items.where("vec is not null").orderBy(F.xxhash64("key"), "key").limit(sample).select("vec").toArrow().column("vec").combine_chunks()
    found = blocks(held, "hamming" if name == "hamming" else "l2sq")
    n = max(found, key=lambda k: len(found[k].rows), default=0)
    if name == "hamming":
        pivots = np.unique(found[0].data, axis=0) if found else np.zeros((1, 4), np.uint64)
        pivots = np.random.default_rng(seed).permutation(pivots)[:count]
        pivots = Block(np.arange(len(pivots)), pivots, np.zeros(len(pivots)))
    else:
        rng = np.random.default_rng(seed)
        x = _points(held, name, n)[1]
        x = np.unique(_means(x, count, rng), axis=0) if len(x) else np.zeros((1, n))
        # Neighbours get neighbouring numbers, so that they lie in one block.
        x = x[np.argsort(_nearest(x, _means(x, max(1, int(len(x) ** 0.5)), rng)), kind="stable")]
        pivots = Block(np.arange(len(x)), x, (x**2).sum(axis=1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row of the table, or what a task has seen of a cell: its rows, their visits, and the cells that they visit as bits.
        size, visits, meets = Counter(), Counter(), {}
        for whole in batches:
            for lo in range(0, whole.num_rows, AROUND):
                b = whole.slice(lo, AROUND)
                r, c, near = _around(b.column("vec"), name, pivots, reach)
                for cell in np.unique(c).tolist():
                    own = near[c == cell]
                    size[cell] += len(own)
                    visits[cell] += int(own.sum())
                    meets[cell] = meets.get(cell, False) | own.any(axis=0)
                if name != "hamming":
                    # Vectors of each other length have a cell of their own.
                    for m, other in blocks(b.column("vec"), "l2sq").items():
                        if m != n and len(other.rows):
                            r, c = np.concatenate([r, other.rows]), np.concatenate([c, np.full(len(other.rows), -m)])
                            size[-m] += len(other.rows)
                nothing = [pa.nulls(len(r), k) for k in (pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(r)).columns, pa.array(c.astype(np.int32)), *nothing], names)
        for cell, rows in size.items():
            bits = np.packbits(meets[cell]).tobytes() if cell >= 0 else b""
            yield pa.RecordBatch.from_arrays([pa.nulls(1, k) for k in kinds] + [pa.array([cell], pa.int32()), pa.array([rows]), pa.array([visits[cell]]), pa.array([bits], pa.binary())], names)

    names, kinds = ["key", "vec", "cell", "size", "visits", "meets"], [to_arrow_type(items.schema[c].dataType) for c in ("key", "vec")]
    summary = [T.StructField("cell", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("size", "visits")), T.StructField("meets", T.BinaryType())]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in items.schema.fields), *summary])
    folder = f"{files.shared(spark)}/halyard/pivots-{uuid.uuid4().hex}"
    spread(items).mapInArrow(deal, schema).write.parquet(f"{folder}/dealt")
    dealt = spark.read.schema(schema).parquet(f"{folder}/dealt")

    def joined(t: pa.Table) -> pa.Table:
        meets = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("meets").to_pylist()])
        return pa.table({"cell": t.column("cell").slice(0, 1), "size": pa.array([pc.sum(t.column("size")).as_py()]), "visits": pa.array([pc.sum(t.column("visits")).as_py()]), "meets": pa.array([meets.tobytes()], pa.binary())})

    # A row for each cell.
    cells = dealt.where("size is not null").select("cell", "size", "visits", "meets").groupBy("cell").applyInArrow(joined, "cell int, size bigint, visits bigint, meets binary").toArrow().sort_by("cell")
    number, size = cells.column("cell").to_numpy(), cells.column("size").to_numpy()
    if stats is not None:
        stats |= {"cells": len(number), "rows": int(size.sum() + cells.column("visits").to_numpy().sum())}
    meet = np.eye(len(number), dtype=bool)
    for i in np.flatnonzero(number >= 0):
        bits = np.unpackbits(np.frombuffer(cells.column("meets")[i].as_py(), np.uint8))[: len(pivots.data)]
        meet[i, number >= 0] |= bits[number[number >= 0]].astype(bool)
    meet |= meet.T
    # Cells side by side share a block while they fit; a larger one has several.
    group, first, cuts, room, blocks_ = [], [], [], 0, 0
    for rows in size.tolist():
        k = max(1, -(-rows // PACK))
        if k > 1 or rows > room:
            first.append(blocks_)
            blocks_, room = blocks_ + k, PACK - rows if k == 1 else 0
            group.append(group[-1] + 1 if group else 0)
        else:
            first.append(first[-1])
            room -= rows
            group.append(group[-1])
        cuts.append(k)
    edges = [group.index(g) for g in range(group[-1] + 1)] if group else []
    near = np.logical_or.reduceat(np.logical_or.reduceat(meet, edges, axis=0), edges, axis=1) if group else meet
    place = spark.createDataFrame([(int(c), i, f, k) for i, (c, f, k) in enumerate(zip(number, first, cuts))], "cell int, at int, first int, cuts int")
    rows = dealt.where("size is null").select("key", "vec", "cell").join(F.broadcast(place), "cell")
    rows = rows.select("key", "vec", "at", (F.col("first") + F.pmod(F.xxhash64("key"), F.col("cuts"))).cast("int").alias("block"))
    table = packed(rows, f"{folder}/blocks", blocks_)
    # The groups that a group meets, 63 in each number.
    words = [[sum(1 << int(b) for b in np.flatnonzero(r[lo : lo + 63])) for lo in range(0, len(r), 63)] for r in near]
    of = {f: g for f, g in zip(first, group)}
    starts = sorted(of)
    owner = spark.createDataFrame([(b, of[f], words[of[f]]) for f, end in zip(starts, [*starts[1:], blocks_]) for b in range(f, end)], "block int, own int, words array<bigint>")
    table = table.join(F.broadcast(owner), "block")
    met, kind = pairs_of(name, items.schema["key"].dataType, radius, digits), items.schema["key"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lo, hi, x, y in block_pairs(batches):
            a, b = x.column("at").to_numpy(), y.column("at").to_numpy()
            left = np.unique(a)
            wanted = meet[np.ix_(left, np.unique(b))]
            if wanted.mean() > 0.5:
                yield from met(x, y, once=lo == hi)
                continue
            for cell in left:
                yield from met(x.take(np.flatnonzero(a == cell)), y.take(np.flatnonzero(meet[cell][b])), once=lo == hi)

    left = table.select(F.col("block").alias("lo"), F.col("body").alias("x"), "words")
    right = table.select(F.col("block").alias("hi"), F.col("body").alias("y"), "own")
    wanted = F.expr("lo <= hi and (shiftright(words[cast(own div 63 as int)], own % 63) & 1) = 1")
    return crossed(left, right).where(wanted).select("lo", "x", "hi", "y").mapInArrow(compare, f"a {kind}, b {kind}, distance double")
