"""Training-order materialisation: token sequences in a keyed permutation, in shards of fixed stride.

Documents' token ids (the library's, text by text) are cut into sequences of `length` ids, the last one padded. Sequences are numbered by
document id and place; a Feistel network under the key, walked along its cycles until it falls below the
number of sequences, sends each number to its slot of the training order. Numbers and slots depend on the
documents and the key alone, not on how the job was split.

Shard s holds the slots from s * stride on. In the `raw` form each shard is one file of little-endian 16-bit
numbers, RECORD bytes more than its ids for each slot (a fixed mark stands behind each sequence), so slot t lies
(t - s * stride) * (2 * length + 2) bytes in: `read_raw` seeks there and reads on. Else a shard is one row of a
compressed table, `payload` being its ids in one block: a reader fetches the one shard that a slot lies in, whole.

Token blocks are written once, bucketed by the task that made them; the numbers, a few bytes a document, are
shuffled to these buckets, so that the blocks themselves travel only once, to their slots.

Defined cases: null or empty texts have no sequences; rows of the same id follow each other by a hash of their
tokens, rows alike in both take its numbers in any order; null ids come first; an empty table writes no shard;
very long texts are cut whole; ids over 65,535 raise an error; other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.llm.common import col, discard, materialise, mix, scratch, slices
from halyard.sources import files

ROUNDS = 6
#: What stands behind each sequence in the raw form.
MARK = "\n\n"
RECORD = len(MARK)
_U = np.uint64


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots, below n, of numbers below n: a bijection under each key."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, bits = _U((1 << half) - 1), _U(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(key % (1 << 64)))
    out = numbers.astype(_U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@lru_cache(2)
def _library(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("halyard", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _cut(docs: DataFrame, ranks_path: str, pattern: str, length: int, pad: int) -> DataFrame:
    """(id, key, n, data): each document's number of sequences and their bytes."""

    def blocks(parts: list[np.ndarray]) -> list[pa.Array]:
        n, data = [], []
        for ids in parts:
            if len(ids) and ids.max() > 0xFFFF:
                raise ValueError(f"id {ids.max()} has more than 16 bits")
            n.append(-(-len(ids) // length))
            block = np.full(n[-1] * length, pad, "<u2")
            block[: len(ids)] = ids
            data.append(block.tobytes())
        return [pa.array(n, pa.int64()), pa.array(data, pa.binary())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = _library(ranks_path, pattern).encode_ordinary
        for b in slices(batches, "text"):
            ids = [np.array(ordinary(t or ""), np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *blocks(ids)], ["id", "n", "data"])

    cut = docs.select("id", "text").mapInArrow(encode, "id bigint, n bigint, data binary")
    return cut.where("n > 0").select("id", F.xxhash64("data").alias("key"), "n", "data")


def _numbered(rows: DataFrame) -> DataFrame:
    """(id, key, first, n): the number of each document's first sequence; documents alike in id and key share a row."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), b.column("n"), pa.array(before), pa.array(np.full(len(n), part, np.int32))], ["id", "key", "n", "before", "part"])

    each = rows.groupBy("id", "key").agg(F.sum("n").alias("n")).repartitionByRange(parts, "id", "key").sortWithinPartitions("id", "key")
    each = materialise(each.mapInArrow(sums, "id bigint, key bigint, n bigint, before bigint, part int"), "numbers")
    # One row for each partition.
    offsets = each.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return each.join(offsets, "part").select("id", "key", (F.col("before") + F.col("offset")).alias("first"), "n")


def _bucketed(df: DataFrame, column: str, parts: int) -> tuple[DataFrame, Callable[[], None]]:
    """`df`, written in buckets of `column` and read back so that joins on it need no shuffle; and what deletes it again."""
    spark = df.sparkSession
    name = f"halyard_{uuid.uuid4().hex}"
    path = f"{scratch(spark)}/halyard/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, column).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        files.delete(spark, path)

    return spark.table(name), drop


def _slots(docs: DataFrame, ranks_path: str, pattern: str, pad: int, key: int, length: int, stride: int) -> tuple[DataFrame, Callable[[], None]]:
    """(slot, data), dealt to ranges of whole shards and sorted by slot; and what deletes the tables it reads."""
    spark, size = docs.sparkSession, 2 * length
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut, drop = _bucketed(_cut(docs, ranks_path, pattern, length, pad).withColumn("part", F.spark_partition_id()), "part", parts)
    # A row for each document and task; copies of a document follow each other by task.
    per = materialise(cut.groupBy("part", "id", "key").agg(F.sum("n").alias("n")), "per")
    firsts = materialise(_numbered(per.select("id", "key", "n")), "firsts")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("id", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    given = firsts.select(F.col("id").alias("gid"), F.col("key").alias("gkey"), "first")
    given = per.withColumn("before", before).join(given, F.col("id").eqNullSafe(F.col("gid")) & (F.col("key") == F.col("gkey")))
    given = given.select(F.col("part").alias("gpart"), "gid", "gkey", (F.col("first") + F.col("before")).alias("first"))
    both = cut.join(given.hint("shuffle_hash"), (F.col("part") == F.col("gpart")) & F.col("id").eqNullSafe(F.col("gid")) & (F.col("key") == F.col("gkey")))
    shards = -(-total // stride)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: dict[int, int] = {}  # by a first number: how many of its sequences went to copies of the document
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                data = b.column("data").to_pylist()
                n = np.array([len(x) // size for x in data], np.int64)
                first = []
                for f, k in zip(b.column("first").to_pylist(), n.tolist()):
                    first.append(f + taken.get(f, 0))
                    taken[f] = taken.get(f, 0) + k
                own = np.repeat(np.array(first, np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                slots = permute(own, total, key)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array([x[i : i + size] for x in data for i in range(0, len(x), size)], pa.binary())], ["slot", "data"])

    slots = both.select("first", "data").mapInArrow(deal, "slot bigint, data binary")
    slots = slots.repartitionById(parts, F.floor(F.floor(F.col("slot") / stride) * parts / max(1, shards)).cast("int")).sortWithinPartitions("slot")

    def clean() -> None:
        discard(per, firsts)
        drop()

    return slots, clean


def write(docs: DataFrame, path: str, *, ranks_path: str, pattern: str, pad: int, key: int, length: int = 512, stride: int = 512, id_col: str = "doc_id", text_col: str = "text", raw: bool = False) -> None:
    """Write the shards of `docs` to `path`, by rising shard.

    As rows (shard, first_slot, sequences, tokens but for padding, payload) or, `raw`, as one file in each folder shard=s.
    """
    if not 0 <= pad <= 0xFFFF:
        raise ValueError("pad must have 16 bits")
    rows = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).alias("text"))
    slots, clean = _slots(rows, ranks_path, pattern, pad, key, length, stride)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []

        def shard() -> pa.RecordBatch:
            block = b"".join(held)
            real = int(np.count_nonzero(np.frombuffer(block, "<u2") != pad))
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([now * stride]), pa.array([len(held)]), pa.array([real]), pa.array([block], pa.binary())], ["shard", "first_slot", "sequences", "tokens", "payload"])

        for b in batches:
            for s, x in zip((b.column("slot").to_numpy() // stride).tolist(), b.column("data").to_pylist()):
                if s != now:
                    if held:
                        yield shard()
                    now, held = s, []
                held.append(x)
        if held:
            yield shard()

    with _by_bucket(docs.sparkSession):
        _save(slots, pack, path, stride, raw=raw)
    clean()


@contextmanager
def _by_bucket(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, tables partitioned by one of a join's keys meet by that one: a bucketed table needs no shuffle then."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _save(slots: DataFrame, pack: Callable, path: str, stride: int, *, raw: bool) -> None:
    if raw:
        # Text's writer puts bytes as they are and the mark behind them; the sort by shard and slot is the order of the files.
        shard = F.floor(F.col("slot") / stride).cast("bigint").alias("shard")
        slots.select(shard, "slot", F.col("data").cast("string").alias("value")).sortWithinPartitions("shard", "slot").select("shard", "value").write.partitionBy("shard").option("lineSep", MARK).text(path)
    else:
        slots.mapInArrow(pack, "shard bigint, first_slot bigint, sequences bigint, tokens bigint, payload binary").write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, first: int, count: int, *, length: int = 512, stride: int = 512) -> Iterator[np.ndarray]:
    """The sequences of `count` slots from `first` on, in order; only their shards are read, one at a time to the driver."""
    shards = spark.read.parquet(path).where(F.col("shard").between(first // stride, (first + count - 1) // stride)).orderBy("shard")
    for s in shards.toLocalIterator():
        block = np.frombuffer(s.payload, "<u2").reshape(-1, length)
        yield from block[max(0, first - s.first_slot) : first + count - s.first_slot]


def read_raw(spark: SparkSession, path: str, first: int, count: int, *, length: int = 512, stride: int = 512) -> Iterator[np.ndarray]:
    """The sequences of `count` slots from `first` on, of the raw form: each shard's file is opened at the slot's place."""
    record, slot = 2 * length + RECORD, first
    while slot < first + count:
        shard = slot // stride
        name = next((x for x in files.folders(spark, f"{path}/shard={shard}") if x.startswith("part-")), None)
        if name is None:
            return
        place, fs = files.fs(spark, f"{path}/shard={shard}/{name}")
        stream = fs.open(place)
        try:
            stream.seek((slot - shard * stride) * record)
            data = bytes(stream.readNBytes((min(first + count, (shard + 1) * stride) - slot) * record))
        finally:
            stream.close()
        yield from np.frombuffer(data, "<u2").reshape(-1, length + RECORD // 2)[:, :length]
        slot = (shard + 1) * stride
