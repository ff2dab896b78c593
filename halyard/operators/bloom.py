"""A growing Bloom filter over whole-number or bytes keys, built and asked in Spark.

Layers grow by a factor, each with half the error rate of the one before, so that the rates sum to at most
twice the first. `build` makes a layer's bits by an aggregation over (word, bit) pairs: every task yields each
word once, so what travels is bounded by the filter's own size.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from halyard.sources import files

MAGIC, VERSION = b"HBLM", 1
_HEAD, _LAYER = struct.Struct("<4sIQddI"), struct.Struct("<QdQQ")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hashes(keys: Iterable[int | bytes] | np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each key, a row for each: whole numbers of 64 bits in one step, bytes and larger ones one by one."""
    if not isinstance(keys, np.ndarray):
        keys = list(keys)
        try:
            keys = np.array(keys, np.int64) if not any(isinstance(k, bytes | bytearray) for k in keys) else keys
        except OverflowError:
            pass
    if isinstance(keys, np.ndarray) and keys.dtype == np.int64:
        x = keys.view(np.uint64)
        return np.stack([_mix(x + np.uint64(0x9E3779B97F4A7C15)), _mix(x ^ np.uint64(0xD1B54A32D192ED03))], axis=1)
    out = np.zeros((len(keys), 2), np.uint64)
    for i, k in enumerate(keys):
        if not isinstance(k, bytes | bytearray) and -(1 << 63) <= k < 1 << 63:
            out[i] = hashes(np.array([k], np.int64))[0]
        else:
            h = xxhash.xxh3_128_intdigest(bytes(k) if isinstance(k, bytes | bytearray) else int(k).to_bytes(17, "little", signed=True))
            out[i] = h & (1 << 64) - 1, h >> 64
    return out


def _places(h: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The bit places of each key's hashes, a row for each."""
    return (h[:, :1] + (h[:, 1:] | np.uint64(1)) * np.arange(count, dtype=np.uint64)) % np.uint64(bits)


@dataclass
class Layer:
    capacity: int
    rate: float
    count: int = 0
    words: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.words is None:
            self.words = np.zeros(self.bits // 64, np.uint64)

    @property
    def bits(self) -> int:
        return 64 * math.ceil(-self.capacity * math.log(self.rate) / math.log(2) ** 2 / 64)

    @property
    def hashes(self) -> int:
        return max(1, round(-math.log2(self.rate)))

    def set(self, h: np.ndarray) -> None:
        """Add keys by their hashes."""
        p = _places(h, self.bits, self.hashes).ravel()
        np.bitwise_or.at(self.words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        self.count += len(h)

    def has(self, h: np.ndarray) -> np.ndarray:
        p = _places(h, self.bits, self.hashes)
        return ((self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1)


class ScalableBloom:
    def __init__(self, capacity: int = 10_000_000, rate: float = 0.01, growth: float = 2.0) -> None:
        if capacity < 1 or not 0 < rate < 1 or growth < 1:
            raise ValueError("capacity must be >= 1, rate within 0 and 1, growth >= 1")
        self.first, self.rate, self.growth = capacity, rate, growth
        self.layers = [Layer(capacity, rate)]

    def _grow(self) -> None:
        last = self.layers[-1]
        self.layers.append(Layer(int(math.ceil(last.capacity * self.growth)), last.rate / 2))

    def add(self, key: int | bytes) -> None:
        self.add_batch([key])

    def add_batch(self, keys: Iterable[int | bytes]) -> None:
        """Add keys: all are hashed in one pass, and each layer takes the slice that its room allows."""
        h, old = hashes(keys), len(self.layers) - 1
        room = self.layers[-1].capacity - self.layers[-1].count
        while room < len(h):
            self._grow()
            room += self.layers[-1].capacity
        ends = np.minimum(np.cumsum([x.capacity - x.count for x in self.layers[old:]]), len(h)).tolist()
        for layer, first, end in zip(self.layers[old:], [0, *ends], ends):
            layer.set(h[first:end])

    def contains(self, key: int | bytes) -> bool:
        return bool(self.contains_batch([key])[0])

    __contains__ = contains

    def contains_batch(self, keys: Iterable[int | bytes]) -> np.ndarray:
        h = hashes(keys)
        return np.logical_or.reduce([x.has(h) for x in self.layers]) if len(h) else np.zeros(0, bool)

    def clear(self) -> None:
        self.layers = [Layer(self.first, self.rate)]

    @property
    def count(self) -> int:
        return sum(x.count for x in self.layers)

    @property
    def capacity(self) -> int:
        return sum(x.capacity for x in self.layers)

    @property
    def filter_count(self) -> int:
        return len(self.layers)

    def __len__(self) -> int:
        return self.count

    def __repr__(self) -> str:
        return f"ScalableBloom(count={self.count}, capacity={self.capacity}, layers={self.filter_count})"

    def to_bytes(self) -> bytes:
        parts = [_HEAD.pack(MAGIC, VERSION, self.first, self.rate, self.growth, len(self.layers))]
        return b"".join(parts + [_LAYER.pack(x.capacity, x.rate, x.count, len(x.words)) + x.words.astype("<u8").tobytes() for x in self.layers])

    @classmethod
    def from_bytes(cls, data: bytes) -> ScalableBloom:
        if len(data) < _HEAD.size or data[:4] != MAGIC:
            raise ValueError("not a filter: the magic differs")
        _, version, capacity, rate, growth, layers = _HEAD.unpack_from(data)
        if version != VERSION:
            raise ValueError(f"version {version} isn't known")
        out, at = cls(capacity, rate, growth), _HEAD.size
        out.layers = []
        for _ in range(layers):
            c, r, count, words = _LAYER.unpack_from(data, at)
            at += _LAYER.size
            out.layers.append(Layer(c, r, count, np.frombuffer(data, "<u8", words, at).astype(np.uint64)))
            at += 8 * words
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the filter to a file, in place of what is there."""
        files.write(spark, path, self.to_bytes())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScalableBloom:
        """The filter of a file; ValueError where there is none, or another thing."""
        try:
            data = files.read(spark, path)
            return cls.from_bytes(data or b"")
        except (OSError, struct.error) as e:
            raise ValueError(f"no whole filter at {path}") from e

    @classmethod
    def build(cls, keys: DataFrame, rate: float = 0.01, growth: float = 2.0) -> ScalableBloom:
        """A filter of one layer of all `key`s.

        Tasks hold a batch's own words only; what comes to the driver, which keeps the filter, is some 10 bits for each
        key. Where that is too much, let Parquet's own filters answer, as the store's lookups do.
        """
        n = keys.count()
        out = cls(max(1, n), rate, growth)
        bits, count = out.layers[0].bits, out.layers[0].hashes

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = np.sort(_places(hashes(_keys(b)), bits, count).ravel())
                at, first = np.unique(p >> np.uint64(6), return_index=True)
                own = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first) if len(p) else p
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(own.view(np.int64))], ["at", "word"])

        got = keys.select("key").mapInArrow(words, "at bigint, word bigint").groupBy("at").agg({"word": "bit_or"}).toPandas()
        out.layers[0].words[got["at"].to_numpy()] = got["bit_or(word)"].to_numpy().view(np.uint64)
        out.layers[0].count = n
        return out

    def filter(self, rows: DataFrame) -> DataFrame:
        """The rows whose `key` may be among those added."""

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(self.contains_batch(_keys(b))))

        return rows.mapInArrow(keep, rows.schema)


def _keys(b: pa.RecordBatch) -> np.ndarray | list:
    c = b.column("key")
    return c.to_numpy(zero_copy_only=False).astype(np.int64) if pa.types.is_integer(c.type) and not c.null_count else c.to_pylist()
