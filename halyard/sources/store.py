"""A vector store of sharded Parquet rows, tombstones and versioned manifests, all on Spark's file systems.

Each write puts its rows into a folder of its own attempt and then creates the next version's manifest, which only one
writer can: what no manifest names doesn't exist, so a job that dies leaves the store as it was, at whatever step, and
nothing that it left is ever taken up. Any number of readers and writers: who comes second with an append of other keys
takes over what the first one committed, anything else raises ConflictError and can be done again after `refresh`.
`open(..., version=n)` reads a store as it was, as far back as `vacuum` has kept manifests.

    store = VectorStore.create(spark, path, ndim=64)                       # dense vectors, 64-bit keys
    store = VectorStore.create(spark, path, kind="varbits", key_type="uuid16")
    store.add(df)                                                          # key, vec [, seq]
    store.search(queries, count=10)                                        # query_id, rank, key, distance

Rows of attempt a, version v and shard s lie in rows/a=a/v=v/shard_id=s (by cells below that, once `build_cells` has
chosen centres) and are read as one partitioned table. No write but `compact` and `build_cells` touches rows that are there: a removal from the active shard is a file of struck keys, with the
version up to which it strikes, one from an older shard a tombstone. Parquet's own Bloom filters on `key` let
lookups of a few keys skip what can't hold them, and the manifest has each folder's least and largest key.
`vacuum` deletes what no kept manifest names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions import codes
from halyard.functions.metrics import Metric
from halyard.operators import candidates, lsm, search
from halyard.operators.bloom import ScalableBloom
from halyard.sources import files

KEY_TYPES = {"long": T.LongType(), "uuid16": T.BinaryType()}
KINDS = {"dense": T.ArrayType(T.DoubleType()), "bits": T.BinaryType(), "varbits": T.BinaryType()}
DEFAULT_METRIC = {"dense": "cos", "bits": "hamming", "varbits": "nphd"}
#: Asked keys up to which they stand in the scan's filter too, where Parquet's Bloom filters meet them.
FILTER_KEYS = 10


class ConflictError(RuntimeError):
    """Another writer has committed what this write can't stand beside; refresh and do it again."""


@dataclass(frozen=True)
class Config:
    """The schema of a store; the last three are hints of graph indexes, kept for whoever asks."""

    ndim: int | None = None
    kind: str = "dense"
    key_type: str = "long"
    metric: str = "cos"
    multi: bool = False
    #: A shard is full, and the next one begun, at so many rows or bytes.
    shard_rows: int = 10_000_000
    shard_bytes: int | None = None
    #: False: one shard for good, in which several vectors for a key can be removed and equal vectors are left alone.
    sharded: bool = True
    #: False: no key is ever found, counted or removed.
    key_lookups: bool = True
    connectivity: int = 16
    expansion_add: int = 128
    expansion_search: int = 64


@dataclass(frozen=True)
class State:
    version: int = 0
    #: By shard: its folders (below rows/), oldest first, with their rows, bytes, least and largest key (as text).
    shards: dict[int, list[tuple]] = field(default_factory=dict)
    active: int = 0
    tombstones: str | None = None
    tombstone_count: int = 0
    #: Folders of (key, shard_id, upto): rows of a shard up to a version that are gone, and how many.
    strikes: tuple[tuple[str, int], ...] = ()
    #: Whether a key may lie in several shards.
    needs_dedup: bool = False
    #: Commit ids; of those that end in a number, such as a stream's, only the last ones and, by name, the highest forgotten.
    commits: tuple[str, ...] = ()
    forgotten: dict[str, int] = field(default_factory=dict)
    #: What made this version: "append" if it only added folders, else "other".
    op: str = "other"
    #: The version that the kept filter is of, and its file's digest.
    bloom: int | None = None
    bloom_digest: str | None = None
    #: The cells' centres, once rows are dealt to cells.
    centres: list[list[float]] | None = None


def _tiers(sizes: list[int], ratio: int) -> list[list[int]]:
    """Which of some folders become one: places in `sizes`, each group with at least `ratio` members of a tier, or what such groups made."""
    tiers: dict[int, list[tuple[list[int], int]]] = {}

    def put(places: list[int], n: int) -> None:
        tier = 0
        while ratio ** (tier + 1) <= n:
            tier += 1
        tiers.setdefault(tier, []).append((places, n))

    for i, n in enumerate(sizes):
        put([i], n)
    tier = 0
    while tier <= max(tiers, default=-1):
        held = tiers.get(tier, [])
        if len(held) >= ratio:
            tiers[tier] = []
            put([i for places, _ in held for i in places], sum(n for _, n in held))
        tier += 1
    return [sorted(places) for own in tiers.values() for places, _ in own if len(places) > 1]


class VectorStore:
    """Add, look up, search, remove and compact keyed vectors."""

    #: Numbered commit ids that are kept one by one.
    REMEMBERED = 1000

    def __init__(self, spark: SparkSession, path: str, config: Config, state: State, *, read_only: bool = False, metric: Metric | None = None) -> None:
        self.spark, self.path, self.config, self.state, self.read_only = spark, path.rstrip("/"), config, state, read_only
        self.closed, self.dirty, self._metric = False, 0, metric or config.metric

    # Opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, ndim: int | None = None, *, kind: str = "dense", key_type: str = "long", metric: str | Metric | None = None, multi: bool = False, shard_rows: int = 10_000_000, shard_bytes: int | None = None, sharded: bool = True, key_lookups: bool = True, **hints: int) -> VectorStore:
        """A new store at `path`, or the one that is there, if its schema agrees."""
        if kind not in KINDS or key_type not in KEY_TYPES:
            raise ValueError(f"kind must be one of {[*KINDS]} and key_type one of {[*KEY_TYPES]}")
        if kind == "varbits":
            ndim = 256 if ndim is None else ndim
            if ndim % 8 or not 8 <= ndim <= 256:
                raise ValueError("ndim of variable-length codes must be a multiple of 8, from 8 to 256 bits")
        if shard_rows < 1 or shard_bytes is not None and shard_bytes < 1:
            raise ValueError("shard_rows and shard_bytes must be >= 1")
        if versions(spark, path):
            found = cls.open(spark, path, metric=metric if callable(metric) else None)
            if (found.config.kind, found.config.key_type) != (kind, key_type) or ndim not in (None, found.config.ndim):
                raise ValueError(f"the store at {path} has another schema: {found.config}")
            return found
        if ndim is None:
            raise ValueError("ndim is needed for a new store")
        name = metric if isinstance(metric, str) else DEFAULT_METRIC[kind] if metric is None else "custom"
        config = Config(ndim, kind, key_type, name, multi, shard_rows, shard_bytes, sharded, key_lookups, **hints)
        store = cls(spark, path, config, State(), metric=metric if callable(metric) else None)
        store._commit(store.state)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, read_only: bool = False, metric: Metric | None = None, version: int | None = None) -> VectorStore:
        """The store at `path`, read-only as of a version if one is given; ValueError where there is none."""
        config, state = _load(spark, path.rstrip("/"), version)
        return cls(spark, path, config, state, read_only=read_only or version is not None, metric=metric)

    def refresh(self) -> int:
        """See what others have committed; the version seen."""
        self.state = _load(self.spark, self.path)[1]
        return self.state.version

    def history(self) -> list[dict]:
        """(version, op, rows, shards) of each version that can be read, oldest first."""
        out = []
        for v in versions(self.spark, self.path):
            s = _load(self.spark, self.path, v)[1]
            out.append({"version": v, "op": s.op, "rows": _physical(s), "shards": sum(bool(x) for x in s.shards.values())})
        return out

    @classmethod
    def restore(cls, spark: SparkSession, path: str) -> VectorStore | None:
        """The store at `path`, read-only; None where there is none or its manifest can't be read."""
        try:
            return cls.open(spark, path, read_only=True)
        except (ValueError, TypeError, KeyError):
            return None

    @staticmethod
    def metadata(spark: SparkSession, path: str) -> dict | None:
        """The schema of the store at `path`; None where there is none."""
        path = path.rstrip("/")
        return asdict(_load(spark, path)[0]) if versions(spark, path) else None

    def copy(self, path: str) -> VectorStore:
        """An independent store at `path` with the same visible rows."""
        c = self.config
        other = VectorStore.create(self.spark, path, c.ndim, kind=c.kind, key_type=c.key_type, metric=self._metric, multi=c.multi, shard_rows=c.shard_rows, shard_bytes=c.shard_bytes, sharded=c.sharded, key_lookups=c.key_lookups)
        if self.size:
            other._append(self.live().select("key", "seq", "vec"), other.state, None)
        return other

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> VectorStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # Rows

    @property
    def _schema(self) -> T.StructType:
        return T.StructType([T.StructField("key", KEY_TYPES[self.config.key_type]), T.StructField("seq", T.LongType()), T.StructField("vec", KINDS[self.config.kind])])

    def _read(self, places: list[tuple[str, int]], *, cells: bool = False) -> DataFrame:
        """key, seq, vec, v, shard_id (and cell, if asked for) of some folders (folder, shard): one scan, however many there are."""
        more = [T.StructField("v", T.LongType()), T.StructField("shard_id", T.IntegerType()), T.StructField("cell", T.IntegerType())]
        schema = T.StructType([*self._schema.fields, *(more if self.state.centres else more[:2])])
        names = [f.name for f in schema.fields if cells or f.name != "cell"]
        if not places:
            return self.spark.createDataFrame([], schema).select(*names)
        return self.spark.read.option("basePath", f"{self.path}/rows").schema(schema).parquet(*[f"{self.path}/rows/{f}/shard_id={s}" for f, s in places]).select(*names)

    def _places(self, shards: Iterable[int] | None = None, state: State | None = None) -> list[tuple[str, int]]:
        return [(x[0], s) for s, own in (state or self.state).shards.items() if shards is None or s in shards for x in own]

    def _unstruck(self, rows: DataFrame) -> DataFrame:
        """Rows without those that later removals and upserts struck from their shard."""
        if not self.state.strikes:
            return rows
        schema = T.StructType([T.StructField("_key", KEY_TYPES[self.config.key_type]), T.StructField("_shard", T.IntegerType()), T.StructField("_upto", T.LongType())])
        gone = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f, _ in self.state.strikes])
        few = sum(n for _, n in self.state.strikes) <= lsm.BROADCAST_KEYS
        return rows.join(F.broadcast(gone) if few else gone, (F.col("key") == F.col("_key")) & (F.col("shard_id") == F.col("_shard")) & (F.col("v") <= F.col("_upto")), "left_anti")

    def rows(self) -> DataFrame:
        """All physical rows: key, seq, vec, shard_id."""
        return self._unstruck(self._read(self._places())).drop("v")

    def tombstones(self) -> DataFrame:
        keys = T.StructType(self._schema.fields[:1])
        if not self.state.tombstones:
            return self.spark.createDataFrame([], keys)
        found = self.spark.read.schema(keys).parquet(f"{self.path}/{self.state.tombstones}")
        return F.broadcast(found) if self.state.tombstone_count <= lsm.BROADCAST_KEYS else found

    def _visible(self, rows: DataFrame) -> DataFrame:
        return lsm.visible(rows, self.tombstones() if self.state.tombstones else None, self.state.active)

    def visible(self) -> DataFrame:
        return self._visible(self.rows())

    def _newest(self, seen: DataFrame) -> DataFrame:
        return lsm.newest(seen) if self.state.needs_dedup and not self.config.multi else seen

    def live(self) -> DataFrame:
        """What reads see; the plain scan where no key can lie in several shards."""
        return self._newest(self.visible())

    def keys(self) -> DataFrame:
        return self.live().select("key")

    def vectors(self) -> DataFrame:
        return self.live().select("key", "vec")

    def positions(self, first: int, end: int) -> DataFrame:
        """(pos, key) of the live keys at places first to end - 1, by shard and key."""
        return lsm.positions(self.live(), first, end)

    def key_at(self, i: int) -> object:
        """The live key at a place, from the end if negative; IndexError where there is none."""
        n = self.size
        if not -n <= i < n:
            raise IndexError(f"place {i} of {n}")
        return self.positions(i % n, i % n + 1).first().key

    # Lookups

    def _asked(self, keys: DataFrame | Iterable) -> DataFrame:
        if isinstance(keys, DataFrame):
            return keys if "pos" in keys.columns else keys.select(F.monotonically_increasing_id().alias("pos"), "key")
        keys = [self._key(k) for k in keys]
        return self.spark.createDataFrame([*enumerate(keys)], T.StructType([T.StructField("pos", T.LongType()), self._schema["key"]]))

    def _key(self, key: object) -> object:
        if self.config.key_type == "uuid16":
            if not isinstance(key, bytes | bytearray) or len(key) != 16:
                raise ValueError("keys must be 16 bytes")
            return bytearray(key)
        if isinstance(key, bool) or not hasattr(key, "__index__"):
            raise ValueError("keys must be whole numbers")
        return int(key)

    def _found(self, asked: DataFrame, given: DataFrame | Iterable) -> DataFrame:
        """The visible rows (with their shard) of asked keys: narrowed to them where they are read."""
        if not self.config.key_lookups:
            return self._read([])
        rows = self._read(self._places())
        if not isinstance(given, DataFrame) and len(given := [self._key(k) for k in given]) <= FILTER_KEYS:
            rows = rows.where(F.col("key").isin(*map(F.lit, given))) if given else rows.where("false")
        return self._visible(self._unstruck(lsm.narrowed(rows, asked)).drop("v"))

    def get(self, keys: DataFrame | Iterable, dtype: str | None = None) -> DataFrame:
        """(pos, key, vec) for each asked key, vec null where it isn't there; `dtype` casts a dense vector's components."""
        keys = keys if isinstance(keys, DataFrame) else [*keys]
        asked = self._asked(keys)
        found = lsm.get(asked, self._newest(self._found(asked, keys)))
        return found if dtype is None else found.withColumn("vec", F.col("vec").cast(f"array<{dtype}>"))

    def contains(self, keys: DataFrame | Iterable) -> DataFrame:
        keys = keys if isinstance(keys, DataFrame) else [*keys]
        asked = self._asked(keys)
        return lsm.contains(asked, self._found(asked, keys))

    def count(self, keys: DataFrame | Iterable) -> DataFrame:
        """(pos, key, n): physical rows by key, so that an upserted key may count twice until compaction."""
        keys = keys if isinstance(keys, DataFrame) else [*keys]
        asked = self._asked(keys)
        return lsm.count(asked, self._found(asked, keys))

    def __contains__(self, key: object) -> bool:
        return self.contains([key]).first().found

    def __getitem__(self, key: object) -> object:
        return self.get([key]).first().vec

    def __delitem__(self, key: object) -> None:
        self.remove([key])

    def __len__(self) -> int:
        return self.size

    # Search

    def _codes(self, df: DataFrame) -> DataFrame:
        return df if self.config.kind == "dense" else df.withColumn("vec", codes.pack(F.col("vec")))

    def search(self, queries: DataFrame, count: int = 10, *, radius: float | None = None, where: F.Column | None = None, exact: bool = True, probes: int = 4) -> DataFrame:
        """(query_id, rank, key, distance): the nearest of each query (query_id, vec); `where` is an optional condition on keys.

        Not `exact`: only the `probes` cells nearest to a query are searched; `build_cells` must have dealt the rows, and
        whatever was written since has been dealt to the same cells. Where a key can lie in several shards, the keys
        (not the vectors) of all cells are read too, to tell which row of it is the newest.
        """
        search.check_count(count)
        if not exact:
            if not self.state.centres:
                raise ValueError("an approximate search needs cells: call build_cells")
            items = self._visible(self._unstruck(self._read(self._places(), cells=True)))
            if self.state.needs_dedup:
                keys = ["key", "shard_id", "seq", "v"]
                items = items.join(lsm.newest(self._visible(self._unstruck(self._read(self._places()).select(*keys)))), keys, "left_semi")
            items = items.select("key", "vec", "cell")
            return candidates.knn_cells(queries, items if where is None else items.where(where), np.array(self.state.centres), count, probes, radius)
        items = self.live().select("key", "vec")
        items = items if where is None else items.where(where)
        return search.knn(self._codes(queries), self._codes(items), self._metric, count, radius=radius, multi=self.config.multi)

    def build_cells(self, count: int, seed: int = 0) -> None:
        """Deal the live rows, and from now on those of each write, to `count` cells around centres, for approximate searches by cos."""
        self._writable()
        if self.config.kind != "dense" or self._metric != "cos" or self.config.multi:
            raise ValueError("cells are for dense vectors by cos, one for each key")
        centres = candidates.cells(self.live(), count, seed)
        folder = self._folder(self.state)
        rows = self._dealt(self.live().select("key", "seq", "vec", "shard_id"), centres.tolist())
        self._writer(rows.repartition("shard_id", "cell")).partitionBy("shard_id", "cell").parquet(f"{self.path}/rows/{folder}")
        state = replace(self.state, centres=centres.tolist())
        shards = {k: [x] for k, x in self._written(folder, state).items()}
        self._commit(replace(state, shards=shards, tombstones=None, tombstone_count=0, strikes=(), needs_dedup=False))

    @staticmethod
    def _dealt(rows: DataFrame, centres: list[list[float]] | None) -> DataFrame:
        return rows if centres is None else candidates.assign(rows, np.array(centres), every=True)

    def search_counted(self, queries: DataFrame, count: int = 10) -> tuple[DataFrame, Observation]:
        """As `search`, with an observation whose `pairs` is the number of distances computed, once the result was read."""
        seen = Observation()
        found = search.knn(self._codes(queries), self._codes(self.live().select("key", "vec")), self._metric, count, multi=self.config.multi, seen=seen)
        return found, seen

    def range_search(self, queries: DataFrame, radius: float) -> DataFrame:
        return search.range_search(self._codes(queries), self._codes(self.live().select("key", "vec")), self._metric, radius)

    # Writes

    def _writable(self) -> None:
        if self.closed:
            raise RuntimeError("the store is closed")
        if self.read_only:
            raise RuntimeError("the store is read-only")

    def frame(self, keys: Iterable | None, vectors: Iterable) -> DataFrame:
        """A batch (key, seq, vec) of Python values; without keys, the next free numbers from the store's row count on."""
        vectors = [bytearray(v) if self.config.kind != "dense" else [float(x) for x in v] for v in vectors]
        if keys is None:
            if self.config.key_type != "long":
                raise ValueError("16-byte keys must be given")
            first = self.physical_rows
            keys = range(first, first + len(vectors))
        keys = [self._key(k) for k in keys]
        if len(keys) != len(vectors):
            raise ValueError(f"{len(keys)} keys for {len(vectors)} vectors")
        return self.spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(zip(keys, vectors))], self._schema)

    def _batch(self, df: DataFrame) -> DataFrame:
        """A checked batch: key, seq, vec; without seq, rows keep the order they are read in, without key, they get the next free numbers."""
        if "seq" not in df.columns:
            df = df.withColumn("seq", F.monotonically_increasing_id())
        if "key" not in df.columns:
            if self.config.key_type != "long":
                raise ValueError("16-byte keys must be given")
            df = lsm.auto_keys(df, self.physical_rows, "seq")
        df = df.select(F.col("key").cast(KEY_TYPES[self.config.key_type]), F.col("seq").cast("bigint"), F.col("vec").cast(KINDS[self.config.kind]))
        size = F.size("vec") if self.config.kind == "dense" else F.length("vec")
        want = {"dense": size == self.config.ndim, "bits": size == -(-self.config.ndim // 8), "varbits": F.lit(True)}[self.config.kind]
        sound = F.col("key").isNotNull() & F.col("vec").isNotNull() & want
        if self.config.key_type == "uuid16":
            sound &= F.length("key") == 16
        if self.config.kind == "varbits":
            df = df.withColumn("vec", F.substring("vec", 1, self.config.ndim // 8))
        return df.withColumn("vec", F.when(sound, F.col("vec")).otherwise(F.raise_error("a row has no key, a key of another length, or a vector of another size").cast(KINDS[self.config.kind])))

    @staticmethod
    def _writer(df: DataFrame):  # noqa: ANN202
        # Adaptive, with candidates down to some hundred bytes: a filter as large as the keys need it, so that small files stay small.
        return df.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.candidates.number#key", "13")

    @staticmethod
    def _folder(state: State) -> str:
        """A new folder for the rows of the version after `state`, which no other attempt shares."""
        return f"a={uuid.uuid4().hex}/v={state.version + 1}"

    def _written(self, folder: str, state: State) -> dict[int, tuple]:
        """What this attempt's folder holds, by shard: folder, rows, bytes, least and largest key."""
        root, out = f"{self.path}/rows/{folder}", {}
        shards = [int(x.split("=")[1]) for x in files.folders(self.spark, root) if x.startswith("shard_id=")]
        if not shards:
            return out
        text = lambda c: (F.col(c).cast("string") if self.config.key_type == "long" else F.hex(c)).alias(c)
        rows = self._with(state)._read([(folder, s) for s in shards])
        each = rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        for r in each.select("shard_id", "n", text("lo"), text("hi")).collect():
            out[r.shard_id] = (folder, r.n, files.size(self.spark, f"{root}/shard_id={r.shard_id}"), r.lo, r.hi)
        return out

    def _with(self, state: State) -> VectorStore:
        """This store in another state, to read from."""
        return VectorStore(self.spark, self.path, self.config, state, read_only=True, metric=self._metric)

    def _apart(self, a: tuple, b: tuple) -> bool:
        """Whether the keys of two folders can't meet."""
        (alo, ahi), (blo, bhi) = [map(int, x[3:]) if self.config.key_type == "long" else x[3:] for x in (a, b)]
        return ahi < blo or bhi < alo

    def _append(self, new: DataFrame, state: State, commit: int | str | None) -> int:
        """Write rows to the active shard, clear their tombstones, and go on to new shards as they fill up."""
        c, folder = self.config, self._folder(state)
        by = ["cell"] if state.centres else []
        new = self._dealt(new.select("key", "seq", "vec"), state.centres)
        new = new.hint("rebalance", "cell") if by else new
        self._writer(new).partitionBy(*by).parquet(f"{self.path}/rows/{folder}/shard_id={state.active}")
        got = self._written(folder, state)
        n, size = (sum(x[i] for x in got.values()) for i in (1, 2))
        if not n:
            return 0
        held, held_size = (sum(x[i] for x in state.shards.get(state.active, [])) for i in (1, 2))
        if c.sharded and (held + n > c.shard_rows or c.shard_bytes is not None and held_size + size > c.shard_bytes):
            # Rows in the order of their keys fill one shard after the other, each to its rows or its bytes, whichever comes first.
            whole, weight = c.shard_rows, F.lit(1)
            rows = self._read([(folder, state.active)], cells=bool(by)).drop("v", "shard_id")
            if c.shard_bytes is not None:
                raw = (F.lit(8 * c.ndim) if c.kind == "dense" else F.length("vec")) + 16
                whole = c.shard_bytes
                weight = F.greatest(F.ceil(raw * F.lit(size / rows.agg(F.sum(raw)).first()[0])), F.lit(-(-whole // c.shard_rows)))
                held = max(held_size, held * -(-whole // c.shard_rows))
            placed = lsm.numbered(rows, weight=weight.cast("bigint"))
            shard = F.lit(state.active) + F.floor((F.col("pos") + held) / whole).cast("int")
            last, folder = folder, self._folder(state)
            self._writer(placed.withColumn("shard_id", shard).drop("pos")).partitionBy("shard_id", *by).parquet(f"{self.path}/rows/{folder}")
            files.delete(self.spark, f"{self.path}/rows/{last.split('/')[0]}")
            got = self._written(folder, state)
        written = self._read([(folder, s) for s in got])
        dedup = state.needs_dedup
        if not c.multi and not dedup:
            # Only older shards whose keys may meet the new ones are asked.
            near = [(x[0], s) for s, own in state.shards.items() if s != state.active for x in own if not all(self._apart(x, y) for y in got.values())]
            dedup = bool(near) and not lsm.narrowed(self._read(near).select("key"), written.select("key")).isEmpty()
        shards = dict(state.shards)
        for s, x in sorted(got.items()):
            shards[s] = [*shards.get(s, []), x]
        op = "other" if state.tombstones or state != replace(self.state, shards=state.shards) else "append"
        state = replace(state, shards=shards, needs_dedup=dedup)
        if state.tombstones:
            state = self._bury(lsm.cleared(self.tombstones(), written), state)
            # A key that comes back may still have an older row in a view.
            state = replace(state, needs_dedup=True)
        last = max(got)
        rows, size = (sum(x[i] for x in shards[last]) for i in (1, 2))
        full = rows >= c.shard_rows or c.shard_bytes is not None and size >= c.shard_bytes
        if c.sharded:
            state = replace(state, active=last + full)
        if not self._commit(state, commit, added=got if op == "append" else None):
            return 0
        self.dirty += n
        return n

    def _keys(self, keys: DataFrame, name: str) -> tuple[str, int]:
        folder = f"{name}/{uuid.uuid4().hex}"
        keys.write.parquet(f"{self.path}/{folder}")
        return folder, self.spark.read.schema(keys.schema).parquet(f"{self.path}/{folder}").count()

    def _bury(self, keys: DataFrame, state: State) -> State:
        folder, n = self._keys(keys.select("key"), "tombstones")
        return replace(state, tombstones=folder if n else None, tombstone_count=n)

    def _strike(self, keys: DataFrame, state: State) -> State:
        """Strike keys from the active shard, as far as it has them; what commits it comes later."""
        own = self._places([state.active])
        if not own:
            return state
        there = self._unstruck(lsm.narrowed(self._read(own).select("key", "v", "shard_id"), keys))
        gone = there.select(F.col("key").alias("_key"), F.col("shard_id").alias("_shard"), F.lit(state.version).cast("bigint").alias("_upto"))
        folder, n = self._keys(gone, "strikes")
        return replace(state, strikes=(*state.strikes, (folder, n))) if n else state

    def _done(self, commit: str | None) -> bool:
        self._writable()
        if commit is None:
            return False
        name, _, number = str(commit).rpartition("-")
        return str(commit) in self.state.commits or number.isdigit() and int(number) <= self.state.forgotten.get(name, -1)

    def add(self, batch: DataFrame, *, commit: str | None = None) -> int:
        """Append what the active shard lacks (all of it with `multi`); the number of rows added. Older shards aren't asked."""
        if self._done(commit):
            return 0
        own = self._unstruck(self._read(self._places([self.state.active]))) if not self.config.multi else None
        new = self._batch(batch)
        new = new if own is None else lsm.to_add(new, own, self.state.active) if self._places([self.state.active]) else lsm.first_of_batch(new)
        return self._append(new, self.state, commit)

    def add_once(self, batch: DataFrame, *, commit: str | None = None) -> int:
        """Append the keys that no shard has; the number of rows added."""
        if self._done(commit):
            return 0
        batch = self._batch(batch)
        return self._append(lsm.to_add_once(batch, self._visible(self._unstruck(lsm.narrowed(self._read(self._places()).select("key", "v", "shard_id"), batch)))), self.state, commit)

    def upsert(self, batch: DataFrame, *, commit: str | None = None) -> int:
        """Write the last vector of each key, whatever was there; the number of rows written.

        A store that isn't sharded leaves vectors alone that are equal to the present ones.
        """
        if self._done(commit):
            return 0
        if self.config.multi:
            raise ValueError("a store of several vectors for a key has no upsert")
        new = lsm.last_of_batch(self._batch(batch))
        if not self.config.sharded:
            new = self._changed(new)
        return self._append(new, self._strike(new.select("key"), self.state), commit)

    def _changed(self, batch: DataFrame) -> DataFrame:
        """Of a batch, the rows that differ from what is there."""
        there = self._newest(self._visible(self._unstruck(lsm.narrowed(self._read(self._places()), batch)).drop("v")))
        return lsm.changes(batch, there).where("change <> 'same'").select("key", F.lit(0).cast("bigint").alias("seq"), "vec")

    def upsert_changed(self, batch: DataFrame, *, commit: str | None = None) -> int:
        """As `upsert`, but vectors equal to the present ones aren't written."""
        if self._done(commit):
            return 0
        if self.config.multi:
            raise ValueError("a store of several vectors for a key has no upsert")
        return self.upsert(self._changed(self._batch(batch)), commit=commit)

    def remove(self, keys: DataFrame | Iterable, *, compact: bool = False) -> int:
        """Remove keys (missing ones are ignored); the number of keys that were there."""
        self._writable()
        if self.config.multi and self.config.sharded:
            raise ValueError("a sharded store of several vectors for a key has no remove")
        gone = self._asked(keys).select("key").distinct()
        there = self._found(gone, gone).select("key").distinct().count()
        if there:
            state = self._strike(gone, self.state)
            views = lsm.narrowed(self._read([x for x in self._places() if x[1] != self.state.active]).select("key", "shard_id"), gone)
            if self.state.tombstones or not views.isEmpty():
                state = self._bury(lsm.buried(self.tombstones(), gone, views, self.state.active), state)
            self._commit(state)
            self.dirty += there
        if compact:
            self.compact()
        return there

    def compact(self) -> int:
        """Keep of each key the newest row, drop tombstones and emptied shards; the number of rows dropped.

        One window over keys finds what stays; only shards that lose rows are written anew, all in one job.
        """
        self._writable()
        before = self.physical_rows
        keys = ["key", "shard_id", "seq", "v"]
        last = self._newest(self._visible(self._unstruck(self._read(self._places()).select(*keys))))
        stay = {r.shard_id: r["count"] for r in last.groupBy("shard_id").count().collect()}
        shards = {s: own for s, own in self.state.shards.items() if own and stay.get(s) == sum(x[1] for x in own)}
        lost = [s for s in self.state.shards if s not in shards and stay.get(s)]
        if lost:
            rows = self._read(self._places(lost), cells=True)
            if self.config.multi:
                rows = self._visible(self._unstruck(rows))
            else:
                rows = rows.join(last.where(F.col("shard_id").isin(lost)), keys, "left_semi")
            by = ["shard_id", *(["cell"] if self.state.centres else [])]
            folder = self._folder(self.state)
            self._writer(rows.drop("v").hint("rebalance", *by)).partitionBy(*by).parquet(f"{self.path}/rows/{folder}")
            shards |= {s: [x] for s, x in self._written(folder, self.state).items()}
        self._commit(replace(self.state, shards=dict(sorted(shards.items())), tombstones=None, tombstone_count=0, strikes=(), needs_dedup=False))
        return before - self.physical_rows

    def tidy(self, ratio: int = 4) -> int:
        """Merge small folders, tier by tier, without touching large ones; the number of folders that went.

        A folder of n rows is in the tier of the highest power of `ratio` up to n. `ratio` folders of a shard in one
        tier become one, and so on upwards, so that a shard keeps less than `ratio` folders a tier and a row is written
        anew about once for each tier. Struck rows go with it. Lists of strikes merge the same way. What is visible
        stays as it is; tombstones, and rows that newer shards hide, wait for `compact`. Another writer's commit since
        this handle's last one makes it raise ConflictError.
        """
        self._writable()
        if ratio < 2:
            raise ValueError("ratio must be at least 2")
        before = sum(map(len, self.state.shards.values())) + len(self.state.strikes)
        shards, state, rounds = dict(self.state.shards), self.state, {}
        for s, own in self.state.shards.items():
            groups = _tiers([x[1] for x in own], ratio)
            for i, g in enumerate(groups):
                rounds.setdefault(i, {})[s] = [own[j] for j in g]
            shards[s] = [x for j, x in enumerate(own) if not any(j in g for g in groups)]
        by = ["shard_id", *(["cell"] if state.centres else [])]
        for parts in rounds.values():
            # The n-th groups of all shards in one job; each job has a folder of its own.
            folder = self._folder(state)
            rows = self._unstruck(self._read([(x[0], s) for s, own in parts.items() for x in own], cells=True)).drop("v")
            self._writer(rows.hint("rebalance", *by)).partitionBy(*by).parquet(f"{self.path}/rows/{folder}")
            for s, x in self._written(folder, state).items():
                shards[s] = [*shards[s], x]
        strikes = list(state.strikes)
        for g in _tiers([n for _, n in state.strikes], ratio):
            old = [state.strikes[j] for j in g]
            gone = self.spark.read.parquet(*[f"{self.path}/{f}" for f, _ in old])
            # What is older than all that is left of its shard strikes nothing any more.
            oldest = {s: min(int(x[0].rpartition("=")[2]) for x in own) for s, own in shards.items() if own}
            left = F.create_map(*[F.lit(x) for pair in oldest.items() for x in pair])[F.col("_shard")] if oldest else F.lit(None)
            made = self._keys(gone.where(F.col("_upto") >= left).groupBy("_key", "_shard").agg(F.max("_upto").alias("_upto")), "strikes")
            strikes = [x for x in strikes if x not in old] + [made] * (made[1] > 0)
        if rounds or len(strikes) < len(state.strikes):
            self._commit(replace(state, shards={s: own for s, own in shards.items() if own}, strikes=tuple(strikes)))
        return before - sum(map(len, self.state.shards.values())) - len(self.state.strikes)

    def vacuum(self, keep: int = 1, grace: float = 0.0) -> int:
        """Delete all manifests but the last `keep`, and folders that none of these names; the number of folders.

        Folders of unfinished writes aren't named yet: `grace` spares what is younger, in seconds. A writer whose
        folder is deleted before it commits gets a ConflictError.
        """
        self._writable()
        found, gone, kept = versions(self.spark, self.path), 0, set()
        for v in found[-max(1, keep) :]:
            s = _load(self.spark, self.path, v)[1]
            kept |= {f"rows/{f}/shard_id={n}" for f, n in self._places(state=s)} | {s.tombstones, *(f for f, _ in s.strikes)}
        for v in found[: -max(1, keep)]:
            files.delete(self.spark, _manifest(self.path, v))
        there = ["rows"]
        for _ in range(3):
            there = [f"{d}/{x}" for d in there for x in files.folders(self.spark, f"{self.path}/{d}")]
        there = [x for x in there if "shard_id=" in x] + [f"{d}/{x}" for d in ("tombstones", "strikes") for x in files.folders(self.spark, f"{self.path}/{d}")]
        for x in there:
            if x not in kept and files.age(self.spark, f"{self.path}/{x}") >= grace:
                files.delete(self.spark, f"{self.path}/{x}")
                gone += 1
        return gone

    def rotate(self) -> None:
        """Close the active shard and go on in a new one."""
        self._writable()
        if self.config.sharded and self.state.shards.get(self.state.active):
            self._commit(replace(self.state, active=self.state.active + 1))

    def drain(self) -> int:
        """Commits are synchronous, so nothing is ever pending; the version that holds everything written so far."""
        return self.state.version

    def reset(self) -> None:
        """Start over in this object; the files stay until the next commit replaces the manifest."""
        self._writable()
        self.state, self.dirty = State(version=self.state.version, active=max([self.state.active, *self.state.shards], default=0) + 1), 0

    def save(self) -> None:
        """Every write is committed already; this only sets the counter of unsaved changes back."""
        self._writable()
        self.dirty = 0

    def _commit(self, state: State, commit: int | str | None = None, *, added: dict[int, tuple] | None = None) -> bool:
        """Make `state` the next version; `added` are the new folders of an append. False if another writer has committed this commit id."""
        base = self.state
        while True:
            done = self._noted(replace(state, version=state.version + 1, op="append" if added else "other"), commit)
            if any(not files.exists(self.spark, f"{self.path}/rows/{f}/shard_id={s}") for s, (f, *_) in (added or {}).items()):
                raise ConflictError("the rows of this write were deleted before it was committed")
            if _swap(self.spark, _manifest(self.path, done.version), json.dumps({"config": asdict(self.config), "state": asdict(done)})):
                self.state = done
                return True
            newest = _load(self.spark, self.path)[1]
            if commit is not None and str(commit) in newest.commits:
                self.state = newest
                return False
            state = self._rebased(base, newest, state, added)

    def _noted(self, state: State, commit: int | str | None) -> State:
        """`state` with a commit id in its list."""
        commits, forgotten = [*state.commits], dict(state.forgotten)
        if commit is not None:
            commits.append(str(commit))
            numbered = [x for x in commits if x.rpartition("-")[2].isdigit()]
            for x in numbered[: -self.REMEMBERED]:
                name, _, number = x.rpartition("-")
                forgotten[name] = max(int(number), forgotten.get(name, -1))
                commits.remove(x)
        return replace(state, commits=tuple(commits), forgotten=forgotten)

    def _rebased(self, base: State, newest: State, state: State, added: dict[int, tuple] | None) -> State:
        """An append's state on top of what others have appended since `base`, if the keys don't meet; else ConflictError."""
        since = [_load(self.spark, self.path, v)[1] for v in versions(self.spark, self.path) if base.version < v <= newest.version]
        if not added or len(since) < newest.version - base.version or any(s.op != "append" for s in since):
            raise ConflictError(f"version {newest.version} was committed meanwhile")
        old = set(self._places(state=base))
        theirs = [(x, k) for k, own in newest.shards.items() for x in own if (x[0], k) not in old]
        near = [(x[0], k) for x, k in theirs if not all(self._apart(x, y) for y in added.values())]
        if near and not self.config.multi:
            own = self._read([(x[0], k) for k, x in added.items()]).select("key")
            if not lsm.narrowed(self._read(near).select("key"), own).isEmpty():
                raise ConflictError(f"version {newest.version} has keys of this write")
        shards = dict(newest.shards)
        for k, x in sorted(added.items()):
            shards[k] = [*shards.get(k, []), x]
        return replace(newest, shards=shards, active=max(newest.active, state.active), needs_dedup=newest.needs_dedup or state.needs_dedup)

    # Membership and buffers

    def bloom(self, rate: float = 0.01) -> ScalableBloom:
        """A Bloom filter of all physical keys: the kept one, or one built anew where that is missing, broken or outdated."""
        if self.state.bloom == self.state.version:
            try:
                # Another writer may have written the file without coming to commit it.
                found = ScalableBloom.load(self.spark, f"{self.path}/bloom")
                if found.rate == rate and self._digest() == self.state.bloom_digest:
                    return found
            except ValueError:
                pass
        return self.rebuild_bloom(rate) if not (self.read_only or self.closed) else ScalableBloom.build(self.rows().select("key"), rate)

    def rebuild_bloom(self, rate: float = 0.01) -> ScalableBloom:
        """Build the filter of all physical keys and keep it beside the manifest."""
        self._writable()
        found = ScalableBloom.build(self.rows().select("key"), rate)
        found.save(self.spark, f"{self.path}/bloom")
        self._commit(replace(self.state, bloom=self.state.version + 1, bloom_digest=self._digest()))
        return found

    def _digest(self) -> str:
        return hashlib.sha256(files.read(self.spark, f"{self.path}/bloom") or b"").hexdigest()

    def to_bytes(self) -> bytes:
        """The live rows as one Arrow stream: for stores that fit the driver."""
        t = self.live().select("key", "seq", "vec").toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        return sink.getvalue().to_pybytes()

    def load_bytes(self, data: bytes) -> int:
        """Add the rows of such a stream; the number of rows added."""
        return self.add(self.spark.createDataFrame(pa.ipc.open_stream(data).read_all()))

    # Figures

    @property
    def ndim(self) -> int | None:
        return self.config.ndim

    @property
    def metric(self) -> str:
        return self.config.metric

    @property
    def metric_kind(self) -> str:
        return self.config.metric.upper()

    @property
    def dtype(self) -> str:
        return {"dense": "double", "bits": "binary", "varbits": "binary"}[self.config.kind]

    @property
    def multi(self) -> bool:
        return self.config.multi

    @property
    def tombstone_count(self) -> int:
        return self.state.tombstone_count

    @property
    def physical_rows(self) -> int:
        return _physical(self.state)

    @property
    def serialized_length(self) -> int:
        """Bytes of all shards' files."""
        return sum(x[2] for own in self.state.shards.values() for x in own)

    memory_usage = serialized_length

    @property
    def capacity(self) -> int:
        """Rows that fit before the next shard is begun."""
        return self.config.shard_rows * (self.state.active + 1)

    @property
    def size(self) -> int:
        """Live rows, counted."""
        return self.live().count() if self.state.needs_dedup or self.state.tombstones else self.physical_rows

    @property
    def size_estimate(self) -> int:
        """Physical rows less tombstones, from the manifest alone; too high where keys lie in several shards."""
        return max(0, self.physical_rows - self.state.tombstone_count)

    @property
    def shard_count(self) -> int:
        return sum(bool(x) for x in self.state.shards.values())

    def stats(self) -> dict:
        """The schema and, from the manifest alone, all figures; `rows_by_shard` and `bytes_by_shard` include struck rows."""
        c, s = self.config, self.state
        by = lambda i: {k: sum(x[i] for x in v) for k, v in s.shards.items()}
        return asdict(c) | {"path": self.path, "version": s.version, "shards": self.shard_count, "active_shard": s.active, "views": self.shard_count - bool(s.shards.get(s.active)), "rows": self.physical_rows, "rows_by_shard": by(1), "bytes": self.serialized_length, "bytes_by_shard": by(2), "struck": sum(n for _, n in s.strikes), "capacity": self.capacity, "size_estimate": self.size_estimate, "tombstones": s.tombstone_count, "needs_dedup": s.needs_dedup, "bloom_kept": s.bloom == s.version, "dirty": self.dirty, "read_only": self.read_only, "closed": self.closed}

    def _unsupported(self, *_: object, **__: object) -> None:
        raise NotImplementedError("a sharded store can't do this")

    rename = join = cluster = pairwise_distance = clear = _unsupported


def _physical(state: State) -> int:
    return sum(x[1] for own in state.shards.values() for x in own) - sum(n for _, n in state.strikes)


def _manifest(path: str, version: int) -> str:
    return f"{path}/manifests/{version:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions whose manifests are there, oldest first."""
    names = files.folders(spark, f"{path.rstrip('/')}/manifests")
    return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())


def _load(spark: SparkSession, path: str, version: int | None = None) -> tuple[Config, State]:
    """What a version's manifest says, or the newest's; ValueError where there is none."""
    if version is None:
        version = max(versions(spark, path), default=-1)
    text = files.read(spark, _manifest(path, version)) if version >= 0 else None
    if text is None:
        raise ValueError(f"no store at {path}" if version < 0 else f"version {version} of {path} isn't kept")
    m = json.loads(text)
    s = m["state"]
    s |= {"shards": {int(k): [tuple(x) for x in v] for k, v in s["shards"].items()}, "commits": tuple(s["commits"]), "strikes": tuple(map(tuple, s["strikes"]))}
    return Config(**m["config"]), State(**s)


def _swap(spark: SparkSession, path: str, text: str) -> bool:
    """Create a manifest; False if another writer has."""
    return files.create(spark, path, text.encode())
