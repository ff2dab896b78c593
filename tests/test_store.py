import numpy as np
import pytest
from pyspark.sql import functions as F

from pyspark.sql import functions as F

from halyard.functions import metrics
from halyard.operators import candidates, search
from halyard.operators.bloom import ScalableBloom
from halyard.sources.store import ConflictError, VectorStore
from halyard.streaming.ingest import ingest


def queries(spark, vectors, kind="array<double>"):
    return spark.createDataFrame([(i, bytearray(v) if isinstance(v, bytes) else [float(x) for x in v]) for i, v in enumerate(vectors)], f"query_id int, vec {kind}")


def eye(n):
    return np.eye(n).tolist()


def rows(df):
    return {r.key: list(r.vec) for r in df.select("key", "vec").collect()}


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore.create(spark, str(tmp_path / "s"), ndim=4)


def test_add_search_and_reopen(spark, store):
    assert store.add(store.frame([1, 2, 3, 1], [*eye(4)[:3], [0, 0, 0, 1]])) == 3
    found = search.collect(store.search(queries(spark, [[0, 1, 0, 0]]), 2))[0]
    assert found.to_list()[0] == (2, 0.0) and len(found) == 2 and found[1][1] == 1.0
    again = VectorStore.open(spark, store.path, read_only=True)
    assert rows(again.live()) == rows(store.live()) and rows(again.live())[1] == [1, 0, 0, 0]
    with pytest.raises(RuntimeError):
        again.add(store.frame([9], [[1, 1, 1, 1]]))
    assert VectorStore.metadata(spark, store.path)["ndim"] == 4 and VectorStore.metadata(spark, "/nowhere") is None


@pytest.mark.parametrize("count", [0, -1])
def test_count_is_checked(spark, store, count):
    with pytest.raises(ValueError, match="count.*>= 1"):
        store.search(queries(spark, eye(4)), count)


def test_lookups_keep_order_and_holes(spark, store):
    store.add(store.frame([5, 7], eye(4)[:2]))
    asked = [7, 6, 5, 7]
    assert [(r.key, r.vec and list(r.vec)) for r in store.get(asked).orderBy("pos").collect()] == [(7, [0, 1, 0, 0]), (6, None), (5, [1, 0, 0, 0]), (7, [0, 1, 0, 0])]
    assert [r.found for r in store.contains(asked).orderBy("pos").collect()] == [True, False, True, True]
    assert [r.n for r in store.count(asked).orderBy("pos").collect()] == [1, 0, 1, 1]
    assert 5 in store and 6 not in store and list(store[5]) == [1, 0, 0, 0] and store[6] is None and len(store) == 2


def test_shards_tombstones_and_compaction(spark, store):
    store.add(store.frame(range(4), eye(4)))
    store.rotate()
    assert store.add(store.frame([0], [[1, 1, 0, 0]])) == 1  # older shards aren't asked
    assert store.size_estimate == 5 and store.size == 4 and list(store[0]) == [1, 1, 0, 0]
    assert store.add_once(store.frame([1, 9, 9], [[5] * 4, [2] * 4, [3] * 4])) == 1 and list(store[9]) == [2] * 4
    assert store.remove([1, 0, 77]) == 2 and 0 not in store and 1 not in store
    assert store.state.tombstone_count == 2
    store.upsert(store.frame([1, 1], [[7] * 4, [8] * 4]))
    assert list(store[1]) == [8] * 4 and store.state.tombstone_count == 1
    assert store.count([1]).first().n == 2  # the older row counts until compaction
    near = search.collect(store.search(queries(spark, [[0, 1, 0, 0]]), 10))[0]
    assert near.keys.count(1) == 1
    before = rows(store.live())
    assert store.compact() == 2 and rows(store.live()) == before and store.state.tombstones is None and not store.state.needs_dedup
    assert rows(VectorStore.open(spark, store.path).live()) == before
    assert store.stats()["rows"] == len(before) and store.remove([9], compact=True) == 1


def test_stale_row_of_an_older_shard_stays_hidden(spark, store):
    store.add(store.frame([1, 2], [[1, 0, 0, 0], [0.9, 0.1, 0, 0]]))
    store.rotate()
    store.upsert(store.frame([1], [[-1, 0, 0, 0]]))
    assert search.collect(store.search(queries(spark, [[1, 0, 0, 0]]), 1))[0].keys == [2]


def test_upsert_changed_writes_only_what_differs(spark, store):
    store.add(store.frame([1, 2], eye(4)[:2]))
    assert store.upsert_changed(store.frame([1, 2, 3], [*eye(4)[:1], [9] * 4, [8] * 4])) == 2
    assert rows(store.live()) == {1: [1, 0, 0, 0], 2: [9] * 4, 3: [8] * 4}


def test_rotation_by_rows_and_auto_keys(spark, tmp_path):
    s = VectorStore.create(spark, str(tmp_path / "r"), ndim=2, shard_rows=3)
    for i in range(3):
        s.add(s.frame(None, [[i, 1], [i, 2]]))
    assert s.shard_count == 2 and sorted(r.key for r in s.keys().collect()) == list(range(6))


def test_a_lost_job_leaves_the_store_as_it_was(spark, store, monkeypatch):
    store.add(store.frame([1], eye(4)[:1]))
    monkeypatch.setattr("halyard.sources.store._swap", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.upsert(store.frame([1, 2], [[2] * 4, [3] * 4]))
    assert rows(store.live()) == rows(VectorStore.open(spark, store.path).live()) == {1: [1, 0, 0, 0]}


def test_sixteen_byte_keys(spark, tmp_path):
    s = VectorStore.create(spark, str(tmp_path / "u"), ndim=2, key_type="uuid16")
    keys = [i.to_bytes(16, "big") for i in range(3)]
    s.add(s.frame(keys, [[1, 0], [0, 1], [1, 1]]))
    assert search.collect(s.search(queries(spark, [[0, 1]]), 1))[0].keys == [keys[1]]
    s.remove([keys[1]])
    assert keys[1] not in s and keys[2] in s
    for bad in ("x" * 16, b"short", 5, None):
        with pytest.raises(ValueError):
            s.get([bad])
    with pytest.raises(ValueError):
        s.frame(None, [[1, 2]])


def test_variable_length_codes(spark, tmp_path):
    s = VectorStore.create(spark, str(tmp_path / "v"), kind="varbits")
    s.add(s.frame([1, 2, 3], [bytes([255, 128, 64]), bytes([255, 129]), b"\x00" * 32]))
    got = search.collect(s.search(queries(spark, [bytes([255, 129])], "binary"), 3))[0]
    assert got.to_list() == [(2, 0.0), (1, 0.0625), (3, 10 / 16)]
    assert search.collect(s.search(queries(spark, [bytes([255, 129])], "binary"), 3, radius=0.0625))[0].keys == [2, 1]
    for bad in (7, 264, 0):
        with pytest.raises(ValueError):
            VectorStore.create(spark, str(tmp_path / "w"), ndim=bad, kind="varbits")


def test_several_vectors_for_a_key(spark, tmp_path):
    s = VectorStore.create(spark, str(tmp_path / "m"), ndim=2, multi=True)
    assert s.add(s.frame([1, 1, 2], [[1, 0], [0, 1], [1, 1]])) == 3
    assert search.collect(s.search(queries(spark, [[0, 1]]), 5))[0].to_list()[0] == (1, 0.0)
    assert s.count([1]).first().n == 2 and s.get([1]).count() == 2
    for f in (lambda: s.upsert(s.frame([1], [[1, 0]])), lambda: s.remove([1])):
        with pytest.raises(ValueError):
            f()


def test_bad_rows_and_states(spark, store, tmp_path):
    with pytest.raises(ValueError):
        store.frame([1], [])
    with pytest.raises(Exception, match="vector of another size"):
        store.add(store.frame([1], [[1, 2]]))
    with pytest.raises(ValueError):
        VectorStore.create(spark, str(tmp_path / "n"))
    with pytest.raises(ValueError):
        VectorStore.create(spark, store.path, ndim=5)
    with pytest.raises(ValueError):
        VectorStore.open(spark, str(tmp_path / "nothing"))
    for name in ("rename", "join", "cluster", "pairwise_distance", "clear"):
        with pytest.raises(NotImplementedError):
            getattr(store, name)()
    with store:
        pass
    with pytest.raises(RuntimeError):
        store.add(store.frame([1], eye(4)[:1]))


def test_copy_and_reset(spark, store, tmp_path):
    store.add(store.frame([1, 2], eye(4)[:2]))
    other = store.copy(str(tmp_path / "c"))
    store.remove([1])
    assert rows(other.live()).keys() == {1, 2}
    store.reset()
    assert store.size == 0 and rows(VectorStore.open(spark, store.path).live()).keys() == {2}


def test_metrics_by_name_and_by_function(spark, store, tmp_path):
    with pytest.raises(ValueError):
        metrics.metric("none")
    assert metrics.metric("COS") is metrics.cos
    s = VectorStore.create(spark, str(tmp_path / "x"), ndim=2, metric=lambda a, b: metrics.dot(a, b))
    s.add(s.frame([1, 2], [[1, 0], [-5, 0]]))
    assert search.collect(s.search(queries(spark, [[1, 0]]), 1))[0].to_list() == [(2, -5.0)]
    zero = search.knn(queries(spark, [[0, 0]]), s.live(), "cos", 3)
    assert zero.count() == 0


def test_block_kernel_equals_columns(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))
    q = e.where("key % 9 = 0").select(F.col("key").alias("query_id"), "vec")
    for name in ("cos", "l2sq"):
        a = {(r.query_id, r.rank): r for r in search.knn(q, e, name, 5, digits=9).collect()}
        b = {(r.query_id, r.rank): r for r in search.knn_dense(q, e, name, 5).collect()}
        assert a.keys() == b.keys() and all(abs(a[k].distance - b[k].distance) < 1e-7 and a[k].key == b[k].key for k in a)


def test_cells_recall(spark):
    r = np.random.default_rng(0)
    c = r.normal(size=(8, 6)) * 4
    items = spark.createDataFrame([(i, (c[i % 8] + r.normal(size=6)).tolist()) for i in range(400)], "key long, vec array<double>")
    q = items.where("key < 40").select(F.col("key").alias("query_id"), "vec")
    centres = candidates.cells(items, 8)
    exact = {(x.query_id, x.key) for x in search.knn(q, items, "cos", 5).collect()}
    near = {(x.query_id, x.key) for x in candidates.knn_cells(q, items, centres, 5, probes=3).collect()}
    assert len(exact & near) / len(exact) > 0.9


def test_bloom(spark):
    b = ScalableBloom(100, 0.01)
    b.add_batch(range(250))
    b.add(b"bytes")
    assert all(b.contains_batch(range(250))) and b"bytes" in b and b.filter_count > 1 and len(b) == 251
    c = ScalableBloom.from_bytes(b.to_bytes())
    assert all(c.contains_batch(range(250))) and repr(c) == repr(b)
    assert np.mean(b.contains_batch(range(10_000, 20_000))) < 0.03
    for bad in (b"", b"XXXX" + b.to_bytes()[4:], b.to_bytes()[:4] + b"\x09" + b.to_bytes()[5:]):
        with pytest.raises(ValueError):
            ScalableBloom.from_bytes(bad)
    d = ScalableBloom.build(spark.range(0, 3000, 3).toDF("key"))
    left = {r.key for r in d.filter(spark.range(3000).toDF("key")).collect()}
    assert set(range(0, 3000, 3)) <= left and len(left) < 1100
    b.clear()
    assert len(b) == 0 and 5 not in b


def test_a_store_of_one_shard(spark, tmp_path):
    s = VectorStore.create(spark, str(tmp_path / "one"), ndim=2, sharded=False, shard_rows=1)
    s.add(s.frame([1, 2, 3], [[1, 0], [0, 1], [1, 1]]))
    assert s.upsert(s.frame([1, 2, 2], [[1, 0], [7, 7], [5, 5]])) == 1 and s.shard_count == 1
    assert rows(s.live()) == {1: [1, 0], 2: [5, 5], 3: [1, 1]}
    assert s.remove([2, 9]) == 1 and s.tombstone_count == 0 and rows(s.live()).keys() == {1, 3}
    m = VectorStore.create(spark, str(tmp_path / "many"), ndim=2, sharded=False, multi=True)
    m.add(m.frame([1, 1, 2], [[1, 0], [0, 1], [1, 1]]))
    assert m.remove([1]) == 1 and [r.key for r in m.keys().collect()] == [2]


def test_buffers_membership_counters_and_restore(spark, store, tmp_path):
    store.add(store.frame([1, 2, 3], eye(4)[:3]))
    other = VectorStore.create(spark, str(tmp_path / "o"), ndim=4)
    assert other.load_bytes(store.to_bytes()) == 3 and rows(other.live()) == rows(store.live())
    assert all(store.bloom().contains_batch([1, 2, 3]))
    found, seen = store.search_counted(queries(spark, eye(4)[:2]), 1)
    assert found.count() == 2 and seen.get["pairs"] == 6
    assert (store.ndim, store.metric, store.multi) == (4, "cos", False)
    assert VectorStore.restore(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "manifest.json").write_text("{")
    assert VectorStore.restore(spark, str(tmp_path / "bad")) is None
    assert VectorStore.restore(spark, store.path).read_only


def test_streams_commit_once(spark, store, tmp_path):
    src = str(tmp_path / "in")
    for i in range(3):
        store.frame([i, i + 1], eye(4)[:2]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("key long, seq long, vec array<double>").option("maxFilesPerTrigger", 1).parquet(src)
    ingest(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert store.size == 4 and len(store.state.commits) == 3
    assert store.add_once(store.frame([99], eye(4)[:1]), commit="ingest-0") == 0 and store.size == 4


def test_lookups_narrow_rows_before_anything_is_shuffled(spark, store):
    for i in range(3):
        store.upsert(store.frame(range(i, 40), [[i + 1.0, 1, 1, 1]] * (40 - i)))
        store.rotate()
    assert store.state.needs_dedup
    for df in (store.get(range(10)), store.contains(range(10)), store.count(range(10)), store.get(store.keys().where("key < 12"))):
        df.collect()  # so that the plan is the final one
        # Of the plan's tree: what stands between the stored rows and the join that narrows them.
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n== Initial")[0].split("\n")
        semi = next(i for i, x in enumerate(lines) if "LeftSemi" in x)
        at = next(i for i, x in enumerate(lines) if i > semi and "FileScan" in x)
        assert "BroadcastHashJoin" in lines[semi] and not any("Exchange" in x and "Broadcast" not in x or "Window" in x or "Sort" in x for x in lines[semi:at])
    assert {r.key: r.vec[0] for r in store.get(range(4)).collect()} == {0: 1, 1: 2, 2: 3, 3: 3}


def test_grid_of_blocks_equals_one_block(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select((F.col("vec_id") % 60).alias("key"), F.col("embedding").alias("vec"), "label")
    q = e.where("key % 9 = 0").withColumn("query_id", F.monotonically_increasing_id())
    wanted = lambda: [sorted(map(tuple, df.collect())) for df in (search.knn(q, e, "l2sq", 5, digits=9), search.knn(q, e, "cos", 4, digits=9, multi=True), search.range_search(q, e, "cos", 0.8, digits=9), search.pairs(q, e, "cos", digits=9))]
    one = wanted()
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 7)
    monkeypatch.setattr(search, "GRID", (11, 70))
    monkeypatch.setattr(search, "RADIUS_GRID", (13, 90))
    monkeypatch.setattr(search, "STEP", (5, 33))
    assert wanted() == one and len(one[3]) == q.count() * 500
    d = search.knn(q, e, lambda a, b: metrics.l2sq(a, b), 5, digits=9)
    assert sorted(map(tuple, d.collect())) == one[0]


def test_pairs_within_a_radius_come_once(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec")).where("key < 120")
    q = e.select(F.col("key").alias("query_id"), "vec")
    want = sorted(map(tuple, search.range_search(q, e, "cos", 0.9, digits=6).where("query_id < key").collect()))
    assert want and all(sorted(map(tuple, search.range_pairs(e, "cos", 0.9, digits=6, block=n).collect())) == want for n in (17, 1000))


def test_odd_vectors_have_no_distance(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, []), (7, [0.0, 0.0]), (8, [1.0, 1.0])]
    items = spark.createDataFrame(rows, "key long, vec array<double>")
    q = items.select(F.col("key").alias("query_id"), "vec")
    assert {(r.query_id, r.key) for r in search.knn(q, items, "cos", 9).collect()} == {(1, 1), (1, 8), (8, 1), (8, 8), (5, 5)}
    assert {(r.query_id, r.key) for r in search.knn(q, items, "l2sq", 1).collect()} == {(1, 1), (8, 8), (7, 7), (5, 5)}


def test_places_in_several_runs(spark):
    from halyard.operators import lsm

    for keys in ([7, -3, 2**60, 5, 5, -(2**61), 0, 1], [bytes([i, 255 - i]) for i in (9, 200, 3, 128)], ["b", "a", "é", ""]):
        df = spark.createDataFrame([(i % 2, k) for i, k in enumerate(keys)], f"g int, key {'long' if isinstance(keys[0], int) else 'binary' if isinstance(keys[0], bytes) else 'string'}")
        want = sorted((k if isinstance(k, int) else bytes(k, "utf8") if isinstance(k, str) else k) for k in keys)
        got = sorted((r.pos, r.key if isinstance(r.key, int) else bytes(r.key, "utf8") if isinstance(r.key, str) else bytes(r.key)) for r in lsm.numbered(df, size=2).collect())
        assert got == list(enumerate(want))
        got = sorted((r.pos, r.g) for r in lsm.numbered(df, within="g", size=1).collect())
        assert got == list(enumerate(sorted(i % 2 for i in range(len(keys)))))


def test_places_types_and_closed_lookups(spark, store, tmp_path):
    store.add(store.frame([5, 1, 9], eye(4)[:3]))
    assert (store.key_at(0), store.key_at(-1), [r.key for r in store.positions(1, 9).orderBy("pos").collect()]) == (1, 9, [5, 9])
    for i in (3, -4):
        with pytest.raises(IndexError):
            store.key_at(i)
    assert store.get([5], dtype="float").schema["vec"].dataType.simpleString() == "array<float>"
    s = VectorStore.create(spark, str(tmp_path / "k"), ndim=4, key_lookups=False)
    s.add(s.frame([1], eye(4)[:1]))
    assert 1 not in s and s[1] is None and s.count([1]).first().n == 0 and s.remove([1]) == 0 and s.size == 1


def test_large_batches_fill_shards_and_bytes_rotate(spark, tmp_path):
    s = VectorStore.create(spark, str(tmp_path / "l"), ndim=2, shard_rows=4)
    assert s.add(s.frame(range(10), [[i, 1] for i in range(10)])) == 10
    assert {r.shard_id: r["count"] for r in s.rows().groupBy("shard_id").count().collect()} == {0: 4, 1: 4, 2: 2} and s.state.active == 2
    b = VectorStore.create(spark, str(tmp_path / "b"), ndim=2, shard_bytes=1)
    b.add(b.frame([1], [[1, 1]]))
    b.add(b.frame([2], [[1, 1]]))
    assert b.shard_count == 2 and b.serialized_length > 0 and not b.state.needs_dedup  # the key ranges don't meet


def test_writes_leave_rows_and_vacuum_deletes_what_is_left(spark, store):
    store.add(store.frame(range(6), [[i, 1, 1, 1] for i in range(6)]))
    first = store.state.shards[0]
    store.upsert(store.frame([1], [[9] * 4]))
    store.remove([2])
    assert store.state.shards[0][:1] == first and store.physical_rows == 5 and store.stats()["struck"] == 2
    store.rotate()
    store.add(store.frame([7], eye(4)[:1]))
    want, kept = rows(store.live()), store.state.shards[1]
    assert store.compact() == 0 and store.state.shards[1] == kept and store.state.shards[0] != first and not store.state.strikes
    assert store.vacuum() >= 3 and rows(store.live()) == rows(VectorStore.open(spark, store.path).live()) == want and store.vacuum() == 0


def test_replays_of_long_ago(spark, store, monkeypatch):
    monkeypatch.setattr(VectorStore, "REMEMBERED", 2)
    for i in range(5):
        store.upsert(store.frame([1], [[i + 1.0] * 4]), commit=f"s-{i}")
    store.upsert(store.frame([1], [[50.0] * 4]), commit="by hand")
    store.upsert(store.frame([1], [[60.0] * 4]), commit="t-0")
    again = VectorStore.open(spark, store.path)
    for c in ("s-0", "s-2", "s-4", "by hand", "t-0"):
        assert again.upsert(again.frame([1], [[0.5] * 4]), commit=c) == 0
    assert len(again.state.commits) == 3 and list(again[1]) == [60.0] * 4


def test_kept_filters(spark, store):
    store.add(store.frame([1, 2], eye(4)[:2]))
    assert 1 in store.rebuild_bloom() and store.state.bloom == store.state.version
    version = store.state.version
    assert 2 in VectorStore.open(spark, store.path).bloom() and store.state.version == version
    store.add(store.frame([3], eye(4)[:1]))
    assert 3 in store.bloom() and store.state.bloom == store.state.version  # outdated, so built anew
    with open(store.path + "/bloom", "wb") as f:
        f.write(b"HBLM")
    assert 3 in store.bloom()
    with pytest.raises(ValueError):
        ScalableBloom.load(spark, store.path + "/none")


def test_bloom_hashes_don_t_depend_on_the_batch():
    from halyard.operators.bloom import hashes

    mixed = [1, -5, b"x", 2**70, -(2**63)]
    assert hashes(mixed).tolist() == [hashes([k])[0].tolist() for k in mixed] and hashes([1, -5]).tolist() == hashes(mixed)[:2].tolist()
    b = ScalableBloom(10, 0.01)
    b.add_batch(range(95))
    assert [x.count for x in b.layers] == [10, 20, 40, 25] and all(b.contains_batch(range(95))) and not len(b.contains_batch([]))


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    from halyard.sources import files

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        files.shared(Session)


# Commits


def test_two_writers_that_add_different_keys_both_stay(spark, tmp_path):
    a = VectorStore.create(spark, str(tmp_path / "w"), ndim=2, shard_rows=3)
    a.add(a.frame([0], [[0, 1]]))
    b, c, d = (VectorStore.open(spark, a.path) for _ in range(3))
    assert a.add(a.frame([1, 3, 5], [[1, 1]] * 3)) == 3 and b.add(b.frame([2, 4], [[2, 1]] * 2)) == 2
    with pytest.raises(ConflictError):
        c.add(c.frame([4, 9], [[3, 1]] * 2))
    with pytest.raises(ConflictError):
        d.remove([0])
    want = {0: [0, 1], **{k: [1, 1] for k in (1, 3, 5)}, **{k: [2, 1] for k in (2, 4)}}
    assert rows(VectorStore.open(spark, a.path).live()) == want == rows(b.live())
    assert c.refresh() == b.state.version and c.add(c.frame([4, 9], [[3, 1]] * 2)) >= 1 and 9 in c
    assert d.refresh() and d.remove([0]) == 1 and a.refresh() and 0 not in a
    with pytest.raises(ConflictError):
        b.upsert(b.frame([2], [[7, 7]]))


def test_a_replay_by_another_writer_changes_nothing(spark, store):
    other = VectorStore.open(spark, store.path)
    assert store.add(store.frame([1], eye(4)[:1]), commit="s-0") == 1
    assert other.add(other.frame([1], [[5] * 4]), commit="s-0") == 0 and rows(other.live()) == {1: [1, 0, 0, 0]}


def test_what_a_lost_compaction_left_is_never_taken_up(spark, tmp_path, monkeypatch):
    s = VectorStore.create(spark, str(tmp_path / "c"), ndim=2, shard_rows=10)
    s.add(s.frame(range(30), [[i, 1] for i in range(30)]))
    s.remove([0, 11])
    with monkeypatch.context() as m:
        m.setattr("halyard.sources.store._swap", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            s.compact()
    s = VectorStore.open(spark, s.path)
    assert s.add(s.frame([100, 101], [[1, 1]] * 2)) == 2 and s.count([5]).first().n == 1 and s.size == 30
    assert s.vacuum() > 0 and s.size == 30


WRITES = {
    "add": lambda s: s.add(s.frame([50, 51, 52, 53, 54], [[i, 1] for i in range(5)])),
    "upsert": lambda s: s.upsert(s.frame([1, 2, 60], [[9, 9]] * 3)),
    "remove": lambda s: s.remove([1, 5]),
    "compact": lambda s: s.compact(),
    "cells": lambda s: s.build_cells(2),
}


@pytest.mark.parametrize("name", WRITES)
def test_a_write_killed_at_any_step_changes_nothing(spark, tmp_path, monkeypatch, name):
    """Each step that touches files is made to fail in turn; what others see stays as it was, and the write then succeeds."""
    from halyard.sources import files

    s = VectorStore.create(spark, str(tmp_path / "k"), ndim=2, shard_rows=4)
    s.add(s.frame(range(6), [[i + 1, 1] for i in range(6)]))
    s.upsert(s.frame([1, 4], [[7, 7]] * 2))
    s.remove([0])
    before, step, failed = rows(s.live()), 0, 0
    while True:
        calls = iter(range(10_000))

        def failing(f, calls=calls, step=step):
            def run(*a, **b):
                if next(calls) == step:
                    raise OSError("killed")
                return f(*a, **b)

            return run

        with monkeypatch.context() as m:
            for f in ("create", "delete", "folders", "size", "exists"):
                m.setattr(files, f, failing(getattr(files, f)))
            m.setattr(VectorStore, "_writer", staticmethod(failing(VectorStore._writer)))
            m.setattr(VectorStore, "_keys", failing(VectorStore._keys))
            try:
                WRITES[name](VectorStore.open(spark, s.path)) if step else WRITES[name](s)
                done = True
            except OSError:
                done = False
        if done:
            break
        failed, step = failed + 1, step + 1
        assert rows(VectorStore.open(spark, s.path).live()) == before
        s = VectorStore.open(spark, s.path)
    assert failed >= 1
    after = rows(VectorStore.open(spark, s.path).live())
    assert after == {"add": before | {50 + i: [i, 1] for i in range(5)}, "upsert": before | dict.fromkeys((1, 2, 60), [9, 9]), "remove": {k: v for k, v in before.items() if k not in (1, 5)}}.get(name, before)


def test_a_store_as_of_a_version(spark, store):
    store.add(store.frame([1, 2], eye(4)[:2]))
    first = store.state.version
    store.upsert(store.frame([1], [[9] * 4]))
    store.compact()
    old = VectorStore.open(spark, store.path, version=first)
    assert rows(old.live()) == {1: [1, 0, 0, 0], 2: [0, 1, 0, 0]} and old.read_only
    assert [x["op"] for x in store.history()] == ["other", "append", "other", "other"] and store.history()[-1]["rows"] == 2
    assert store.vacuum(keep=9) == 0 and rows(old.live())[1] == [1, 0, 0, 0]
    assert store.vacuum(grace=3600) == 0 and store.vacuum() > 0 and [x["version"] for x in store.history()] == [store.state.version]
    with pytest.raises(ValueError):
        VectorStore.open(spark, store.path, version=first)


def test_a_manifest_is_created_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from halyard.sources import files

    path = f"file://{tmp_path}/m/1.json"
    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda i: files.create(spark, path, str(i).encode() * 1000), range(8)))
    assert sum(done) == 1 and files.read(spark, path) == str(done.index(True)).encode() * 1000 and files.folders(spark, f"{tmp_path}/m") == ["1.json"]


@pytest.mark.parametrize("kind", ["dense", "varbits"])
def test_shards_hold_their_bytes_within_a_batch(spark, tmp_path, kind):
    r = np.random.default_rng(0)
    s = VectorStore.create(spark, str(tmp_path / "b"), 64 if kind == "dense" else None, kind=kind, shard_bytes=100_000)
    vectors = r.normal(size=(2000, 64)).tolist() if kind == "dense" else [r.bytes(1 + i * 31 // 20_000) for i in range(20_000)]
    s.add(s.frame(range(len(vectors)), vectors))
    s.add(s.frame(range(len(vectors), len(vectors) + 100), vectors[:100]))
    sizes = [*s.stats()["bytes_by_shard"].values()]
    assert len(sizes) > 2 and max(sizes) <= 200_000 and sorted(sizes)[1] > 30_000, sizes
    assert s.size == len(vectors) + 100


def test_small_files_have_small_filters(spark, store):
    store.add(store.frame(range(10), [[i, 1, 1, 1] for i in range(10)]))
    assert store.serialized_length < 8_000
    big = VectorStore.create(spark, store.path + "-big", ndim=1)
    big.add(spark.range(200_000).select(F.col("id").alias("key"), F.array(F.col("id").cast("double")).alias("vec")).coalesce(1))
    assert 5 in big and 200_001 not in big


def test_approximate_search_after_writes_reads_only_its_cells(spark, tmp_path):
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 16))
    x = centres[np.arange(1200) % 20] + 0.1 * r.normal(size=(1200, 16))
    s = VectorStore.create(spark, str(tmp_path / "a"), ndim=16)
    with pytest.raises(ValueError, match="build_cells"):
        s.search(queries(spark, x[:1]), 1, exact=False)
    s.add(s.frame(range(600), x[:600]))
    s.build_cells(20)
    s.add(s.frame(range(600, 1000), x[600:1000]))
    s.rotate()
    s.upsert(s.frame(range(900, 1200), x[900:]))
    s.upsert(s.frame([0, 20], -x[[0, 20]]))
    s.add(s.frame([5000], [[0.0] * 16]))
    s.remove(range(40, 60))
    for _ in range(2):
        q = queries(spark, x[::10])
        near, exact = s.search(q, 5, exact=False, probes=2), s.search(q, 5)
        got, want = ({(y.query_id, y.key) for y in d.collect()} for d in (near, exact))
        assert len(got & want) >= 0.9 * len(want) and all(k not in range(40, 60) for _, k in got)
        lines = near._jdf.queryExecution().executedPlan().toString()
        assert "cell" in lines.split("PartitionFilters: [")[1].split("]")[0]
        few = s.search(queries(spark, x[:1]), 5, exact=False, probes=1)
        assert few.count() == 5
        s.compact()
    assert s.live().count() == 1200 - 20 + 1 and s.state.centres


# Sub-codes


def code_rows(spark, words, name):
    return spark.createDataFrame([(i, [int(w) for w in row]) for i, row in enumerate(words.view(np.int64))], f"{name} bigint, w array<bigint>").select(name, F.struct(F.col("w").alias("words"), F.lit(256).alias("bits")).alias("vec"))


@pytest.mark.parametrize("limit", [1 << 20, 10])
def test_subcodes_find_the_nearest_codes(spark, monkeypatch, limit):
    """Families of near codes are proven from few candidates; codes without neighbours are compared with all."""
    monkeypatch.setattr(candidates, "BROADCAST_PROBES", limit)
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, size=(50, 4), dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 63, size=(2000, 4), dtype=np.uint64)
    codes_ = base[np.arange(2000) % 50] ^ np.where(r.random((2000, 4)) < 0.6, flips, np.uint64(0))
    asked = np.concatenate([codes_[::100], r.integers(0, 2**63, size=(3, 4), dtype=np.uint64)])
    counts = []
    got = candidates.knn_hamming(code_rows(spark, asked, "query_id"), code_rows(spark, codes_, "key"), 7, bits=256, counts=counts)
    d = np.bitwise_count(asked[:, None] ^ codes_[None]).sum(2)
    want = sorted((i, n + 1, int(k), float(d[i, k])) for i in range(len(asked)) for n, k in enumerate(np.lexsort((np.arange(2000), d[i]))[:7]))
    assert sorted(map(tuple, got.collect())) == want
    assert sum(counts[:-1]) < 0.05 * 2000 * len(asked) and counts[-1] == 3
    with pytest.raises(ValueError):
        candidates.knn_hamming(code_rows(spark, asked, "query_id"), code_rows(spark, codes_, "key"), 0)


def test_subcodes_of_odd_tables(spark):
    none = spark.createDataFrame([], "key bigint, vec struct<words:array<bigint>,bits:int>")
    one = spark.createDataFrame([(1, ([5, 0, 0, 0], 64)), (2, None), (3, ([5, 0, 0, 0], 64))], none.schema)
    q = one.withColumnRenamed("key", "query_id")
    assert candidates.knn_hamming(q, none, 2).count() == 0 and candidates.knn_hamming(q.where("false"), one, 2).count() == 0
    assert sorted(map(tuple, candidates.knn_hamming(q, one, 5).collect())) == [(1, 1, 1, 0.0), (1, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 3, 0.0)]


def test_timer(caplog):
    from halyard.functions.timing import timer

    with caplog.at_level("INFO", logger="halyard"):
        with timer("fine", log_start=True):
            pass
        with pytest.raises(KeyError), timer("failed"):
            raise KeyError
    said = [r.getMessage() for r in caplog.records]
    assert said[0] == "fine ..." and said[1].startswith("fine: 0.") and said[2].startswith("failed: 0.") and len(said) == 3
