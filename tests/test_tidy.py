"""Small folders merged by tiers."""

import random

import pytest

from halyard.sources import files
from halyard.sources.store import ConflictError, VectorStore, _tiers
from halyard.streaming.ingest import ingest


def live(store):
    return {r.key: list(r.vec) for r in store.live().collect()}


@pytest.mark.parametrize("ratio", [2, 3, 4])
def test_few_folders_and_few_rewrites(ratio):
    rng = random.Random(1)
    own, written = [], 0
    for i in range(2000):
        own.append(rng.randrange(1, 20))
        groups = _tiers(own, ratio)
        assert all(len(g) >= ratio for g in groups) and sorted({j for g in groups for j in g}) == sorted(j for g in groups for j in g)
        made = [sum(own[j] for j in g) for g in groups]
        written += sum(made)
        own = [n for j, n in enumerate(own) if not any(j in g for g in groups)] + made
        tier = [max(t for t in range(40) if ratio**t <= n) for n in own]
        assert max(map(tier.count, tier)) < ratio
    n = sum(own)
    assert len(own) <= ratio * n.bit_length() and written <= n * n.bit_length()
    assert _tiers([], 2) == [] == _tiers([5], 2) and _tiers([1, 1], 2) == [[0, 1]]


@pytest.mark.parametrize("kind", ["dense", "cells", "bits"])
def test_tidy_changes_nothing_visible(spark, tmp_path, kind):
    store = VectorStore.create(spark, str(tmp_path / "s"), ndim=16 if kind == "bits" else 2, kind="bits" if kind == "bits" else "dense", shard_rows=14)
    vec = (lambda k, i: bytes([k, i])) if kind == "bits" else (lambda k, i: [float(k + 1), float(i)])
    want = {}
    for i in range(12):
        keys = [3 * i, 3 * i + 1, 3 * i + 2, max(0, 3 * i - 7)]
        store.upsert(store.frame(keys, [vec(k, i) for k in keys]))
        want |= {k: list(vec(k, i)) for k in keys}
        if i == 5 and kind == "cells":
            store.build_cells(2)
        if i % 4 == 3:
            store.remove([3 * i])
            del want[3 * i]
    before = live(store)
    assert before == want
    old, large = store.state, [x for own in store.state.shards.values() for x in own if x[1] >= 8]
    assert store.tidy(2) > 0 and live(store) == want == live(VectorStore.open(spark, store.path))
    assert live(VectorStore.open(spark, store.path, version=old.version)) == want
    now = [x for own in store.state.shards.values() for x in own]
    assert len(now) < sum(map(len, old.shards.values())) and (len(large) != 1 or large[0] in now)
    # Later writes strike and hide merged rows too.
    keys = [0, 1, 35, 40]
    store.upsert(store.frame(keys, [vec(k, 99) for k in keys]))
    store.remove([2, 34])
    want = {k: v for k, v in (want | {k: list(vec(k, 99)) for k in keys}).items() if k not in (2, 34)}
    assert live(store) == want
    store.tidy(2)
    store.compact()
    store.vacuum()
    assert live(VectorStore.open(spark, store.path)) == want


def test_strikes_merge_and_go(spark, tmp_path):
    store = VectorStore.create(spark, str(tmp_path / "s"), ndim=1)
    store.add(store.frame(range(64), [[float(i)] for i in range(64)]))
    for i in range(4):
        store.upsert(store.frame([i], [[-1.0]]))
        store.remove([60 + i])
    assert len(store.state.strikes) == 8
    want = live(store)
    big = store.state.shards[0][0]
    store.tidy(4)
    # The large folder stays, so what strikes it does as well.
    assert len(store.state.strikes) == 1 and big in store.state.shards[0] and len(store.state.shards[0]) == 2 and live(store) == want
    assert store.tidy(4) == 0
    again = VectorStore.create(spark, str(tmp_path / "t"), ndim=1)
    for i in range(4):
        again.add(again.frame([2 * i, 2 * i + 1], [[1.0]] * 2))
        again.remove([2 * i])
    again.tidy(2)
    assert again.state.strikes == () and again.physical_rows == 4 and sorted(live(again)) == [1, 3, 5, 7]


def test_another_writer_makes_it_raise(spark, tmp_path):
    a = VectorStore.create(spark, str(tmp_path / "s"), ndim=1)
    for i in range(4):
        a.add(a.frame([i], [[1.0]]))
    b = VectorStore.open(spark, a.path)
    b.add(b.frame([9], [[1.0]]))
    with pytest.raises(ConflictError):
        a.tidy(2)
    a.refresh()
    a.tidy(2)
    assert sorted(live(a)) == [0, 1, 2, 3, 9] and len(a.state.shards[0]) <= 2
    for bad in (1, 0):
        with pytest.raises(ValueError):
            a.tidy(bad)


def test_a_stream_keeps_few_folders(spark, tmp_path):
    store = VectorStore.create(spark, str(tmp_path / "s"), ndim=1)
    for i in range(9):
        spark.createDataFrame([(i, [float(i)])], "key bigint, vec array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key bigint, vec array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, store, str(tmp_path / "c"), mode="add", tidy=3).awaitTermination()
    assert len(live(store)) == 9 and len(store.state.shards[0]) == 1
    store.vacuum()
    assert files.size(spark, f"{store.path}/rows") < 20_000
