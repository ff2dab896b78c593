import base64
import hashlib
from pathlib import Path

import numpy as np
import public_tokenizers as vocab
import pytest
import tiktoken

from halyard.llm import order, queries
from halyard.llm.common import scratch

HOW = {"ranks_path": vocab.path("byte_bpe_50k.tiktoken"), "pattern": vocab.PATTERN, "pad": 50256}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutations(n):
    a, b = order.permute(np.arange(n), n, 7), order.permute(np.arange(n), n, 8)
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 17 or (a != b).any()


def plain_slot(number, n, key):
    """The Feistel network of one number, walked until it falls below n, in plain whole numbers."""
    m = (1 << 64) - 1

    def scramble(x):
        for _ in range(2):
            x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & m
        return x ^ x >> 32

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = [scramble((i * 0x9E3779B97F4A7C15 + key) & m) for i in range(1, 7)]
    while True:
        left, right = number >> half, number & ((1 << half) - 1)
        for k in keys:
            left, right = right, left ^ (scramble(right ^ k) & ((1 << half) - 1))
        number = left << half | right
        if number < n:
            return number


def library():
    with open(HOW["ranks_path"], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=HOW["pattern"], mergeable_ranks=ranks, special_tokens={})


def sequences(rows, length):
    """All sequences in order of number, of (id, text) rows; ids don't repeat but for rows alike."""
    out, enc = [], library()
    for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = enc.encode_ordinary(text or "")
        out += [(ids[i : i + length] + [HOW["pad"]] * length)[:length] for i in range(0, len(ids), length)]
    return out


def test_shards_hold_the_permuted_sequences(spark):
    rows = [(i, f"text {i} " * (i % 9) + "é") for i in range(60)] + [(70, None), (71, ""), (None, "null id"), (-5, "x" * 3000), (72, "twice twice"), (72, "twice twice")]
    docs = spark.createDataFrame([(*r, "d") for r in rows], "doc_id bigint, text string, data string")
    want = sequences(rows, 8)
    for key in (1, 2):
        path = f"{scratch(spark)}/order-{key}"
        order.write(docs, path, key=key, length=8, stride=16, **HOW)
        got = [x.tolist() for x in order.read(spark, path, 0, len(want), length=8, stride=16)]
        slots = [plain_slot(i, len(want), key) for i in range(len(want))]
        assert [got[s] for s in slots] == want
        assert [x.tolist() for x in order.read(spark, path, 21, 30, length=8, stride=16)] == got[21:51]
        shards = spark.read.parquet(path).collect()
        assert all(s.first_slot == 16 * s.shard and len(s.payload) == 16 * s.sequences for s in shards)


def test_empty_table(spark):
    path = f"{scratch(spark)}/order-none"
    order.write(spark.createDataFrame([], "doc_id bigint, text string"), path, key=1, **HOW)
    assert spark.read.parquet(path).count() == 0


def test_documents(spark):
    """Every column of every shard against plain code of its own."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sequences(rows, 512)
    placed = [None] * len(want)
    for i, s in enumerate(want):
        placed[plain_slot(i, len(want), queries.ORDER_KEY)] = s
    shards = [placed[i : i + 512] for i in range(0, len(placed), 512)]
    want = [(i, i * 512, len(s), sum(x != HOW["pad"] for q in s for x in q), hashlib.sha256(np.array(s, "<u2").tobytes()).hexdigest()) for i, s in enumerate(shards)]
    assert sorted(map(tuple, queries.op6_training_order(spark, sf).collect())) == want


def test_raw_files_are_read_from_any_slot(spark):
    rows = [(i, f"raw {i} \n\n text " * (i % 13)) for i in range(80)] + [(90, "\n" * 700), (91, "z" * 30_000), (92, "same"), (92, "same"), (92, "same")]
    docs = spark.createDataFrame([(*r, "d", 3) for r in rows], "`doc.id` bigint, `a.text` string, part string, n int")
    want, path = sequences(rows, 8), f"{scratch(spark)}/order-raw"
    order.write(docs, path, key=5, length=8, stride=16, raw=True, id_col="doc.id", text_col="a.text", **HOW)
    placed = [None] * len(want)
    for i, s in enumerate(want):
        placed[plain_slot(i, len(want), 5)] = s
    for first, count in ((0, len(want)), (37, 5), (15, 2), (len(want) - 3, 3)):
        assert [x.tolist() for x in order.read_raw(spark, path, first, count, length=8, stride=16)] == placed[first : first + count]
    # Every file but the last is as long as its stride says.
    shards = sorted(Path(path.removeprefix("file://")).glob("shard=*/part-*"), key=lambda p: int(p.parent.name[6:]))
    assert [p.stat().st_size for p in shards] == [18 * len(placed[i : i + 16]) for i in range(0, len(placed), 16)]


def test_copies_of_a_document_take_all_its_numbers(spark):
    rows = [(1, "one two three " * 20)] * 40 + [(None, "none")] * 5 + [(2, "two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    want, path = sequences(rows, 8), f"{scratch(spark)}/order-copies"
    order.write(docs, path, key=1, length=8, stride=16, **HOW)
    got = [x.tolist() for x in order.read(spark, path, 0, len(want), length=8, stride=16)]
    assert [got[plain_slot(i, len(want), 1)] for i in range(len(want))] == want
    assert not [x.name for x in spark.catalog.listTables() if x.name.startswith("halyard_")]


def test_ids_of_more_bits_are_refused(spark, tmp_path):
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % (i + 70_000 * (i == 120)) for i in range(256)))
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    with pytest.raises(Exception, match="more than 16 bits"):
        order.write(docs, f"{scratch(spark)}/order-wide", key=1, ranks_path=str(tmp_path / "ranks"), pattern=HOW["pattern"], pad=0)
    with pytest.raises(ValueError):
        order.write(docs, f"{scratch(spark)}/order-wide", key=1, ranks_path=HOW["ranks_path"], pattern=HOW["pattern"], pad=1 << 16)
