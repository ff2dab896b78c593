import base64
import hashlib
from functools import cache

import numpy as np
import public_tokenizers as vocab
import tiktoken
import pytest
from hypothesis import given, settings
import pytest
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.llm import bpe, queries

RANKS = vocab.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "a b", "  two  spaces \n\n x", "é ñ 漢字 🙂 it's we'll", "x" * 400, " " * 300 + "y", "ab cd " * 200, "1234 " * 90 + "\t\t\n" * 50 + "end", "same", "same"]


def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip_with_every_chunk_size(spark):
    want = reference()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "x"), (None, "null id", "x")], "doc_id bigint, text string, ids string")
    for chunk, overlap in ((1 << 15, 512), (50, 20), (7, 3), (64, 1)):
        got = bpe.decode(bpe.encode(docs, RANKS, vocab.PATTERN, chunk_chars=chunk, overlap=overlap), RANKS, vocab.PATTERN).collect()
        assert len(got) == len(TEXTS) + 2
        for r in got:
            text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
            assert r.ids == want.encode_ordinary(text)
            assert bytes(r.decoded) == text.encode()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(docs, RANKS, vocab.PATTERN).count() == 0


def test_documents_match_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = reference()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs, RANKS, vocab.PATTERN, chunk_chars=2000, overlap=64).where(F.col("doc_id") >= 0).collect():
        assert r.ids == want.encode_ordinary(texts[r.doc_id])


@settings(max_examples=300, deadline=None)
@given(st.text("abeinrst \nZ19é漢", min_size=1, max_size=400))
def test_merges_equal_the_library(text):
    ranks, want = merge_ranks()
    for piece in (text.encode(), text.encode()[:100]):
        assert bpe.merge(piece, ranks) == want._core_bpe.encode_single_piece(piece)
    pieces = [x for size in (100, 7, 3) for i in range(0, len(text), size) if (x := text[i : i + size].encode()) not in ranks]
    if pieces:
        assert [np.frombuffer(x, np.int32).tolist() for x in merges().all(pieces)] == [want._core_bpe.encode_single_piece(x) for x in pieces]


@pytest.mark.parametrize("size", [1, 40, 150_000])
def test_full_generations_change_no_ids(monkeypatch, size):
    monkeypatch.setattr(bpe, "CACHE", size)
    monkeypatch.setattr(bpe, "TEXT_CHARS", 50)
    texts = ["", "the cat", "unbelievable antidisestablishmentarianism " * 3, "x" * 500, " zq" * 90, "the cat", "漢字 é\n\n"] * 3
    got = bpe.Codec(RANKS, vocab.PATTERN).ids(texts)
    assert [x.tolist() for x in got] == [reference().encode_ordinary(t) for t in texts]


@cache
def merges():
    return bpe.Merges(merge_ranks()[0])


@cache
def merge_ranks():
    with open(RANKS, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, reference()


def test_the_query_and_very_long_texts(spark, tmp_path):
    """All columns of op3 against the library: whole documents, and texts of several chunks of the production size."""
    r = np.random.default_rng(1)
    long = ["z" * 60_000, "é漢 " * 9_000, " " * 20_000 + "end", "".join(map(chr, r.integers(32, 0x2FFF, 30_000))), "word " * 8_191 + "x", ("a" * 8_190 + " bc ") * 3]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*long, None, long[1]])], "doc_id bigint, text string")
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    texts, want = {x.doc_id: x.text or "" for x in docs.unionByName(more).collect()}, reference()
    got = queries.op3_byte_bpe(spark, str(tmp_path)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert len(got) == len(texts)
    for x in got:
        ids = want.encode_ordinary(texts[x.doc_id])
        assert tuple(x) == (x.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[x.doc_id].encode()))


def test_dotted_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "k")], "`doc.id` bigint, `a.text` string, ids string")
    got = bpe.decode(bpe.encode(docs, RANKS, vocab.PATTERN, id_col="doc.id", text_col="a.text"), RANKS, vocab.PATTERN, id_col="doc.id")
    assert got.columns == ["doc.id", "ids", "decoded"] and bytes(got.first().decoded) == b"a b"


def test_decoding_in_small_slices(spark, monkeypatch):
    """However ids are cut into slices, rows, nulls and long rows come back whole."""
    import public_tokenizers as vocab

    monkeypatch.setattr(bpe, "DECODE_IDS", 5)
    texts = ["", None, "hello there", "a longer text of many more ids than a slice takes, é", *(f"row {i}" for i in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    ranks = vocab.path("byte_bpe_50k.tiktoken")
    got = bpe.decode(bpe.encode(docs, ranks, vocab.PATTERN), ranks, vocab.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in got} == {i: t or "" for i, t in enumerate(texts)}
