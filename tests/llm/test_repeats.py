import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import queries, repeats


def brute(rows, width=13):
    """[(id, words, removed, kept text)] of (id, text) rows."""
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = defaultdict(list)
    for i, w in docs:
        for s in range(len(w) - width + 1):
            if i is not None:
                first[tuple(w[s : s + width])].append(i)
    first = {k: min(v) for k, v in first.items()}
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - width + 1):
            if i is not None and first[tuple(w[s : s + width])] < i:
                gone.update(range(s, s + width))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=13, max_size=40), st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(1, 4), max_size=12), st.sampled_from([13, 5, 2]))
def test_equal_windows_pick_equal_symbols(core, before, after, width):
    text = lambda x: " ".join(f"t{i}" for i in x)
    w, starts, counts = repeats.tokens([text(core), text(before + core + after), ""])
    best = repeats.picks(w, width)
    x, y = repeats.names(w, width, np.arange(len(best)))
    a, b = starts[0], starts[1] + len(before)
    n = len(core) - width + 1
    assert (best[a : a + n] != 0).all() and (best[a : a + n] == best[b : b + n]).all()
    assert (x[a : a + n] == x[b : b + n]).all() and (y[a : a + n] == y[b : b + n]).all()
    edges = {0, *(starts + counts).tolist()}
    for i in range(len(best)):
        assert (best[i] == 0) == any(j in edges for j in range(i, i + width))


def test_texts_pick_alone_what_they_pick_among_others():
    r = np.random.default_rng(11)
    texts = [" ".join(f"v{i}" for i in r.integers(0, 1000, n)) for n in [*[13] * 150, *range(13, 40)]]
    w, starts, counts = repeats.tokens([*texts, "tail " * 50])
    among = repeats.picks(w, 13)
    for t, s, c in zip(texts, starts, counts):
        x, (at, *_), _ = repeats.tokens([t])
        assert (repeats.picks(x, 13)[at : at + c - 12] == among[s : s + c - 12]).all()


@pytest.mark.parametrize(("limit", "sample"), [(1 << 18, 64), (0, 1)])
def test_odd_tables(spark, monkeypatch, limit, sample):
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(repeats, "SAMPLE", sample)
    monkeypatch.setattr(repeats, "PARTS", 4)
    r = np.random.default_rng(5)
    words = lambda n, k: " ".join(f"v{i}" for i in r.integers(0, k, n))
    passage = words(30, 1000)
    rows = [(int(i), words(20, 9) + " " + passage + "\n " + words(15, 500)) for i in r.permutation(20)]
    rows += [(30, rows[0][1]), (31, "\x1c é" + passage), (32, "a " * 60), (33, "a " * 40), (34, "a " * 13), (35, "a " * 12), (36, ""), (37, None), (38, "z" * 100_000)]
    rows += [(None, passage), (40, passage), (40, passage + " more"), (40, passage), (41, passage[: len(passage) // 3])]
    table = spark.createDataFrame([(*x, "k") for x in rows], "doc_id bigint, text string, key string")
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in repeats.dedup(table).collect()), key=str)
    assert got == brute(rows)
    assert repeats.dedup(table.where("false")).count() == 0


@pytest.mark.parametrize(("sf", "sample"), [("sf0.001", 64), ("sf0.01", 1)])
def test_documents_against_brute_force(spark, monkeypatch, sf, sample):
    monkeypatch.setattr(repeats, "SAMPLE", sample)
    path = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in queries.op1_substring_dedup(spark, path).collect()), key=str)
    assert got == sorted(((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows)), key=str)
