import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import jaccard, queries
from halyard.llm.components import components


def brute(rows, n=5, percent=80):
    """[(id, set size, component)] of (id, text) rows."""

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            a, b = sets[i], sets[j]
            if percent * len(b) > 100 * len(a):
                break
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                up[root(i)] = root(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[root(i)] = min(doc, names.get(root(i), doc))
    return sorted(((doc, len(s), names.get(root(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df, name="component", size="n_grams"):
    return sorted(((r.doc_id, r[size], r[name]) for r in df.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.sampled_from([80, 90, 60]))
def test_linked_sets_share_an_entry(n, seed, percent):
    r = np.random.default_rng(seed)
    base = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    drop, add = r.integers(0, 1 + len(base) // 5), r.integers(0, 1 + len(base) // 5)
    other = np.unique(np.concatenate([r.permutation(base)[drop:], r.integers(0, 2**63, add, dtype=np.uint64)]))
    both = len(np.intersect1d(base, other))
    if np.array_equal(base, other) or 100 * both < percent * (len(base) + len(other) - both):
        return
    (x, tx), (y, ty) = jaccard.signatures(base, percent), jaccard.signatures(other, percent)
    shared = set(x.tolist()) & set(y.tolist())
    assert shared
    # Each side may pass over as many entries as its slack says and still meet the other.
    for sig, tag in ((x, tx), (y, ty)):
        here = [t for s, t in zip(sig.tolist(), tag.tolist()) if s in shared]
        assert any(len([t for t in here if t == tag_]) >= tag_ // 2 for tag_ in set(here))


@pytest.mark.parametrize("frequent", [4, 1, 64])
def test_documents_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got(queries.op5_ngram_jaccard(spark, "/root/testdata/sf0.01"), "component_id", "n_shingles") == want


def test_chains_small_sets_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    words = [f"w{i}" for i in range(60)]
    rows = [(100 - k, " ".join(words[:40][: 40 - k] + [f"x{k}{j}" for j in range(k)])) for k in range(8)]  # links form a chain
    rows += [(200 + k, " ".join(words[20 : 29 + k])) for k in range(4)] + [(210, "A b"), (211, "a  B"), (212, "a"), (213, ""), (214, None), (None, "a"), (213, "a b c d e f g h i j"), (220, "a b c d e f g h i j"), (None, "only me")]
    rows += [(300 + i, "same text " * 30) for i in range(20)] + [(400, "v" * 200_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, node string")
    assert got(jaccard.join(docs)) == brute(rows)
    assert jaccard.join(docs.where("false")).count() == 0


@pytest.mark.parametrize("sample", [64, 1])
def test_families_of_near_copies_in_blocks(spark, monkeypatch, sample):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    monkeypatch.setattr(jaccard, "BROADCAST_HUBS", 0 if sample == 1 else 1 << 18)
    r = np.random.default_rng(2)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(90):
        words = list(base)
        for j in r.integers(0, 150, r.integers(0, 7)):
            words[j] = f"x{r.integers(0, 30)}"
        rows.append((int(1000 - i), " ".join(words)))
    want = brute(rows)
    assert 1 < len({c for *_, c in want}) < 60
    assert got(jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"))) == want


@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_near_copies_with_null_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = np.random.default_rng(4)
    base, other = [f"w{i}" for i in range(150)], [f"u{i}" for i in range(60)]
    rows = [(500, " ".join(other)), (None, " ".join(other[:-1])), (None, " ".join(other[2:])), (None, " ".join(other[:-1]))]  # small
    rows += [(None, "p q r s t u v w x y z"), (None, "p q r s t u v w x y z a"), (600, "unlike any other")]
    for i in range(60):  # a family, most of it without ids
        words = list(base)
        for j in r.integers(0, 150, r.integers(0, 4)):
            words[j] = f"x{r.integers(0, 30)}"
        rows.append((700 + i if i % 20 == 3 else None, " ".join(words)))
    if ids == "string":
        rows = [(None if i is None else str(i), t) for i, t in rows]
    docs = spark.createDataFrame(rows, f"doc_id {ids}, text string")
    want = brute(rows)
    assert got(jaccard.join(docs)) == want
    kept = [(x.doc_id, x.text) for x in jaccard.unique(docs).collect()]
    # One row of each class: the two with ids, the pair without, and the one that is like none.
    assert len(kept) == 4 and {i for i, _ in kept if i is not None} == {c for *_, c in want if c is not None}



def test_components_of_a_long_path(spark):
    n = 3000
    order = np.random.default_rng(0).permutation(n).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1) if i != 1500] + [(5000, 5000)], "a bigint, b bigint")
    comp = {r.node: r.component for r in components(edges).collect()}
    assert {comp[x] for x in order[:1501]} == {min(order[:1501])} and {comp[x] for x in order[1501:]} == {min(order[1501:])}


def test_allocation_is_by_cost():
    """Small sets take the form with one-deletion neighbours, large ones the other, and each costs no more than its rival."""
    for percent in (60, 80, 90):
        edge = jaccard.bands(percent, 5000)
        numbers = [jaccard.allot(lo, hi - 1, percent)[1] for lo, hi in zip(edge, edge[1:])]
        assert 2 in numbers and numbers[-1] == 1 and [x for x in numbers if x] == sorted([x for x in numbers if x], reverse=True)


def test_a_large_family_is_sent_once_for_each_pivot(spark):
    """Near copies of one text: what a task of the family's comparison gets grows with the family, not with its square."""
    base = [f"w{i}" for i in range(200)]
    r, rows = np.random.default_rng(9), []
    for i in range(3000):
        words = list(base)
        for j in r.integers(0, 200, 1 + i % 3):
            words[j] = f"x{r.integers(10**9)}"
        rows.append((i, " ".join(words)))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {x.component for x in got} == {0} and len(got) == 3000


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.sampled_from([80, 90, 60]))
def test_entries_equal_by_chance_cost_slack(n, seed, percent):
    """Entries are short; those of one set that are equal by chance count as one, and linked sets still share more than is asked for."""
    r = np.random.default_rng(seed)
    base = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    assert all((x < 2**48).all() and (np.diff(x[y % 2 == p].astype(np.int64)) > 0).all() for x, y in [jaccard.signatures(base, percent)] for p in (0, 1))
    other = np.unique(np.concatenate([r.permutation(base)[r.integers(0, 1 + len(base) // 5) :], r.integers(0, 2**63, r.integers(0, 1 + len(base) // 5), dtype=np.uint64)]))
    both = len(np.intersect1d(base, other))
    if np.array_equal(base, other) or 100 * both < percent * (len(base) + len(other) - both):
        return
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jaccard, "BITS", 14)
        sides = [set(zip((x * np.uint64(2) + (y % 2).astype(np.uint64)).tolist(), (y // 2).tolist())) for x, y in (jaccard.signatures(base, percent), jaccard.signatures(other, percent))]
    shared = {s for s, _ in sides[0]} & {s for s, _ in sides[1]}
    need = [max([n for own in sides for s, n in own if s % 2 == p], default=1) for p in (0, 1)]
    assert any(sum(s % 2 == p for s in shared) >= max(1, need[p]) for p in (0, 1))


def test_entries_and_texts_are_shuffled_once(spark, monkeypatch):
    """The plan that keeps the shared entries deals them once, and the families' last comparison reads each text at one place."""
    plans, real, last = {}, jaccard.materialise, jaccard.components
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def keep(df, name):
        plans[name] = plan(df)
        return real(df, name)

    def connect(edges):
        plans["edges"] = plan(edges)
        return last(edges)

    monkeypatch.setattr(jaccard, "materialise", keep)
    monkeypatch.setattr(jaccard, "components", connect)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    jaccard.join(docs)
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", plans["shared"])) == 1
    assert len(re.findall(r"FileScan parquet \[[^\]]*\bz#", plans["edges"])) == 1


def test_copies_do_not_make_entries_frequent(spark):
    """Copies of one text reach every task, and each task gives its entries; they are one set that has them."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[i % 2 :])) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    index = jaccard._index(docs, 5, 80, "text")
    assert index.select("sig", "node").count() > 4 * index.select("sig", "node").distinct().count()
    shared = jaccard._dealt(index, index.select("sig", "node").limit(0)).collect()
    assert shared and {r.cnt for r in shared} == {2}


def test_unlinked_gatherings_are_labelled_once(spark, monkeypatch):
    """Texts that share much and aren't near copies: a pivot that links nothing costs no more labelling, and the next is another one."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    r = np.random.default_rng(5)
    rows = [(i, " ".join([f"w{j}" for j in range(60)] + [f"x{i}v{r.integers(10**9)}" for _ in range(16)])) for i in range(60)]
    pivots, rounds, real, connect = [], [], jaccard._pivot_links, jaccard.components

    def links(dealt, given, n, percent):
        pivots.append({(x.hub, x.pivot) for x in given.collect()})
        return real(dealt, given, n, percent)

    def count(edges):
        rounds.append(edges.count())
        return connect(edges)

    monkeypatch.setattr(jaccard, "_pivot_links", links)
    monkeypatch.setattr(jaccard, "components", count)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(jaccard.join(docs)) == brute(rows) and len({c for *_, c in brute(rows)}) == len(rows)
    assert len(pivots) == jaccard.PIVOTS and sum(map(len, pivots)) == len(set().union(*pivots))
    # Once for what the hubs link, and once for all links.
    assert len(rounds) == 2
