import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from halyard.llm import mixing, queries


def deal(budget, children):
    """{child: budget} of {child: (weight, cap)}, whole shares first to those that can't take theirs."""
    out, left = {}, dict(children)
    while left:
        weight = sum(w for w, _ in left.values())
        full = [c for c, (w, cap) in left.items() if w > 0 and cap <= budget / weight * w + 1e-9]
        if not full:
            return out | {c: math.floor(budget / weight * w + 1e-9) if w > 0 else 0 for c, (w, _) in left.items()}
        c = min(full, key=lambda c: left[c][1] / left[c][0])
        out[c] = left.pop(c)[1]
        budget -= out[c]
    return out


def brute(rows, weights, total, epochs, seed):
    """Counter of (id, path, epoch) of (id, text, path) rows."""
    leaf = defaultdict(list)
    for doc, text, path in rows:
        d = hashlib.md5(f"{'-' if doc is None else doc}|{text or ''}".encode()).hexdigest()
        leaf[path].append((doc, d, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    supply = {p: sum(n for *_, n in v) for p, v in leaf.items()}
    share = {(): min(sum(supply.values()) if total is None else total, epochs * sum(supply.values()))}
    for level in range(3):
        names = ["domain", "lang", "source"][level]
        for up in {p[:level] for p in leaf}:
            kids = {p[: level + 1] for p in leaf if p[:level] == up}
            caps = {k: (weights.get(names, {}).get(k[-1], 1), epochs * sum(n for p, n in supply.items() if p[: level + 1] == k)) for k in kids}
            share |= deal(share[up], caps)
    out = Counter()
    for p, docs in leaf.items():
        whole = share[p] // supply[p] if supply[p] else 0
        rest = share[p] - whole * supply[p]
        for doc, _, _ in docs:
            for e in range(whole):
                out[doc, p, e] += 1
        key = lambda d: int(hashlib.md5(f"{seed}|{whole}|{d}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        for doc, d, _ in docs:
            if rest > 0 and sum(n for _, x, n in docs if key(x) < key(d)) < rest:
                out[doc, p, whole] += 1
    return out


def got(df):
    return Counter((r.doc_id, (r.mix.domain, r.mix.lang, r.mix.source), r.mix.epoch) for r in df.collect())


ROWS = [(i, "w " * (1 + i * 7 % 13), "a" if i % 3 else "b", ["en", "de", None][i % 5 % 3], f"s{i % 4}") for i in range(150)]
ROWS += [(3, ROWS[3][1], *ROWS[3][2:]), (None, "null id", "a", "en", "s1"), (200, None, "a", "en", "s1"), (201, "", "z", None, None), (202, "lone word", "z", "xx", None)]


@pytest.mark.parametrize("total", [None, 0, 300, 5000])
@pytest.mark.parametrize("bits", [10, 1])
def test_small_trees_against_brute_force(spark, monkeypatch, total, bits):
    monkeypatch.setattr(mixing, "RANGE_BITS", bits)
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", bits)
    docs = spark.createDataFrame([(*r, "kept") for r in ROWS], "doc_id bigint, text string, domain string, lang string, source string, epochs string")
    weights = {"domain": {"a": 1, "b": 4, "z": 2}, "lang": {"en": 5, "xx": 0}}
    out = mixing.blend(docs, {x: F.col(x) for x in ("domain", "lang", "source")}, weights, total=total, max_epochs=3, seed=7)
    assert got(out) == brute([(d, t, (a, b, c)) for d, t, a, b, c in ROWS], weights, total, 3, 7)
    assert {r.epochs for r in out.collect()} <= {"kept"}
    assert mixing.blend(docs.where("false"), {x: F.col(x) for x in ("domain", "lang", "source")}, weights, total=total).count() == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, ("crawl" if r.source == "src0" else "curated", r.lang, r.source)) for r in docs.collect()]
    want = brute(rows, mixing.WEIGHTS, None, 2, queries.MIX_SEED)
    out = queries.op4_mixing(spark, "/root/testdata/sf0.01").collect()
    assert Counter((r.doc_id, (r.domain, r.lang, r.source), r.epoch) for r in out) == want
