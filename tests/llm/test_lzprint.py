import hashlib
from collections import Counter

import numpy as np
import pytest

from halyard.llm import lzprint, queries


def phrases(raw: bytes) -> set[bytes]:
    seen, now = set(), b""
    for i in range(len(raw)):
        now += raw[i : i + 1]
        if now not in seen:
            seen.add(now)
            now = b""
    return seen | ({now} if now else set())


def test_fingerprints_estimate_the_likeness_of_phrase_sets():
    r = np.random.default_rng(0)
    words = [bytes(r.integers(97, 123, r.integers(2, 9)).astype(np.uint8)) for _ in range(300)]
    texts = [b" ".join(words[i] for i in r.zipf(1.3, 400) % 300).decode() for _ in range(12)]
    texts += [texts[0][:800] + texts[1][:800], texts[0] + "é" * 50, "ab", "a" * 5000, "x"]
    errors = []
    for a in texts:
        for b in texts:
            x, y = phrases(a.encode()), phrases(b.encode())
            errors.append(lzprint.likeness(lzprint.fingerprint(a), lzprint.fingerprint(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15
    assert all(lzprint.likeness(lzprint.fingerprint(a), lzprint.fingerprint(a)) == 1 for a in [*texts, ""])
    assert lzprint.likeness(lzprint.fingerprint("a"), lzprint.fingerprint("")) == 0


M = (1 << 64) - 1


def plain_mix(x):
    for _ in range(2):
        x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & M
    return x ^ x >> 32


def plain_print(text):
    """The fingerprint of a text by the definition, phrase by phrase, in plain whole numbers."""
    raw = text.encode()
    if not raw:
        return ""
    value = lambda b: plain_mix((b + 1) * 0xC2B2AE3D27D4EB4F & M)
    hashes = [plain_mix(sum(value(b) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(p)) & M) for p in phrases(raw)]
    least = {}
    for h in hashes:
        least[h >> 56] = min(h, least.get(h >> 56, h))
    out = []
    for i in range(256):
        away = next(d for d in range(256) if (i + d) % 256 in least)
        out.append(plain_mix((least[(i + away) % 256] + away * 0x9E3779B97F4A7C15) & M) & 255)
    return bytes(out).hex()


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    a, b = bytes.fromhex(a), bytes.fromhex(b)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 256) / (1 - 1 / 256))


def check(rows, got):
    """Every column of every row against plain code of its own."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, (doc, text) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        changed = text[: len(text) - cut] + nxt[:cut]
        r = by[doc]
        own, other, following = map(plain_print, (text, changed, nxt))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own, other)
        assert r.near_edited == pytest.approx(plain_likeness(own, other), abs=1e-12) and r.near_next == pytest.approx(plain_likeness(own, following), abs=1e-12)


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_small_tables(spark, n):
    r = np.random.default_rng(n)
    rows = [(int(i) * 1_000_003 - 5_000_000, "".join(r.choice(list("ab é\n"), r.integers(0, 60)))) for i in r.permutation(n)]
    rows += [(2**62, None), (None, "null id"), (7, "")] if n > 2 else []
    docs = spark.createDataFrame([(*x, "f") for x in rows], "doc_id bigint, text string, fingerprint string")
    check(rows, lzprint.with_next(docs).collect())


@pytest.mark.parametrize("limit", [0, 100])
def test_repeated_ids_and_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(lzprint, "BROADCAST_TWINS", limit)
    rows = [(1, "aaa bbb ccc"), (1, "ddd eee fff"), (1, "ddd eee fff"), (2, "ggg"), (0, "hhh iii")]
    rows += [(None, f"null {i % 40} text {i % 7}") for i in range(120)] + [(5, f"five {i}") for i in range(60)] + [(6, "six of one")] * 50
    got = lzprint.with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in got) == Counter((d, len(t), plain_print(t)) for d, t in rows)
    # Rows alike follow each other, so each but the last has itself as its next.
    alike = Counter(rows)
    for (d, t), n in alike.items():
        own = [r for r in got if r.doc_id == d and r.fingerprint == plain_print(t)]
        same = hashlib.sha256((t[: len(t) - len(t) // 3] + t[: len(t) // 3]).encode()).hexdigest()
        assert sum(r.edited_sha256 == same for r in own) >= n - 1
    # All in all, the order is one circle: each text but for copies is the next of one row.
    cuts = Counter()
    for r in got:
        cuts[r.edited_sha256] += 1
    assert sum(cuts.values()) == len(rows)


def test_a_very_long_text_and_dotted_columns(spark):
    rows = [(3, "ab" * 150_000 + "é"), (2, "x" * 100_000), (1, "short")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "`doc.id` bigint, `a.text` string, range string, n int")
    got = lzprint.with_next(docs, id_col="doc.id", text_col="a.text").withColumnRenamed("doc.id", "doc_id").collect()
    for (d, t), (_, nxt) in zip(rows, [*rows[1:], rows[0]]):
        r = next(r for r in got if r.doc_id == d)
        cut = len(t) // 3
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest() and r.fingerprint == plain_print(t)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op2_lz_fingerprint(spark, sf).collect()
    check(rows, got)
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.2
