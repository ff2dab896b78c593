"""Document fingerprints from Lempel-Ziv phrases.

A text's bytes are parsed into phrases as LZ78 does: each is the longest one seen before in this text plus
one byte (the last may be an old one). The hashes of the phrase set are dealt to bins; a bin's least hash,
cut to eight bits, is its entry, and an empty bin borrows from the next full one (densified one-permutation
minimum hashing). The share of equal entries, corrected for chance, estimates the Jaccard likeness of two
phrase sets, which behaves like a compression distance.

`with_next` also parses each text with its last third replaced by the start of the next document in falling
order of id: texts go once, compressed, to ranges of (id, hash of the text), whose first row is sent to the range
before too. An id that very many rows share is cut into several ranges by the hash; of rows alike in both, one
goes, with their number. The common head of a text and its edited form is parsed once.

Defined cases: a null text counts as empty; an empty text's fingerprint is empty, like itself (1) and like
nothing else (0); rows alike in id follow each other by a hash of their text, so a copy's next is the copy; null
ids come last; the last document's next is the first, and a lone document is its own next; an empty table gives
an empty one; very long texts are parsed whole; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import col, materialise, mix, slices

BINS = 256
#: Rows (id, key, number) of repeated rows that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_TWINS = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, _U(base))
            step[0] = 1
            _POWERS[i] = np.multiply.accumulate(step)
    return _POWERS[0], _POWERS[1]


def parse(raw: bytes, known: dict[int, int], ends: list[int], node: int, at: int) -> int:
    """Go on parsing at byte `at`: adds to the dictionary and the phrase ends, returns where in the dictionary it stopped."""
    get, n = known.get, len(known) + 1
    for i, c in enumerate(raw, at + 1):
        key = node << 8 | c
        node = get(key)
        if node is None:
            known[key] = n
            n += 1
            node = 0
            ends.append(i)
    return node


def entries(raw: bytes, ends: list[int], open_: bool) -> bytes:
    """The fingerprint of a parsed text; `open_` if a phrase was still being read at its end."""
    if not raw:
        return b""
    stops = np.array([*ends, len(raw)] if open_ else ends, np.int64)
    starts = np.concatenate([[0], stops[:-1]])
    up, down = _powers(len(raw))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_VALUES[np.frombuffer(raw, np.uint8)] * up[: len(raw)])])
    h = mix((sums[stops] - sums[starts]) * down[starts])
    h.sort()
    bins = (h >> _U(56)).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    full, least = bins[first], h[first]
    at = np.searchsorted(full, np.arange(BINS))
    away = np.where(at < len(full), full[at % len(full)], full[0] + BINS) - np.arange(BINS)
    return (mix(least[at % len(full)] + away.astype(_U) * _U(_BASE)) & _U(255)).astype(np.uint8).tobytes()


def fingerprint(text: str | None) -> bytes:
    raw, ends = (text or "").encode(), []
    node = parse(raw, {}, ends, 0, 0)
    return entries(raw, ends, node != 0)


def likeness(a: bytes, b: bytes) -> float:
    """The estimated Jaccard likeness of two fingerprints, 0 to 1."""
    if not a or not b:
        return float(a == b)
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / BINS
    return float(max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def edited(text: str, following: str) -> tuple[str, str]:
    """What stays of a text, and what replaces its last third."""
    cut = len(text) // 3
    return text[: len(text) - cut], following[:cut]


def both(text: str, following: str) -> tuple[bytes, bytes, bytes]:
    """The fingerprints of a text and of its edited form, and the latter's bytes."""
    head, new = (x.encode() for x in edited(text, following))
    raw, known, ends = text.encode(), {}, []
    node = parse(head, known, ends, 0, 0)
    sofar, size = len(ends), len(known)
    last = parse(raw[len(head) :], known, ends, node, len(head))
    own = entries(raw, ends, last != 0)
    while len(known) > size:
        known.popitem()
    del ends[sofar:]
    last = parse(new, known, ends, node, len(head))
    return own, entries(head + new, ends, last != 0), head + new


def prints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint in hexadecimal) of each row."""
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([fingerprint(t).hex() for t in b.column("text").to_pylist()], pa.string())], ["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def _bounds(rows: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """Rising bounds (not null, id, key) between ranges of about equal size; an id of many ranges is cut by its keys, which are even."""
    ids = F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts) if parts > 1 else F.array().cast("array<bigint>")
    nulls, found, n = rows.agg(F.count(F.when(F.col("id").isNull(), 1)), ids, F.count(F.lit(1))).first()
    out = []
    hot = [(0, 0, round(parts * nulls / n) if n else 0), *((1, i, found.count(i)) for i in sorted(set(found or ())))]
    for there, i, times in hot:
        out += [(there, i, -(1 << 63) + (1 << 64) * k // times) for k in range(times)]
    return out


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row; ids are whole numbers."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = plain = docs.select(col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    twins = materialise(rows.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twins")
    small = twins.limit(BROADCAST_TWINS + 1).count() <= BROADCAST_TWINS
    given = twins.select(F.col("id").alias("id2"), F.col("key").alias("key2"), "n")
    rows = rows.join(F.broadcast(given) if small else given, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left").select("id", "key", "text", F.coalesce("n", F.lit(1)).alias("n"))
    one = rows.where("n = 1").unionByName(rows.where("n > 1").dropDuplicates(["id", "key"])) if not twins.isEmpty() else rows
    bounds = _bounds(plain.select("id"), parts)
    last = len(bounds)

    def at(b: pa.RecordBatch) -> list[int]:
        """The range of each row: 0 holds the largest ids; nulls lie in the last ones."""
        return [last - bisect_right(bounds, (0, 0, k) if i is None else (1, i, k)) for i, k in zip(b.column("id").to_pylist(), b.column("key").to_pylist())]

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(at(b), pa.int32()), b.column("id"), b.column("key")], ["range", "id", "key"])

    # A row for each range that has rows.
    heads = plain.select("id", "key").mapInArrow(ranged, "range int, id bigint, key bigint").groupBy("range").agg(F.max(F.struct(F.col("id").isNotNull().alias("there"), "id", "key")).alias("m")).collect()
    heads = sorted((r.range, r.m.id, r.m.key) for r in heads)
    before = {(i, k): heads[j - 1][0] for j, (_, i, k) in enumerate(heads)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in slices(batches, "text"):
            packed = pa.array([z.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
            own = pa.RecordBatch.from_arrays([pa.array(at(b), pa.int32()), pa.array(np.zeros(b.num_rows, bool)), b.column("id"), b.column("key"), b.column("n"), packed], ["range", "guest", "id", "key", "n", "z"])
            yield own
            guests = [(j, before[x]) for j, x in enumerate(zip(b.column("id").to_pylist(), b.column("key").to_pylist())) if x in before]
            if guests:
                t = own.take(pa.array([j for j, _ in guests]))
                yield pa.RecordBatch.from_arrays([pa.array([r for _, r in guests], pa.int32()), pa.array([True] * len(guests)), *t.columns[2:]], own.schema.names)

    dealt = one.mapInArrow(deal, "range int, guest boolean, id bigint, key bigint, n bigint, z binary")
    dealt = dealt.repartitionById(last + 1, "range").sortWithinPartitions("range", "guest", F.col("id").desc_nulls_last(), F.col("key").desc())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, names = zstandard.ZstdDecompressor(), ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        waiting: tuple | None = None  # a row whose next one's fingerprint isn't known yet
        now: tuple | None = None  # the row before, whose next text is the coming one
        out: list[tuple] = []

        def emit(doc: int, n: int, raw: bytes, mine: bytes, other: bytes, near: float, times: int = 1) -> None:
            out.extend([(doc, n, hashlib.sha256(raw).hexdigest(), mine.hex(), other.hex(), likeness(mine, other), near)] * times)

        def close(own: bytes) -> None:
            if waiting:
                emit(*waiting, likeness(waiting[3], own))

        for batch in batches:
            for r, guest, doc, n, packed in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "id", "n", "z"))):
                text = z.decompress(packed).decode()
                if now and now[0] != r:
                    close(fingerprint(now[2]))
                    waiting = None
                elif now:
                    own, other, raw = both(now[2], text)
                    close(own)
                    waiting = (now[1], len(now[2]), raw, own, other)
                if n > 1 and not guest:
                    # All copies but the last are followed by a copy.
                    own, other, raw = both(text, text)
                    emit(doc, len(text), raw, own, other, 1.0, n - 1)
                now = (r, doc, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if now:
            close(fingerprint(now[2]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    done = dealt.select("range", "guest", "id", "n", "z").mapInArrow(walk, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done.withColumnRenamed("id", id_col)
