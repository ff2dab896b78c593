"""Substring dedup by recompression: drop words that lie in a window which an earlier document holds too.

Texts are recompressed: first every run of equal tokens gets a name, then, round by round, each symbol falls
into a left or a right class by a hash of its name, and every left-right pair becomes one symbol, named by a
hash of both. Names depend on content alone, so equal substrings get equal symbols in their interiors, in all
documents, without talk between tasks. For each symbol the range of tokens is known that its being there
depends on; if that range lies in a window, every equal window holds the same symbol at the same place.

1. Texts with the same words as one of a smaller id are told by a hash of all their words.
2. Of the rest, every window of `width` tokens picks the largest symbol (then the largest hash) whose range it
   covers, or a token if there is none. A shuffle by symbol finds the symbols of several documents.
3. Windows with such a symbol are candidates; a shuffle by their 128-bit names verifies which ones an earlier
   document holds, and the words that they cover go.

Both shuffles are relieved of frequent keys before: what occurs in several documents of one slice of a task
goes out once, and the other documents' answers, known by then, go out by document. Symbols that a sample of the
documents shows to be frequent aren't asked for at all, and the windows that pick them find their least document
in two steps, by parts of the documents and then over these; so no task holds all rows of one key.

Defined cases: a null text has no words; texts shorter than `width` words lose nothing; rows with a null id
neither lose words nor make others lose any; rows of the same id don't affect each other; kept words are
joined by one space; an empty table gives an empty one; long texts are read whole; other columns, whatever
their names, are not looked at. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import col, discard, frequent, join_size_checked, materialise, mix, slices

ROUNDS = 3
#: Rows (id, key, ranges) that are broadcast at most (some 60 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 1 << 18
#: One document in so many is looked at to find frequent symbols, and the parts that windows with one are dealt to.
SAMPLE, PARTS = 64, 64
_U = np.uint64
_K = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names of all words, with a 0 before, between and after the texts; the place of each text's first, and their numbers."""
    # Without an argument, split() divides bytes at just the space and 0x09 to 0x0D.
    words = [(t or "").encode().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), _U, int(counts.sum()))
    flat[flat == 0] = 1
    starts = np.concatenate([[0], np.cumsum(counts + 1)])[:-1] + 1
    out = np.zeros(len(flat) + len(texts) + 1, _U)
    at = np.ones(len(out), bool)
    at[0] = False
    at[starts + counts] = False
    out[at] = flat
    return out, starts, counts


def symbols(w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each round's new symbols: tokens spanned, first and last token they depend on, name."""
    edge = w == 0
    first = np.concatenate([[True], (w[1:] != w[:-1]) | edge[1:]])
    s = np.flatnonzero(first)
    e = np.append(s[1:], len(w)) - 1
    name = np.where(e > s, mix(w[s] + (e - s).astype(_U) * _K[0]), w[s])
    lo, hi, edge = s - 1, e + 1, edge[s]
    for r in range(ROUNDS):
        left = (mix(name ^ (_K[1] + _U(r))) >> _U(63)) == 0
        right = ~left & ~edge
        left &= ~edge
        m = np.flatnonzero(left[:-1] & right[1:])
        paired = np.zeros(len(name), bool)
        paired[m] = paired[m + 1] = True
        new_lo, new_hi = lo.copy(), hi.copy()
        # An unpaired left symbol depends on what follows, an unpaired right one on what comes before.
        alone = np.flatnonzero(left & ~paired)
        new_hi[alone] = np.maximum(hi[alone], hi[alone + 1])
        alone = np.flatnonzero(right & ~paired)
        new_lo[alone] = np.minimum(lo[alone], lo[alone - 1])
        new_lo[m], new_hi[m] = np.minimum(lo[m], lo[m + 1]), np.maximum(hi[m], hi[m + 1])
        name[m] = mix(name[m] * _K[2] + mix(name[m + 1]) + _U(r))
        e[m] = e[m + 1]
        yield e[m] - s[m] + 1, new_lo[m], new_hi[m], name[m]
        stay = np.ones(len(name), bool)
        stay[m + 1] = False
        s, e, name, lo, hi, edge = s[stay], e[stay], name[stay], new_lo[stay], new_hi[stay], edge[stay]


def picks(w: np.ndarray, width: int) -> np.ndarray:
    """The symbol that the window from each token on picks; 0 where there is no window."""
    n = len(w) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    edges = np.concatenate([[0], np.cumsum(w == 0)])
    whole = edges[width:] == edges[:-width]
    best = np.zeros(n, _U)
    for span, lo, hi, name in symbols(w):
        key = np.minimum(span, 15).astype(_U) << _U(60) | mix(name) >> _U(4)
        slack = width - 1 - (hi - lo)
        for j in range(width):
            at = (slack >= j) & (lo - j >= 0) & (lo - j < n)
            if not at.any():
                # Symbols at a slice's end belong to windows that start further ahead of them only.
                if not (slack >= j).any():
                    break
                continue
            np.maximum.at(best, lo[at] - j, key[at])
    bare = np.flatnonzero(whole & (best == 0))
    if len(bare):
        own = mix(w) >> _U(4)
        best[bare] = np.max([own[bare + j] for j in range(width)], axis=0) | _U(1)
    best[~whole] = 0
    return best


def names(w: np.ndarray, width: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of the windows that start at the tokens `at`."""
    a, b = np.zeros(len(at), _U), np.zeros(len(at), _U)
    for i in range(width):
        own = w[at + i]
        a = mix(a + own) * _K[0]
        b = mix(b ^ own * _K[3]) * _K[1]
    return a, b


def _relieve(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with keys and ids: the first row (least id) of each key, and whether others have the same key and a larger id."""
    order = np.lexsort((ids, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    first = order[new]
    larger = np.zeros(len(order), bool)
    larger[order] = ids[order] > ids[first][group]
    leader = np.zeros(len(order), bool)
    leader[order] = ids[order] == ids[first][group]
    return leader, larger


def _sequences(rows: DataFrame) -> DataFrame:
    """(id, key, n, a, b): each row's number of words and their two-part hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            joined = [b" ".join((t or "").encode().split()) for t in b.column("text").to_pylist()]
            n = [x.count(b" ") + 1 if x else 0 for x in joined]
            h = [xxhash.xxh3_128_intdigest(x) for x in joined]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(n, pa.int64()), pa.array([(x >> 64) - (1 << 63) for x in h], pa.int64()), pa.array([(x & (1 << 64) - 1) - (1 << 63) for x in h], pa.int64())], ["id", "key", "n", "a", "b"])

    return rows.mapInArrow(run, "id bigint, key int, n bigint, a bigint, b bigint")


def _anchors(rows: DataFrame, width: int) -> DataFrame:
    """(slot, id, name, kind): the symbols that windows pick.

    Kind 0: the only document of its slice with the symbol; 1: the first of several; 2: another of several, to
    be kept without asking, so its slot is spread by document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w, starts, counts = tokens(b.column("text").to_pylist())
            best = picks(w, width)
            if not len(best):
                continue
            use = np.flatnonzero((best != 0) & np.concatenate([[True], best[1:] != best[:-1]]))
            doc = np.searchsorted(starts, use, side="right") - 1
            ids = b.column("id").to_numpy()[doc]
            order = np.lexsort((ids, best[use]))
            name, ids = best[use][order], ids[order]
            fresh = np.concatenate([[True], (name[1:] != name[:-1]) | (ids[1:] != ids[:-1])])
            name, ids = name[fresh], ids[fresh]
            head = np.concatenate([[True], name[1:] != name[:-1]])
            several = np.diff(np.append(np.flatnonzero(head), len(name)))[np.cumsum(head) - 1] > 1
            kind = np.where(head, several.astype(np.int8), 2).astype(np.int8)
            slot = np.where(kind == 2, mix(name + ids.astype(_U)), name)
            yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), pa.array(ids), pa.array(np.where(kind == 2, name, _U(0)).view(np.int64)), pa.array(kind)], ["slot", "id", "name", "kind"])

    return rows.mapInArrow(run, "slot bigint, id bigint, name bigint, kind tinyint")


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """(id, key, ranges), written out: for each row that loses words, the ranges (first, end) of words that go; key is hash(text)."""
    rows = docs.where(col(id_col).isNotNull()).select(col(id_col).cast("bigint").alias("id"), F.hash(col(text_col)).alias("key"), col(text_col).alias("text"))
    seqs = materialise(_sequences(rows).where(F.col("n") >= width), "sequences")
    firsts = seqs.groupBy("n", "a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = materialise(seqs.join(firsts, ["n", "a", "b"]).where("id > first").select("id", "key", "n").distinct(), "copies")
    gone = copies.select(F.struct("id", "key").alias("place")).distinct()
    rest = join_size_checked(rows.withColumn("place", F.struct("id", "key")), gone, "place", BROADCAST_ROWS, "left_anti").select("id", "key", "text")

    own = F.when(F.col("kind") == 2, F.col("name")).otherwise(F.col("slot"))
    some = rest.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("id", "text")
    hot = frequent(_anchors(some, width).select(own.alias("name")), "name")
    # FREQUENT_KEYS numbers at most.
    hottest = np.array(sorted(r.name for r in hot.collect()), np.int64)
    anchors = _anchors(rest.select("id", "text"), width).join(F.broadcast(hot.select(F.col("name").alias("hot"))), F.col("slot") == F.col("hot"), "left")
    sure = F.col("hot").isNotNull()
    anchors = anchors.select("id", F.when(sure, F.col("slot")).otherwise(F.col("name")).alias("name"), F.when(sure, F.lit(2)).otherwise(F.col("kind")).alias("kind"), F.when(sure, F.xxhash64("slot", "id")).otherwise(F.col("slot")).alias("slot"))
    slot = Window.partitionBy("slot")
    shared = anchors.repartition("slot").withColumns({"low": F.min("id").over(slot), "high": F.max("id").over(slot)})
    shared = shared.where("kind > 0 or low < high").select("id", own.alias("name"))
    keys = materialise(shared.groupBy("id").agg(F.collect_set("name").alias("names")), "names")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array([z.compress((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())], ["id", "key", "z"])

    both = rest.mapInArrow(pack, "id bigint, key int, z binary").join(keys, "id")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for b in slices([batch], "z", 1 << 20):
                w, starts, _ = tokens([z.decompress(x).decode() for x in b.column("z").to_pylist()])
                best = picks(w, width)
                at = [np.zeros(0, np.int64)]
                for i, (s, wanted) in enumerate(zip(starts, b.column("names"))):
                    part = best[s : starts[i + 1] - 1 if i + 1 < len(starts) else None]
                    at.append(s + np.flatnonzero(np.isin(part.view(np.int64), wanted.values.to_numpy()) & (part != 0)))
                at = np.concatenate(at)
                doc = np.searchsorted(starts, at, side="right") - 1
                ids, (x, y) = b.column("id").to_numpy()[doc], names(w, width, at)
                first, larger = _relieve([x, y], ids)
                place = (b.column("key").to_numpy()[doc].astype(np.int64) << 32) | (at - starts[doc])
                # What an earlier document of the slice holds is known to go; its slot is spread by document.
                spread = mix(x + ids.astype(_U))
                use = first | larger
                part = np.where(np.isin(best[at].view(np.int64), hottest) & ~larger, (mix(ids.astype(_U)) % _U(PARTS)).astype(np.int32) + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(larger, spread, x)[use].view(np.int64)), pa.array(np.where(larger, _U(0), y)[use].view(np.int64)), pa.array(ids[use]), pa.array(place[use]), pa.array(larger[use]), pa.array(part[use])], ["x", "y", "id", "place", "known", "part"])

    found = both.mapInArrow(candidates, "x bigint, y bigint, id bigint, place bigint, known boolean, part int")
    same = ["x", "y", "known", "part"]
    found = found.repartition(*same).withColumn("low", F.min("id").over(Window.partitionBy(*same))).withColumn("known", F.col("known") | (F.col("low") < F.col("id"))).where("known or part > 0")
    if len(hottest):
        # The least documents of each part are left to compare: some PARTS rows for a window, or those of copies of one id.
        again = [F.when(F.col("known"), F.xxhash64("id", "place")).otherwise(F.col("x")).alias("x"), "y", "id", "place", "known"]
        same = ["x", "y", "known"]
        found = found.select(*again).repartition(*same).withColumn("low", F.min("id").over(Window.partitionBy(*same)))
    found = found.where("known or low < id").select("id", F.shiftright("place", 32).cast("int").alias("key"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"))
    starts = found.groupBy("id", "key").agg(F.array_sort(F.collect_list("at")).alias("starts"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("starts"):
                s = x.values.to_numpy()
                cut = np.concatenate([[True], np.diff(s) > width])
                out.append([{"first": int(i), "end": int(j)} for i, j in zip(s[cut], s[np.append(np.flatnonzero(cut)[1:], len(s)) - 1] + width)])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))], ["id", "key", "ranges"])

    kind = "array<struct<first:bigint,end:bigint>>"
    whole = copies.select("id", "key", F.array(F.struct(F.lit(0).cast("bigint").alias("first"), F.col("n").alias("end"))).cast(kind).alias("ranges"))
    out = materialise(starts.mapInArrow(ranges, f"id bigint, key int, ranges {kind}").unionByName(whole), "removals")
    discard(seqs, copies, keys)
    return out


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """(id, n_words, n_removed, kept) of each row: the number of words, of those that go, and the text of the rest."""
    gone = removals(docs, id_col=id_col, text_col=text_col, width=width).withColumnsRenamed({"id": "gid", "key": "gkey"})
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(col(id_col).alias("id"), F.hash(col(text_col)).alias("key"), col(text_col).alias("text"))
    both = rows.join(F.broadcast(gone) if small else gone, (F.col("id") == F.col("gid")) & (F.col("key") == F.col("gkey")), "left").select("id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n, removed, kept = [], [], []
            for t, cuts in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist()):
                words = (t or "").encode().split()
                n.append(len(words))
                for x in reversed(cuts or []):
                    del words[x["first"] : x["end"]]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col)
