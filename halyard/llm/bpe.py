"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into overlapping chunks that are pre-tokenised where they lie: one of up to `chunk_chars` characters
is one chunk, those of a longer one are dealt to different tasks. One step per document then stitches them where
the pre-token boundaries of neighbouring chunks meet again. The pattern has no look-behind, so from a common
boundary on both chunks split alike. Where an overlap has no common boundary (a pre-token longer than the
overlap), the two chunks are decoded, joined and split anew, so the result is always that of the whole text.
Pre-tokens are encoded by merging, again and again, the neighbours of the lowest rank, many pre-tokens at once. Decoding concatenates the
tokens' bytes.

Defined cases: a null text counts as empty and has no ids; ids and texts may repeat, each row is kept; an empty
table gives an empty one; very long texts and very long pre-tokens are encoded whole; columns other than the two
named, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm.common import col, slices, tidy

#: Pre-tokens of a generation that are kept with their ids (two generations in each Python worker), and the longest kept; the rest is encoded anew.
CACHE, CACHED_CHARS = 150_000, 48
#: Bytes of a pre-token from which it is merged alone, and bytes of shorter ones that are merged at once.
LONG, MERGED_BYTES = 128, 1 << 20
#: Characters of texts whose pre-tokens are looked up at once.
TEXT_CHARS = 1 << 19


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of all neighbours, those of the lowest rank, the first ones of equal rank, become one.

    In n log n steps: parts know their neighbours, and a heap has the pairs, outdated ones too.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a byte; 0: merged into the one before
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(piece[before[i] : stop])) is not None:
            heappush(heap, (r, before[i], stop))
    return [ranks[piece[i:e]] for i, e in enumerate(end) if e]


class Merges:
    """The pairs of ids that become one id, for many short pre-tokens at once. An id is its token's rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.none = ranks, max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        pairs = {ranks[b[:i]] * self.none + ranks[b[i:]]: r for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks}
        # The last key is above every pair's, so that a search always ends on one.
        self.keys = np.array([*sorted(pairs), self.none**2])
        self.to = np.array([*(pairs[k] for k in sorted(pairs)), self.none])

    def _rank(self, at: np.ndarray, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each place; `none` where there is none."""
        nxt = np.minimum(at + 1, len(ids) - 1)
        key = ids[at] * self.none + ids[nxt]
        found = np.searchsorted(self.keys, key)
        return np.where((self.keys[found] == key) & (nxt > at) & (owner[at] == owner[nxt]), self.to[found], self.none)

    def all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token (not empty), as bytes of 32-bit numbers: a round merges the best pair of each, and the finished ones leave."""
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        rank = self._rank(np.arange(len(ids)), ids, owner)
        done = []
        while len(ids):
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, np.flatnonzero(new))[np.cumsum(new) - 1]
            open_ = least < self.none
            done.append((owner[~open_], ids[~open_]))
            hit = np.flatnonzero(open_ & (rank == least))
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])] if len(hit) else hit
            ids[hit] = rank[hit]
            keep = open_.copy()
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for touched in (at, at[at > 0] - 1):
                rank[touched] = self._rank(touched, ids, owner)
        owner, ids = (np.concatenate(x) for x in zip(*done))
        data = ids[np.argsort(owner, kind="stable")].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


class Known(dict):
    """The ids of pre-tokens, as bytes of 32-bit numbers: what is asked for again outlives a full generation."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.merges, self.older = Merges(ranks), {}

    def __missing__(self, piece: str) -> bytes:
        return array("i", merge(piece.encode(), self.merges.ranks)).tobytes()

    def learn(self, pieces: Iterable[str]) -> None:
        """Keep the ids of all these but long ones."""
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        ranks, new, size = self.merges.ranks, {}, 0
        for x in set(pieces):
            if x in self:
                continue
            ids = self.older.get(x)
            if ids is not None:
                self[x] = ids
                continue
            if len(x) > CACHED_CHARS or len(b := x.encode()) >= LONG:
                continue
            if (whole := ranks.get(b)) is not None:
                self[x] = array("i", [whole]).tobytes()
                continue
            new[x] = b
            size += len(b)
            if size >= MERGED_BYTES:
                self.update(zip(new, self.merges.all(list(new.values()))))
                new, size = {}, 0
        if new:
            self.update(zip(new, self.merges.all(list(new.values()))))


class Codec:
    """Ranks and pattern of one vocabulary."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.table = pa.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)], pa.large_binary())

        self.known = Known(ranks)

    def found(self, texts: list[str]) -> Iterator[tuple[list[str], list[bytes]]]:
        """The pre-tokens of each text and their ids as bytes; those of some texts are looked up together."""
        found, size = [], 0
        for i, t in enumerate(texts):
            found.append(self.split.findall(t))
            size += len(t)
            if size >= TEXT_CHARS or i + 1 == len(texts):
                self.known.learn(chain.from_iterable(found))
                for x in found:
                    yield x, list(map(self.known.__getitem__, x))
                found, size = [], 0

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text that is one chunk."""
        return [np.frombuffer(b"".join(ids), np.int32) for _, ids in self.found(texts)]

    def pieces(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: starts of the pre-tokens and the text's end, how many ids each has, and all ids."""
        for found, ids in self.found(texts):
            starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
            yield starts, np.fromiter(map(len, ids), np.int32, len(ids)) // 4, np.frombuffer(b"".join(ids), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode_rows(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each list: taking the tokens' bytes in order puts them one after the other already."""
        flat = self.table.take(ids.flatten())
        ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        at = ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        data = flat.buffers()[2] or pa.py_buffer(b"")
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(at)), data]).cast(pa.binary())


#: Ids that are decoded at once: even of the longest tokens, that is some hundred MB.
DECODE_IDS = 1 << 20


@lru_cache(2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def _lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *parts])))


Chunk = tuple[int, int, np.ndarray, np.ndarray, np.ndarray]


def stitch(chunks: list[Chunk], c: Codec) -> np.ndarray:
    """The ids of a whole text from its chunks: (start, end, starts of the pre-tokens and the end, ids in each, ids).

    All positions are code points of the text. Chunks are in order, and each next start lies in the one before.
    """
    begin, end, starts, counts, ids = chunks[0]
    done: list[np.ndarray] = []
    for nxt_begin, nxt_end, nxt_starts, nxt_counts, nxt_ids in chunks[1:]:
        # A pre-token that touches the chunk's end may go on; boundaries before it are final.
        final = starts[:-1] if starts[-1] == end else starts
        meet = np.intersect1d(final[final >= nxt_begin], nxt_starts[:-1])
        if not len(meet):
            keep = max(0, min(len(starts) - 2, int(np.searchsorted(starts, nxt_begin)) - 1))
            cut = int(counts[:keep].sum())
            done.append(ids[:cut])
            head = c.decode(ids[cut:]).decode()[: nxt_begin - int(starts[keep])]
            begin, (rel, counts, ids) = int(starts[keep]), next(c.pieces([head + c.decode(nxt_ids).decode()]))
            starts, end = begin + rel, nxt_end
            continue
        done.append(ids[: int(counts[: int(np.searchsorted(starts, meet[0]))].sum())])
        at = int(np.searchsorted(nxt_starts, meet[0]))
        begin, end, starts, counts, ids = nxt_begin, nxt_end, nxt_starts[at:], nxt_counts[at:], nxt_ids[int(nxt_counts[:at].sum()) :]
    return np.concatenate([*done, ids])


def _as_lists(parts: list[np.ndarray]) -> list[pa.Array]:
    return [_lists(parts, np.int32)]


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1 << 13, overlap: int = 1 << 9,
    shape: Callable[[list[np.ndarray]], list[pa.Array]] = _as_lists, columns: str = "ids array<int>",
) -> DataFrame:
    """(id, ids array<int>) of each row of `docs`; `ranks_path` must exist on every executor.

    `shape` may turn the ids of a batch of texts into other `columns` (a schema text) where they were made.
    """
    if not 0 < overlap <= chunk_chars:
        raise ValueError("overlap must be from 1 to chunk_chars")
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in tidy(slices(batches, "text")):
            yield pa.RecordBatch.from_arrays([b.column("id"), *shape(c.ids(b.column("text").to_pylist()))], names)

    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(whole, f"id {kind}, {columns}")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, z = codec(ranks_path, pattern), zstandard.ZstdCompressor(3)
        for b in tidy(slices(batches, "text")):
            packed = []
            for starts, counts, ids in c.pieces(b.column("text").to_pylist()):
                packed.append(z.compress(np.concatenate([[len(counts)], starts, counts, ids]).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("id", "hash", "at", "end")), pa.array(packed, pa.binary())], ["id", "hash", "at", "end", "pieces"])

    def joined(t: pa.Table) -> pa.Table:
        c, z, chunks, copies = codec(ranks_path, pattern), zstandard.ZstdDecompressor(), {}, 0
        for at, end, packed in zip(*(t.column(x).to_pylist() for x in ("at", "end", "pieces"))):
            copies += at == 0
            x = np.frombuffer(z.decompress(packed), "<u4").astype(np.int64)
            n = int(x[0])
            chunks[at] = (at, end, at + x[1 : n + 2], x[n + 2 : 2 * n + 2], x[2 * n + 2 :].astype(np.int32))
        ids = stitch([chunks[a] for a in sorted(chunks)], c)
        return pa.table([pa.concat_arrays([t.column("id").combine_chunks().slice(0, 1)] * copies), *shape([ids] * copies)], names)

    size = F.length("text")
    long = rows.where(size > chunk_chars).select("id", F.sha2("text", 256).alias("hash"), "text", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / chunk_chars))).alias("k"))
    at = F.col("k") * chunk_chars
    long = long.select("id", "hash", at.cast("bigint").alias("at"), F.least(at + chunk_chars + overlap, size).cast("bigint").alias("end"), F.expr(f"substring(text, cast(k * {chunk_chars} + 1 as int), {chunk_chars + overlap})").alias("text"))
    long = long.repartition("id", "at").mapInArrow(part, f"id {kind}, hash string, at bigint, end bigint, pieces binary")
    return short.unionByName(long.groupBy("id", "hash").applyInArrow(joined, f"id {kind}, {columns}")).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", keep: tuple[str, ...] = ("ids",)) -> DataFrame:
    """(id, kept columns, decoded binary): the bytes of each row's `ids` (null: none), one after the other."""
    names = [id_col, *keep]
    rows = encoded.select(*[col(c).alias(f"k{i}") for i, c in enumerate(names)], col("ids").alias("ids"))
    kinds = T.StructType([*rows.schema.fields[:-1], T.StructField("decoded", T.BinaryType())])

    def batched(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Slices of some rows and ids each, so that their bytes have 32-bit offsets; a longer row stands alone."""
        counts = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(counts.tolist()):
            if i > start and (total + n > DECODE_IDS or i - start == 1024):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for b in batched(batch):
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], c.decode_rows(b.column("ids"))], [*b.schema.names[:-1], "decoded"])

    return rows.mapInArrow(back, kinds).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "decoded")
