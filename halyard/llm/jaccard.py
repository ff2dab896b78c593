"""Exact Jaccard join on word n-grams, by pigeonhole over partitions of the hashed universe.

A text is the set of its distinct word n-grams. Two sets of sizes s and r with 100 * |both| >= percent * |either|
differ in at most t(s + r) elements. Sizes fall into bands such that linked sets lie in the same band or in
neighbours; each band pair has a scheme with one bound t for all its pairs. A scheme hashes the universe
into segments and allots each a number of differences, so that the numbers add up to more than t: then at
least one segment of two linked sets differs by less than its number. `allot` picks the cheaper form:

* t + 1 + slack segments of number 1, indexed by their exact content. A linked pair agrees on more than `slack`
  of them, so a set may leave out up to `slack` segments and still meet its partners: the empty ones and those
  whose content very many sets share (a set whose empty and frequent segments exceed the slack keeps all).
* half as many segments of number 2, indexed by content and by all one-deletion neighbours.

The cost of a form is its entries, each with the sets expected to meet it by chance, which fall with the elements
that an entry holds; small sets come out at the second form, large ones at the first.

Sets that share an indexed content are candidates. Contents of few sets give all their pairs, counted: a
linked pair agrees on more of them than the slack that either set has left, so chance meetings fall out.
Contents of many sets matter only between sets beyond their slack: these gather at a hub. A gathering is a
family of near copies as a rule, so all of it is compared with one member, then what isn't linked to that with
another one, a few times: every text is sent once for each. What still stands outside the gathering's largest
class, little in a family, is then compared exactly with all of it, block by block on the n-grams themselves;
what is linked in two blocks leaves as a star. So each link between different texts is found or follows from
others, and neither copies nor families of near copies expand into pairs.

Contents that a share of a sample of the sets have are dealt by set, so that no task holds all of one.

Defined cases: a text with fewer than n words is one n-gram of all its words; one without words (or null)
has an empty set, no links and its own id as its component; a null id is kept and never is a component's
name unless nothing else is; repeated rows and ids are each kept; an empty table gives an empty one; long texts
are read whole; other columns, whatever their names, are not looked at. Hashes have 64 bits, by XXH3; those of
contents are cut to 48, as they only choose candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import col, discard, frequent, join_size_checked, materialise, mix, slices, tidy
from halyard.llm.components import components

#: Contents that more sets than this share are frequent.
FREQUENT = 4
#: Sets of a block that is compared in one task, at most, and their elements.
BLOCK, BLOCK_ELEMENTS = 1024, 1 << 20
#: Bits of an index entry: every entry is shuffled, and of the bytes of its row only those of its hashes don't compress.
#: Entries that are equal by chance only make candidates.
BITS = 48
#: For the cost of an entry: the share of n-grams that some other text has too, and what a set that meets it by chance costs.
SHARED, CHANCE = 0.5, 20
#: Members that a gathering is compared with before its rest is.
PIVOTS = 3
#: One set in so many is looked at to find the frequent entries that are dealt by set.
SAMPLE = 64
#: Ids that are broadcast at most (8 bytes each); beyond, both sides are shuffled.
BROADCAST_IDS = 1 << 20
#: Gatherings, or frequent entries with their hub, that are broadcast at most.
BROADCAST_HUBS = 1 << 18
#: Characters of packed texts that are made sets of at once.
SET_CHARS = 1 << 19
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


_GRAM = mix(np.arange(1, 65, dtype=_U) * _ODD[0]) | _U(1)


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct n-grams, A to Z in lower case."""
    # Without an argument, split() divides bytes at just the space and 0x09 to 0x0D.
    words = [(t or "").encode().lower().split() for t in texts]
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), _U)

    def grams(w: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(w) - size + 1, _U(size))
        for i in range(size):
            h += w[i : len(w) - size + 1 + i] * _GRAM[i % len(_GRAM)] + _U(i)
        return mix(h)

    every, at, found = grams(flat, n) if len(flat) >= n else flat, 0, []
    for count in map(len, words):
        h = every[at : at + count - n + 1].copy() if count >= n else grams(flat[at : at + count], count) if count else flat[:0]
        h.sort()
        found.append(h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h)
        at += count
    return found


@lru_cache(64)
def bands(percent: int, top: int) -> list[int]:
    """The least size of each band, up to one beyond `top`."""
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, 100 * (out[-1] - 1) // percent + 1))
    return out


def bound(largest: int, percent: int) -> int:
    """How many elements two linked sets differ in at most, the smaller having at most `largest`."""
    return (largest + 100 * largest // percent) * (100 - percent) // (100 + percent)


def allot(least: int, largest: int, percent: int) -> tuple[int, int, int]:
    """(segments, number of each, slack) of the cheaper scheme for pairs whose smaller sets have `least` to `largest` elements."""
    t = bound(largest, percent)
    if t == 0:
        return 0, 0, 0
    slack = 2 + (8 * (t + 1) + 99) // 100
    forms = [(t + 1 + slack, 1, slack), ((t + 2) // 2, 2, 0)]

    def cost(form: tuple[int, int, int]) -> float:
        segments, number, _ = form
        entries, held = (segments, least / segments) if number == 1 else (segments + least, max(0.0, least / segments - 1))
        return entries * (1 + CHANCE * SHARED**held)

    return min(forms, key=cost)


def signatures(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The index entries of one set: hashes of contents, and for each 2 * (slack left + 1) + parity of the scheme.

    With no slack left the first part is 0: such a set keeps its frequent entries too. Entries of one set that are
    equal by chance count as one, at the cost of its slack.
    """
    edge = bands(percent, max(64, 1 << int(len(s)).bit_length()))
    band = int(np.searchsorted(edge, len(s), side="right")) - 1
    mixed, found, tags = mix(s ^ _ODD[2]), [], []
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed)])
    for k in (band, band - 1):
        m, number, slack = allot(edge[k], edge[k + 1] - 1, percent) if k >= 0 else (0, 0, 0)
        if not m:
            continue
        at = (((s >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
        count = np.bincount(at, minlength=m)
        ends = np.cumsum(count)
        whole = sums[ends] - sums[ends - count]
        salt = np.arange(m, dtype=_U) * _ODD[3] + _U((k + 1) * int(_ODD[4]) % (1 << 64))
        sig = mix(mix(whole + salt) + count.astype(_U))
        left = slack - int((count == 0).sum())
        if number == 1 and left >= 0:
            sig = sig[count > 0]
        if number == 2:
            sig = np.concatenate([sig, mix(mix(whole[at] - mixed + salt[at]) + (count[at] - 1).astype(_U))])
        every, sig = len(sig), np.unique(sig >> _U(64 - BITS))
        left -= every - len(sig)
        found.append(sig)
        tags.append(np.full(len(sig), 2 * (max(left, -1) + 1 if number == 1 else 0) + (k & 1), np.int32))
    return (np.concatenate(found), np.concatenate(tags)) if found else (np.zeros(0, _U), np.zeros(0, np.int32))


def _name(s: np.ndarray) -> int:
    """A set's hash, as a signed number."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sets(docs: DataFrame, n: int, *, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n_grams, node) of each row: key is a hash of the text, node of the set, null for an empty one."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(slices(batches, "text")):
            found = ngram_sets(b.column("text").to_pylist(), n)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(list(map(len, found)), pa.int64()), pa.array([_name(s) if len(s) else None for s in found], pa.int64())], ["id", "key", "n_grams", "node"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key bigint, n_grams bigint, node bigint")


def _index(docs: DataFrame, n: int, percent: int, text_col: str) -> DataFrame:
    """(sig, node, tag): the index entries of the different sets; a set is left out where its task has seen it already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in tidy(slices(batches, "text")):
            sig, tag, node = [], [], []
            for s in ngram_sets(b.column("text").to_pylist(), n):
                if len(s) and (name := _name(s)) not in seen:
                    seen.add(name)
                    x, y = signatures(s, percent)
                    sig.append(x)
                    tag.append(y)
                    node.append(np.full(len(x), name, np.int64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(tag))], ["sig", "node", "tag"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "sig bigint, node bigint, tag int")


def _texts(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(node, z): one text, compressed, of each wanted node."""
    places = nodes.join(wanted, "node", "left_semi").select(F.col("rep").alias("place"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in tidy(slices(batches, "text")):
            texts = b.column("text").to_pylist()
            found = ngram_sets(texts, n)
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) if len(s) else None for s in found], pa.int64()), pa.array([z.compress((t or "").encode()) for t in texts], pa.binary())], ["node", "z"])

    # A place is never null, as an id may be; what else has the same hash is left out by its node.
    rows = docs.select(F.xxhash64(id_col, F.xxhash64(text_col)).alias("place"), F.col(text_col).alias("text"))
    return join_size_checked(rows, places, "place", BROADCAST_IDS).select("text").mapInArrow(pack, "node bigint, z binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _sets_of(packed: list[bytes], n: int) -> list[np.ndarray]:
    """The sets of packed texts, unpacked some SET_CHARS characters at a time: a word takes many times its length while it is hashed."""
    z, found, texts, size = zstandard.ZstdDecompressor(), [], [], 0
    for x in packed:
        texts.append(z.decompress(x).decode())
        size += len(texts[-1])
        if size >= SET_CHARS:
            found += ngram_sets(texts, n)
            texts, size = [], 0
    return found + ngram_sets(texts, n)


def _verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are linked, checked on the n-grams of one text each."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                good = []
                for x, y in zip(_sets_of(b.column("za").to_pylist(), n), _sets_of(b.column("zb").to_pylist(), n)):
                    common = len(np.intersect1d(x, y, assume_unique=True)) if percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)) else 0
                    good.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(good, pa.bool_())), b.column("b").filter(pa.array(good, pa.bool_()))], ["a", "b"])

    return both.select("a", "b", "za", "zb").mapInArrow(check, "a bigint, b bigint")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each of `left` has in common with each of `right`, by products over the elements both sides have."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(shared), 2048):
        part = shared[lo : lo + 2048]

        def rows(side: list[np.ndarray], part: np.ndarray = part) -> np.ndarray:
            m = np.zeros((len(side), len(part)), np.float32)
            for i, s in enumerate(side):
                own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                at = np.minimum(np.searchsorted(part, own), len(part) - 1)
                m[i, at[part[at] == own]] = 1
            return m

        out += rows(left) @ rows(right).T
    return out


def _star(rows: np.ndarray, cols: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what the matrix `linked` of nodes `rows` and `cols` connects."""
    node, at = np.unique(np.concatenate([rows, cols]), return_inverse=True)
    a, b = at[: len(rows)], at[len(rows) :]
    label = np.arange(len(node))
    while True:
        new = label.copy()
        np.minimum.at(new, a, np.where(linked, label[b][None], len(node)).min(axis=1, initial=len(node)))
        np.minimum.at(new, b, np.where(linked, label[a][:, None], len(node)).min(axis=0, initial=len(node)))
        new = new[new]
        if (new == label).all():
            away = label != np.arange(len(node))
            return node[label[away]], node[away]
        label = new


def _pivot_links(dealt: DataFrame, pivots: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): the pivots a of gatherings (hub, pivot) and the members b of `dealt` (hub, part, node, z) that are linked to them."""
    given = pivots.select("hub", F.col("pivot").alias("node"))
    given = F.broadcast(given) if given.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS else given
    # A pivot's text goes to each part of its gathering.
    own = dealt.join(given, ["hub", "node"]).select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("pivot"), F.col("z").alias("zp"))
    both = dealt.select("hub", "part", "node", "z").join(own, ["hub", "part"]).where(F.col("node") != F.col("pivot"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            for b in slices([batch], "z", 1 << 20):
                good = []
                for p, zp, y in zip(b.column("pivot").to_pylist(), b.column("zp"), _sets_of(b.column("z").to_pylist(), n)):
                    if p != last:
                        last, x = p, _sets_of([zp.as_py()], n)[0]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([b.column("pivot").filter(pa.array(good, pa.bool_())), b.column("node").filter(pa.array(good, pa.bool_()))], ["a", "b"])

    return both.select("pivot", "node", "z", "zp").mapInArrow(check, "a bigint, b bigint")


def _families(crowd: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): pairs that connect whatever is linked among the sets that share an entry of `crowd` (sig, node, passed).

    The sets of an entry gather at the one with most frequent entries, so that sets sharing many entries gather once.
    """
    hubs = crowd.groupBy("sig").agg(F.max(F.struct("passed", "node")).alias("h")).select("sig", F.col("h.node").alias("hub"))
    hubs = F.broadcast(hubs) if hubs.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS else hubs
    members = materialise(crowd.select("sig", "node").join(hubs, "sig").select("hub", "node").distinct(), "members")
    sized = members.groupBy("hub").agg(F.count(F.lit(1)).alias("size")).where("size > 1").join(nodes.select(F.col("node").alias("hub"), "n"), "hub")
    # Sets of one entry lie in two neighbouring bands, so none has more than (100 / percent) ** 2 times the elements of the hub.
    block = F.greatest(F.lit(8), F.least(F.lit(BLOCK), F.expr(f"{BLOCK_ELEMENTS} div (n * 10000 div {percent * percent})")))
    sized = materialise(sized.select("hub", F.ceil(F.col("size") / block).cast("int").alias("parts"), block.cast("int").alias("block")), "hubs")
    few = sized.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS

    def with_hub(rows: DataFrame, more: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(more) if few else more, "hub")

    texts = materialise(_texts(members.select("node").distinct(), docs, nodes, n, id_col, text_col), "texts")
    dealt = with_hub(members, sized).join(texts, "node").select("hub", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "parts", "block", "node", "z")
    dealt = materialise(dealt, "dealt")
    pivots, tried, links = sized.select("hub", F.col("hub").alias("pivot")), None, None
    for i in range(PIVOTS):
        new = materialise(_pivot_links(dealt, pivots, n, percent), "links")
        links = new if links is None else links.unionByName(new)
        own = pivots.select("hub", F.col("pivot").alias("node"))
        tried = own if tried is None else tried.unionByName(own)
        if i == 0 or not new.isEmpty():
            comp = materialise(components(links), "component")
            # The members of each gathering's largest class. Those without a link needn't be labelled: they are no one's class.
            classed = materialise(dealt.select("hub", "node").join(comp, "node"), "classed")
            giants = classed.groupBy("hub", "component").count().groupBy("hub").agg(F.max(F.struct("count", "component")).alias("g")).select("hub", "g.component")
            inside = classed.join(F.broadcast(giants) if few else giants, ["hub", "component"], "left_semi").select("hub", "node")
            # What stands outside: of a linked pair that isn't in one class yet one is here, since a pivot has met everyone.
            outside = materialise(dealt.select("hub", "node", "block").join(inside.unionByName(tried), ["hub", "node"], "left_anti"), "outside")
        if i + 1 == PIVOTS or outside.isEmpty():
            break
        # The next member to compare with: of each gathering whose rest is more than a block, one of the rest, in another order each time.
        pivots = outside.groupBy("hub", "block").agg(F.count(F.lit(1)).alias("left"), F.min(F.struct(F.xxhash64(F.lit(i), "node"), "node")).alias("m"))
        pivots = materialise(pivots.where(F.col("left") > F.col("block")).select("hub", F.col("m.node").alias("pivot")), "pivots")
        if pivots.isEmpty():
            break

    # The rest against everyone, by blocks of both: a text goes once for each block of its gathering's rest, one of the
    # rest to its gathering's other parts as well. Texts come last, by node and with its label, so that they aren't shuffled to be labelled.
    rest = outside.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.max("block")).cast("int").alias("k"))
    placed = with_hub(dealt.select("hub", "node", "part", "parts"), rest).join(outside.select("hub", "node", F.lit(True).alias("out")), ["hub", "node"], "left")
    placed = placed.select("hub", "node", "part", "parts", "k", F.when(F.col("out"), F.pmod(F.xxhash64(F.lit(1), "node"), "k").cast("int")).alias("own"))
    every = placed.select("hub", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("at"), "part", "node", "own", F.lit(True).alias("every")).withColumn("rest", F.coalesce(F.col("at") == F.col("own"), F.lit(False)))
    more = placed.where("own is not null and parts > 1").select("hub", F.col("own").alias("at"), F.explode(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("part"))).alias("part"), "node", F.lit(False).alias("every"), F.lit(True).alias("rest"))
    labelled = texts.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("label"), "z")
    met = every.drop("own").unionByName(more).join(labelled, "node")

    def compare(t: pa.Table) -> pa.Table:
        left, right = t.filter(t.column("rest")), t.filter(t.column("every"))
        (la, a, sa), (lb, b, sb) = ((x.column("label").to_numpy(), x.column("node").to_numpy(), _sets_of(x.column("z").to_pylist(), n)) for x in (left, right))
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both = common_counts(sa, sb).astype(np.int64)
        size = [np.array([len(s) for s in x]) for x in (sa, sb)]
        # What is one class already needs no link.
        linked = (100 * both >= percent * (size[0][:, None] + size[1][None] - both)) & (la[:, None] != lb[None])
        x, y = _star(a, b, linked)
        return pa.table({"a": x, "b": y})

    return links.unionByName(met.groupBy("hub", "at", "part").applyInArrow(compare, "a bigint, b bigint"))


def _dealt(index: DataFrame, sample: DataFrame) -> DataFrame:
    """The index entries (sig, node, tag) that several sets have, with their number cnt.

    Frequent entries, by a sample, are first dealt by set, counted in parts, and summed up by entry then; the
    others meet in one step. Which are called frequent makes no difference to the result.
    """
    hot = frequent(sample, "sig")
    rows = index.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sig", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(4096))).otherwise(0))
    # What differs from row to row stands together, so that the rest of a row compresses as one piece.
    rows, group = rows.select("node", "sig", "tag", "hot", "salt"), Window.partitionBy("sig", "salt")
    # A set comes once from each task that has a copy of its text, and counts once: else copies would make entries frequent.
    rows = rows.repartition("sig", "salt").withColumn("nth", F.dense_rank().over(group.orderBy("node"))).withColumn("cnt", F.max("nth").over(group))
    # With the salt, equal rows are told apart from others where they lie, without another shuffle.
    rows = materialise(rows.where("cnt > 1 or hot").select("sig", "salt", "node", "tag", "cnt", "hot").distinct(), "shared")
    # At most a row for each entry of `hot`, which is bounded.
    whole = rows.where("hot").groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("all"))
    rows = rows.join(F.broadcast(whole), "sig", "left").where("hot is null or least < most")
    return rows.select("sig", "node", "tag", F.coalesce("all", "cnt").alias("cnt"))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(id, key, n_grams, class) of each row; class is null for an empty set."""
    docs, id_col, text_col = docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "id", "text"
    rows = materialise(sets(docs, n, id_col=id_col, text_col=text_col), "sets")
    place = F.xxhash64("id", "key")
    nodes = rows.where("node is not null").groupBy("node").agg(F.coalesce(F.min_by(place, "id"), F.min(place)).alias("rep"), F.max("n_grams").alias("n"))
    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0)
    shared = _dealt(_index(docs, n, percent, text_col), _index(some, n, percent, text_col).select("sig", "node"))
    few = F.col("cnt") <= FREQUENT
    passed = materialise(shared.where(~few).groupBy("node", "tag").agg(F.count(F.lit(1)).alias("passed")), "passed")

    # Sets of which one keeps within its slack agree on more of the other entries than its slack has left.
    rare = shared.where(few).select("sig", (F.col("tag") % 2).alias("parity"), "node", "tag")
    a, b = rare.toDF("sig", "parity", "a", "ta"), rare.toDF("sig", "parity", "b", "tb")
    close = a.join(b, ["sig", "parity"]).where("a < b").groupBy("a", "ta", "b", "tb").agg(F.count(F.lit(1)).alias("n"))
    for side in "ab":  # how many entries each side passed over, asked for pairs, not for entries
        close = close.join(passed.toDF(side, f"t{side}", f"p{side}"), [side, f"t{side}"], "left")
        close = close.where(F.col("n") >= F.shiftright(f"t{side}", 1) - F.coalesce(f"p{side}", F.lit(0)))
    close = close.select("a", "b").distinct()

    close = materialise(close, "close")
    wanted = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
    texts = materialise(_texts(wanted, docs, nodes, n, id_col, text_col), "texts")
    linked = materialise(_verify(close, texts, n, percent), "linked")
    discard(close, texts)

    # Sets beyond their slack meet in the frequent entries.
    beyond = passed.where("passed >= shiftright(tag, 1)")
    crowd = materialise(shared.where(~few).join(beyond, ["node", "tag"]).select("sig", "node", "passed"), "frequent")
    discard(passed)
    comp = components(linked.unionByName(_families(crowd, nodes, docs, n, percent, id_col, text_col)))
    discard(crowd, linked)
    return rows.join(comp, "node", "left").select("id", "key", "n_grams", F.coalesce("component", "node").alias("class"))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_grams, component) of each row: the set's size and the least id that links reach."""
    found = classes(docs, id_col=id_col, text_col=text_col, n=n, percent=percent)
    names = found.where("class is not null").groupBy("class").agg(F.min("id").alias("name"))
    return found.join(names, "class", "left").select(F.col("id").alias(id_col), "n_grams", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("name")).alias("component"))


def unique(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without all but one of each class: the least id's stays (null ids last, then the least text hash).

    Rows without words stay. Of rows alike in id and text one stays.
    """
    found = materialise(classes(docs, id_col=id_col, text_col=text_col, n=n, percent=percent), "classes")
    found = found.where("class is not null").withColumn("place", F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    first = found.groupBy("class").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    both = materialise(found.join(first, "class").select("id", "key", F.col("place").eqNullSafe(F.col("first")).alias("stays")), "places")
    here = [F.col(f"d.`{id_col}`").eqNullSafe(F.col("x.id")), F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("x.key")]

    def without(rows: DataFrame, out: DataFrame, how: str) -> DataFrame:
        small = out.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return rows.alias("d").join((F.broadcast(out) if small else out).alias("x"), here, how)

    kept = without(docs, both.where("not stays").select("id", "key").distinct(), "left_anti")
    again = both.where("stays").groupBy("id", "key").count().where("count > 1").select("id", "key")
    if again.isEmpty():
        return kept
    return without(kept, again, "left_anti").unionByName(without(kept, again, "left_semi").dropDuplicates([id_col, text_col]))
