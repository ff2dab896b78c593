"""Quality classifier: histogram gradient-boosted trees over document statistics.

Texts become two dozen statistics (shares of byte classes, word and line lengths, repetition, entropy).
Trees of equal depth are grown by histograms of 64 quantile bins with logistic loss, and kept as flat
arrays: a tree's nodes lie level by level, so that a batch goes down all trees by array arithmetic.

Sample bound: at most `max_rows` labels, the first by a hash of the id; where several rows have a labelled id, the
one with the least hash of its text is learned from. Defined cases: a null text counts as empty and gets a score
like any other; rows with a null label aren't learned from; repeated rows and ids each keep their row; without
two classes to learn from (an empty table, for one), every score is the smoothed share of 1; other columns,
whatever their names, are not looked at, and kept ones pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import col, slices, tidy

_CLASSES = np.zeros((256, 8))
for _i, _chars in enumerate([b" ", b"\n\r", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256)), b".,;:!?", b"#$%&*@^~|<>{}\\=+_/[]"]):
    _CLASSES[list(_chars), _i] = 1
N_FEATURES = 25


def statistics(text: str) -> np.ndarray:
    """The statistics of one whole text."""
    out = np.zeros(N_FEATURES)
    raw = text.encode()
    words = raw.split()
    if not words:
        out[0] = np.log1p(len(raw))
        return out
    n, w = len(raw), len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[0], out[1], out[2] = np.log1p(n), np.log1p(w), n / w
    out[3:11] = hist @ _CLASSES / n
    share = hist[hist > 0] / n
    out[11] = -(share * np.log2(share)).sum()
    lens = np.fromiter(map(len, words), np.int64, w)
    out[12], out[13], out[14] = (lens <= 3).mean(), lens.std(), np.log1p(lens.max())
    kinds = set(words)
    out[15] = len(kinds) / w
    out[16] = len(kinds) / np.sqrt(w)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    own = set(lines)
    out[17] = len(own) / len(lines)
    out[18] = sum(map(len, own)) / sum(map(len, lines))
    out[19] = np.log1p(n / len(lines))
    out[20] = hist[46] / w
    out[21] = hist[124] / w
    out[22] = sum(a == b for a, b in zip(words, words[1:])) / w
    pairs = set(zip(words, words[1:]))
    out[23] = len(pairs) / max(1, w - 1)
    out[24] = hist[list(b"#$%&*")].sum() / w
    return out


@dataclass
class Trees:
    """`base` plus, for each tree, the leaf's value; feature and threshold by [tree, node], leaf by [tree, leaf]."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - (1 << self.depth) + 1]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 3.0) -> Trees:
    """Fit `trees` trees of `depth` levels to labels 0 and 1."""
    n, k = x.shape if len(x) else (0, N_FEATURES)
    prior = (y.sum() + 1) / (len(y) + 2)
    base, nodes = float(np.log(prior / (1 - prior))), (1 << depth) - 1
    if len(np.unique(y)) < 2:
        return Trees(base, depth, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin, found = np.full(n, base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, at = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(n, np.int64)
        for d in range(depth):
            first, wide = (1 << d) - 1, 1 << d
            best, where = np.full(wide, 1e-9), [None] * wide
            for j in range(k):
                key = (at - first) * bins + binned[:, j]
                gs = np.bincount(key, g, wide * bins).reshape(wide, bins).cumsum(1)
                hs = np.bincount(key, h, wide * bins).reshape(wide, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = -1
                cut = gain.argmax(1)
                for v in np.flatnonzero(gain[np.arange(wide), cut] > best):
                    if cut[v] < len(edges[j]):
                        best[v], where[v] = gain[v, cut[v]], (j, edges[j][cut[v]])
            for v, w in enumerate(where):
                if w:
                    feature[first + v], threshold[first + v] = w
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf_at = at - nodes
        value = -rate * np.bincount(leaf_at, g, nodes + 1) / (np.bincount(leaf_at, h, nodes + 1) + l2)
        margin += value[leaf_at]
        for to, what in zip(found, (feature, threshold, value)):
            to.append(what)
    return Trees(base, depth, *map(np.stack, found))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in tidy(slices(batches, "text")):
        yield b, np.stack([statistics(t or "") for t in b.column("text").to_pylist()])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", usable: Column | None = None, max_rows: int = 20_000) -> Trees:
    """Fit on at most `max_rows` labelled rows; `usable` is a condition on the labels' rows."""
    known = labels.where(col(label_col).isin(0, 1) & col(id_col).isNotNull())
    known = known if usable is None else known.where(usable)
    ids = known.select(col(id_col).alias("id"), col(label_col).cast("int").alias("y")).distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(ids), "id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _featurise(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), b.column("h"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "h", "x"])

    got = rows.select("id", "y", F.xxhash64("text").alias("h"), "text").mapInArrow(measure, f"id {ids.schema['id'].dataType.simpleString()}, y int, h bigint, x array<double>")
    # One row for each label, so no more than the labels' bound come to the driver.
    got = got.groupBy("id", "y").agg(F.min(F.struct("h", "x")).alias("m")).select("id", "y", "m.x").orderBy(F.xxhash64("id"), "id", "y").toPandas()
    return boost(np.stack(got.x) if len(got) else np.zeros((0, N_FEATURES)), got.y.to_numpy(float))


def score(docs: DataFrame, trees: Trees, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out_col: str = "score") -> DataFrame:
    """The kept columns and each row's score (0 to 1, higher: label 1 likelier)."""
    rows = docs.select(*[col(c).alias(f"k{i}") for i, c in enumerate(keep)], col(text_col).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _featurise(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(trees.scores(x))], [*b.schema.names[:-1], "score"])

    out = rows.mapInArrow(run, f"{kinds}, score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(out_col))
