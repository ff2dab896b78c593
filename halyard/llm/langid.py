"""Language ID by prediction by partial matching.

Each language has byte context trees of order 0 to 3, counted once over a sample of its labelled texts and
then frozen. A byte costs -log2 of its probability in the longest context that the language has seen;
where the context hasn't seen the byte, the escape (distinct successors / (count + distinct successors),
method C, without exclusions) is paid and the next shorter context asked, down to a uniform choice of 256.
A text's code length under a language is the exact sum over all its bytes; the language with the shortest
one wins, ties by name.

The costs of all strings seen in training are tabled over all languages at once, so a text needs a few
array look-ups a byte, however many languages there are; bytes seen in no language fall back, together,
through the shorter orders.

Sample bound: `per_lang` different texts of at most `max_chars` characters for each language, the first by a hash
of id and text; tables, and the model's size, grow with the number of languages, not with the texts. Defined
cases: a null text or one without a letter is `und` with score 0, as is every text where nothing could be
learned (an empty table has no rows); rows with a null language or text aren't learned from; rows alike in id
and text count once in the sample; long texts are scored whole; other columns, whatever their names, are not
looked at, and kept ones pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import col, slices

ORDER = 3
#: Stands before each text, so that its first bytes have a context.
PAD = b"\n" * ORDER


@dataclass
class Model:
    langs: list[str]
    #: By order k: the sorted strings of k + 1 bytes, their costs and their escapes as contexts of order k + 1; row 0 stands for any other.
    keys: list[np.ndarray]
    costs: list[np.ndarray]
    escapes: list[np.ndarray]
    token: str = field(default_factory=lambda: uuid.uuid4().hex)


def _strings(data: np.ndarray, n: int) -> np.ndarray:
    """The n-byte strings that end at each byte of `data` from ORDER on, as numbers."""
    out = np.zeros(len(data) - ORDER, np.uint32)
    for i in range(n):
        out = (out << np.uint32(8)) | data[ORDER - n + 1 + i : len(data) - n + 1 + i]
    return out


def fit(texts: dict[str, list[str]]) -> Model:
    """Freeze the context trees of each language's texts."""
    langs = sorted(texts)
    counts = []
    for lang in langs:
        data = np.frombuffer(b"".join(PAD + t.encode() for t in texts[lang]) or PAD, np.uint8)
        counts.append([np.unique(_strings(data, k + 1), return_counts=True) for k in range(ORDER + 1)])
    keys = [np.unique(np.concatenate([c[k][0] for c in counts] or [np.zeros(0, np.uint32)])) for k in range(ORDER + 1)]
    costs, escapes = [], [np.zeros((1, len(langs)), np.float32)]
    for k in range(ORDER + 1):
        cost = np.zeros((len(keys[k]) + 1, len(langs)))
        escape = np.zeros((len(keys[k - 1]) + 1 if k else 1, len(langs)))
        for j, c in enumerate(counts):
            own, n = c[k]
            ctx, first = np.unique(own >> np.uint32(8) if k else np.zeros_like(own), return_index=True)
            total, kinds = np.add.reduceat(n, first) if len(n) else n, np.diff([*first, len(own)])
            at = np.searchsorted(keys[k - 1], ctx) + 1 if k else np.zeros(len(ctx), np.int64)
            escape[at, j] = -np.log2(kinds / (total + kinds))
            bottom = np.full(len(keys[k]), 8.0) if not k else costs[k - 1][_rows(keys[k - 1], _tail(keys[k], k)), j]
            if k:
                cost[1:, j] = bottom + escape[_rows(keys[k - 1], keys[k] >> np.uint32(8)), j]
            else:
                cost[:, j] = 8.0 + escape[0, j]
            here = np.repeat(np.arange(len(ctx)), kinds)
            cost[np.searchsorted(keys[k], own) + 1, j] = -np.log2(n / (total + kinds)[here])
        costs.append(cost.astype(np.float32))
        escapes[k:] = [escape.astype(np.float32)]
        escapes.append(np.zeros((len(keys[k]) + 1, len(langs)), np.float32))
    return Model(langs, keys, costs, escapes[: ORDER + 1])


def _tail(keys: np.ndarray, k: int) -> np.ndarray:
    """The strings without their first byte."""
    return keys & np.uint32((1 << 8 * k) - 1)


def _rows(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """1 + the place of each wanted string in `keys`, 0 where it isn't there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at + 1, 0)


class Scorer:
    """Dense look-up tables of a model: strings of up to three bytes by value, of four by (row of the first three, byte)."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.dense = []
        for k in range(ORDER):
            d = np.zeros(1 << 8 * (k + 1), np.int32)
            d[model.keys[k]] = np.arange(1, len(model.keys[k]) + 1)
            self.dense.append(d)
        self.child = np.zeros((len(model.keys[ORDER - 1]) + 1) * 256, np.int32)
        node = self.dense[ORDER - 1][model.keys[ORDER] >> np.uint32(8)].astype(np.int64)
        # A text's last bytes may be followed by nothing in training, so a context can lack its own row: skip those strings.
        own = node > 0
        self.child[(node * 256 + (model.keys[ORDER] & np.uint32(255)))[own]] = np.arange(1, len(own) + 1)[own]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        data = np.frombuffer(b"".join(PAD + t for t in texts), np.uint8)
        if not texts:
            return np.zeros((0, len(self.m.langs)))
        ends = np.cumsum([len(t) + ORDER for t in texts])
        three = _strings(data, ORDER)
        before = np.empty_like(three)
        before[1:] = three[:-1]
        before[:1] = int.from_bytes(PAD, "big")
        node = self.dense[ORDER - 1][before]
        row = self.child[node.astype(np.int64) * 256 + data[ORDER:]]
        bits = self.m.costs[ORDER][row]
        missed = np.flatnonzero(row == 0)
        if len(missed):
            here, extra, s = missed, self.m.escapes[ORDER][node[missed]].astype(np.float64), three[missed]
            for k in range(ORDER - 1, -1, -1):
                row = self.dense[k][_tail(s, k + 1)]
                cost = self.m.costs[k][row] if k else np.where(row[:, None] > 0, self.m.costs[0][row], self.m.costs[0][:1])
                hit = (row > 0) | (k == 0)
                bits[here[hit]] = extra[hit] + cost[hit]
                if k:
                    ctx = self.dense[k - 1][_tail(s, k + 1) >> np.uint32(8)]
                    here, extra, s = here[~hit], (extra + self.m.escapes[k][ctx])[~hit], s[~hit]
        starts = np.concatenate([[0], ends[:-1]])
        for i in range(ORDER):  # the padding before each next text costs nothing
            bits[ends[:-1] - i - 1] = 0
        return np.where((ends - ORDER > starts)[:, None], np.add.reduceat(np.concatenate([bits, bits[:1] * 0]), starts, axis=0, dtype=np.float64), 0)


_SCORERS: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    if model.token not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.token] = Scorer(model)
    return _SCORERS[model.token]


def train(docs: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, max_chars: int = 20_000) -> Model:
    """Fit on at most `per_lang` texts for each language, of the rows where `usable` holds."""
    text = col(text_col)
    rows = docs.where(usable & col(lang_col).isNotNull() & text.isNotNull() & (F.length(text) <= max_chars))
    named = rows.select(col(lang_col).alias("lang"), F.xxhash64(col(id_col).cast("string"), text).alias("h"), text.alias("text"))
    # Hashes are even, so of n different ones the first per_lang lie, all but certainly, below the limit of four times as many:
    # what is ranked is a few thousand rows a language, whatever the table's size.
    sizes = named.select("lang", "h").groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    limits = sizes.select("lang", (F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(4.0 * per_lang + 100) / F.col("n"))).alias("limit"))
    near = named.select("lang", "h").join(F.broadcast(limits), "lang").where(F.col("h").cast("double") <= F.col("limit")).select("lang", "h").distinct()
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_lang)
    # Names only are ranked, and then joined to the texts.
    sample = named.join(F.broadcast(ranked.select("lang", "h")), ["lang", "h"])
    texts: dict[str, list[str]] = {}
    for r in sample.dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect():
        texts.setdefault(r.lang, []).append(r.text)
    return fit(texts)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score (the language's share of the posterior, 0 to 1) of each row."""
    rows = docs.select(*[col(c).alias(f"k{i}") for i, c in enumerate(keep)], col(text_col).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scorer(model)
        for b in slices(batches, "text", 1 << 20):
            texts = b.column("text").to_pylist()
            known = [bool(t) and any(map(str.isalpha, t)) and bool(model.langs) for t in texts]
            bits = s.code_lengths([t.encode() for t, k in zip(texts, known) if k])
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if len(bits):
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                at = np.flatnonzero(known)
                scores[at] = share
                for i, j in zip(at.tolist(), best.tolist()):
                    names[i] = model.langs[j]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores)], [*b.schema.names[:-1], "lang_pred", "score"])

    out = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
