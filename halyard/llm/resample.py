"""Importance resampling towards a target distribution, with a dictionary of the distinct features.

Every n-gram string of the corpus and of the target is counted once globally. Each distinct string is hashed
once, in the dictionary; counts are summed by bucket; a bucket's gain is its log-likelihood ratio in
thousandths, and the dictionary takes its gains from the buckets (whose number is a parameter, so they are
broadcast). The gains are then joined back to the features of each document: those of frequent strings where the
document is read, since there can't be more than FREQUENT of them, all others by a join on the string, in which
no string has more than a FREQUENTth of the rows. So no hot string meets one task, and no text is hashed twice.

A document's weight is the floored mean of its features' gains, its score adds Gumbel noise that its id alone
decides, and the highest scores of the long enough documents are drawn without replacement. Ranks come from
counts by score, of which there are no more than the bounded range of whole scores has values.

Defined cases: a null text has no features and weight 0; a null id has no noise, no score and no rank, but counts
among the documents with enough words; of rows alike in id and text each has its row, with ranks in any order;
an empty corpus gives an empty table, an empty target is one without counts; very long texts are read by pieces
and counted whole; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm.common import col, materialise, slices

#: What isn't a word's byte, once A to Z are lower: UTF-8's bytes from 0x80 on are.
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of a text that are taken apart at once.
PIECE = 1 << 20
#: Strings whose gains are sent to all tasks at most, and their longest, in bytes.
FREQUENT, FREQUENT_BYTES = 1 << 18, 64


def _words(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, piece by piece."""
    at, text = 0, text.translate(_LOWER)
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield _WORD.findall(text, at, end)
        at = end


def _count(text: bytes | None, longest: int, counts: Counter) -> int:
    """Count a text's runs of 1 to `longest` words; the number of its words."""
    n, last = 0, []
    for words in _words(text or b""):
        n += len(words)
        counts.update(words)
        if longest > 1:
            both = last + words
            for size in range(2, longest + 1):
                first = max(len(last) - size + 1, 0)
                counts.update(b" ".join(both[i : i + size]) for i in range(first, len(both) - size + 1))
            last = both[-(longest - 1) :]
    return n


def _counted(longest: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts: Counter = Counter()
            for text in part.column("text"):
                _count(text.as_py(), longest, counts)
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["feature", "n"])

    return run


def _strings(docs: DataFrame, text_col: str, longest: int) -> DataFrame:
    """(feature, n): partial counts of the strings of all texts."""
    return docs.select(col(text_col).cast("binary").alias("text")).mapInArrow(_counted(longest), "feature string, n bigint")


def dictionary(docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(feature, s, t, gain): each distinct string of the corpus with its counts and its bucket's gain in thousandths."""
    zero = F.lit(0).cast("bigint")
    both = _strings(docs, text_col, longest).select("feature", F.col("n").alias("s"), zero.alias("t")).unionByName(_strings(target, target_col, longest).select("feature", zero.alias("s"), F.col("n").alias("t")))
    counted = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    strings = materialise(counted.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets), "strings")
    by = materialise(strings.groupBy("bucket").agg(F.sum("s").alias("bs"), F.sum("t").alias("bt")), "buckets")
    big, aim = by.agg(F.coalesce(F.sum("bs"), zero), F.coalesce(F.sum("bt"), zero)).first()
    num = lambda x: x.cast("double")
    ratio = num(F.col("bt") + 1) * num(F.lit(big + buckets)) / (num(F.col("bs") + 1) * num(F.lit(aim + buckets)))
    gains = by.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    return strings.where("s > 0").join(F.broadcast(gains), "bucket").select("feature", "s", "t", "gain")


def _weighed(longest: int, gains: dict[bytes, int]):  # noqa: ANN202
    names = ["id", "key", "n_words", "n_features", "known", "rest"]
    item = pa.list_(pa.struct([("feature", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words, features, known, rest = [], [], [], []
            for text in part.column("text"):
                counts: Counter = Counter()
                words.append(_count(text.as_py(), longest, counts))
                features.append(counts.total())
                known.append(sum(n * gains[x] for x, n in counts.items() if x in gains))
                rest.append([{"feature": x.decode(), "n": n} for x, n in counts.items() if x not in gains])
            numbers = [pa.array(x, pa.int64()) for x in (words, features, known)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), *numbers, pa.array(rest, item)], names)

    return run


def weigh(docs: DataFrame, strings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) of each row, by the gains of a `dictionary`."""
    strings = materialise(strings, "dictionary")
    total = strings.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    often = (F.col("s") >= total / FREQUENT) & (F.octet_length("feature") <= FREQUENT_BYTES)
    gains = {r.feature.encode(): r.gain for r in strings.where(often).select("feature", "gain").toLocalIterator()}
    kind = docs.select(col(id_col)).schema.fields[0].dataType
    item = T.ArrayType(T.StructType([T.StructField("feature", T.StringType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(x, T.LongType()) for x in ("key", "n_words", "n_features", "known")], T.StructField("rest", item)])
    named = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("key"), col(text_col).cast("binary").alias("text"))
    each = materialise(named.mapInArrow(_weighed(longest, gains), schema), "features")
    # Of rows alike in id and text, each brings all its strings: their number is that of first ones.
    cold = each.where(F.size("rest") > 0).select("id", "key", F.posexplode("rest").alias("at", "x")).select("id", "key", "at", "x.*")
    cold = cold.join(strings.where(~often).select("feature", "gain").hint("merge"), "feature")
    cold = cold.groupBy("id", "key").agg(F.sum(F.col("n") * F.col("gain")).alias("all"), F.sum((F.col("at") == 0).cast("bigint")).alias("rows"))
    cold = cold.select(F.col("id").alias("id2"), F.col("key").alias("key2"), F.expr("all div rows").alias("more"))
    both = each.drop("rest").join(cold, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")
    gain, n = F.col("known") + F.coalesce("more", F.lit(0)), F.greatest("n_features", F.lit(1))
    # Whole numbers throughout: the floor of a quotient is what is left without its remainder, divided.
    weight = both.withColumn("gain", gain).withColumn("n", n).withColumn("weight", F.expr("(gain - pmod(gain, n)) div n"))
    return weight.select(F.col("id").alias(id_col), "n_words", "n_features", "weight")


def noise(row_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, by the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), row_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, *, percent: int, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id") -> DataFrame:
    """`weighed` with score and rank: the highest scores of the documents of enough words, ties to smaller ids; rank is null for those not drawn."""
    fits = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(col(id_col), seed)), "scored")
    size = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    # As many rows as there are different scores, whatever the corpus: gains and noise are whole and bounded.
    counts = scored.where(fits).groupBy("score").count()
    above = counts.withColumn("above", F.sum("count").over(Window.orderBy(F.desc("score"))) - F.col("count")).where(F.col("above") < size).select("score", "above")
    met = scored.join(F.broadcast(materialise(above, "above")), "score", "left")
    within = F.row_number().over(Window.partitionBy("score").orderBy(col(id_col)))
    drawn = met.where(fits & F.col("above").isNotNull()).withColumn("rank", F.col("above") + within)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")))
    rest = met.where(~(F.coalesce(fits, F.lit(False)) & F.col("above").isNotNull())).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).drop("above").select(*map(col, scored.columns), F.col("rank").cast("bigint").alias("rank"))
