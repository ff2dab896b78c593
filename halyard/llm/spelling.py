"""Spelling variants by anagram hashing.

Each word gets a whole number, the sum of its letters' powers, which all its anagrams share. Two words that differ by
one letter have numbers that differ by the value of the letter added, removed or exchanged; so they meet where one
number, or both, is reduced by a letter. First the numbers alone are joined that way: a reduced number is live if
two different ones come to it, and there are no more such numbers for one than the alphabet has letters. Only words
of live numbers go on. Letter order is then verified by equality of 61-bit hashes beside the equal numbers: an exchange
leaves equal rests at equal places, an addition or removal leaves the other word. Where words with equal rests meet, they differ in one letter at one place,
so a group has at most a word for each letter; it gives each member a count and its best other member, not pairs.

A word's form is the near word that occurs most, if that is often enough; forms are followed to their roots by pointer
jumping, whose rounds grow with the logarithm of a chain, and chains with that of the greatest count.

Defined cases: a null text has no words; a null id leaves its runs as they are; repeated rows count like others; an
empty table gives an empty one; very long texts are read by pieces cut between runs, very long runs are worked on
whole (a row for each place, but never a copy of the word in each); other columns are not looked at.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import col, materialise

RUN = r"[A-Za-zÀ-ÿ]+"
#: A piece of text that ends where no run goes on.
_PIECE = r"(?s).{1,65536}+[A-Za-zÀ-ÿ]*+"
#: Letters' values are fifth powers of their code points, summed modulo this prime; hashes of their order are polynomials in BASE.
PRIME, BASE = (1 << 61) - 1, 0x1D2B_3C4F_5A69_7887
_BACK = pow(BASE, -1, PRIME)


def runs(text: Column) -> Column:
    """The runs of letters of a piece of text, A to Z in lower case."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(RUN), F.lit(0))


def damaged(row_id: Column, run: Column, one_in: int) -> Column:
    """The run, or where a hash of it and the id says so, the run without the letter that the hash names."""
    h, n = F.crc32(F.concat(row_id.cast("string"), F.lit(":"), run).cast("binary")), F.length(run)
    at = (h % n).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, n))).otherwise(run)


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, one_in: int | None = 97) -> DataFrame:
    """(word, n) of the words of all texts that are long enough and occur often enough; one_in: as `damaged` says."""
    pieces = docs.select(col(id_col).alias("id"), F.explode(F.regexp_extract_all(col(text_col), F.lit(_PIECE), F.lit(0))).alias("piece"))
    each = pieces.select("id", F.explode(runs(F.col("piece"))).alias("word")).where(F.length("word") >= shortest)
    if one_in:
        each = each.select(damaged(F.col("id"), F.col("word"), one_in).alias("word")).where(F.length("word") >= shortest)
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, number, at, left, rest) of each word (id, n, word) and place: the number without its letter, and a hash of what is left in order; place -1 is the whole word."""
    for batch in batches:
        for words in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            ids, counts, numbers, places, lefts, rests = [], [], [], [], [], []
            for i, n, word in zip(*(words.column(c).to_pylist() for c in ("id", "n", "word"))):
                values = [pow(ord(c), 5, PRIME) for c in word]
                number, before, behind = sum(values) % PRIME, 0, 0
                for v in values:
                    behind = (behind * BASE + v) % PRIME
                size, power = len(values), pow(BASE, len(values), PRIME)
                lefts.append(number)
                rests.append(behind)
                # The rest's hash is what stands before the place, moved on by the length of what stands behind it.
                for v in values:
                    power = power * _BACK % PRIME
                    behind = (behind - v * power) % PRIME
                    lefts.append((number - v) % PRIME)
                    rests.append((before * power + behind) % PRIME)
                    before = (before * BASE + v) % PRIME
                ids += [i] * (size + 1)
                counts += [n] * (size + 1)
                numbers += [number] * (size + 1)
                places += range(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, counts, numbers, places, lefts, rests)], ["id", "n", "number", "at", "left", "rest"])


def ordered(words: DataFrame) -> DataFrame:
    """The words (word, n) written in order, with ids in the same order."""
    return materialise(words.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "ordered")


def near(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of `ordered` words: how many are one letter away, and the one that occurs most, as (minus n, id)."""
    rows = materialise(words.mapInArrow(_rests, "id bigint, n bigint, number bigint, at bigint, left bigint, rest bigint"), "rests")
    live = rows.select("left", "number").distinct().groupBy("left").agg(F.count(F.lit(1)).alias("numbers")).where("numbers >= 2").select("left")
    rows = materialise(rows.drop("number").join(live, "left", "left_semi"), "live")
    cut, whole = rows.where("at >= 0"), rows.where("at < 0")

    group = Window.partitionBy("left", "at", "rest")
    ranked = group.orderBy(F.desc("n"), "id")
    every = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    this = F.struct((-F.col("n")).alias("minus_n"), F.col("id").alias("id"))
    exchanged = cut.select("id", F.count(F.lit(1)).over(group).alias("members"), F.row_number().over(ranked).alias("place"), F.first(this).over(every).alias("top"), F.nth_value(this, 2).over(every).alias("second"))
    exchanged = exchanged.where("members >= 2").select("id", (F.col("members") - 1).alias("count"), F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("top")).alias("best"))

    short = whole.select("left", "rest", F.col("id").alias("id2"), F.col("n").alias("n2"))
    # A letter that comes twice in a row can go from either place.
    added = cut.select("left", "rest", "id", "n").distinct().join(short, ["left", "rest"])
    one = F.lit(1).cast("bigint").alias("count")
    longer = added.select(F.col("id2").alias("id"), one, this.alias("best"))
    shorter = added.select("id", one, F.struct((-F.col("n2")).alias("minus_n"), F.col("id2").alias("id")).alias("best"))
    return exchanged.unionByName(longer).unionByName(shorter).groupBy("id").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of each (id, form): the last one that forms lead to."""
    at = materialise(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = materialise(at.join(onward, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("id", "root")
        at = moved.select("id", "root")


def group(words: DataFrame, *, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words (word, n): a form occurs at least `times` as often as its word."""
    words = ordered(words)
    found = words.join(near(words), "id", "left")
    often = -F.col("best.minus_n") >= times * F.col("n")
    form, form_n = F.when(often, F.col("best.id")).alias("form"), F.when(often, -F.col("best.minus_n")).alias("form_n")
    found = materialise(found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form, form_n), "forms")
    some = found.where("form is not null")
    name = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    ends = some.select("id", "form").join(roots(some), "id").join(name("form"), "form").join(name("root"), "root").select("id", "form_word", "root_word")
    return found.drop("form").join(ends, "id", "left").select("word", "n", "n_near", F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"))
