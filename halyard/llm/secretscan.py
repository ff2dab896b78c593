"""Secrets: strict base patterns, and unseen ones found by a battery of randomness tests.

Base spans come from three regular expressions. Apart from them, each long run of base64 characters is a candidate.
Its encoding is inferred from its characters (hex, base32, base36, letters of one case, base64), and three tests look
at its symbols: chi-squared against a uniform alphabet, runs of character classes and of halves of the alphabet, and
the serial correlation of neighbours. Each test is asked twice. Against randomness: a candidate that any test tells
from uniform symbols at VETO standard deviations isn't random. Against ordinary text: the statistic's tail bound, if
symbols came as they do in the corpus's own words, whose pairs are counted over all texts. The three bounds combine
by Fisher's method. Their power grows with length, so false discoveries are controlled within each encoding and band
of lengths: by the step-up procedure over its distinct candidates at rate RATE, from counts by rounded-down score.

All numbers that come to the driver are bounded by the alphabets: pairs make five rows, thresholds one for each
encoding and band. With them a candidate is judged where it stands, so that nothing is joined by value, however often
one is copied. Everything is DataFrame expressions.

Defined cases: a null text counts as empty and has no spans; repeated rows and ids each keep their row; positions are
code points, ends exclusive; a UUID is an identifier and no candidate, numbers alone aren't either; runs of any length
are judged; other columns are not looked at, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import col, materialise
from halyard.llm.pii import SPAN, _let, _placed, _spliced

#: Kinds in their order, with the pattern of each. Those of access and hex match what passes the contract's checks.
KINDS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
FOUND = "random"
#: Least length of an assigned value.
ASSIGNED = 6
#: Lengths of candidates, in symbols and characters: the longest is what a string can hold.
SHORTEST, LONGEST = 16, 2**31 - 1
_CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
_UUID = r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: A piece of text that ends where no candidate goes on.
_PIECE = r"(?s).{1,65536}+[A-Za-z0-9+/_-]*+"
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Each encoding's symbols in order.
ALPHABETS = {"hex": _DIGITS + "abcdef", "base32": _LOWER.upper() + "234567", "base36": _DIGITS + _LOWER, "letters": _LOWER, "base64": _LOWER.upper() + _LOWER + _DIGITS + "+/"}
#: Where, in each alphabet, the second and third class of characters begin; letters have two halves instead.
CLASSES = {"hex": (10, 99), "base32": (26, 99), "base36": (10, 99), "letters": (13, 99), "base64": (26, 52)}
#: Standard deviations from uniform symbols that aren't random any more; the share of false discoveries.
VETO, RATE = 3.0, 1e-3
#: The least rate at which ordinary text is taken to change its class: identifiers in camel case do so at some fifth character.
CHANGES = 0.2
#: Steps of a score (minus log 10 of a bound) and its highest step.
STEPS, MOST = 20, 2000


def base_spans(text: Column) -> Column:
    """The base spans of a text as array<struct<start, end, kind, value>>, by start and then kind."""
    found = {kind: _placed(text, pattern) for kind, pattern in KINDS.items()}
    found["assign"] = F.filter(found["assign"], lambda x: F.length(F.regexp_extract(x["value"], KINDS["assign"], 2)) >= ASSIGNED)
    return in_order(F.concat(*[_spans(x, kind) for kind, x in found.items()]))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))


def in_order(spans: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for i, k in enumerate([*KINDS, FOUND]) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


def candidates(text: Column, spans: Column) -> Column:
    """The long runs of a text outside its spans, as spans."""
    blank = _spliced(text, spans, lambda s, at, _: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)).cast("int")))
    found = F.filter(_placed(blank, _CANDIDATE), lambda x: ~x["value"].rlike(_UUID))
    return _spans(found, FOUND)


def _of(kind: Column, given: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), kind)


def _encoding(value: Column) -> Column:
    """The name of a run's encoding, null for numbers and what has too few symbols."""
    bare = F.regexp_replace(value, "[+/_-]", "")

    def kind(x: Column) -> Column:
        digit = x.rlike("[0-9]")
        one = F.when(~x.rlike("[A-Za-z]"), None).when(digit & x.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(digit & x.rlike("^[A-Z2-7]+$"), "base32")
        one = one.when(digit & x.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), "base36").when(x.rlike("^(?:[a-z]+|[A-Z]+)$"), "letters").otherwise("base64")
        return F.when(F.when(one == "base64", F.length(value)).otherwise(F.length(x)) >= SHORTEST, one)

    return _let(bare, kind)


def _symbols(value: Column, kind: Column) -> Column:
    """A run as symbols of its alphabet."""
    bare = F.regexp_replace(value, "[+/_-]", "")
    return F.when(kind == "base64", F.translate(value, "-_", "+/")).when(kind == "base32", bare).otherwise(F.lower(bare))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _neighbours(values: Column, f) -> Column:  # noqa: ANN001
    """f of each value and the next."""
    n = F.size(values)
    return F.when(n > 1, F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), f)).otherwise(F.array().cast("array<double>"))


def _class(v: Column, kind: Column) -> Column:
    return (v >= _of(kind, {k: a for k, (a, _) in CLASSES.items()})).cast("double") + (v >= _of(kind, {k: b for k, (_, b) in CLASSES.items()})).cast("double")


def ordinary(docs: DataFrame, text_col: str = "text") -> dict[str, tuple[float, ...]]:
    """What symbols look like in the corpus's own words, by encoding.

    From pairs of neighbours, over all texts: the sums of squared and cubed shares of symbols, the rate of class
    changes, mean and variance of the product of neighbours' distances from the alphabet's middle. An encoding that
    the corpus has no pairs of is left out.
    """
    pieces = docs.select(F.explode(F.regexp_extract_all(col(text_col), F.lit(_PIECE), F.lit(0))).alias("piece"))
    words = F.regexp_replace("piece", _CANDIDATE, " ")
    pairs = pieces.select(F.explode(F.regexp_extract_all(words, F.lit("[A-Za-z0-9]{2}"), F.lit(0))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("alphabet"), F.lit(len(a)).cast("double").alias("k")) for k, a in ALPHABETS.items()])
    folded = F.when(F.col("kind") == "base64", F.col("pair")).when(F.col("kind") == "base32", F.upper("pair")).otherwise(F.lower("pair"))
    each = pairs.select("pair", "n", F.explode(kinds).alias("e")).select("pair", "n", "e.*").withColumn("folded", folded)
    each = materialise(
        each.select("kind", "k", "n", (F.position(F.substring("folded", 1, 1), F.col("alphabet")) - 1).alias("a"), (F.position(F.substring("folded", 2, 1), F.col("alphabet")) - 1).alias("b")).where("a >= 0 and b >= 0"), "pairs"
    )
    shares = each.select("kind", "n", F.explode(F.array("a", "b")).alias("a")).groupBy("kind", "a").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("kind"))
    shares = shares.withColumn("p", share).groupBy("kind").agg(F.sum(F.pow("p", F.lit(2.0))).alias("q2"), F.sum(F.pow("p", F.lit(3.0))).alias("q3"))
    product = (F.col("a") - (F.col("k") - 1) / 2) * (F.col("b") - (F.col("k") - 1) / 2) * 12 / (F.col("k") * F.col("k") - 1)
    change = (_class(F.col("a"), F.col("kind")) != _class(F.col("b"), F.col("kind"))).cast("double")
    w = F.sum("n")
    near = each.withColumn("x", product).groupBy("kind").agg((F.sum(F.col("n") * change) / w).alias("c"), (F.sum(F.col("n") * F.col("x")) / w).alias("m"), (F.sum(F.col("n") * F.col("x") * F.col("x")) / w).alias("s"))
    found = shares.join(near, "kind").select("kind", "q2", "q3", "c", "m", (F.col("s") - F.col("m") * F.col("m")).alias("v")).collect()
    return {r.kind: (r.q2, r.q3, max(r.c, CHANGES), r.m, max(r.v, 1e-9)) for r in found}


def battery(value: Column, model: dict[str, tuple[float, ...]]) -> Column:
    """struct<kind, band, score, random>: a run's encoding, band of lengths, score against ordinary text, and whether it passes as random; null without encoding."""
    if not model:
        return F.lit(None).cast("struct<kind:string,band:int,score:int,random:boolean>")
    of = lambda kind, i: _of(kind, {k: float(x[i]) for k, x in model.items()})

    def symbols(kind: Column) -> Column:
        s = _symbols(value, kind)
        alphabet = _of(kind, ALPHABETS)
        numbers = F.transform(F.split(s, ""), lambda c: (F.position(c, alphabet) - 1).cast("double"))
        squares = _total(F.transform(F.split(alphabet, ""), lambda c: F.pow((F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2.0))))
        return _let(F.struct(kind.alias("kind"), numbers.alias("v"), squares.alias("squares"), F.length(alphabet).cast("double").alias("k")), counts)

    def counts(x: Column) -> Column:
        kind, v, k = x["kind"], x["v"], x["k"]
        n, mid = F.size(v).cast("double"), (k - 1) / 2
        classes = F.transform(F.filter(v, lambda s: s < 62), lambda s: _class(s, kind))
        return _let(
            F.struct(
                kind.alias("kind"), n.alias("n"), k.alias("k"), (x["squares"] * k / n - n).alias("chi"),
                _total(_neighbours(v, lambda a, b: ((a >= k / 2) != (b >= k / 2)).cast("double"))).alias("halves"),
                _total(_neighbours(v, lambda a, b: (a - mid) * (b - mid))).alias("serial"),
                _total(_neighbours(classes, lambda a, b: (a != b).cast("double"))).alias("changes"), F.greatest(F.size(classes) - 1, F.lit(1)).cast("double").alias("places"),
            ), judged,
        )

    def judged(x: Column) -> Column:
        kind, n, k = x["kind"], x["n"], x["k"]
        m, serial = n - 1, x["serial"] * 12 / (k * k - 1)
        # Against uniform symbols: chi-squared by the cube root that makes it nearly normal, and two binomial or normal scores.
        free = 2 / (9 * (k - 1))
        far = F.greatest((F.cbrt(x["chi"] / (k - 1)) - (1 - free)) / F.sqrt(free), F.abs(x["halves"] - m / 2) / (F.sqrt(m) / 2), F.abs(serial) / F.sqrt(m))
        # Against ordinary text: tail bounds, as logarithms.
        q2, q3, c, mean, var = (of(kind, i) for i in range(5))
        z = (x["chi"] - (k * (1 - q2) + n * (k * q2 - 1))) / F.sqrt(4 * n * k * k * F.greatest(q3 - q2 * q2, F.lit(0.0)) + 2 * k * k * q2)
        tail = lambda z: F.when(z < 0, -math.log(2) - z * z / 2).otherwise(0.0)
        r = x["changes"] / x["places"]
        apart = r * F.log(r / c) + F.when(r < 1, (1 - r) * F.log((1 - r) / (1 - c))).otherwise(0.0)
        runs = F.when(r > c, -x["places"] * apart).otherwise(0.0)
        bound = -(tail(z) + runs + tail(F.signum(mean) * (serial - m * mean) / F.sqrt(m * var)))
        score = _let(bound, lambda y: (y - F.log(1 + y + y * y / 2)) / math.log(10))
        band = F.floor(2 * F.log2(n)).cast("int")
        return F.struct(kind.alias("kind"), band.alias("band"), F.least(F.floor(score * STEPS), F.lit(MOST)).cast("int").alias("score"), (far <= VETO).alias("random"))

    return _let(_encoding(value), lambda kind: F.when(kind.isin(*model), symbols(kind)))


def thresholds(values: DataFrame, model: dict[str, tuple[float, ...]], rate: float = RATE) -> dict[tuple[str, int], int]:
    """The least score that is a discovery, by encoding and band, of the distinct candidates (value)."""
    tested = values.distinct().select(battery(F.col("value"), model).alias("b")).where("b is not null").select("b.*")
    # A candidate that fails as random counts among those tested, but can't be found.
    counts = tested.withColumn("score", F.when(F.col("random"), F.col("score")).otherwise(-1)).groupBy("kind", "band", "score").count()
    group = Window.partitionBy("kind", "band")
    upto = F.sum("count").over(group.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = counts.withColumn("found", upto).withColumn("tested", F.sum("count").over(group))
    met = met.where((F.col("score") >= 0) & (F.pow(F.lit(10.0), -F.col("score") / STEPS) * F.col("tested") <= F.lit(rate) * F.col("found")))
    return {(r.kind, r.band): r.least for r in met.groupBy("kind", "band").agg(F.min("score").alias("least")).collect()}


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(id, base, spans) of each row: arrays of (start, end, kind, value), the base spans and all spans."""
    text = F.coalesce(col(text_col), F.lit(""))
    every = docs.select(col(id_col).alias("id"), text.alias("text")).withColumn("base", base_spans(F.col("text"))).withColumn("runs", candidates(F.col("text"), F.col("base")))
    every = materialise(every.drop("text"), "runs")
    model = ordinary(docs, text_col)
    least = thresholds(every.select(F.explode("runs.value").alias("value")), model, rate)
    if not least:
        return every.select(F.col("id").alias(id_col), "base", F.col("base").alias("spans"))
    from_score = {f"{kind} {band}": x for (kind, band), x in least.items()}

    def discovered(s: Column) -> Column:
        return _let(battery(s["value"], model), lambda b: F.coalesce(b["random"] & (b["score"] >= _of(F.concat_ws(" ", b["kind"], b["band"].cast("string")), from_score)), F.lit(False)))

    more = F.filter("runs", discovered)
    return every.select(F.col("id").alias(id_col), "base", F.when(F.size("runs") > 0, in_order(F.concat("base", more))).otherwise(F.col("base")).cast(f"array<{SPAN}>").alias("spans"))
