"""Personal data: strict base patterns, and unseen identifiers found by bootstrapped contexts.

Base spans come from four regular expressions with checks. They are the seeds of a graph between lexical
patterns (the two words before an identifier-shaped token) and instances (the token's value). A pattern's
confidence for a kind is the sum of its instances' scores over all its occurrences in the corpus, those
before ordinary words included; an instance's score is 1 for a base span, else 1 - product of
(1 - confidence) over the trusted patterns it stands in. A few rounds of this run on the aggregated graph.
Unknown tokens behind a trusted pattern become spans of its kind.

Everything is DataFrame expressions. Positions are running sums of the lengths of what lies between matches,
made by doubling steps over whole arrays, so a text's cost grows as n log n with its matches. Tokens are looked
for in a copy of the text in which each span is masked, length by length, by characters of its kind: a token's
own mask says whether and of what kind it is known. The regular expressions below match what the plain forms
match, but can't backtrack: a run of characters is tried at its first position only, or where the match before
ended. Texts are scanned for spans and tokens once; the result is written out.

Defined cases: a null text counts as empty and has no spans; repeated rows and ids each keep their row;
positions are code points, ends exclusive; other columns, whatever their names, are not looked at, and
`scrub` passes them through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import col, join_size_checked, materialise

#: Kinds in their order, with the pattern of each.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap condition that every text with a match of the kind meets.
_HINT = {"email": "@", "phone": "+"}
SPAN = "struct<start:bigint,end:bigint,kind:string,value:string>"
#: The least number of different values and the least confidence of a trusted context, and the rounds.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.6, 3
#: Contexts or rows of new spans that are broadcast at most, counted before; beyond, both sides are shuffled.
BROADCAST_CONTEXTS = 1 << 17
#: Masks: a span's first character and its other ones, by kind. The same characters of a text itself count as "?".
_HEAD, _REST = ({k: chr(0xE000 + first + i) for i, k in enumerate(KINDS)} for first in (4, 0))
_MASK = r"\uE000-\uE007"
_TOKEN = rf"(?<!\S)[^\s0-9@{_MASK}]*+[0-9@{_MASK}]\S*+"
#: The last two words of what stands before a token, and the space behind them.
_CONTEXT = r"(?<!\S)(\S++\s++\S++)\s++\z"
#: Characters of a piece of text, from which parts are cut without counting from the text's start.
PIECE = 1024


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f refers to it."""
    return F.transform(F.array(value), f)[0]


def _running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """The running sums (or maxima, none below 0) of an array of numbers: at step k, each takes in what lies 2**k before it."""
    n, zero = F.size(values), F.lit(0).cast("bigint")
    steps = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, k: Column) -> Column:
        wide = F.least(F.pow(F.lit(2.0), k).cast("int"), n)
        return F.zip_with(F.concat(F.array_repeat(zero, wide), F.slice(acc, F.lit(1), n - wide)), acc, both).cast("array<bigint>")

    return F.aggregate(steps, values.cast("array<bigint>"), step)


def _shifted(values: Column, by: int) -> Column:
    """An array moved on by some places, filled up with empty texts."""
    return F.slice(F.concat(F.array_repeat(F.lit(""), by), values), F.lit(1), F.size(values))


def _placed(text: Column, pattern: str, *, context: bool = False) -> Column:
    """array<struct<start, end, value, before>> of a pattern's matches.

    With `context`, for matches that are whole words, `before` is what stands before each from the second last
    word on, whole and across matches; else it is empty.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def places(p: Column) -> Column:
        gap = F.slice(p["parts"], F.lit(1), F.size(p["found"]))
        ends = _running(F.zip_with(gap, p["found"], lambda g, v: (F.length(g) + F.length(v)).cast("bigint")), lambda x, y: x + y)
        more = [_shifted(p["found"], 2).alias("v2"), _shifted(gap, 1).alias("g1"), _shifted(p["found"], 1).alias("v1"), gap.alias("g0")] if context else []
        every = F.arrays_zip(p["found"].alias("value"), ends.alias("end"), *more)

        def one(x: Column) -> Column:
            # The two words before a match lie in the gap before it or, as far as that lacks them, in what comes next.
            before = _let(F.concat(x["v2"], x["g1"], x["v1"], x["g0"]), lambda t: _let(F.regexp_extract(t, _CONTEXT, 0), lambda w: F.when(w == "", t).otherwise(w))) if context else F.lit("")
            return F.struct((x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value"), before.alias("before"))

        return F.transform(every, one)

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>")
    return F.coalesce(F.when(text.rlike(pattern), _let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("parts")), places)), none)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, first: Column, end: Column) -> Column:
    """The characters first to end - 1 of a text, from its pieces."""

    def parts(x: Column) -> Column:
        i, j, a, n = x["i"], x["j"], x["a"], x["n"]
        head = F.substring(F.get(pieces, i), a + 1, F.least(n, F.lit(PIECE)))
        rest = F.concat(head, F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(pieces, j), F.lit(1), a + n - (j - i) * PIECE))
        return F.when(n <= 0, "").when(i == j, head).otherwise(rest)

    i, j = (first / PIECE).cast("int"), ((end - 1) / PIECE).cast("int")
    return _let(F.struct(i.alias("i"), j.alias("j"), (first % PIECE).cast("int").alias("a"), (end - first).cast("int").alias("n")), parts)


def _spliced(text: Column, spans: Column, new: Callable[[Column, Column, Column], Column], kept: Callable[[Column], Column] = lambda x: x) -> Column:
    """The text with each of its spans (by start) replaced by new(span, end of those before, pieces), the rest by kept(rest)."""

    def splice(p: Column) -> Column:
        ends = _running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
        zero = F.array(F.lit(0).cast("bigint"))
        every = F.arrays_zip(spans.alias("s"), F.slice(F.concat(zero, ends), F.lit(1), F.size(spans)).alias("at"))
        parts = F.transform(every, lambda x: F.concat(kept(_cut(p, x["at"], x["s"]["start"])), new(x["s"], x["at"], p)))
        return F.concat(F.array_join(parts, ""), kept(_cut(p, F.array_max(ends), F.length(text).cast("bigint"))))

    return F.when(F.size(spans) > 0, _let(_pieces(text), splice)).otherwise(kept(text))


def _by_kind(kind: Column, given: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), kind)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span's characters replaced by those of its kind; its length stays."""

    def mask(s: Column, at: Column, _: Column) -> Column:
        rest = _by_kind(s["kind"], _REST)
        whole = F.concat(_by_kind(s["kind"], _HEAD), F.repeat(rest, (s["end"] - s["start"] - 1).cast("int")))
        return F.when(s["start"] >= at, whole).otherwise(F.repeat(rest, F.greatest(s["end"] - at, F.lit(0)).cast("int")))

    odd = "".join([*_HEAD.values(), *_REST.values()])
    return _spliced(text, spans, mask, lambda x: F.translate(x, odd, "?" * len(odd)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    d = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c: c.cast("int"))
    parts = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x < 5, 2 * x).otherwise(2 * x - 9))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)(?:\.|$)){4}$")
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(value)).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _of_kind(found: Column, kind: str) -> Column:
    ok = F.filter(found, lambda x: _valid(kind, x["value"]))
    return F.transform(ok, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start and then kind, as an array of structs."""
    parts = []
    for kind, pattern in KINDS.items():
        found = _placed(text, pattern)
        if kind in _HINT:
            found = F.when(text.contains(_HINT[kind]), found)
        parts.append(F.coalesce(_of_kind(found, kind), F.array().cast(f"array<{SPAN}>")))
    return in_order(F.concat(*parts))


def in_order(spans: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


TOKEN = "struct<context:string,value:string,kind:string,start:bigint,end:bigint>"


def tokens(text: Column, spans: Column) -> Column:
    """array<struct> of the identifier-shaped tokens with two words before them: context, value, kind (null: unknown), place.

    A span within a token stands for it; unknown ones must be long enough to identify someone.
    """

    def one(t: Column, pieces: Column) -> Column:
        run = F.regexp_extract(t["value"], f"[{''.join(_HEAD.values())}][{''.join(_REST.values())}]*", 0)
        core = F.regexp_extract(t["value"], r"^[^\p{L}\p{N}+]*(.*?)[^\p{L}\p{N}]*$", 1)
        context = F.regexp_replace(F.lower(F.regexp_extract(t["before"], _CONTEXT, 1)), r"\s+", " ")

        def placed(x: Column) -> Column:
            known = x["run"] != ""
            head = F.when(known, F.regexp_extract(t["value"], f"^[^{''.join(_HEAD.values())}]*", 0)).otherwise(F.regexp_extract(t["value"], r"^[^\p{L}\p{N}+]*", 0))
            kind = F.when(known, _by_kind(F.substring(x["run"], 1, 1), {v: k for k, v in _HEAD.items()}))
            return F.struct(known.alias("known"), kind.alias("kind"), x["core"].alias("core"), (t["start"] + F.length(head)).alias("start"), F.length(F.when(known, x["run"]).otherwise(x["core"])).alias("n"))

        def token(x: Column) -> Column:
            end = x["start"] + x["n"]
            value = F.when(x["known"], _cut(pieces, x["start"], end)).otherwise(x["core"])
            return F.struct(context.alias("context"), value.alias("value"), x["kind"].alias("kind"), x["start"].cast("bigint").alias("start"), end.cast("bigint").alias("end"))

        return _let(F.struct(run.alias("run"), core.alias("core")), lambda x: _let(placed(x), token))

    found = _placed(masked(text, spans), _TOKEN, context=True)
    found = _let(found, lambda ts: F.when(F.size(ts) > 0, _let(_pieces(text), lambda p: F.transform(ts, lambda t: one(t, p)))))
    kept = F.filter(found, lambda t: (t["context"] != "") & (t["kind"].isNotNull() | (F.length(t["value"]) >= 5)))
    return F.coalesce(kept, F.array().cast(f"array<{TOKEN}>"))


def trusted_contexts(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(context, kind, confidence) of the patterns that the graph comes to trust."""
    graph = materialise(tokens.groupBy("context", "value", "kind").agg(F.count(F.lit(1)).alias("n")), "graph")
    # A first round can only trust what has enough known values; where nothing has, no text needs to be read for totals.
    seeds = graph.where("kind is not null").groupBy("context", "kind").agg(F.count_distinct("value").alias("values")).where(F.col("values") >= SUPPORT)
    if seeds.isEmpty():
        return rows.sparkSession.createDataFrame([], "context string, kind string, confidence double")
    wide = graph.groupBy("context").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("most")).where(F.col("values") >= SUPPORT).select("context", "most")

    def occurrences(part: DataFrame, contexts: DataFrame) -> DataFrame:
        w = F.split(F.lower("text"), r"\s+")
        pair = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
        pairs = part.select(w.alias("w")).select(F.explode(pair).alias("context"))
        n = F.count(F.lit(1)).alias("total")
        if contexts.limit(BROADCAST_CONTEXTS + 1).count() <= BROADCAST_CONTEXTS:
            return pairs.join(F.broadcast(contexts), "context", "left_semi").groupBy("context").agg(n)
        # Counted before they are shuffled to meet the contexts, so that a frequent pair is one row of each task.
        return pairs.groupBy("context").agg(n).join(contexts, "context", "left_semi")

    # What a context occurs in a part of the texts is a lower bound of its total: where even all its tokens are
    # too few against that, no round can come to trust it, and the count over all texts leaves it out.
    some = occurrences(rows.where(F.pmod("key", F.lit(16)) == 0), wide.select("context"))
    wide = materialise(wide.join(some, "context", "left").where(F.col("most") >= CONFIDENCE * F.coalesce("total", F.lit(0))).select("context"), "wide")
    totals = occurrences(rows, wide)
    totals = materialise(totals, "totals")
    graph = join_size_checked(graph, totals, "context", BROADCAST_CONTEXTS, "inner")
    known = graph.where("kind is not null").select("context", "value", "kind", "n", F.lit(1.0).alias("score"))
    trusted = None
    for i in range(ROUNDS):
        by = known.groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count_distinct("value").alias("values"))
        by = by.join(totals, "context").withColumn("confidence", F.least(F.col("mass") / F.col("total"), F.lit(1.0)))
        by = by.where((F.col("confidence") >= CONFIDENCE) & (F.col("values") >= SUPPORT))
        best = by.groupBy("context").agg(F.max(F.struct("confidence", "kind")).alias("best"))
        trusted = materialise(best.select("context", "best.kind", "best.confidence"), "trusted")
        # Where nothing is trusted, or nothing new stands in what is, further rounds change nothing.
        if i + 1 < ROUNDS and not trusted.isEmpty():
            # Unknown values score by the trusted patterns they stand in, wherever else they stand too.
            fresh = join_size_checked(graph.where("kind is null").drop("kind"), trusted, "context", BROADCAST_CONTEXTS, "inner")
            scored = materialise(fresh.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score")), "scored")
            if scored.isEmpty():
                break
            grown = join_size_checked(graph.where("kind is null").drop("kind"), scored, "value", BROADCAST_CONTEXTS, "inner").select("context", "value", "kind", "n", "score")
            known = materialise(graph.where("kind is not null").select("context", "value", "kind", "n", F.lit(1.0).alias("score")).unionByName(grown), "known")
        else:
            break
    return trusted


def _found(docs: DataFrame, id_col: str, text_col: str, *, rows: bool) -> tuple[DataFrame, DataFrame]:
    """(id, key, spans, and with `rows` the whole row) of each row, and (id, key, more) of those to which contexts add spans; both written out."""
    text = F.coalesce(col(text_col), F.lit(""))
    named = docs.select(col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), *([F.struct(*map(col, docs.columns)).alias("row")] if rows else []))
    every = named.withColumn("spans", base_spans(F.col("text"))).withColumn("tokens", tokens(F.col("text"), F.col("spans")))
    every = materialise(every.drop("text"), "spans")
    each = every.select("id", "key", F.explode("tokens").alias("t")).select("id", "key", "t.*")
    trusted = trusted_contexts(named.select("key", "text"), each)
    fresh = join_size_checked(each.where("kind is null").drop("kind"), trusted, "context", BROADCAST_CONTEXTS, "inner").select("id", "key", F.struct("start", "end", "kind", "value").alias("s"))
    return every.drop("tokens"), materialise(fresh.distinct().groupBy("id", "key").agg(F.collect_list("s").alias("more")), "fresh")


def _joined(every: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows with all their spans in `every`."""
    small = fresh.limit(BROADCAST_CONTEXTS + 1).count() <= BROADCAST_CONTEXTS
    fresh = fresh.select(F.col("id").alias("id2"), F.col("key").alias("key2"), "more")
    both = every.join(F.broadcast(fresh) if small else fresh, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")
    more = F.coalesce("more", F.array().cast(f"array<{SPAN}>"))
    return both.withColumn("every", F.when(F.size(more) > 0, in_order(F.concat("spans", more))).otherwise(F.col("spans")))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of each row: arrays of (start, end, kind, value), the base spans and all spans."""
    both = _joined(*_found(docs, id_col, text_col, rows=False))
    return both.select(F.col("id").alias(id_col), F.col("spans").alias("base"), F.col("every").alias("spans"))


def scrub(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with each span of its texts replaced by its kind in angle brackets; a null text stays null."""
    both = _joined(*_found(docs, id_col, text_col, rows=True)).select("row", "every")
    field = F.col("row").getField
    return both.select(*[(redact(field(c), F.col("every")) if c == text_col else field(c)).alias(c) for c in docs.columns])


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans make one."""
    return _spliced(text, spans, lambda s, at, _: F.when(s["start"] >= at, F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(""))
