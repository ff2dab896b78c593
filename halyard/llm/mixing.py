"""Mixing sources to target weights by hierarchical budgets.

Every document hangs at a leaf of a tree (by default domain, language, source). A node's budget of tokens is
dealt to its children by weight; a child takes no more than its subtree can give (its tokens times
`max_epochs`), and what it can't take goes to its siblings first. Because a parent already gets no more than
its own subtree can give, only what a whole sibling group can't take passes on to the parent's siblings.

A leaf whose budget exceeds its supply repeats: whole epochs first, then a prefix of one more epoch. Each
epoch orders the leaf's documents by a seeded hash of epoch, id and text; the prefix is the documents before
whose first token less than the rest of the budget was dealt. The prefix is found by sums over hash ranges
and then within the one range where the budget ends, so no leaf is ever sorted in one task.

Defined cases: null ids, texts and tree columns are values of their own; a null or empty text has no tokens
and comes along where its place in the order lies in the prefix; rows alike in id and text share their fate;
a leaf of weight 0 gets nothing; an empty table gives an empty one; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import col, materialise

WORDS = r"[^\x20\x09-\x0D]+"
#: Hash ranges of a leaf: 2 to this power.
RANGE_BITS = 10
#: Leaves whose plan is broadcast at most (some 60 bytes each); beyond, documents are shuffled to their leaf's plan.
BROADCAST_LEAVES = 1 << 16


def order_key(seed: int, epoch: Column, digest: Column) -> Column:
    """The first 60 bits of md5(seed|epoch|digest)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), digest).cast("binary")), 1, 15), 16, 10).cast("bigint")


def digest(id_col: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))).cast("binary"))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    given = weights.get(level, {})
    if not given:
        return F.lit(1).cast("bigint")
    table = F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, int(v))])
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1)).cast("bigint")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], total: int | None, max_epochs: int) -> DataFrame:
    """The leaves (levels, supply) with a bigint budget; `weights` has whole numbers by level and value, 1 where none is given."""
    cap = (F.col("supply") * max_epochs).cast("bigint")
    root = leaves.agg(F.coalesce(F.sum(cap), F.lit(0)).alias("cap"), F.coalesce(F.sum("supply"), F.lit(0)).alias("supply")).select(F.least("cap", F.lit(total).cast("bigint") if total is not None else F.col("supply")).cast("bigint").alias("budget"))
    above, path = root, []
    for level in levels:
        nodes = leaves.groupBy(*path, level).agg(F.sum(cap).cast("bigint").alias("cap")).withColumn("w", _weight(level, weights))
        nodes = nodes.crossJoin(F.broadcast(above)) if not path else nodes.join(above, path)
        ranked = Window.partitionBy(*path).orderBy(F.col("w") <= 0, F.try_divide(F.col("cap").cast("double"), F.col("w")), level)
        before = F.coalesce(F.sum("cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        onward = F.sum("w").over(ranked.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("share", F.try_divide((F.col("budget") - before).cast("double"), onward))
        full = (F.col("w") > 0) & (F.col("cap") <= F.col("share") * F.col("w"))
        nodes = nodes.withColumn("full", full).withColumn("share", F.max(F.when(~F.col("full"), F.col("share"))).over(Window.partitionBy(*path)))
        path = [*path, level]
        above = nodes.select(*path, F.when(F.col("full"), F.col("cap")).when(F.col("w") > 0, F.floor(F.col("share") * F.col("w"))).otherwise(0).cast("bigint").alias("budget"))
    return leaves.join(above, levels)


def plan(marks: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], total: int | None, max_epochs: int, seed: int) -> DataFrame:
    """(levels, budget, epochs, cut): whole epochs, and the last order key of the prefix (-1: none) of each leaf."""
    leaves = materialise(marks.groupBy(*levels).agg(F.sum("n").alias("supply")), "leaves")
    found = budgets(leaves, levels, weights, total, max_epochs)
    found = found.withColumn("epochs", F.coalesce(F.try_divide("budget", "supply").cast("bigint"), F.lit(0)))
    found = materialise(found.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply")), "budgets")
    keyed = _with_plan(marks, found.where("rest > 0").select(*levels, "epochs", "rest"), levels).withColumn("h", order_key(seed, F.col("epochs"), F.col("digest")))
    keyed = keyed.withColumn("r", F.shiftright("h", 60 - RANGE_BITS))
    ranges = keyed.groupBy(*levels, "rest", "r").agg(F.sum("n").alias("n"))
    upto = F.coalesce(F.sum("n").over(Window.partitionBy(*levels).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = ranges.withColumn("upto", upto).where("upto < rest").groupBy(*levels).agg(F.max(F.struct("r", "upto")).alias("m")).select(*levels, "m.r", "m.upto")
    fine = keyed.join(last, [*levels, "r"])
    start = F.col("upto") + F.coalesce(F.sum("n").over(Window.partitionBy(*levels).orderBy("h").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = fine.withColumn("start", start).where("start < rest").groupBy(*levels).agg(F.max("h").alias("cut"))
    return materialise(found.join(cuts, levels, "left").select(*levels, "supply", "budget", "epochs", F.coalesce("cut", F.lit(-1)).alias("cut")), "plan")


def _with_plan(rows: DataFrame, found: DataFrame, levels: list[str]) -> DataFrame:
    small = found.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(found) if small else found, levels)


def blend(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], *, total: int | None = None, max_epochs: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", out_col: str = "mix") -> DataFrame:
    """`docs` with a column `out_col` (levels as strings, epoch): each chosen document once for each epoch it is chosen in.

    `total` is the budget in words (None: as many as there are). If docs has a column of that name, it is replaced.
    """
    names = list(levels)
    known = [F.coalesce(c.cast("string"), F.lit("\u0000")).alias(n) for n, c in levels.items()]
    tag, text = digest(col(id_col), col(text_col)), F.coalesce(col(text_col), F.lit(""))
    marks = materialise(docs.select(*known, tag.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("n")), "marks")
    found = plan(marks, names, weights, total, max_epochs, seed).select(*names, "epochs", "cut")
    kept = [c for c in docs.columns if c != out_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), tag.alias("digest"), *known)
    rows = _with_plan(rows, found, names)
    copies = F.col("epochs") + (order_key(seed, F.col("epochs"), F.col("digest")) <= F.col("cut")).cast("bigint")
    rows = rows.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    mix = F.struct(*[F.nullif(F.col(n), F.lit("\u0000")).alias(n) for n in names], F.col("epoch").cast("bigint").alias("epoch"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], mix.alias(out_col))


#: The production mixture: the crawl's one large source against all curated ones, by language, sources alike.
WEIGHTS = {"domain": {"crawl": 40, "curated": 60}, "lang": {"en": 55, "de": 17, "fr": 17, "es": 11}}


def production_levels() -> dict[str, Column]:
    return {"domain": F.when(F.col("source") == "src0", "crawl").otherwise("curated"), "lang": F.col("lang"), "source": F.col("source")}
