"""Reads and writes over sharded rows with tombstones, as plain DataFrame functions.

Rows are (key, shard_id, seq, vec). The active shard is the newest; older ones are views. Tombstones are keys
that were removed from views; they never hide rows of the active shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are broadcast at most, counted before; beyond, both sides of a join are shuffled.
BROADCAST_KEYS = 1 << 17


def _checked(keys: DataFrame) -> DataFrame:
    """`keys`, to be broadcast if there are few."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def narrowed(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of some keys: what a lookup asks for, before anything is shuffled, sorted or ranked."""
    return rows.join(_checked(keys.select("key")), "key", "left_semi")


def visible(rows: DataFrame, tombstones: DataFrame | None, active: int) -> DataFrame:
    """The physical rows that tombstones don't hide, in one pass over them."""
    if tombstones is None:
        return rows
    gone = tombstones.select(F.col("key").alias("_gone"))
    return rows.join(gone, (F.col("key") == F.col("_gone")) & (F.col("shard_id") != active), "left_anti")


def newest(rows: DataFrame) -> DataFrame:
    """Of each key only the row of the newest shard (the last of it, if there are more)."""
    last = Window.partitionBy("key").orderBy(F.desc("shard_id"), F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def live(rows: DataFrame, tombstones: DataFrame | None, active: int, *, dedup: bool = True) -> DataFrame:
    """What reads see: visible rows, and of each key the newest where `dedup` says that keys may lie in several shards."""
    seen = visible(rows, tombstones, active)
    return newest(seen) if dedup else seen


def first_of_batch(batch: DataFrame) -> DataFrame:
    return _one(batch, F.col("seq"))


def last_of_batch(batch: DataFrame) -> DataFrame:
    return _one(batch, F.col("seq").desc())


def _one(batch: DataFrame, order: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("key").orderBy(order))
    return batch.withColumn("_n", n).where("_n = 1").drop("_n")


def to_add(batch: DataFrame, rows: DataFrame, active: int, *, multi: bool = False) -> DataFrame:
    """What an add appends: the first of each key that the active shard lacks (views are not asked); all of it with `multi`."""
    if multi:
        return batch
    return first_of_batch(batch).join(rows.where(F.col("shard_id") == active).select("key"), "key", "left_anti")


def to_add_once(batch: DataFrame, live_rows: DataFrame) -> DataFrame:
    """What an add_once appends: the first of each key that no shard has."""
    return first_of_batch(batch).join(live_rows.select("key"), "key", "left_anti")


def removed(live_rows: DataFrame, gone: DataFrame) -> DataFrame:
    """What a removal leaves."""
    return live_rows.join(_checked(gone.select("key")), "key", "left_anti")


def cleared(tombstones: DataFrame, added: DataFrame) -> DataFrame:
    """The tombstones that stay when keys are added again."""
    return tombstones.join(added.select("key"), "key", "left_anti")


def buried(tombstones: DataFrame, removed: DataFrame, rows: DataFrame, active: int) -> DataFrame:
    """The tombstones after a removal: those before and the removed keys that a view holds."""
    held = removed.select("key").distinct().join(rows.where(F.col("shard_id") != active).select("key"), "key", "left_semi")
    return tombstones.select("key").unionByName(held).distinct()


def changes(batch: DataFrame, live_rows: DataFrame) -> DataFrame:
    """(key, change, vec) of a conditional upsert: `new`, `changed` or `same`; the last of each key in the batch counts."""
    old = live_rows.select("key", F.col("vec").alias("_old"), F.lit(True).alias("_there"))
    kind = F.when(F.col("_there").isNull(), "new").when(F.col("vec").eqNullSafe(F.col("_old")), "same").otherwise("changed")
    return last_of_batch(batch).join(old, "key", "left").select("key", kind.alias("change"), "vec")


def compacted(rows: DataFrame, tombstones: DataFrame | None, active: int) -> DataFrame:
    """(key, shard_id, seq) of the rows that a compaction keeps; vectors don't travel to find them."""
    return live(rows.select("key", "shard_id", "seq"), tombstones, active)


def stats(rows: DataFrame, tombstones: DataFrame, active: int) -> DataFrame:
    """One row: total, shards, tombstones, size (live) and size_estimate (total less tombstones), all bigint."""
    n = F.count(F.lit(1))
    out = rows.agg(n.alias("total"), F.count_distinct("shard_id").alias("shards"))
    out = out.crossJoin(tombstones.agg(n.alias("tombstones"))).crossJoin(compacted(rows, tombstones, active).agg(n.alias("size")))
    return out.withColumn("size_estimate", F.greatest(F.lit(0), F.col("total") - F.col("tombstones")).cast("bigint"))


# Lookups: narrow the rows to the asked keys first


def get(keys: DataFrame, live_rows: DataFrame) -> DataFrame:
    """(pos, key, vec) of each asked key (pos, key), null where it isn't there; a key with several vectors has a row for each."""
    return keys.join(live_rows.select("key", "vec"), "key", "left").select("pos", "key", "vec")


def contains(keys: DataFrame, live_rows: DataFrame) -> DataFrame:
    """(pos, key, found) of each asked key."""
    there = live_rows.select("key", F.lit(True).alias("_there")).distinct()
    return keys.join(there, "key", "left").select("pos", "key", F.coalesce("_there", F.lit(False)).alias("found"))


def count(keys: DataFrame, visible_rows: DataFrame) -> DataFrame:
    """(pos, key, n): the physical rows of each asked key, copies in several shards included."""
    n = visible_rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return keys.join(n, "key", "left").select("pos", "key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


# Places


def _number(df: DataFrame, column: str) -> Column:
    """A double that rises with a whole number, text or bytes."""
    kind = df.schema[column].dataType.simpleString()
    if kind in ("binary", "string"):
        return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 8)), 16, "0"), 16, 10).cast("double")
    return F.col(column).cast("double")


def numbered(rows: DataFrame, key: str = "key", *, within: str | None = None, size: int = 100_000, weight: Column | None = None) -> DataFrame:
    """`rows` with `pos`: each row's place, from 0, in the order of `within` (if given) and `key`.

    With a bigint `weight`, places are what lies before a row: the sum of the weights. Quantiles cut the order into
    runs of about `size` rows; only rows of one run are ranked together.
    """
    groups = [within] if within else []
    runs = min(1000, -(-rows.count() // size))
    if runs > 1:
        at = _number(rows, key)
        cuts = rows.groupBy(*groups).agg(F.percentile_approx(at, [i / runs for i in range(1, runs)], 10 * runs).alias("_cuts"))
        rows = rows.join(F.broadcast(cuts), groups) if groups else rows.crossJoin(F.broadcast(cuts))
        rows = rows.withColumn("_run", F.size(F.filter("_cuts", lambda c: c <= at))).drop("_cuts")
    else:
        rows = rows.withColumn("_run", F.lit(0))
    where = [*groups, "_run"]
    # A row for each run.
    sizes = rows.groupBy(*where).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy(*where).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).drop("_size")
    order = Window.partitionBy(*where).orderBy(key)
    inside = F.row_number().over(order) - 1 if weight is None else F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes), where).withColumn("pos", (F.col("_before") + inside).cast("bigint")).drop("_run", "_before")


def auto_keys(batch: DataFrame, first: int, order: str) -> DataFrame:
    """`batch` with a bigint `key`: numbers from `first` on, in the order of column `order`."""
    return numbered(batch, order).withColumn("key", F.col("pos") + F.lit(first)).drop("pos")


def positions(rows: DataFrame, first: int, end: int) -> DataFrame:
    """(pos, key) of the keys at places first to end - 1 in the order of shard and key.

    Places are counted by shard, then within the shards that the slice meets.
    """
    sizes = rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = sizes.withColumn("before", before).where((F.col("before") < end) & (F.col("before") + F.col("n") > first)).collect()
    if not met:
        return rows.sparkSession.createDataFrame([], f"pos bigint, key {rows.schema['key'].dataType.simpleString()}")
    skipped = min(r.before for r in met)
    inside = numbered(rows.where(F.col("shard_id").between(min(r.shard_id for r in met), max(r.shard_id for r in met))).select("shard_id", "key"), within="shard_id")
    placed = inside.select((F.col("pos") + skipped).cast("bigint").alias("pos"), "key")
    return placed.where((F.col("pos") >= first) & (F.col("pos") < end))
