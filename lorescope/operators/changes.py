"""What changed between two snapshots, by content hash, and reuse of what did not."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

NEW, CHANGED, UNCHANGED, REMOVED = "new", "changed", "unchanged", "removed"


def has_changed(items: DataFrame, state: DataFrame) -> DataFrame:
    """items(entity_type, entity_id, content_hash) with `changed`; an unknown item has changed. Null hashes are equal."""
    known = state.select("entity_type", "entity_id", F.col("content_hash").alias("__known"), F.lit(True).alias("__there"))
    out = items.join(known, ["entity_type", "entity_id"], "left")
    return out.withColumn("changed", F.col("__there").isNull() | ~F.col("__known").eqNullSafe(F.col("content_hash"))).drop("__known", "__there")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status; old and new have keys and content_hash. Null hashes are equal."""
    a = old.select(*keys, F.col("content_hash").alias("__old"), F.lit(True).alias("__was"))
    b = new.select(*keys, F.col("content_hash").alias("__new"), F.lit(True).alias("__is"))
    status: Column = F.when(F.col("__was").isNull(), NEW).when(F.col("__is").isNull(), REMOVED).when(F.col("__old").eqNullSafe(F.col("__new")), UNCHANGED).otherwise(CHANGED)
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def reconcile(previous: DataFrame, listing: DataFrame, state: DataFrame, key: str, parents: DataFrame | None = None, parent_key: str | None = None, force_full: bool = False) -> DataFrame:
    """What becomes of each listed item: listing's columns with `unchanged`, `reused` and `kept_hash`.

    Three things are compared: what is listed now (key, content_hash), what the state knows (key, content_hash), and of
    which items the last run has rows. An item is unchanged if its hash is the state's, null hashes being equal, or if it
    stands under an unchanged parent (parents: parent_key, unchanged). It is reused if it is unchanged and the last run has
    rows of it. kept_hash is the hash of the content that is kept, so the state's for a reused item, and not the one listed; kept_known
    tells whether there is one.
    """
    last = state.select(F.col(key), F.col("content_hash").alias("__last"), F.lit(True).alias("__listed"))
    have = previous.select(key).distinct().withColumn("__have", F.lit(True))
    judged = listing.join(last, key, "left").join(have, key, "left")
    listed, there = F.coalesce("__listed", F.lit(False)), F.coalesce("__have", F.lit(False))
    same = F.lit(False) if force_full else listed & F.col("__last").eqNullSafe(F.col("content_hash"))
    if parents is not None and not force_full:
        judged = judged.join(parents.select(parent_key, F.col("unchanged").alias("__above")), parent_key, "left")
        same = same | F.coalesce("__above", F.lit(False))
    judged = judged.withColumn("unchanged", same).withColumn("reused", F.col("unchanged") & there)
    kept = F.when(F.col("reused"), F.col("__last")).otherwise(F.col("content_hash"))
    return judged.withColumns({"kept_hash": kept, "kept_known": ~F.col("reused") | listed}).drop("__last", "__listed", "__have", "__above")


def incremental(previous: DataFrame, listing: DataFrame, fresh: DataFrame, key: str, state: DataFrame, parents: DataFrame | None = None, parent_key: str | None = None, force_full: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of one level, of reused items from the previous snapshot and of others fresh ones, and its new state (key, content_hash).

    The new state follows the rows: a reused item has the hash of the content that was kept, an item of which there are
    no rows, neither kept nor fresh, has none.
    """
    return _taken(previous, fresh, key, reconcile(previous, listing, state, key, parents, parent_key, force_full))


def _taken(previous: DataFrame, fresh: DataFrame, key: str, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    old = previous.join(judged.filter("reused").select(key), key, "left_semi")
    new = fresh.join(judged.filter("not reused").select(key), key, "left_semi")
    read = judged.filter("not reused").join(fresh.select(key), key, "left_semi")
    after = judged.filter("reused and kept_known").unionByName(read).select(key, F.col("kept_hash").alias("content_hash"))
    return old.unionByName(new, allowMissingColumns=True), after.distinct()


@dataclass(frozen=True)
class Level:
    """One level of a hierarchy: what the last run kept, what is listed now with its content_hash, and what a fresh
    reading gives. key names an item in all three, parent_key the item's parent in listing; both are as in the parent."""

    name: str
    key: str
    previous: DataFrame
    listing: DataFrame
    fresh: DataFrame
    parent: str | None = None
    parent_key: str | None = None


def incremental_levels(levels: list[Level], state: DataFrame, force_full: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each level's rows, and the new state (entity_type, entity_id, content_hash), from the state of the last run.

    Parents come before children. An item whose own hash is unchanged, or that stands under an unchanged one, is
    taken from the last run with all that lies below it; of a changed or new item the rows are fresh, and its children
    are judged by their own hashes. An item that the last run has no row of is read afresh whatever its hash. The new state
    follows the rows that are kept: what changed under an unchanged parent keeps the hash of its old content, and so is read
    afresh once the parent changes.
    """
    found, kept, states = {}, {}, []
    for level in levels:
        kind = level.listing.schema[level.key].dataType
        own = state.filter(F.col("entity_type") == level.name).select(F.col("entity_id").cast(kind).alias(level.key), "content_hash")
        above = kept[level.parent].withColumnRenamed("__item", level.parent_key) if level.parent else None
        judged = reconcile(level.previous, level.listing, own, level.key, above, level.parent_key, force_full)
        found[level.name], after = _taken(level.previous, level.fresh, level.key, judged)
        kept[level.name] = judged.select(F.col(level.key).alias("__item"), "unchanged")
        states.append(after.select(F.lit(level.name).alias("entity_type"), F.col(level.key).cast("string").alias("entity_id"), "content_hash"))
    return found, reduce(DataFrame.unionByName, states)


def rolled_over(items: DataFrame) -> DataFrame:
    """The state after a run: the hash of every item seen in it."""
    return items.select("entity_type", "entity_id", "content_hash").distinct()
