"""Event-sourced entities: append, replay, time travel, snapshots and pruning.

An event has ``entity_id, rev, op`` (``create``, ``patch``, ``revert``, ``snapshot``), ``patch`` (a map; null values delete) and
``state`` (a map, for all ops but ``patch``). The state at a revision is the last state event up to it and the
patches after that, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT_EVERY = 50
KEEP = 1000


def _fold(state: Column, patch: Column) -> Column:
    kept = F.map_filter(state, lambda k, v: ~F.map_contains_key(patch, k))
    return F.map_filter(F.map_concat(kept, patch), lambda k, v: v.isNotNull())


def states_at(events: DataFrame, rev: int | None = None) -> DataFrame:
    """``entity_id``, ``rev``, ``state`` of each entity at a revision (the newest without one).

    An entity's events since its last state event are folded in one row: with a snapshot every
    ``SNAPSHOT_EVERY`` revisions these are few, whatever the length of its history.
    """
    upto = events if rev is None else events.where(F.col("rev") <= rev)
    base = upto.where("op <> 'patch'").groupBy("entity_id").agg(F.max("rev").alias("base"))
    tail = upto.join(base, "entity_id").where("rev >= base")
    empty = F.expr("map()").cast("map<string,string>")
    folded = tail.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("rev", "op", "state", "patch")), lambda a, b: (a["rev"] - b["rev"]).cast("int")).alias("e"), F.max("rev").alias("rev"))
    step = lambda s, x: F.when(x["op"] == "patch", _fold(s, F.coalesce(x["patch"], empty))).otherwise(F.coalesce(x["state"], empty))
    return folded.select("entity_id", "rev", F.aggregate("e", empty, step).alias("state"))


def number_events(raw: DataFrame, *, order: list[str], every: int = SNAPSHOT_EVERY) -> DataFrame:
    """Revision of each event of its entity, when every ``every`` revisions a snapshot takes the next number."""
    n = F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))
    return raw.withColumn("rev", n + F.floor((n - 1) / (every - 1)).cast("int"))


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of the states of two revisions that differ: ``entity_id, key, before, after``."""
    flat = lambda df, name: df.select("entity_id", F.explode("state").alias("key", name))
    return flat(a, "before").join(flat(b, "after"), ["entity_id", "key"], "full_outer").where("not (before <=> after)")


def revert(events: DataFrame, rev: int) -> DataFrame:
    """Events that bring every entity back to its state at a revision."""
    last = events.groupBy("entity_id").agg(F.max("rev").alias("last"))
    then = states_at(events, rev).select("entity_id", "state")
    empty = F.lit(None).cast("map<string,string>")
    return then.join(last, "entity_id").where(F.col("last") > rev).select("entity_id", (F.col("last") + 1).alias("rev"), F.lit("revert").alias("op"), empty.alias("patch"), "state")


def slot_snapshots(rows: DataFrame, key: str, ts: str, order: str, hours: int = 8) -> DataFrame:
    """The last row of each key in each slot of so many hours."""
    from quire.functions.dates import slot

    from .paging import latest

    x = rows.withColumn("_s", slot(F.col(ts), hours)).select("*", "_s.bucket", "_s.slot").drop("_s")
    return latest(x, [key, "bucket", "slot"], [ts, order])


def prune_plan(events: DataFrame, key: str, order: list[str], keep: int = KEEP) -> DataFrame:
    """Events to delete so that each key falls back to ``keep``: its oldest that are no anchors (``op`` ``create`` or ``snapshot``), with their ``place`` from the oldest.

    Anchors count but stay, so a key with more than ``keep`` of them stays over. Without a column ``op`` no event is an anchor.
    """
    anchor = F.coalesce(F.col("op").isin("create", "snapshot"), F.lit(False)) if "op" in events.columns else F.lit(False)
    total = events.groupBy(F.col(key).alias("_key")).agg((F.count(F.lit(1)) - keep).alias("_excess")).where("_excess > 0")
    oldest = Window.partitionBy(key).orderBy(*order)
    ranked = events.where(~anchor).withColumn("place", F.row_number().over(oldest))
    return ranked.join(total, F.col(key).eqNullSafe(F.col("_key"))).where("place <= _excess").drop("_key", "_excess")


def expired(rows: DataFrame, ts: str, now: Column, days: Column) -> DataFrame:
    """Rows older than the days their kind may live; a null never expires."""
    return rows.where(days.isNotNull() & (F.datediff(now, F.col(ts)) > days))
