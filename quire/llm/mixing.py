"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's documents form blocks. Block ``j`` of a source of weight ``w`` is released at
``floor((j - 1) / w)`` and due at ``ceil(j / w)``; of the released blocks the one due
first takes the next slot. Every source then stays within one block of its target at all
times. Weights are ratios of whole numbers, so the order repeats with their common denominator and only one
period is ever worked out; a block's slot follows from its number.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.let import let

from .common import numbered, placed_in_groups, shuffle_partitions, written

BLOCK_DOCS = 16
#: Without weights the largest source counts as so many, another as the square root of its share of that.
LARGEST = 100
MOST_SLOTS = 100_000
STRETCH = 256
_DENOMINATOR = 1_000_000


def _ratio(weight: float | Decimal | Fraction) -> Fraction:
    """A weight as a ratio: a float is the ratio of small whole numbers that it was worked out from, if there is one, else the decimal that it prints as."""
    if not isinstance(weight, float):
        return Fraction(weight)
    near = Fraction(weight).limit_denominator(_DENOMINATOR)
    return near if math.isclose(float(near), weight, rel_tol=1e-14) else Fraction(repr(weight))


def whole_weights(weights: dict[str, float | Decimal | Fraction], most: int = MOST_SLOTS) -> dict[str, int]:
    """Whole numbers in the ratio of ``weights``, those of zero left out.

    If they add up to more than ``most``, they are rounded to that sum by largest remainders (at least one each): the mix then stays within one block of the rounded weights, and moves
    away from those given by at most one block in ``most`` slots.
    """
    ratios = {s: _ratio(w) for s, w in sorted(weights.items()) if w > 0}
    scale = math.lcm(*(r.denominator for r in ratios.values())) if ratios else 1
    whole = {s: int(r * scale) for s, r in ratios.items()}
    common = math.gcd(*whole.values()) or 1
    whole = {s: n // common for s, n in whole.items()}
    total = sum(whole.values())
    if total <= most:
        return whole
    left = most - sum(n * most // total for n in whole.values())
    up = sorted(whole, key=lambda s: -(whole[s] * most % total))[:left]
    return {s: max(1, n * most // total + (s in up)) for s, n in whole.items()}


def source_quotas(counts: DataFrame, weights: dict[str, float | Decimal | Fraction] | None) -> DataFrame:
    """``source``, ``n``, ``quota``: slots of each source in a period. Its target weight is its quota's share of all of them.

    Without ``weights`` the largest source has ``LARGEST`` and another ``LARGEST`` times the square root of its share of the largest, rounded down, at least one. A source that ``weights`` gives
    zero, or does not name, has none.
    """
    if weights is None:
        every = Window.partitionBy(F.lit(0))  # a row for each source
        quota = F.greatest(F.floor(LARGEST * F.sqrt(F.col("n") / F.max("n").over(every))), F.lit(1))
    else:
        whole = whole_weights(weights)
        quota = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in whole.items() for x in kv)), F.col("source")), F.lit(0)) if whole else F.lit(0)
    return counts.select("source", "n", quota.cast("long").alias("quota"))


def _window(quota: Column, had: Column, i: Column, length: Column) -> Column:
    """A source's next block: its deadline, the source, its release, and how many blocks the source has had."""
    due, release = F.ceil((had + 1) * length / quota), F.floor(had * length / quota)
    return F.struct(due.cast("long").alias("due"), i.cast("int").alias("i"), release.cast("long").alias("release"), had.alias("had"), quota.alias("quota"))


def _one_period(quotas: Column, length: Column) -> Column:
    """Earliest deadline first over one period: the index of the source in each slot. It goes on in stretches, so that a long order is not copied for each slot."""
    empty = F.expr("cast(array() as array<int>)")

    def step(state: Column, t: Column) -> Column:
        waiting = state["next"]
        soonest = F.array_min(F.filter(waiting, lambda x: x["release"] <= t))
        taken = lambda x: F.concat(F.slice(waiting, 1, x["i"]), F.array(_window(x["quota"], x["had"] + 1, x["i"], length)), F.slice(waiting, x["i"] + 2, F.size(waiting)))
        return let(soonest, lambda x: F.struct(taken(x).alias("next"), F.array_append(state["order"], x["i"]).alias("order")))

    def stretch(state: Column, at: Column) -> Column:
        slots = F.sequence(at, F.least(at + F.lit(STRETCH), length) - 1)
        after = F.aggregate(slots, F.struct(state["next"].alias("next"), empty.alias("order")), step)
        return let(after, lambda x: F.struct(x["next"].alias("next"), F.array_append(state["orders"], x["order"]).alias("orders")))

    first = F.transform(quotas, lambda q, i: _window(q, F.lit(0).cast("long"), i, length))
    start = F.struct(first.alias("next"), F.expr("cast(array() as array<array<int>>)").alias("orders"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), length - 1, F.lit(STRETCH).cast("long")), start, stretch, lambda s: F.flatten(s["orders"]))


def schedule(quotas: DataFrame) -> DataFrame:
    """One period: ``source``, ``k`` (its how many-th block, from 0), ``slot0``, ``quota``, ``length``."""
    row = quotas.where("quota > 0").agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("s")).where(F.size("s") > 0)
    row = row.withColumn("quotas", F.transform("s", lambda x: x["quota"])).withColumn("length", F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x))
    # written, as the optimizer would work the order out again wherever it is used
    period = written(row.select("s", "length", _one_period(F.col("quotas"), F.col("length")).alias("order")), "period")
    slots = period.select("s", "length", F.posexplode("order").alias("slot0", "i"))
    mine = slots.select(F.get("s", F.col("i")).alias("x"), "length", "slot0").select("x.source", "x.quota", "length", "slot0")
    return mine.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("slot0")) - 1)


def _plan(docs: DataFrame, number: str, weights: dict | None, block_docs: int) -> DataFrame:
    """The plan of ``docs``, rows told apart by the column ``number``."""
    rows = docs.select(number, "doc_id", F.coalesce("source", F.lit("")).alias("source"))
    counts = written(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "sources")
    table = written(schedule(source_quotas(counts, weights)), "schedule")
    key = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    ranked = placed_in_groups(rows.withColumn("_key", key), "source", ["_key", "doc_id", number]).withColumnRenamed("pos", "_i")
    blocks = ranked.withColumn("block", F.floor(F.col("_i") / block_docs)).withColumn("pos", (F.col("_i") % block_docs).cast("int"))
    # a period has at most MOST_SLOTS rows and one for each source, whatever the documents
    blocks = blocks.join(F.broadcast(table.select("source", "quota", "length").distinct()), "source", "left").withColumn("k", (F.col("block") % F.col("quota")).cast("int"))
    blocks = blocks.join(F.broadcast(table.select("source", "k", "slot0")), ["source", "k"], "left")
    return blocks.select(
        number,
        "doc_id",
        "source",
        "block",
        "pos",
        F.expr("block div quota * length + slot0").alias("slot"),
        F.expr("block * length div quota").alias("release"),
        F.expr("((block + 1) * length + quota - 1) div quota").alias("due"),
    )


def mix_plan(docs: DataFrame, weights: dict[str, float | Decimal | Fraction] | None = None, *, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per input row: ``doc_id``, ``source``, ``block`` (from 0), ``pos`` in it, ``slot``, ``release``, ``due``.

    Within a source documents go by the MD5 of their id. Rows that share an id keep separate places. A null source is the source ``''``, a null
    id comes first. Every row is placed: once a source is used up, the others go on in their order. Rows of a source of weight zero have blocks, but no slot.
    Only ``doc_id`` and ``source`` are read. An empty table gives an empty result.
    """
    rows, number = numbered(docs)
    return _plan(rows, number, weights, block_docs).drop(number)


def placed(docs: DataFrame, weights: dict[str, float | Decimal | Fraction] | None = None, *, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows of ``docs`` with their ``slot`` and ``pos`` in the mix, each row its own place. Columns of these names in ``docs`` are left out."""
    rows, number = numbered(docs.drop("slot", "pos"))
    plan = written(_plan(rows, number, weights, block_docs).select(number, "slot", "pos"), "plan")
    return written(rows.join(plan, number).drop(number), "placed")  # what follows reads it more than once


def mixed(docs: DataFrame, weights: dict[str, float | Decimal | Fraction] | None = None, *, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows of ``docs``, all columns unchanged, in the order of the mix; rows without a slot come last."""
    rows, number = numbered(docs)
    n = shuffle_partitions(docs.sparkSession)
    place = F.struct(F.col("slot").isNull().alias("without"), "slot", "pos", number).alias("_place")
    # the plan is cut into ranges, not the texts: these are joined and dealt once
    ranges = _plan(rows, number, weights, block_docs).select(number, place).repartitionByRange(n, "_place")
    plan = written(ranges.withColumn("_range", F.spark_partition_id()), "plan")
    dealt = rows.join(plan, number).repartitionById(n, plan["_range"]).sortWithinPartitions(plan["_place"])
    return dealt.select(*(rows[c] for c in docs.columns))
