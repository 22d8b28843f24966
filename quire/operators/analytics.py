"""Catalogue analytics: co-occurrence, networks, chains, geography, movement, facets, quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task of ``co_occurrence`` holds about, memberships or pairs.
ROWS_OF_A_TASK = 500_000
#: Parts that boxes are dealt in, for each task: several, so that tasks are of like size.
PARTS_OF_A_TASK = 32


def co_occurrence(members: DataFrame, *, box: str, item: str, top: int = 1000, rows_of_a_task: int = ROWS_OF_A_TASK) -> DataFrame:
    """Unordered pairs of items in the same box with the number of boxes, the ``top`` most frequent, ties by items.

    The result is a top list. Memberships count once. A box is one row of its items, which are one manuscript's works, and its pairs are spelled out from
    there, so the work grows with the squares of the boxes' sizes. Boxes and pairs are dealt to as many tasks as their numbers ask for, so a task's memory
    does not grow with the tables; a pair of very many boxes is summed within tasks first.
    """
    m = members.select(F.col(box).alias("b"), F.col(item).alias("i")).dropna()

    def boxes(tasks: int) -> DataFrame:
        part = F.pmod(F.hash("b"), F.lit(PARTS_OF_A_TASK * tasks))
        return m.withColumn("part", part).repartition(tasks, "part").groupBy("part", "b").agg(F.collect_set("i").alias("items"))

    tasks = _tasks(m, m.count(), rows_of_a_task)
    size = F.size("items").cast("double")
    n_pairs = boxes(tasks).agg(F.sum(size * (size - 1) / 2)).first()[0] or 0
    tasks = max(tasks, _tasks(m, n_pairs, rows_of_a_task))
    ordered = boxes(tasks).select("part", F.array_sort("items").alias("items"))
    firsts = ordered.select("part", "items", F.posexplode("items").alias("at", "a"))
    pairs = firsts.select("part", F.col("a").alias("item_a"), F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("item_b"))
    within = pairs.groupBy("part", "item_a", "item_b").agg(F.count(F.lit(1)).alias("n"))
    dealt = within.select("item_a", "item_b", "n").repartition(tasks, "item_a", "item_b")
    return dealt.groupBy("item_a", "item_b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "item_a", "item_b").limit(top)


def _tasks(df: DataFrame, rows: float, rows_of_a_task: int) -> int:
    """Tasks that ``rows`` are dealt to: those of the session's shuffles, fewer for few rows, and more where these would hold too many."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(rows / rows_of_a_task), min(usual, math.ceil(10 * rows / rows_of_a_task)))


def edge_degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Degree of each end over the given edges."""
    return edges.select(F.explode(F.array(a, b)).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("degree"))


def main_roles(rows: DataFrame, priority: dict[str, int], *, person: str, box: str, role: str) -> DataFrame:
    """Persons with their most important role (ties by name) and how many boxes they have."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in priority.items() for x in kv)), F.col(role)), F.lit(0))
    order = F.struct(-rank, F.col(role))
    return rows.groupBy(person).agg(F.min_by(role, order).alias("role"), F.count_distinct(box).alias("n_boxes"))


def chains(rows: DataFrame, *, box: str, member: str, order: Column) -> DataFrame:
    """Ordered distinct members of each box, as text, and how many; the first place of a repeated member counts."""
    first = rows.groupBy(box, member).agg(F.min(order).alias("o"))
    listed = first.groupBy(box).agg(F.array_sort(F.collect_list(F.struct("o", F.col(member).alias("m")))).alias("c"))
    return listed.select(box, F.array_join(F.transform("c", lambda x: x["m"].cast("string")), ">").alias("chain"), F.size("c").alias("length"))


def places(rows: DataFrame, *, place: str, box: str, kind: str) -> DataFrame:
    """Distinct boxes of each place and its kinds: ``both`` where different boxes give it more than one. A box gives a place
    one kind, the first by name."""
    once = rows.groupBy(place, box).agg(F.min(kind).alias("k"))
    return once.groupBy(place).agg(F.count(F.lit(1)).alias("weight"), F.when(F.min("k") != F.max("k"), "both").otherwise(F.min("k")).alias("kind"))


def histogram(rows: DataFrame, year: Column) -> DataFrame:
    return rows.groupBy(year.cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n")).where("year is not null")


def century(year: Column) -> Column:
    return (F.floor((year - 1) / 100) + 1).cast("int")


def quarter_century(year: Column) -> Column:
    return (F.floor(year / 25) * 25).cast("int")


def facet_counts(rows: DataFrame, facets: list[str]) -> DataFrame:
    """Counts of the values of several columns in one pass; null is ``(none)``."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("value")) for c in facets))).alias("x")
    return rows.select(each).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


def property_usage(triples: DataFrame, top: int = 30) -> DataFrame:
    """How often each property is used, and how often with a resource as its value; the ``top`` most used."""
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_kind") == "uri").alias("n_links")).orderBy(F.desc("n"), "p").limit(top)


def worst_state(states: DataFrame, *, key: str, rule: str = "rule", state: str = "state") -> DataFrame:
    """Worst state of each entity, how many rules passed, and which failed. Severity: fail, error, pass, not_relevant."""
    rank = F.when(F.col(state) == "fail", 3).when(F.col(state) == "error", 2).when(F.col(state) == "pass", 1).otherwise(0)
    return states.groupBy(key).agg(
        F.max_by(state, rank).alias("worst"),
        F.count_if(F.col(state) == "pass").alias("n_pass"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col(state) == "fail", F.col(rule)))), ",").alias("failing"),
    )


def calibrate(rows: DataFrame, *, target: float = 0.9, lo: int = 85, hi: int = 99) -> DataFrame:
    """Smallest confidence threshold (in hundredths from ``lo`` to ``hi``) at which a bucket's precision reaches the target;
    the one of highest precision where none does, the smallest of those.

    ``rows``: ``bucket``, ``confidence``, ``full`` (the verdict), ``error``. Rows with an error do not count; without rows above any threshold the floor stays.
    """
    clean = rows.where("error is null").select("bucket", "confidence", "full")
    sums = clean.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_total"),
        *(F.count_if(F.col("confidence") >= t / 100).alias(f"n{t}") for t in range(lo, hi + 1)),
        *(F.count_if((F.col("confidence") >= t / 100) & F.col("full")).alias(f"f{t}") for t in range(lo, hi + 1)),
    )
    steps = F.array(*(F.struct(F.lit(t / 100).alias("threshold"), (F.col(f"f{t}") / F.nullif(F.col(f"n{t}"), F.lit(0))).alias("precision"), F.col(f"n{t}").alias("n")) for t in range(lo, hi + 1)))
    some = F.filter(steps, lambda x: x["n"] > 0)
    good = F.filter(some, lambda x: x["precision"] >= target)
    peak = F.array_max(F.transform(some, lambda x: x["precision"]))
    best = F.coalesce(F.get(good, F.lit(0)), F.get(F.filter(some, lambda x: x["precision"] == peak), F.lit(0)))
    floor = F.struct(F.lit(lo / 100).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0).cast("long").alias("n"))
    x = F.coalesce(best, floor)
    return sums.select("bucket", "n_total", x["threshold"].alias("threshold"), F.round(x["precision"], 6).alias("precision"), x["n"].alias("n_above"), (F.size(good) > 0).alias("target_reached"))


def run_diff(old: DataFrame, new: DataFrame, *, key: str = "bucket", metric: str = "precision", epsilon: float = 0.001) -> DataFrame:
    """Metrics of two runs side by side: new, gone, regressed, improved or stable."""
    o, n = old.select(key, F.col(metric).alias("before")), new.select(key, F.col(metric).alias("after"))
    delta = F.col("after") - F.col("before")
    verdict = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(delta < -epsilon, "regressed").when(delta > epsilon, "improved").otherwise("stable")
    return o.join(n, key, "full_outer").select(key, "before", "after", verdict.alias("verdict"))


def stops_to_edges(stops: DataFrame, *, box: str, order: list[str], place: str) -> DataFrame:
    """Edges between neighbouring stops of each box that have a place."""
    w = Window.partitionBy(box).orderBy(*order)
    return stops.where(F.col(place).isNotNull()).withColumn("to", F.lead(place).over(w)).withColumn("ord", F.row_number().over(w)).where("to is not null").select(box, "ord", F.col(place).alias("from"), "to")


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows in which each column has a value, in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").alias("has")) for c in columns))).alias("x")
    return rows.select(each).groupBy("x.field").agg(F.count(F.lit(1)).alias("n"), F.count_if("x.has").alias("n_with"), F.round(F.avg(F.col("x.has").cast("int")), 6).alias("share"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of the rows as a set of lines, independent of their order: a sum of line hashes, and the count."""
    line = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).cast("binary"))
    part = F.conv(F.substring(line, 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("string").alias("digest"))
