"""Matching names against authority tables: exact, containment and trigram tiers that abstain on doubt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import dates, text

TIE = 15
FUZZY = 0.45


def exact_candidates(queries: DataFrame, index: DataFrame, *, limit: int = 8) -> DataFrame:
    """Authorities whose key equals a query's key, main tag 100 before 400 before others, dated first, then by id; ``limit`` at most.

    Their order does not depend on the query, so the first of each key are found before the queries are joined.
    """
    rank = F.when(F.col("tag") == "100", 0).when(F.col("tag") == "400", 1).otherwise(2)
    order = Window.partitionBy("key").orderBy(rank, F.col("dates").isNull(), "id")
    return queries.join(index.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit), "key")


def trigram_pairs(left: DataFrame, right: DataFrame, *, threshold: float = FUZZY) -> DataFrame:
    """``left_id``, ``right_id``, ``similarity`` of texts (``id``, ``text``) whose trigram sets are at least that similar.

    Similarity is shared over all distinct trigrams. A set can only reach the threshold with another if they share one of its rarest trigrams,
    so only those are joined on (prefix filter), and pairs of too different sizes are left out before the exact comparison.
    """
    sets = lambda df, side: df.select(F.col("id").alias(f"{side}_id"), text.trigrams(F.col("text")).alias(f"{side}_grams")).where(F.size(f"{side}_grams") > 0)
    a, b = sets(left, "left"), sets(right, "right")
    df = a.select(F.explode("left_grams").alias("g")).union(b.select(F.explode("right_grams").alias("g"))).groupBy("g").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(rows: DataFrame, side: str) -> DataFrame:
        grams = rows.select(f"{side}_id", F.size(f"{side}_grams").alias("n"), F.explode(f"{side}_grams").alias("g")).join(df, "g")
        by_rarity = Window.partitionBy(f"{side}_id").orderBy("df", "g")
        need = F.col("n") - F.ceil(F.col("n") * threshold) + 1
        return grams.withColumn("place", F.row_number().over(by_rarity)).where(F.col("place") <= need).select(f"{side}_id", F.col("n").alias(f"{side}_n"), "g")

    near = (F.col("left_n") >= F.ceil(F.col("right_n") * threshold)) & (F.col("right_n") >= F.ceil(F.col("left_n") * threshold))
    pairs = prefixes(a, "left").join(prefixes(b, "right"), "g").where(near).select("left_id", "right_id").distinct()
    shared = F.size(F.array_intersect("left_grams", "right_grams"))
    similarity = shared / (F.size("left_grams") + F.size("right_grams") - shared)
    return pairs.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def cascade(queries: DataFrame, names: DataFrame, *, threshold: float = FUZZY) -> DataFrame:
    """Best name for each query (``id``, ``text``): an equal key, else the shortest that contains it or is contained,
    else the most similar by trigrams. Ties go to the smaller id. Queries without any match are left out.

    Containment is that of characters, also within words. It is found through the shorter key's rarest three characters, which
    are in the longer key too; a key of one or two characters is looked up whole. An empty key contains nothing and is in none.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("text").alias("query"), text.plain_key(F.col("text")).alias("key"))
    n = names.select(F.col("id").alias("name_id"), F.col("text").alias("name"), text.plain_key(F.col("text")).alias("key"))
    equal = q.join(n, "key").select("query_id", "name_id", F.lit(0).alias("tier"), F.length("name").alias("length"), F.lit(1.0).alias("similarity"))
    left = q.join(equal, "query_id", "left_anti")
    grams = lambda size: F.when(F.length("key") >= size, F.transform(F.sequence(F.lit(1), F.length("key") - size + 1), lambda i: F.substring(F.col("key"), i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    pieces = F.array_distinct(F.concat(grams(1), grams(2), grams(3)))
    counts = n.select(F.explode(F.array_distinct(grams(3))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def rare(df: DataFrame, k: str) -> DataFrame:
        long = df.select(k, "key", F.explode(grams(3)).alias("w")).join(counts, "w").groupBy(k, "key").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
        return long.union(df.where(F.length("key").between(1, 2)).select(k, "key", F.col("key").alias("w")))

    every = lambda df, k: df.select(k, F.col("key").alias("longer"), F.explode(pieces).alias("w"))
    inside = rare(left, "query_id").join(every(n, "name_id"), "w").where(F.contains("longer", "key"))
    around = rare(n, "name_id").join(every(left, "query_id"), "w").where(F.contains("longer", "key"))
    held = inside.select("query_id", "name_id").union(around.select("query_id", "name_id")).distinct()
    contained = held.join(n.select("name_id", "name"), "name_id").select("query_id", "name_id", F.lit(1).alias("tier"), F.length("name").alias("length"), F.lit(1.0).alias("similarity"))
    rest = left.join(contained, "query_id", "left_anti")
    fuzzy = trigram_pairs(rest.select(F.col("query_id").alias("id"), F.col("query").alias("text")), n.select(F.col("name_id").alias("id"), F.col("name").alias("text")), threshold=threshold)
    similar = fuzzy.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("name_id"), F.lit(2).alias("tier"), F.lit(0).alias("length"), "similarity")
    best = Window.partitionBy("query_id").orderBy("tier", "length", F.desc("similarity"), "name_id")
    return equal.union(contained).union(similar).withColumn("place", F.row_number().over(best)).where("place = 1").drop("place", "length")


def homonym_score(tag: Column, dated: Column, overlaps: Column, plausible: Column, fuzzy: Column) -> Column:
    """Score of an authority for a name: its tag, its dates against the record's, the manuscript's year, a fuzzy match.

    A candidate without dates counts as overlapping where the record has dates.
    """
    by_tag = F.when(tag == "100", 100).when(tag.isin("150", "450"), -40).otherwise(0)
    return by_tag + F.when(dated & overlaps, 50).otherwise(0) + F.when(plausible, 20).otherwise(0) - F.when(fuzzy, 30).otherwise(0)


def pick_homonym(candidates: DataFrame, *, key: str = "query_id") -> DataFrame:
    """One row per query: ``winner`` or ``abstain`` with a ``reason``, from rows with ``id``, ``tag``, ``dates``, ``record_dates``, ``year``, ``role``, ``fuzzy``.

    Abstains when the best two are within ``TIE`` points of each other and neither overlaps in dates.
    """
    candidates = candidates.withColumn("_a", dates.person_dates(F.col("record_dates"))).withColumn("_b", dates.person_dates(F.col("dates")))
    a, b = F.col("_a"), F.col("_b")
    lo = lambda d: F.coalesce(d["birth_year"], d["active_year"])
    hi = lambda d: F.coalesce(d["death_year"], d["active_year"])
    dated = lo(a).isNotNull() | hi(a).isNotNull()
    overlaps = dated & dates.overlap(lo(a), hi(a), lo(b), hi(b))
    plausible = F.col("year").isNotNull() & dates.date_conflict(F.col("role"), F.col("year"), lo(b), hi(b)).isNull()
    scored = candidates.withColumn("overlap", overlaps).withColumn("score", homonym_score(F.col("tag"), dated, F.col("overlap"), plausible, F.col("fuzzy")))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    top = scored.withColumn("place", F.row_number().over(order)).where("place <= 2").groupBy(key).agg(
        F.max(F.when(F.col("place") == 1, F.struct("id", "score", "overlap"))).alias("one"), F.max(F.when(F.col("place") == 2, F.struct("id", "score", "overlap"))).alias("two")
    )
    tie = F.coalesce((F.col("one.score") - F.col("two.score") <= TIE) & ~F.col("one.overlap") & ~F.col("two.overlap"), F.lit(False))
    return top.select(key, F.when(~tie, F.col("one.id")).alias("winner"), tie.alias("abstain"), F.when(tie, "tie").otherwise("").alias("reason"), F.col("one.score").alias("score"))


def unique_or_abstain(candidates: DataFrame, *, key: str = "query_id", value: str = "qid", exact: str = "exact") -> DataFrame:
    """The one value that all of a query's candidates have, else the one value of its exact candidates, else an abstention."""
    c = candidates.groupBy(key).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.min(F.when(F.col(exact), F.col(value))).alias("elo"), F.max(F.when(F.col(exact), F.col(value))).alias("ehi"),
    )
    pick = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("elo") == F.col("ehi"), F.col("elo"))
    return c.select(key, pick.alias("picked"), pick.isNull().alias("abstain"))


def ground(candidates: DataFrame, fields: DataFrame, *, key: str = "record_id") -> DataFrame:
    """How a candidate's text stands to the fields of its record: ``unknown`` (no fields), ``grounded`` in a field of its own
    kind, ``wrong_field``, or ``novel``; with the fields that hold it. Containment either way, in any case and punctuation."""
    c = candidates.withColumn("_k", text.plain_key(F.col("text")))
    f = fields.select(key, F.col("field"), text.plain_key(F.col("value")).alias("_v")).where("_v <> ''")
    known = f.select(key).distinct().withColumn("_known", F.lit(True))
    hit = c.join(f, key).where((F.col("_k") != "") & (F.contains("_v", "_k") | F.contains("_k", "_v"))).groupBy(key, "candidate_id").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    status = F.when(F.col("_known").isNull(), "unknown").when(F.col("fields").isNull(), "novel").when(F.array_contains("fields", F.col("kind")), "grounded").otherwise("wrong_field")
    return c.join(known, key, "left").join(hit, [key, "candidate_id"], "left").select(key, "candidate_id", status.alias("status"), "fields")
