"""Source divergence audit by joint count histograms.

For every pair of groups of a language the kept terms are tallied by their two counts, terms that one or both groups lack included. A measure that
depends on the two counts alone is then worked out once for each combination and multiplied by the number of terms that have it. Terms that both groups
have come from one join by term; cells with a zero follow from each group's own histogram less what the pair has in common.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import null_text_as_empty, sliced, tidy, written

MIN_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: A task hands on its counts once it holds so many terms.
HELD_TERMS = 200_000

# A-Z in lower case, other letters and all bytes above 0x7F as they are, anything else a space
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
COUNTED = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, lower-cased."""
    return text.translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, for the rows of one task, in parts of bounded size."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            columns = [[lang] * len(terms), [source] * len(terms), [t.decode() for t in terms], list(n.values()), [docs[t] for t in terms]]
            for at in range(0, len(terms), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000], f.type) for c, f in zip(columns, _COUNTED, strict=True)], schema=_COUNTED)
        counts.clear()

    for part in sliced(batches, 2):
        for lang, source, text in zip(*(c.to_pylist() for c in (part.column(0), part.column(1), part.column(2).cast(pa.binary()))), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            mine = Counter(terms_of(text))
            before = len(n)
            n.update(mine)
            docs.update(mine.keys())
            held += len(n) - before
        if held > HELD_TERMS:
            yield from out()
            held = 0
    yield from out()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences, at least one), ``lang_n`` (those of the whole language) of the terms in at least
    ``min_docs`` documents of their language. One shuffle: all parts of a term meet by language and term."""
    by_task = docs.select("lang", "source", "text").mapInArrow(tidy(_count), COUNTED)
    cells = by_task.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row for each source
    kept = cells.withColumn("lang_docs", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term)).where(F.col("lang_docs") >= min_docs)
    return kept.select("lang", "source", "term", "n", "lang_n")


def share(count: Column, total: Column, terms: Column, prior: int = PRIOR) -> Column:
    """``1 + floor(SCALE * (count + prior) / (total + prior * terms))`` in whole numbers."""
    whole = lambda c: c.cast("decimal(19,0)")
    over, under = F.lit(SCALE).cast("decimal(10,0)") * (whole(count) + prior), whole(total) + F.lit(prior).cast("decimal(3,0)") * whole(terms)
    return F.lit(1) + ((over - over % under) / under).cast("long")


def joint_histogram(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """How many kept terms have each pair of counts: ``lang``, ``a``, ``b`` (``a`` before ``b``), ``count_a``, ``count_b``, ``terms``.

    ``cells`` has ``lang``, ``source``, ``term``, ``n``; ``groups`` has ``lang``, ``source``, ``kept`` (terms of the language). Counts of zero are
    included, so the terms of a pair add up to the language's; a pair of a language without kept terms has no rows.
    """
    side = lambda name: cells.select("lang", "term", F.col("source").alias(name), F.col("n").alias(f"count_{name}"))
    key = ["lang", "a", "b", "count_a", "count_b"]
    both = side("a").join(side("b"), ["lang", "term"]).where(F.col("a") < F.col("b")).groupBy(*key).agg(F.count(F.lit(1)).alias("terms"))
    both = written(both, "joint")
    pairs = groups.select("lang", F.col("source").alias("a"), "kept").join(groups.select("lang", F.col("source").alias("b")), "lang").where(F.col("a") < F.col("b"))
    own = written(cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")), "own")
    mine = lambda name: own.select("lang", F.col("source").alias(name), F.col("n").alias(f"count_{name}"), "terms")
    none = F.lit(0).cast("long")
    parts = [
        # what a group has on its own, whatever the other has, less what both have
        pairs.drop("kept").join(mine("a"), ["lang", "a"]).withColumn("count_b", none),
        pairs.drop("kept").join(mine("b"), ["lang", "b"]).withColumn("count_a", none),
        both.withColumn("count_b", none).withColumn("terms", -F.col("terms")),
        both.withColumn("count_a", none).withColumn("terms", -F.col("terms")),
    ]
    zero = parts[0].select(*key, "terms")
    for part in parts[1:]:
        zero = zero.unionByName(part.select(*key, "terms"))
    some = both.unionByName(zero).groupBy(*key).agg(F.sum("terms").alias("terms")).where("terms > 0")
    some = written(some, "some")
    seen = some.groupBy("lang", "a", "b").agg(F.sum("terms").alias("seen"))
    neither = pairs.join(seen, ["lang", "a", "b"], "left").select("lang", "a", "b", none.alias("count_a"), none.alias("count_b"), (F.col("kept") - F.coalesce("seen", none)).alias("terms"))
    return some.unionByName(neither.where("terms > 0"))


def divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """How far the sources of each language differ in their words, and in which.

    Part ``pair`` has a row for each ordered pair of a language's sources, part ``term`` the ``top`` terms that a source uses more than its language as a whole. Returns
    ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``. Null text, lang and source are empty texts. A source without terms is a group as any other; a language without
    kept terms has pairs of value 0. Equal values go by the UTF-8 bytes of the item. Only ``text``, ``lang`` and ``source`` are read. An empty table gives an empty result.
    """
    rows = docs.select("text", "lang", "source")
    for column in rows.columns:
        rows = null_text_as_empty(rows, column)
    cells = written(term_counts(rows, min_docs), "cells")
    lang_size = cells.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(lang_size, "lang", "left")
    groups = written(groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total"))), "groups")

    total = lambda name: groups.select("lang", F.col("source").alias(name), F.col("total").alias(f"total_{name}"))
    tally = joint_histogram(cells, groups).join(total("a"), ["lang", "a"]).join(total("b"), ["lang", "b"]).join(lang_size.select("lang", "kept"), "lang")
    apart = F.abs(share(F.col("count_a"), F.col("total_a"), F.col("kept")) - share(F.col("count_b"), F.col("total_b"), F.col("kept")))
    summed = tally.groupBy("lang", "a", "b").agg(F.sum(apart * F.col("terms")).alias("value"))
    ordered = summed.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item"))
    pairs = others.join(ordered, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))

    shares = cells.join(groups, ["lang", "source"]).withColumn("value", share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
    terms = shares.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
