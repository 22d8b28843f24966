"""Items, statements, probes and verdicts: filters, keys, orders and merges on tables of built entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text

# fixed values: the order in which kinds of items go up, and states of a duplicate check that say nothing
UPLOAD_ORDER = ("work", "person", "manuscript")
NOT_RUN = "not_run"
RANKS = ("preferred", "normal")


def clean(c: Column) -> Column:
    """Text without spaces at its ends; null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


# facts and statements


def indexed_facts(statements: DataFrame, names: DataFrame) -> DataFrame:
    """``id, property, value`` of what can be searched: statements (``id, property, rank, snaktype, value``) of normal or preferred rank that have a value, and
    names (``id, name``) in lower case without spaces under ``@name``."""
    live = statements.where(F.col("rank").isin(*RANKS) & (F.col("snaktype") == "value") & F.col("value").isNotNull())
    named = names.where(clean(F.col("name")).isNotNull()).select("id", F.lit("@name").alias("property"), F.lower(F.regexp_replace("name", r"\s+", "")).alias("value"))
    return live.select("id", "property", "value").unionByName(named).distinct()


def statement_values(statements: Column, pid: str) -> Column:
    """Distinct values of one property of an array of statements, in their order."""
    return F.array_distinct(F.transform(F.filter(statements, lambda x: (x["property"] == pid) & x["value"].isNotNull()), lambda x: x["value"]))


def resolve_references(statements: DataFrame, items: DataFrame) -> DataFrame:
    """Statements with ``target``: the item that their ``title`` names, first in the same record, else anywhere. A title of several items there names none."""
    unique = lambda by: items.groupBy(*by).agg(F.min("id").alias("_id"), F.count_distinct("id").alias("_n"))
    near = unique(["record", "title"]).withColumnsRenamed({"_id": "_near", "_n": "_n_near"})
    far = unique(["title"]).withColumnsRenamed({"_id": "_far", "_n": "_n_far"})
    joined = statements.join(near, ["record", "title"], "left").join(far, "title", "left")
    found = F.when(F.col("_n_near") == 1, F.col("_near")).when(F.col("_n_near").isNull() & (F.col("_n_far") == 1), F.col("_far"))
    return joined.select(*statements.columns, found.alias("target"))


def supported_claims(claims: DataFrame, targets: DataFrame) -> DataFrame:
    """Claims (``target``) whose target is an item that exists; those without a target stay."""
    known = targets.select(F.col("id").alias("target"), F.lit(True).alias("_known")).distinct()
    return claims.join(known, "target", "left").where(F.col("target").isNull() | F.col("_known")).select(*claims.columns)


def merge_references(references: DataFrame) -> DataFrame:
    """One reference of each citation of a statement (``statement, citation, ord, retrieved``): at its first place, with its last day of retrieval."""
    return references.groupBy("statement", "citation").agg(F.min("ord").alias("ord"), F.max("retrieved").alias("retrieved"))


# duplicates and probes


def duplicate_status(*surfaces: Column) -> Column:
    """The first status that says something, most direct surface first."""
    return F.coalesce(*(F.when(s != NOT_RUN, s) for s in surfaces), F.lit(NOT_RUN))


def fair_order(keys: DataFrame, kind: str, key: str) -> DataFrame:
    """Keys with ``turn`` and ``kind``, to be taken in this order: the first of each kind, then the second of each, so that no kind is always last. Turns are
    places in a sort of all keys less the first of the kind, so a kind of any size is in many tasks."""
    from quire.sources.shared import written

    from .paging import ordinals

    at = F.struct(F.col(kind).alias("a"), F.col(key).alias("b"))
    placed = written(ordinals(keys.select(at.alias("_at"), F.struct(*keys.columns).alias("_row")), "_at"), "turns")
    firsts = placed.groupBy(F.col("_at.a").alias("_kind")).agg(F.min("ordinal").alias("_first"))
    turned = placed.join(firsts, F.col("_at.a").eqNullSafe(F.col("_kind")))
    return turned.select("_row.*", (F.col("ordinal") - F.col("_first") + 1).cast("int").alias("turn"))


def attribute_hits(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Which pair (``pair, pid_a, value_a, pid_b, value_b``) each hit satisfies: ``pair, id`` of the entities that have both facts."""
    first = pairs.join(facts.select(F.col("property").alias("pid_a"), F.col("value").alias("value_a"), "id"), ["pid_a", "value_a"])
    second = facts.select(F.col("property").alias("pid_b"), F.col("value").alias("value_b"), "id")
    return first.join(second, ["pid_b", "value_b", "id"], "left_semi").select("pair", "id").distinct()


def adoptable(hits: DataFrame, items: DataFrame) -> DataFrame:
    """``item, qid`` of items that one entity alone matches by identifier, that no other item adopts, and that have no id or the same one."""
    one = hits.select("item", "qid").distinct().withColumn("_of_item", F.count("qid").over(Window.partitionBy("item"))).withColumn("_of_qid", F.count("item").over(Window.partitionBy("qid")))
    safe = one.where("_of_item = 1 and _of_qid = 1").join(items.select("item", F.col("qid").alias("_own")), "item")
    return safe.where(F.col("_own").isNull() | (F.col("_own") == F.col("qid"))).select("item", "qid")


def over_merged(clusters: DataFrame) -> DataFrame:
    """Clusters (``cluster, item, birth_year, death_year, occupation``) of several items that disagree in a year of birth or death or an occupation."""
    n = clusters.groupBy("cluster").agg(*(F.count_distinct(c).alias(c) for c in ("item", "birth_year", "death_year", "occupation")))
    return n.where("item > 1 and (birth_year > 1 or death_year > 1 or occupation > 1)").select("cluster")


def pair_collisions(rows: DataFrame) -> DataFrame:
    """Cluster ids that stand with several names and with several authority ids (``cluster, name, authority_id``)."""
    return rows.groupBy("cluster").agg(F.count_distinct("name").alias("names"), F.count_distinct("authority_id").alias("ids")).where("names > 1 and ids > 1")


def single_or_none(values: Column) -> Column:
    """The one distinct value of an array, null for none or several."""
    some = F.array_distinct(F.array_compact(values))
    return F.when(F.size(some) == 1, F.get(some, F.lit(0)))


def in_type(rows: DataFrame, types: DataFrame, subclass: DataFrame, roots: list[str]) -> DataFrame:
    """Rows (``id``) of which a type (``types``: ``id, type``) is one of ``roots`` or below it (``subclass``: ``s, o``)."""
    from .paths import connected, star, step

    above = rows.sparkSession.createDataFrame([(x,) for x in roots], "o string")
    graph = subclass.select("s", F.lit("subclass").alias("p"), "o", F.lit("uri").alias("o_kind"))
    # from the roots down: what is below none of them is never walked
    wanted = connected(graph, star(step("subclass")), ends=above).select(F.col("s").alias("type")).distinct()
    return rows.join(types.join(wanted, "type", "left_semi").select("id").distinct(), "id", "left_semi")


# names


def token_overlap(a: Column, b: Column, particles: tuple[str, ...] = ()) -> Column:
    """Whether two names share two words, or all words of the shorter one; particles do not count."""
    words = lambda c: F.array_except(F.array_remove(F.array_distinct(F.split(F.lower(F.trim(c)), r"[\s,.]+")), ""), F.array(*map(F.lit, particles)).cast("array<string>"))
    shared = F.size(F.array_intersect(words(a), words(b)))
    return F.coalesce((shared > 0) & ((shared >= 2) | (shared == F.least(F.size(words(a)), F.size(words(b))))), F.lit(False))


def typed_lookup(queries: DataFrame, index: DataFrame, kind: str) -> DataFrame:
    """``query, id`` by exact name among entries (``name, kind, tag, id``) of one kind: the smallest tag, then the smallest id."""
    best = index.where(F.col("kind") == kind).groupBy("name").agg(F.min(F.struct("tag", "id")).alias("b"))
    return queries.join(best, "name").select("query", "b.id")


def expand_names(rows: DataFrame, sep: str = "|") -> DataFrame:
    """A row for each name of ``name`` and the role at its place in ``role``; where roles run out, the whole ``role``. Empty names go."""
    cut = lambda c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), f"\\{sep}"), lambda x: F.trim(x))
    each = rows.withColumn("_roles", cut("role")).select(*(c for c in rows.columns if c not in ("name", "role")), F.posexplode(cut("name")).alias("at", "name"), "_roles", F.col("role").alias("_role"))
    return each.where("name <> ''").withColumn("role", F.coalesce(F.get("_roles", F.col("at")), F.col("_role"))).drop("_roles", "_role")


def normal_subjects(subjects: Column) -> Column:
    """Subjects (``term, type, field``) without empty terms: corporate bodies are organizations, geographic names places; the first of those with equal
    term in any case, type and field stays."""
    kind = lambda x: F.when(x["type"] == "corporate", "organization").when(x["type"] == "geographic", "place").otherwise(F.coalesce(x["type"], F.lit("topic")))
    field = lambda k: F.when(k == "person", "600").when(k == "organization", "610").when(k == "place", "651").otherwise("650")
    whole = F.transform(F.filter(subjects, lambda x: clean(x["term"]).isNotNull()), lambda x: F.struct(F.trim(x["term"]).alias("term"), kind(x).alias("type"), F.coalesce(x["field"], field(kind(x))).alias("field")))
    key = lambda x: F.concat_ws("\x1f", F.lower(x["term"]), x["type"], x["field"])
    return F.filter(whole, lambda x, i: ~F.exists(F.slice(whole, 1, i), lambda y: key(y) == key(x)))


# records


def year_band(dates: Column) -> Column:
    """``certain, earliest, latest`` of dates (``year, date_start, year_start, date_end, year_end`` as text): the bounds fall back on the year."""
    year = lambda k: F.regexp_extract(dates[k], r"^\s*(\d+)(?:[-T].*)?\s*$", 1).try_cast("int")
    return F.struct(year("year").alias("certain"), F.coalesce(year("date_start"), year("year_start"), year("year")).alias("earliest"), F.coalesce(year("date_end"), year("year_end"), year("year")).alias("latest"))


def primary_number(numbers: Column, *identity: Column) -> Column:
    """The number that stands in the first identity field that has any of them, else the first number."""
    inside = lambda f: F.get(F.filter(numbers, lambda n: F.contains(F.coalesce(f, F.lit("")), n)), F.lit(0))
    return F.coalesce(*map(inside, identity), F.get(numbers, F.lit(0)))


def fill_gaps(records: DataFrame, extracted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Records with empty columns filled from ``extracted``; what a record has stays."""
    other = extracted.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = records.join(other, key, "left")
    return joined.select(*(F.coalesce(clean(F.col(c)), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in records.columns))


def fold_genres(genres: Column, predicted: Column) -> Column:
    """A record's genres, or where it has none the predicted ones but ``other``, each once."""
    labels = F.array_distinct(F.filter(predicted, lambda x: clean(x).isNotNull() & (x != "other")))
    return F.when(F.size(F.coalesce(genres, F.array().cast("array<string>"))) > 0, genres).otherwise(labels)


def with_row_ids(rows: DataFrame, number: str, order: str) -> DataFrame:
    """Rows with a control number: their own, else ``row`` and the four or more digits of their place by ``order``."""
    from .paging import ordinals

    placed = ordinals(rows, order)
    return placed.withColumn(number, F.coalesce(clean(F.col(number)), F.concat(F.lit("row"), F.lpad(F.col("ordinal").cast("string"), F.greatest(F.lit(4), F.length(F.col("ordinal").cast("string"))), F.lit("0"))))).drop("ordinal")


def grounded(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Proposed spans (``record, span``) that stand word for word in their record's text (``record, text``)."""
    return spans.join(texts, "record").where((clean(F.col("span")).isNotNull()) & F.contains("text", F.col("span"))).select(*spans.columns)


def rebase(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans (``record, part, text, start, end``) with offsets in the joined text of their record (``record, part, said``; parts joined by one
    character), or those of the first place where their text stands if it is not at that offset. Others go."""
    parts = texts.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("part", "said"))).alias("_p"))  # the parts of one record
    joined = spans.join(parts, "record").withColumn("_whole", F.array_join(F.transform("_p", lambda x: x["said"]), "\n"))
    before = F.aggregate(F.filter("_p", lambda x: x["part"] < F.col("part")), F.lit(0), lambda a, x: a + F.length(x["said"]) + 1)
    here = before + F.col("start")
    right = F.substr("_whole", here + 1, F.length("text")) == F.col("text")
    start = F.when(right, here).otherwise(F.expr("locate(text, _whole)") - 1)
    return joined.withColumn("start", start.cast("int")).where("start >= 0").withColumn("end", (F.col("start") + F.length("text")).cast("int")).drop("_p", "_whole")


def title_index(works: DataFrame) -> DataFrame:
    """``title, id`` of titles that one work alone has."""
    return works.groupBy("title").agg(F.min("id").alias("id"), F.count_distinct("id").alias("_n")).where("_n = 1").drop("_n")


def missing_claims(records: DataFrame, claims: DataFrame) -> DataFrame:
    """What a record names (``record, value``) and no claim of its item (``record, value``) says, by text in any case."""
    key = lambda df: df.withColumn("_k", F.lower(F.trim("value")))
    return key(records).join(key(claims).select("record", "_k").distinct(), ["record", "_k"], "left_anti").select("record", "value")


def identifier_errors(identifiers: DataFrame, shapes: dict[str, str]) -> DataFrame:
    """Identifiers (``item, property, value``) that have not the shape of their property; those of other properties have none to break."""
    table = F.create_map(*(F.lit(x) for kv in shapes.items() for x in kv))
    return identifiers.withColumn("_shape", F.try_element_at(table, F.col("property"))).where(F.col("_shape").isNotNull() & ~F.regexp_like("value", F.col("_shape"))).drop("_shape")


# verdicts and runs


def compact_verdict(results: Column) -> Column:
    """``fail_count, error_count, pass_count`` and ``failing`` rules of an array of results (``rule, state``); null without results."""
    n = lambda s: F.size(F.filter(results, lambda r: r["state"] == s))
    failing = F.transform(F.filter(results, lambda r: r["state"] == "fail"), lambda r: r["rule"])
    return F.when(F.size(results) > 0, F.struct(n("fail").alias("fail_count"), n("error").alias("error_count"), n("pass").alias("pass_count"), failing.alias("failing")))


def merge_fresh(streamed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """All rows of both by key, the stored one where both have it; rows without a key all stay."""
    kept = streamed.join(stored.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return stored.unionByName(kept.select(*stored.columns))


def failure_signs(rows: DataFrame, mark: str = "judge_failure") -> Column:
    """By what signs a verdict (``overall, failed, status, error``) tells that the judge failed, not what it judged; none for a sound one."""
    signs = {"verdict": F.col("overall") == mark, "flag": F.col("failed"), "provider": F.col("status") == "provider_error", "message": clean(F.col("error")).isNotNull()}
    return F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in signs.items())))


#: What leaves a session partial, by name: conditions on its counts and its runner (SQL, null counts as not so).
PARTIAL_REASONS = {
    "scope not covered": "scope > 0 and judged < scope",
    "judge failures": "failures > 0",
    "runner failed": "exit_code <> 0",
    "runner never ended": "uncached > 0 and not saw_exit",
    "no judge": "uncached > 0 and unavailable",
    "error": "trim(error) <> ''",
}


def session_reasons(sessions: DataFrame) -> DataFrame:
    """Sessions (``scope, judged, uncached, unavailable, failures, exit_code, saw_exit, error``) with the ``reasons`` that leave them partial, and their ``outcome``."""
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(F.expr(said), F.lit(False)), F.lit(name)) for name, said in PARTIAL_REASONS.items())))
    told = sessions.withColumn("reasons", reasons)
    return told.withColumn("outcome", F.when(F.size("reasons") > 0, "partial").otherwise("complete"))


def build_signature(rows: DataFrame, key: str, options: str) -> DataFrame:
    """One row: the first 16 hex digits of a digest of the number of rows, their first and last key and the options. Equal signatures may resume."""
    said = F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.min(key), F.max(key), F.lit(options))
    return rows.agg(F.left(F.sha2(said.cast("binary"), 256), F.lit(16)).alias("signature"))


def view_fingerprint(*latest: DataFrame) -> DataFrame:
    """One row: the latest time of each table (its first column), ``-`` for an empty one."""
    tops = [t.agg(F.max(t.columns[0]).alias("t")).select(F.lit(i).alias("i"), F.coalesce(F.date_format("t", "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias("t")) for i, t in enumerate(latest)]
    every = tops[0]
    for t in tops[1:]:
        every = every.union(t)
    return every.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "|").alias("fingerprint"))


def stale(rows: DataFrame, observed: str, now: Column, days: int = 7) -> DataFrame:
    """Rows last observed more than so many days ago, or never."""
    return rows.where(F.col(observed).isNull() | (F.col(observed) < now - F.make_dt_interval(F.lit(days))))


def patch_rows(rows: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows without those that ``new`` replaces by key, and the new ones after the last place of the others, in the order of their keys."""
    from .paging import ordinals

    kept = rows.join(new.select(key).distinct(), key, "left_anti")
    last = kept.agg(F.max(order)).first()[0] or 0
    added = ordinals(new, key).withColumn(order, F.col("ordinal") + last).select(*rows.columns)
    return kept.select(*rows.columns).unionByName(added)


def in_upload_order(items: DataFrame) -> DataFrame:
    """Items with ``turn``: works, then persons, then manuscripts, then the rest, each by ``local_id``; links go only to what is up."""
    from .paging import ordinals

    at = F.coalesce(F.array_position(F.array(*map(F.lit, UPLOAD_ORDER)), F.lower("entity_type")), F.lit(0))
    keyed = items.withColumn("_at", F.struct(F.when(at == 0, 9).otherwise(at).alias("kind"), "local_id"))
    return ordinals(keyed, "_at").withColumnRenamed("ordinal", "turn").drop("_at")


def shards(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with ``shard``: slices of a fixed size in the order of the key."""
    from .paging import ordinals

    return ordinals(rows, key).withColumn("shard", F.ceil(F.col("ordinal") / size)).drop("ordinal")


def by_authority(*sources: DataFrame, key: str) -> DataFrame:
    """One row for each key: that of the first source that has it, with ``source`` (its number)."""
    every = sources[0].withColumn("source", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        every = every.unionByName(s.withColumn("source", F.lit(i)))
    rest = [c for c in every.columns if c != key]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), "source").alias("_r")).select(key, "_r.*")


def to_enrich(pending: DataFrame, existing: DataFrame, keys: list[str], now: Column, days: int = 7) -> DataFrame:
    """Distinct pending keys that have no fresh result (``observed``)."""
    return pending.select(*keys).distinct().join(existing.where(F.col("observed") >= now - F.make_dt_interval(F.lit(days))).select(*keys).distinct(), keys, "left_anti")


def changed_only(new: DataFrame, old: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Rows of ``new`` that are not in ``old`` or differ in content: what an upsert has to write."""
    before = old.select(*keys, F.col(content).alias("_old"), F.lit(True).alias("_there"))
    return new.join(before, keys, "left").where(F.col("_there").isNull() | ~F.col(content).eqNullSafe(F.col("_old"))).select(*new.columns)


def match_key(control_number: Column, name: Column, kind: Column, role: Column) -> Column:
    """What makes two matches the same: record, name key, kind and role key."""
    return F.struct(control_number.alias("control_number"), text.name_key(name).alias("name"), kind.alias("kind"), F.regexp_replace(F.lower(F.trim(role)), r"[\s-]+", "_").alias("role"))


def next_version(artifacts: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New artifacts with ``version``: one more than the largest of their key, 1 for a new key."""
    top = artifacts.groupBy(key).agg(F.max("version").alias("_v"))
    return new.join(top, key, "left").withColumn("version", F.coalesce("_v", F.lit(0)) + 1).drop("_v")


def place_dots(rows: DataFrame, item: str) -> DataFrame:
    """One row for each place (``place, lat, lon``) with the sorted items there and their number."""
    return rows.where("lat is not null and lon is not null").groupBy("place", "lat", "lon").agg(F.sort_array(F.collect_set(item)).alias("items")).withColumn("n", F.size("items"))
