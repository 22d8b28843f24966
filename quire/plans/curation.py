"""Curation queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import analytics, curation, rules
from quire.operators import filters as filtering

from .registry import Tables, query


@query("""WITH w AS (SELECT o_custkey AS item, o_orderkey AS ord, unnest([o_orderstatus, o_orderpriority]) AS w, unnest([1, 2]) AS i FROM orders), f AS (SELECT item, w, min((ord, i)) AS p FROM w GROUP BY 1, 2)
          SELECT item, string_agg(w, '|' ORDER BY p) AS words, (SELECT arg_min(o_totalprice, o_orderkey) FROM orders WHERE o_custkey = item) AS price FROM f GROUP BY 1""")
def merge_records(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("record"), F.array("o_orderstatus", "o_orderpriority").alias("words"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("item"))
    merged = curation.merge_records(o.select("item", "record", F.col("record").alias("ord")), o.drop("item"), lists=["words"], scalars=["price"])
    return merged.withColumn("words", F.array_join("words", "|"))


@query("""WITH RECURSIVE st AS (SELECT c_custkey AS a, c_custkey // 3 AS b FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey // 3, c_custkey FROM customer WHERE c_custkey > 0),
          r(item, value, d) AS (SELECT c_custkey, c_name, 0 FROM customer WHERE c_custkey IN (5, 700) UNION SELECT b, value, d + 1 FROM r JOIN st ON a = item WHERE d < 10),
          f AS (SELECT item, min(d) AS d FROM r GROUP BY 1) SELECT r.item, min(value) AS value FROM r JOIN f ON r.item = f.item AND r.d = f.d GROUP BY 1""")
def propagate_links(t: Tables) -> DataFrame:
    c = t.customer
    known = c.where("c_custkey in (5, 700)").select(F.col("c_custkey").alias("item"), F.col("c_name").alias("value"))
    return curation.propagate(known, c.where("c_custkey > 0").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 3).alias("b")))


@query("""WITH f AS (SELECT DISTINCT user_id AS id, event_type AS property, props->>'$.k' AS value FROM events), a AS (SELECT DISTINCT CAST(value AS BIGINT) % 7 AS query_id, property, value FROM f WHERE CAST(value AS BIGINT) < 14 AND property IN ('click', 'view') AND CAST(value AS BIGINT) % 2 = CASE property WHEN 'click' THEN 0 ELSE 1 END),
          n AS (SELECT query_id, count(*) AS n FROM a GROUP BY 1), h AS (SELECT query_id, id, count(*) AS k FROM a JOIN f USING (property, value) GROUP BY 1, 2) SELECT h.query_id, id, false AS truncated FROM h JOIN n USING (query_id) WHERE k = n""")
def anchor_probe(t: Tables) -> DataFrame:
    facts = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("property"), F.get_json_object("props", "$.k").alias("value")).distinct()
    v = F.col("value").cast("bigint")
    wanted = facts.where((v < 14) & F.col("property").isin("click", "view") & (v % 2 == F.when(F.col("property") == "click", 0).otherwise(1)))
    return curation.probe(wanted.select((v % 7).alias("query_id"), "property", "value").distinct(), facts)


@query("""SELECT s_nationkey, arg_min(s_name, (CASE WHEN s_acctbal > 7000 THEN 0 WHEN s_acctbal > 3000 THEN 1 ELSE 2 END, s_suppkey)) AS s_name FROM supplier GROUP BY 1""")
def best_authority(t: Tables) -> DataFrame:
    level = F.when(F.col("s_acctbal") > 7000, "high").when(F.col("s_acctbal") > 3000, "medium").otherwise("low")
    return curation.best_row(t.supplier.select("s_nationkey", "s_name", "s_suppkey", level.alias("level")), "s_nationkey", "level", "s_suppkey").select("s_nationkey", "s_name")


@query("""WITH a AS (SELECT p_partkey AS key, p_name AS v FROM part WHERE p_partkey % 3 > 0), b AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS v FROM part WHERE p_partkey % 5 > 0)
          SELECT CASE WHEN a.v IS NULL THEN 'only_second' WHEN b.v IS NULL THEN 'only_first' WHEN a.v = b.v THEN 'same' ELSE 'conflict' END AS kind, count(*) AS n FROM a FULL JOIN b USING (key) GROUP BY 1""")
def version_conflicts(t: Tables) -> DataFrame:
    p = t.part
    side = lambda keep, v: p.where(keep).select(F.col("p_partkey").alias("key"), F.lit("label").alias("field"), v.alias("value"))
    both = curation.compare_fields(side("p_partkey % 3 > 0", F.col("p_name")), side("p_partkey % 5 > 0", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type"))))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_type, count(*) AS n, (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM (SELECT p_partkey AS k FROM part q WHERE q.p_type = part.p_type ORDER BY 1 LIMIT 3)) AS examples FROM part GROUP BY 1""")
def usage_examples(t: Tables) -> DataFrame:
    return curation.usage_examples(t.part, "p_type", "p_partkey")


@query("""SELECT c_nationkey AS term, 'missing' AS kind FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20) GROUP BY 1
          UNION ALL SELECT s_nationkey, 'undeclared' FROM supplier WHERE s_suppkey < 20 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer) GROUP BY 1""")
def vocabulary_gaps(t: Tables) -> DataFrame:
    return curation.vocabulary_gaps(t.customer.select(F.col("c_nationkey").alias("term")), t.supplier.where("s_suppkey < 20").select(F.col("s_nationkey").alias("term")), "term")


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 50")
def seeded_sample(t: Tables) -> DataFrame:
    return curation.sample(t.orders.select("o_orderkey"), "o_orderkey", 50, 42)


@query("""WITH e AS (SELECT event_id, 'failed: ' || event_type || ' ' || '#' AS signature FROM events)
          SELECT signature, count(*) AS n, (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM (SELECT event_id AS k FROM e f WHERE f.signature = e.signature ORDER BY 1 LIMIT 3)) AS examples FROM e GROUP BY 1""")
def error_signatures(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.concat(F.lit("failed: "), "event_type", F.lit(" "), F.col("event_id").cast("string")).alias("message"))
    return curation.signatures(rows, "message", "event_id")


@query("SELECT count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders")
def record_bounds(t: Tables) -> DataFrame:
    return t.orders.agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN count(DISTINCT l_partkey) OVER (PARTITION BY l_orderkey, l_suppkey % 5) > 1 THEN 'low' ELSE 'high' END AS confidence FROM lineitem""")
def cluster_collapse(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 5).alias("cluster"), F.lit("high").alias("confidence"))
    return curation.collapse_clusters(rows, record="l_orderkey", cluster="cluster", name="l_partkey", level="confidence").select("l_orderkey", "l_linenumber", "l_partkey", "confidence")


@query("""SELECT l_orderkey AS item, min(CAST(l_suppkey AS VARCHAR)) || '|' || min(l_returnflag) AS composite FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1 AND count(DISTINCT l_returnflag) = 1""")
def composite_probe(t: Tables) -> DataFrame:
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("s"), F.collect_set("l_returnflag").alias("r"))
    return curation.composite_keys(items, "item", ["s", "r"])


@query("""WITH q AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN s_name || 'x' ELSE 'nobody' END AS name, CASE WHEN s_suppkey % 4 = 2 THEN s_suppkey ELSE -1 END AS ext FROM supplier)
          SELECT query_id, CASE WHEN query_id % 4 = 3 THEN NULL ELSE query_id END AS cand_id, CASE query_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'low' END AS confidence FROM q""")
def strict_match(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 4
    q = t.supplier.select(F.col("s_suppkey").alias("query_id"), F.when(k == 0, F.col("s_name")).when(k == 1, F.concat("s_name", F.lit("x"))).otherwise("nobody").alias("name"), F.when(k == 2, F.col("s_suppkey")).otherwise(-1).alias("ext_id"))
    c = t.supplier.select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("cand_id"), F.col("s_name").alias("cand_name"), F.col("s_suppkey").alias("cand_ext"))
    return curation.strict_match(q, c)


@query("""WITH s AS (SELECT l_orderkey AS record, l_linenumber AS ord, l_partkey, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey END AS place, l_returnflag <> 'R' AS approved, CASE WHEN l_tax > 0.06 THEN 'low' ELSE 'high' END AS confidence, l_discount * 100 AS lat FROM lineitem)
          SELECT CASE WHEN place IS NULL THEN 'no place' WHEN NOT approved THEN 'unapproved' WHEN confidence = 'low' THEN 'low confidence' WHEN abs(lat) < 0.01 THEN 'no location' END AS reason, count(*) AS n FROM s
          JOIN orders ON o_orderkey = record WHERE (place IS NULL OR NOT approved OR confidence = 'low' OR abs(lat) < 0.01) GROUP BY 1""")
def provenance_drops(t: Tables) -> DataFrame:
    stops = t.lineitem.select(
        F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey")).alias("place"), (F.col("l_returnflag") != "R").alias("approved"),
        F.when(F.col("l_tax") > 0.06, "low").otherwise("high").alias("confidence"), (F.col("l_discount") * 100).alias("lat"), F.lit(0.0).alias("lon"),
    )
    _, dropped = curation.movement_stops(t.orders.select(F.col("o_orderkey").alias("record")), stops)
    return dropped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'p_name' AS tag, count(*) FILTER (p_name <> '') AS n, true AS mapped FROM part UNION ALL SELECT 'p_type', count(*) FILTER (p_type <> ''), false FROM part""")
def mapping_audit(t: Tables) -> DataFrame:
    return curation.audit_mapping(t.part.select("p_name", "p_type"), ["p_name"])


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'meeting' WHEN s_suppkey % 4 = 1 THEN 'person' WHEN s_suppkey % 8 = 2 THEN 'person' ELSE 'corporate' END AS kind FROM supplier""")
def entity_kind(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    tag = F.when(k % 4 == 0, "111").when(k % 4 == 1, "100").otherwise("710")
    name = F.when(k % 8 == 2, "Cohen, Moshe").when(k % 4 == 3, "National Library, The").otherwise("Firm")
    return t.supplier.select("s_suppkey", curation.entity_kind(tag, name, ["library", "museum"]).alias("kind"))


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def memo_misses(t: Tables) -> DataFrame:
    return curation.misses(t.orders.select(F.col("o_custkey").alias("key")), t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key")))


@query("""SELECT rule, state, count(*) AS n FROM (SELECT 'a' AS rule, CASE WHEN p_size > 10 THEN 'pass' ELSE 'fail' END AS state FROM part UNION ALL SELECT 'b', CASE WHEN p_size > 30 THEN 'pass' ELSE 'fail' END FROM part) GROUP BY 1, 2""")
def verdict_merge(t: Tables) -> DataFrame:
    yes = F.lit(True)
    stored = rules.evaluate(t.part, "p_partkey", [("a", yes, F.col("p_size") > 10), ("b", yes, F.col("p_size") > 20)])
    fresh = rules.evaluate(t.part, "p_partkey", [("b", yes, F.col("p_size") > 30)])
    return rules.merge_states(stored, fresh, ["b"], "p_partkey").groupBy("rule", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH y AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 1 OR c_nationkey BETWEEN 10 AND 19)
          SELECT CAST(y AS INTEGER) AS year, count(*) AS n FROM y WHERE y BETWEEN 1996 AND 1999 GROUP BY 1""")
def corpus_movement(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.array(F.concat(F.lit("NATION_"), "c_nationkey")).alias("places"))
    y = F.year("o_orderdate")
    items = t.orders.join(c, "o_custkey").where(filtering.any_contains(F.col("places"), ["nation_1"]) & (F.size("places") > 0) & filtering.years_overlap(y, y, 1996, 1999))
    return analytics.histogram(items, y)


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def day_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
