"""Filters, joins, windows, pages and facets on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import analytics, filters, matching, paging, resolve

from .registry import Tables, query


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_project_filter(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT l_orderkey, min(year(l_shipdate)) AS first_year, max(year(l_shipdate)) AS last_year FROM lineitem GROUP BY 1
          HAVING min(year(l_shipdate)) <= 1997 AND max(year(l_shipdate)) >= 1996""")
def filter_interval_overlap(t: Tables) -> DataFrame:
    years = t.lineitem.groupBy("l_orderkey").agg(F.min(F.year("l_shipdate")).alias("first_year"), F.max(F.year("l_shipdate")).alias("last_year"))
    return years.where(filters.years_overlap(F.col("first_year"), F.col("last_year"), 1996, 1997))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%' OR p_name LIKE '%bolt%'")
def filter_any_of_array(t: Tables) -> DataFrame:
    return t.part.where(filters.any_contains(F.split("p_name", " "), ["RED", "bolt"])).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE') AND c_nationkey IN (1, 2, 3)")
def filter_multi_column_or_and(t: Tables) -> DataFrame:
    return t.customer.where(filters.columns_match({"c_mktsegment": ["MACHINERY", "FURNITURE"], "c_nationkey": ["1", "2", "3"]})).select("c_custkey")


def _user_facts(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("property"), F.floor(k / 5).cast("string").alias("value"))


@query("""SELECT user_id AS id FROM events WHERE (event_type = 'click' AND CAST(props->>'$.k' AS INTEGER) // 5 = 9) OR (event_type = 'view' AND CAST(props->>'$.k' AS INTEGER) // 5 = 11)
          GROUP BY 1 HAVING count(DISTINCT event_type) = 2 ORDER BY 1 LIMIT 500""")
def filter_fact_conjunction(t: Tables) -> DataFrame:
    return filters.with_all_facts(_user_facts(t), [("click", "9"), ("view", "11")])


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def dataset_select(t: Tables) -> DataFrame:
    return filters.dataset_select(t.part.select("p_partkey", "p_name"), "p_name", "contains", "RING")


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(CAST(n_nationkey AS VARCHAR), '1') OR contains(lower(n_name), '1')")
def dataset_search(t: Tables) -> DataFrame:
    return filters.dataset_search(t.nation.select("n_nationkey", "n_name"), "1")


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 25")
def dataset_distinct(t: Tables) -> DataFrame:
    return filters.dataset_distinct(t.part, "p_brand")


@query("""SELECT count(*) AS n, min(c_acctbal) AS min, max(c_acctbal) AS max, round(sum(c_acctbal), 4) AS sum, round(avg(c_acctbal), 6) AS avg FROM customer""")
def dataset_agg(t: Tables) -> DataFrame:
    return filters.dataset_agg(t.customer, "c_acctbal")


@query("""SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'high' ELSE 'low' END AS confidence FROM supplier
          WHERE s_nationkey % 3 <> 0 AND s_acctbal > 1000""")
def auto_approve_rule(t: Tables) -> DataFrame:
    rows = t.supplier.select(
        "s_suppkey", (F.col("s_nationkey") % 3 == 0).alias("approved"), F.when(F.col("s_acctbal") > 1000, F.array().cast("array<string>")).otherwise(F.array(F.lit("block:small"))).alias("flags"),
        F.when(F.col("s_acctbal") > 5000, "high").otherwise("low").alias("confidence"), F.array(F.lit("catalogue")).alias("sources"), F.lit("person").alias("kind"),
    )
    return filters.auto_approve(rows, levels=["high", "low"], sources=["catalogue"], kinds=["person"]).select("s_suppkey", "confidence")


# joins


@query("""SELECT c.c_custkey, coalesce(max(o.o_orderkey), -1) AS last_order, count(o.o_orderkey) AS n_orders, CASE WHEN count(o.o_orderkey) > 0 THEN 'created' ELSE 'would_create' END AS status
          FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1""")
def left_merge_view(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"), F.count(F.lit(1)).alias("n"))
    joined = t.customer.select("c_custkey").join(per, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("last_order", F.lit(-1)).alias("last_order"), F.coalesce("n", F.lit(0)).alias("n_orders"), F.when(F.col("n").isNotNull(), "created").otherwise("would_create").alias("status"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def anti_dangling(t: Tables) -> DataFrame:
    live = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return resolve.dangling(t.orders.select("o_orderkey", "o_custkey"), live, "o_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
          AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def semi_conjunction(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority")
    return t.customer.select("c_custkey").join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(o.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_semi")


@query("""WITH d AS (SELECT DISTINCT s_suppkey % 70 AS a, s_nationkey * 10 + s_suppkey % 10 AS b FROM supplier)
          SELECT a, b FROM d WHERE a NOT IN (SELECT a FROM d GROUP BY a HAVING count(*) > 1) AND b NOT IN (SELECT b FROM d GROUP BY b HAVING count(*) > 1)""")
def unambiguous_ledger(t: Tables) -> DataFrame:
    return resolve.unambiguous(t.supplier.select((F.col("s_suppkey") % 70).alias("a"), (F.col("s_nationkey") * 10 + F.col("s_suppkey") % 10).alias("b")), "a", "b")


@query("""WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)
          SELECT coalesce(a.k, b.k) AS bucket, round(a.v, 2) AS before, round(b.v, 2) AS after,
          CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'gone' WHEN b.v - a.v < -1000 THEN 'regressed' WHEN b.v - a.v > 1000 THEN 'improved' ELSE 'stable' END AS verdict FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_diff(t: Tables) -> DataFrame:
    year = lambda y: t.orders.where(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("bucket")).agg(F.sum("o_totalprice").alias("v"))
    d = analytics.run_diff(year(1996), year(1997), metric="v", epsilon=1000)
    return d.withColumn("before", F.round("before", 2)).withColumn("after", F.round("after", 2))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def lateral_unnest(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("""SELECT p_partkey, i AS ord, w[i] AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) s, unnest(range(1, len(w) + 1)) u(i)""")
def unnest_ordinality(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word")).select("p_partkey", (F.col("pos") + 1).cast("long").alias("ord"), "word")


_NAMES = "SELECT min(p_partkey) AS id, p_name AS text FROM part GROUP BY p_name"
_TRI = """list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: w <> ''),
          lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""


def _names(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("id")).select("id", "text")


@query(f"""WITH g AS (SELECT id, {_TRI} AS g FROM ({_NAMES}))
          SELECT a.id AS left_id, b.id AS right_id, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS similarity
          FROM g a, g b WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.45""")
def trigram_join(t: Tables) -> DataFrame:
    return matching.trigram_pairs(_names(t), _names(t)).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH n AS ({_NAMES}), q AS (SELECT id, CASE id % 3 WHEN 0 THEN text WHEN 1 THEN string_split(text, ' ')[2] ELSE replace(text, 'e', 'a') END AS text FROM n),
          e AS (SELECT q.id AS query_id, n.id AS name_id, 0 AS tier, 0 AS len, 1.0 AS similarity FROM q JOIN n ON q.text = n.text),
          c AS (SELECT q.id, n.id, 1, length(n.text), 1.0 FROM q JOIN n ON contains(n.text, q.text) OR contains(q.text, n.text) WHERE q.id NOT IN (SELECT query_id FROM e)),
          gq AS (SELECT id, {_TRI} AS g FROM q), gn AS (SELECT id, {_TRI} AS g FROM n),
          f AS (SELECT a.id, b.id, 2, 0, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS s FROM gq a, gn b WHERE a.id NOT IN (SELECT query_id FROM e) AND s >= 0.45),
          u AS (SELECT * FROM e UNION ALL SELECT * FROM c UNION ALL SELECT * FROM f)
          SELECT query_id, name_id, tier, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, len, similarity DESC, name_id) AS r FROM u) WHERE r = 1""")
def exact_then_fuzzy_cascade(t: Tables) -> DataFrame:
    n = _names(t)
    changed = F.when(F.col("id") % 3 == 0, F.col("text")).when(F.col("id") % 3 == 1, F.get(F.split("text", " "), F.lit(1))).otherwise(F.replace("text", F.lit("e"), F.lit("a")))
    return matching.cascade(n.select("id", changed.alias("text")), n).select("query_id", "name_id", "tier", F.round("similarity", 6).alias("similarity"))


@query(f"WITH n AS ({_NAMES}) SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id < b.id AND levenshtein(a.text, b.text) <= 3")
def levenshtein_match(t: Tables) -> DataFrame:
    # names within three edits share a trigram unless they are very short; the trigram join finds them without a cross join
    near = matching.trigram_pairs(_names(t), _names(t), threshold=0.2).where("left_id < right_id")
    left, right = _names(t).toDF("left_id", "x"), _names(t).toDF("right_id", "y")
    return near.join(left, "left_id").join(right, "right_id").where(text.within_distance(F.col("x"), F.col("y"), 3)).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


@query("""SELECT p_name AS query_id, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) WHEN count(DISTINCT p_brand) FILTER (p_size <= 2) = 1 THEN min(p_brand) FILTER (p_size <= 2) END AS picked,
          NOT (count(DISTINCT p_brand) = 1 OR count(DISTINCT p_brand) FILTER (p_size <= 2) = 1) AS abstain FROM part GROUP BY 1""")
def unique_or_abstain(t: Tables) -> DataFrame:
    return matching.unique_or_abstain(t.part.select(F.col("p_name").alias("query_id"), F.col("p_brand").alias("qid"), (F.col("p_size") <= 2).alias("exact")))


@query("""WITH c AS (SELECT o_custkey AS query_id, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN '100' WHEN 'O' THEN '150' ELSE '110' END AS tag, year(o_orderdate) - 1000 AS y, o_orderkey % 2 = 0 AS fuzzy FROM orders),
          s AS (SELECT *, y BETWEEN 991 AND 1005 OR y + 5 >= 996 AND y - 5 <= 1000 AS ov, CASE tag WHEN '100' THEN 100 WHEN '150' THEN -40 ELSE 0 END AS base FROM c),
          k AS (SELECT query_id, id, base + CASE WHEN y - 5 <= 1000 AND 996 - 5 <= y THEN 50 ELSE 0 END - CASE WHEN fuzzy THEN 30 ELSE 0 END AS score, y - 5 <= 1000 AND 991 <= y AS o FROM s),
          r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM k),
          p AS (SELECT query_id, max(CASE WHEN place = 1 THEN id END) AS id1, max(CASE WHEN place = 1 THEN score END) AS s1, max(CASE WHEN place = 2 THEN score END) AS s2, bool_or(place <= 2 AND o) AS any_o FROM r GROUP BY 1)
          SELECT query_id, CASE WHEN NOT coalesce(s1 - s2 <= 15 AND NOT any_o, false) THEN id1 END AS winner, coalesce(s1 - s2 <= 15 AND NOT any_o, false) AS abstain,
          CASE WHEN coalesce(s1 - s2 <= 15 AND NOT any_o, false) THEN 'tie' ELSE '' END AS reason, s1 AS score FROM p""")
def homonym_score(t: Tables) -> DataFrame:
    y = (F.year("o_orderdate") - 1000).cast("string")
    c = t.orders.select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "100").when(F.col("o_orderstatus") == "O", "150").otherwise("110").alias("tag"),
        F.concat(y, F.lit("-"), y).alias("dates"), F.lit("996-1000").alias("record_dates"), F.lit(None).cast("int").alias("year"), F.lit("author").alias("role"), (F.col("o_orderkey") % 2 == 0).alias("fuzzy"),
    )
    return matching.pick_homonym(c)


@query("""WITH f AS (SELECT doc_id AS record_id, 'lang' AS field, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents),
          c AS (SELECT doc_id AS record_id, doc_id AS candidate_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE 'zzz' END AS text, 'lang' AS kind FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
          h AS (SELECT record_id, candidate_id, list(DISTINCT field ORDER BY field) AS fields FROM c JOIN f USING (record_id) WHERE contains(value, text) OR contains(text, value) GROUP BY 1, 2)
          SELECT record_id, candidate_id, CASE WHEN fields IS NULL THEN 'novel' WHEN list_contains(fields, kind) THEN 'grounded' ELSE 'wrong_field' END AS status, array_to_string(fields, ',') AS fields FROM c LEFT JOIN h USING (record_id, candidate_id)""")
def grounding_classify(t: Tables) -> DataFrame:
    d = t.documents.where("lang is not null and source is not null")
    both = F.explode(F.array(F.struct(F.lit("lang").alias("field"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("field"), F.col("source").alias("value")))).alias("x")
    fields = d.select(F.col("doc_id").alias("record_id"), both).select("record_id", "x.field", "x.value")
    said = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise("zzz")
    c = d.select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("candidate_id"), said.alias("text"), F.lit("lang").alias("kind"))
    return matching.ground(c, fields).withColumn("fields", F.array_join("fields", ","))


# windows and pages


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_per_key(t: Tables) -> DataFrame:
    return paging.latest(t.events.select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def max_by_latest(t: Tables) -> DataFrame:
    return paging.latest(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT o_totalprice, o_orderkey FROM orders WHERE o_totalprice > 200000 OR (o_totalprice = 200000 AND o_orderkey > 5) ORDER BY 1, 2 LIMIT 51")
def keyset_page(t: Tables) -> DataFrame:
    return paging.keyset_page(t.orders.select("o_totalprice", "o_orderkey"), "o_totalprice", "o_orderkey", after=(200000, 5))


@query("SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderpriority < '3-MEDIUM' OR (o_orderpriority = '3-MEDIUM' AND o_orderkey < 700) ORDER BY 1 DESC, 2 DESC LIMIT 21")
def keyset_page_desc(t: Tables) -> DataFrame:
    return paging.keyset_page(t.orders.select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", after=("3-MEDIUM", 700), limit=20, descending=True)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC NULLS LAST, c_custkey LIMIT 20 OFFSET 40")
def offset_page(t: Tables) -> DataFrame:
    return paging.offset_page(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", offset=40, limit=20)


@query("""WITH r AS (SELECT user_id, event_type, min(event_id) AS e, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS p FROM events GROUP BY 1, 2),
          b AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, e) AS k FROM r)
          SELECT user_id, max(CASE WHEN k = 1 THEN event_type END) AS role, coalesce(string_agg(CASE WHEN k > 1 THEN event_type END, ',' ORDER BY event_type), '') AS alt_roles FROM b GROUP BY 1""")
def role_priority_dedup(t: Tables) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return paging.by_priority(t.events, ["user_id"], "event_type", rank, "event_id")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey % 7 AS place FROM lineitem WHERE l_suppkey % 7 <> 0),
          w AS (SELECT l_orderkey, row_number() OVER o AS ord, place AS "from", lead(place) OVER o AS "to" FROM s WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, place))
          SELECT * FROM w WHERE "to" IS NOT NULL""")
def consecutive_edges(t: Tables) -> DataFrame:
    stops = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif(F.col("l_suppkey") % 7, F.lit(0)).alias("place"))
    return analytics.stops_to_edges(stops, box="l_orderkey", order=["l_linenumber", "place"], place="place")


@query("""(SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 3) UNION ALL
          (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey <> 3 ORDER BY c_acctbal DESC, c_custkey LIMIT greatest(0, 100 - (SELECT count(*) FROM customer WHERE c_nationkey = 3)))""")
def top_k_with_mandatory(t: Tables) -> DataFrame:
    return paging.top_with_mandatory(t.customer, F.col("c_nationkey") == 3, "c_acctbal", "c_custkey", 100).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS ordinal FROM orders WHERE o_orderstatus = 'O'")
def ordinal_assignment(t: Tables) -> DataFrame:
    return paging.ordinals(t.orders.where("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey")


# entity resolution


@query("SELECT lang, source, count(*) AS n, min(doc_id) AS first FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(t: Tables) -> DataFrame:
    return resolve.duplicate_groups(t.documents, ["lang", "source"], "doc_id")


@query("SELECT p_name, p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) > 1")
def id_collision(t: Tables) -> DataFrame:
    return resolve.collisions(t.part, ["p_name", "p_brand"], "p_type")


@query("""WITH e AS (SELECT s_suppkey, s_nationkey AS kind, CAST(s_suppkey % 5 AS VARCHAR) AS id, s_name AS source FROM supplier), o AS (SELECT kind AS subject, 'k' AS kind, id, min(source) AS source FROM e GROUP BY 1, 3)
          SELECT subject, kind, id, source, count(*) OVER (PARTITION BY subject, kind) = 1 AS accepted, CASE WHEN count(*) OVER (PARTITION BY subject, kind) > 1 THEN 'conflicting candidates' ELSE '' END AS reason FROM o""")
def evidence_gate(t: Tables) -> DataFrame:
    return resolve.gate_evidence(t.supplier.select(F.col("s_nationkey").alias("subject"), F.lit("k").alias("kind"), (F.col("s_suppkey") % 5).cast("string").alias("id"), F.col("s_name").alias("source")))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'qid:' || CAST(c_custkey % 300 AS VARCHAR) END AS k1, CASE WHEN c_custkey % 4 IN (0, 1) THEN 'cn:' || CAST(c_custkey % 400 AS VARCHAR) END AS k2,
            CASE WHEN c_custkey % 4 > 1 THEN 'label:' || c_mktsegment || CAST(c_nationkey AS VARCHAR) END AS k3 FROM customer),
          k AS (SELECT id, k1 AS k, 0 AS r FROM e WHERE k1 IS NOT NULL UNION ALL SELECT id, k2, 1 FROM e WHERE k2 IS NOT NULL UNION ALL SELECT id, k3, 4 FROM e WHERE k3 IS NOT NULL),
          first AS (SELECT k, min(id) AS f FROM k GROUP BY k), edge AS (SELECT DISTINCT id AS a, f AS b FROM k JOIN first USING (k) UNION SELECT DISTINCT f, id FROM k JOIN first USING (k)),
          reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
          c AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a), best AS (SELECT cluster, arg_min(k, (r, k)) AS cluster_key FROM c JOIN k USING (id) GROUP BY 1)
          SELECT id AS entity_id, cluster, cluster_key FROM c JOIN best USING (cluster)""")
def union_find_sources(t: Tables) -> DataFrame:
    n = F.col("c_custkey") % 4
    none = F.lit(None).cast("string")
    e = t.customer.select(
        F.col("c_custkey").alias("entity_id"), F.when(n == 0, (F.col("c_custkey") % 300).cast("string")).alias("qid"), F.when(n <= 1, (F.col("c_custkey") % 400).cast("string")).alias("cn"),
        none.alias("viaf"), none.alias("nli"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("label"), none.alias("raw"),
    )
    return resolve.merge_sources(e).select("entity_id", "cluster", "cluster_key")
