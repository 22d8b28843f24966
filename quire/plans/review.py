"""Review queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import review
from quire.sources import readers

from .registry import Tables, query


@query("SELECT event_id FROM events WHERE (event_id % 3 = 0 OR event_type = 'view') AND event_id % 2 = 0 AND (contains(props, '7') OR contains(CAST(user_id AS VARCHAR), '7'))")
def entity_list(t: Tables) -> DataFrame:
    none, k = F.lit(None).cast("string"), F.col("event_id")
    rows = t.events.select(
        "event_id", F.lit("s").alias("source"), F.col("event_type").alias("type"), F.when(k % 3 == 0, "view").alias("effective_type"), none.alias("role"), none.alias("effective_role"),
        F.when(k % 2 == 0, True).alias("approved"), F.col("props").alias("text"), F.col("user_id").alias("control_number"),
    )
    return rows.where(review.entity_filter(source="s", kind="view", approved=True, search=" 7 ")).select("event_id")


@query("""SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS pass_count, count(*) FILTER (l_returnflag <> 'A') AS n_open FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0""")
def verdict_export(t: Tables) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "pass").otherwise("not_relevant")
    verdicts = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("rule"), state.alias("state"))).alias("results"))
    return review.compact_verdicts(verdicts, failures_only=True).select("l_orderkey", F.col("pass_count").cast("long").alias("pass_count"), F.size("results").cast("long").alias("n_open"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN 'fail' WHEN s_suppkey % 3 = 0 THEN 'partial' ELSE 'full' END AS overall FROM supplier")
def axis_overall(t: Tables) -> DataFrame:
    a = F.when(F.col("s_nationkey") % 5 == 0, " No").otherwise("n/a")
    b = F.when(F.col("s_suppkey") % 3 == 0, "partial").when(F.col("s_suppkey") % 3 == 1, "yes")
    return t.supplier.select("s_suppkey", review.overall(a, b).alias("overall"))


@query("""WITH p AS (SELECT lower(c_name) AS label, min('c' || c_custkey) AS uri FROM customer GROUP BY 1),
          m AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE 'nobody' END AS a, CASE WHEN o_orderkey % 3 = 0 THEN c_name END AS b, o_orderkey % 5 = 0 AS high, CAST(year(o_orderdate) AS INTEGER) AS y
                FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 7 > 0),
          u AS (SELECT coalesce(x.uri, z.uri) AS uri, ord, high, y FROM m LEFT JOIN p x ON x.label = lower(a) LEFT JOIN p z ON z.label = lower(b))
          SELECT uri, coalesce(arg_max(y, ord) FILTER (high), arg_min(y, ord)) AS birth_year FROM u WHERE uri IS NOT NULL GROUP BY 1""")
def person_lifespans(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    people = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("uri"), F.col("c_name").alias("label"))
    matches = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select(
        k.alias("ord"), F.when(k % 2 == 0, F.upper("c_name")).otherwise("nobody").alias("matched_name"), F.when(k % 3 == 0, F.col("c_name")).alias("entity_text"),
        F.when(k % 5 == 0, "high").otherwise("low").alias("confidence"), F.when(k % 7 > 0, F.year("o_orderdate")).alias("birth_year"), F.lit(None).cast("int").alias("death_year"),
    )
    return review.lifespans(people, matches).select("uri", "birth_year")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)")
def namespace_ledger(t: Tables) -> DataFrame:
    parts = t.part.select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "urn:a#").otherwise("urn:b#"), "p_partkey").alias("raw_uri"))
    return review.known_in(parts, t.supplier.select(F.concat(F.lit("urn:b#"), "s_suppkey").alias("uri")), ["urn:a#", "urn:b#"]).select("p_partkey")


@query("""WITH n AS (SELECT 'n' || n_nationkey AS id, n_name AS h FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region),
          e AS (SELECT 'e' || n_nationkey AS id, 'n' || n_nationkey AS a, 'r' || n_regionkey AS b, CASE WHEN n_nationkey % 2 = 0 THEN 'part of' ELSE 'in' END AS l FROM nation),
          k AS (SELECT id FROM n WHERE contains(lower(h), 'a') UNION SELECT unnest([a, b]) FROM e WHERE contains(l, 'a') UNION SELECT 'n0'),
          shown AS (SELECT * FROM e WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k) AND l = 'in')
          SELECT id FROM shown UNION SELECT unnest([a, b]) FROM shown UNION SELECT 'n0'""")
def graph_view(t: Tables) -> DataFrame:
    node = lambda kind, k, name: (F.concat(F.lit(kind[0]), k).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("haystack"))
    nodes = t.nation.select(*node("nation", "n_nationkey", "n_name")).union(t.region.select(*node("region", "r_regionkey", "r_name")))
    k = F.col("n_nationkey")
    edges = t.nation.select(
        F.concat(F.lit("e"), k).alias("id"), F.concat(F.lit("n"), k).alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"), F.lit("in").alias("predicate"), F.when(k % 2 == 0, "part of").alias("predicate_label")
    )
    kept, lines = review.visible(nodes, edges, query="A", types=("nation", "region"), predicates=("in",), selected="n0")
    return kept.union(lines)


@query("SELECT CAST(p_partkey AS VARCHAR) AS control_number, '245' AS linked_tag, substr(p_brand, 1, 1) AS script, p_name AS romanised FROM part WHERE p_partkey % 3 > 0")
def linked_script(t: Tables) -> DataFrame:
    sub = lambda code, v: F.struct(F.lit(code).alias("code"), v.cast("string").alias("value"))
    six = F.when(F.col("p_partkey") % 3 == 0, "245").otherwise(F.concat(F.lit("245-01/("), F.substring("p_brand", 1, 1)))
    field = F.struct(F.lit("880").alias("tag"), F.lit(1).alias("occurrence"), F.array(F.lit(" "), F.lit(" ")).alias("indicators"), F.array(sub("6", six), sub("a", F.col("p_name"))).alias("subfields"), F.lit(None).cast("string").alias("data"))
    records = t.part.select(F.col("p_partkey").cast("string").alias("control_number"), F.array(field).cast(readers.OCCURRENCE).alias("occurrences"))
    return review.linked_fields(records).select("control_number", "linked_tag", "script", F.try_element_at("subfields", F.lit("a")).alias("romanised"))
