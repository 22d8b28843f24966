"""Export, graph-detail and validation queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import exports, triples
from quire.sources import turtle
from quire.sources.shared import new_dir

from .registry import Tables, query


def _graph(t: Tables) -> DataFrame:
    """Orders with their customer, status and total price; customers with their nation and name."""
    s, c = F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey")
    orders = triples.melt(t.orders, s, {"type": F.lit("Order"), "by": c, "status": F.col("o_orderstatus"), "price": F.round("o_totalprice").cast("long")}, links=("by",))
    people = triples.melt(t.customer, F.concat(F.lit("c"), "c_custkey"), {"type": F.lit("Person"), "of": F.concat(F.lit("n"), "c_nationkey"), "label": F.col("c_name")}, links=("of",))
    return orders.unionByName(people)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def extraction_export(t: Tables) -> DataFrame:
    return exports.ordered_export(t.orders.withColumn("approved", F.when(F.col("o_orderstatus") == "F", True)), ["o_custkey", "o_orderkey"], approved_only=True).select("o_orderkey", "o_custkey")


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def authority_export(t: Tables) -> DataFrame:
    return exports.ordered_export(t.supplier.withColumn("approved", F.lit(False)), ["s_nationkey", "s_suppkey"]).select("s_suppkey", "s_nationkey")


@query("""SELECT user_id AS entity_id, count(*) AS rev, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1""")
def folded_export(t: Tables) -> DataFrame:
    from quire.operators.events import number_events

    raw = t.events.withColumnRenamed("user_id", "entity_id")
    numbered = number_events(raw, order=["ts", "event_id"], every=1 << 30)
    state = F.create_map(F.lit("type"), F.col("event_type"))
    history = numbered.select("entity_id", "rev", F.when(F.col("rev") == 1, "create").otherwise("patch").alias("op"), F.when(F.col("rev") > 1, state).alias("patch"), F.when(F.col("rev") == 1, state).alias("state"))
    return exports.folded_items(history).select("entity_id", F.col("rev").cast("long").alias("rev"), F.col("fields")["type"].alias("last"))


@query("""SELECT 'customer' AS entity_type, 'c' || c_custkey AS entity_id, '{"entity_id":"c' || c_custkey || '","label":"' || c_name || '"}' AS value FROM customer""")
def project_export(t: Tables) -> DataFrame:
    of = lambda df, kind, k, name: df.select(F.lit(kind).alias("entity_type"), F.concat(F.lit(kind[0]), k).alias("entity_id"), F.col(name).alias("label"))
    rows = of(t.customer, "customer", "c_custkey", "c_name").unionByName(of(t.supplier, "supplier", "s_suppkey", "s_name"))
    return exports.project_export(rows, ["customer"])


@query("SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation")
def graph_elements(t: Tables) -> DataFrame:
    nation, region = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "r_regionkey")
    nodes = t.nation.select(nation.alias("id"), F.col("n_name").alias("label"), F.lit("nation").alias("type"), F.lit(0).alias("must"), F.lit(1).alias("degree")).union(t.region.select(region, "r_name", F.lit("region"), F.lit(1), F.lit(5)))
    edges = t.nation.select(F.col("n_nationkey").cast("string").alias("id"), nation.alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"), F.lit("in").alias("predicate"))
    return exports.graph_elements(nodes.withColumn("haystack", F.lower("label")), edges, most=100)[1].select("source", "target")


@query("""SELECT 'type' AS part, 'type' AS predicate, 'Person' AS value UNION ALL SELECT 'property', 'label', c_name FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'outgoing', 'of', 'n' || c_nationkey FROM customer WHERE c_custkey = 7
          UNION ALL SELECT 'incoming', 'by', 'o' || o_orderkey FROM orders WHERE o_custkey = 7""")
def node_detail(t: Tables) -> DataFrame:
    return exports.node_detail(_graph(t), "c7")


@query("SELECT 'c' || o_custkey AS entity, 'buyer' AS role, 'o' || o_orderkey AS subject FROM orders UNION ALL SELECT DISTINCT 'n' || c_nationkey, 'home', 'c' || c_custkey FROM customer")
def roles_of(t: Tables) -> DataFrame:
    return exports.roles_of(_graph(t), {"by": "buyer", "of": "home"})


@query("""WITH x AS (SELECT 'c' || o_custkey AS k, o_orderstatus AS role FROM orders UNION ALL SELECT 'c' || c_custkey, 'F' FROM customer) SELECT role, count(DISTINCT k) AS n FROM x GROUP BY 1""")
def people_by_role(t: Tables) -> DataFrame:
    graph = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("key"), F.col("o_orderstatus").alias("role"))
    return exports.people_by_role(graph, t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.lit("F").alias("role")))


@query("""SELECT (SELECT count(*) FROM nation) AS n_rows, 3 AS n_columns, string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}', ' ' ORDER BY n_nationkey) AS sample FROM nation WHERE n_nationkey < 5""")
def dataset_info(t: Tables) -> DataFrame:
    return exports.dataset_info(t.nation.select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey").select("n_rows", "n_columns", F.array_join("sample", " ").alias("sample"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10")
def top_values(t: Tables) -> DataFrame:
    return exports.top(t.lineitem, "l_suppkey", 10)


@query("""WITH p AS (SELECT n_nationkey AS k FROM nation), m AS (SELECT s_nationkey AS k, arg_min(CAST(s_suppkey AS DOUBLE), s_suppkey) FILTER (s_suppkey % 2 = 1 AND s_suppkey <= 90) AS lat FROM supplier WHERE s_nationkey % 3 > 0 GROUP BY 1)
          SELECT p.k AS place, CASE WHEN m.k IS NULL THEN CASE WHEN p.k % 2 = 0 THEN 10.0 END ELSE m.lat END AS lat FROM p LEFT JOIN m ON m.k = p.k""")
def place_coordinates(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    matches = t.supplier.where("s_nationkey % 3 > 0").select(F.col("s_nationkey").alias("place"), k.alias("ord"), F.when(k % 2 == 1, k.cast("double")).otherwise(0.0).alias("lat"), F.when(k % 2 == 1, 5.0).otherwise(0.0).alias("lon"))
    gazetteer = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("place"), F.lit(10.0).alias("lat"), F.lit(1.0).alias("lon"))
    return exports.place_coordinates(t.nation.select(F.col("n_nationkey").alias("place")), matches, gazetteer).select("place", "lat")


@query("SELECT s_suppkey, CASE (CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM supplier")
def place_confidence(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", exports.place_confidence(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey") % 2 == 0, F.lit(None).cast("boolean")).alias("confidence"))


SHAPES = [
    triples.Shape("Order", "status", "in", ["F", "O"]),
    triples.Shape("Order", "price", "datatype", "integer"),
    triples.Shape("Order", "price", "max_value", 200_000),
    triples.Shape("Order", "price", "min_value", 5_000),
    triples.Shape("Order", "status", "pattern", "^[A-O]$"),
    triples.Shape("Order", "status", "node_kind", "uri"),
    triples.Shape("Order", "by", "class", "Person"),
    triples.Shape("Person", "label", "max_count", 0),
    triples.Shape("Person", "nickname", "min_count", 1),
    triples.Shape("Person", "label", "datatype", "year"),
]


@query("""WITH o AS (SELECT 'o' || o_orderkey AS s, o_orderstatus AS st, CAST(round(o_totalprice) AS BIGINT) AS p FROM orders), x AS (
          SELECT s, 'status' AS path, 'in' AS kind FROM o WHERE st NOT IN ('F', 'O') UNION ALL SELECT s, 'status', 'pattern' FROM o WHERE st = 'P' UNION ALL SELECT s, 'status', 'node_kind' FROM o
          UNION ALL SELECT s, 'price', 'max_value' FROM o WHERE p > 200000 UNION ALL SELECT s, 'price', 'min_value' FROM o WHERE p < 5000
          UNION ALL SELECT 'o' || o_orderkey, 'by', 'class' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
          UNION ALL SELECT 'c' || c_custkey, u.path, u.kind FROM customer, (VALUES ('label', 'max_count'), ('nickname', 'min_count'), ('label', 'datatype')) u(path, kind))
          SELECT path, kind, count(*) AS n FROM x GROUP BY ALL""")
def shacl_kinds(t: Tables) -> DataFrame:
    return triples.violations(_graph(t), SHAPES).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'n' || n_nationkey AS s, 'label' AS p, n_name AS o, 'literal' AS o_kind, 'en' AS o_lang, CAST(NULL AS VARCHAR) AS o_datatype FROM nation UNION ALL SELECT 'n' || n_nationkey, 'said', 'a "b" \\ c' || chr(10) || n_name, 'literal', NULL, NULL FROM nation
          UNION ALL SELECT 'n' || n_nationkey, 'in', 'r' || n_regionkey, 'uri', NULL, NULL FROM nation""")
def turtle_round_trip(t: Tables) -> DataFrame:
    """Triples written as Turtle and read back."""
    s = F.concat(F.lit("n"), "n_nationkey")
    graph = triples.melt(t.nation, s, {"label": F.col("n_name")}, lang="en").unionByName(triples.melt(t.nation, s, {"said": F.concat(F.lit('a "b" \\ c\n'), "n_name"), "in": F.concat(F.lit("r"), "n_regionkey")}, links=("in",)))
    path = new_dir(t.spark, "turtle")
    turtle.to_turtle(graph).write.text(path)
    good, _ = turtle.read_turtle(t.spark, path)
    return good
