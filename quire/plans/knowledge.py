"""Analytics, triples, graphs and event histories on the driver's tables.

Orders stand for manuscripts, parts for works, customers for owners, suppliers for scribes, nations for places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import analytics, components, events, graphs, rules, triples

from .registry import Tables, query


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS b, l_partkey AS i FROM lineitem)
          SELECT x.i AS item_a, y.i AS item_b, count(*) AS n FROM m x JOIN m y ON x.b = y.b AND x.i < y.i GROUP BY 1, 2 ORDER BY n DESC, item_a, item_b LIMIT 1000""")
def cooccurrence(t: Tables) -> DataFrame:
    return analytics.co_occurrence(t.lineitem, box="l_orderkey", item="l_partkey")


@query("""SELECT count(DISTINCT l_orderkey) AS manuscripts, count(DISTINCT l_partkey) AS works, count(DISTINCT l_suppkey) AS scribes, count(*) AS triples FROM lineitem""")
def summary_counts(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_distinct("l_orderkey").alias("manuscripts"), F.count_distinct("l_partkey").alias("works"), F.count_distinct("l_suppkey").alias("scribes"), F.count(F.lit(1)).alias("triples"))


@query("""WITH r AS (SELECT 'c' || o_custkey AS person, o_orderkey AS ms, 'owner' AS role, 1 AS p FROM orders UNION ALL SELECT 's' || l_suppkey, l_orderkey, 'scribe', 3 FROM lineitem)
          SELECT person, arg_max(role, p) AS role, count(DISTINCT ms) AS n_boxes FROM r GROUP BY 1""")
def people_network(t: Tables) -> DataFrame:
    owners = t.orders.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("person"), F.col("o_orderkey").alias("ms"), F.lit("owner").alias("role"))
    scribes = t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("person"), F.col("l_orderkey").alias("ms"), F.lit("scribe").alias("role"))
    return analytics.main_roles(owners.union(scribes), {"scribe": 3, "author": 2, "owner": 1}, person="person", box="ms", role="role")


@query("""WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2)
          SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), '>' ORDER BY o, l_suppkey) AS chain, CAST(count(*) AS INTEGER) AS length FROM f GROUP BY 1""")
def ownership_chains(t: Tables) -> DataFrame:
    return analytics.chains(t.lineitem, box="l_orderkey", member="l_suppkey", order=F.col("l_linenumber"))


_PLACES = """SELECT c_nationkey AS place, o_orderkey AS ms, 'mentioned' AS kind FROM orders JOIN customer ON c_custkey = o_custkey
             UNION ALL SELECT s_nationkey, l_orderkey, 'production' FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""


def _places(t: Tables) -> DataFrame:
    said = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("place"), F.col("o_orderkey").alias("ms"), F.lit("mentioned").alias("kind"))
    made = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("place"), F.col("l_orderkey").alias("ms"), F.lit("production").alias("kind"))
    return said.union(made)


@query(f"SELECT place, count(DISTINCT ms) AS weight, min(kind) AS kind FROM ({_PLACES}) GROUP BY 1")
def geography(t: Tables) -> DataFrame:
    return _places(t).groupBy("place").agg(F.count_distinct("ms").alias("weight"), F.min("kind").alias("kind"))


@query(f"""WITH o AS (SELECT place, ms, min(kind) AS k FROM ({_PLACES}) GROUP BY 1, 2)
           SELECT place, count(*) AS weight, CASE WHEN min(k) <> max(k) THEN 'both' ELSE min(k) END AS kind FROM o GROUP BY 1""")
def heatmap(t: Tables) -> DataFrame:
    return analytics.places(_places(t), place="place", box="ms", kind="kind")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def year_histogram(t: Tables) -> DataFrame:
    return analytics.histogram(t.orders.where("o_orderstatus <> 'P'"), F.year("o_orderdate"))


@query("SELECT CAST((year(l_shipdate) - 1) // 100 + 1 AS INTEGER) AS century, CAST(year(l_shipdate) // 25 * 25 AS INTEGER) AS quarter, count(*) AS n FROM lineitem GROUP BY 1, 2")
def century_histogram(t: Tables) -> DataFrame:
    y = F.year("l_shipdate")
    return t.lineitem.groupBy(analytics.century(y).alias("century"), analytics.quarter_century(y).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def facet_counts(t: Tables) -> DataFrame:
    return analytics.facet_counts(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("""SELECT min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, (SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders) AS priorities FROM orders""")
def facets_sorted(t: Tables) -> DataFrame:
    return t.orders.agg(F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("""SELECT 'p_name' AS field, count(*) AS n, count(*) FILTER (trim(p_name) <> '') AS n_with, round(avg(CASE WHEN trim(p_name) <> '' THEN 1.0 ELSE 0 END), 6) AS share FROM part
          UNION ALL SELECT 'p_brand', count(*), count(*) FILTER (trim(p_brand) <> ''), round(avg(CASE WHEN trim(p_brand) <> '' THEN 1.0 ELSE 0 END), 6) FROM part""")
def coverage_rates(t: Tables) -> DataFrame:
    return analytics.coverage(t.part, ["p_name", "p_brand"])


def _states(t: Tables) -> DataFrame:
    yes = F.lit(True)
    return rules.evaluate(t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("item"), "*"), "item", [
        ("discount_low", yes, F.col("l_discount") <= 0.08), ("tax_low", F.col("l_returnflag") == "A", F.col("l_tax") <= 0.05), ("quantity", yes, F.col("l_quantity") >= 2),
    ])


_STATES = """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS item, unnest([{'rule': 'discount_low', 'state': CASE WHEN l_discount <= 0.08 THEN 'pass' ELSE 'fail' END},
             {'rule': 'tax_low', 'state': CASE WHEN l_returnflag <> 'A' THEN 'not_relevant' WHEN l_tax <= 0.05 THEN 'pass' ELSE 'fail' END}, {'rule': 'quantity', 'state': CASE WHEN l_quantity >= 2 THEN 'pass' ELSE 'fail' END}]) AS x FROM lineitem"""


@query(f"""SELECT x.rule AS rule, count(*) FILTER (x.state = 'pass') AS n_pass, count(*) FILTER (x.state = 'fail') AS n_fail, count(*) FILTER (x.state = 'error') AS n_error, count(*) FILTER (x.state = 'not_relevant') AS n_not_relevant FROM ({_STATES}) GROUP BY 1""")
def rule_tallies(t: Tables) -> DataFrame:
    return rules.tallies(_states(t))


@query(f"""SELECT item, CASE max(CASE x.state WHEN 'fail' THEN 3 WHEN 'error' THEN 2 WHEN 'pass' THEN 1 ELSE 0 END) WHEN 3 THEN 'fail' WHEN 2 THEN 'error' WHEN 1 THEN 'pass' ELSE 'not_relevant' END AS worst,
           count(*) FILTER (x.state = 'pass') AS n_pass, coalesce(string_agg(DISTINCT CASE WHEN x.state = 'fail' THEN x.rule END, ',' ORDER BY CASE WHEN x.state = 'fail' THEN x.rule END), '') AS failing FROM ({_STATES}) GROUP BY 1""")
def worst_states(t: Tables) -> DataFrame:
    return analytics.worst_state(_states(t), key="item")


_SCORED = """SELECT d.source AS bucket, (d.n_chars % 15 + 85) / 100.0 AS confidence, l.quality = 1 AS "full" FROM documents d JOIN labels l USING (doc_id)"""


@query(f"""WITH r AS ({_SCORED}), th AS (SELECT i / 100.0 AS threshold FROM range(85, 100) t(i)),
           g AS (SELECT bucket, threshold, count(*) AS n, count(*) FILTER ("full") / count(*) AS p FROM r JOIN th ON confidence >= threshold GROUP BY 1, 2),
           b AS (SELECT bucket, min(threshold) FILTER (p >= 0.9) AS good, max(p) AS peak FROM g GROUP BY 1),
           c AS (SELECT g.bucket, coalesce(good, min(threshold) FILTER (p = peak)) AS threshold, good IS NOT NULL AS target_reached FROM g JOIN b USING (bucket) GROUP BY g.bucket, good),
           n AS (SELECT bucket, count(*) AS n_total FROM r GROUP BY 1)
           SELECT bucket, n_total, CAST(threshold AS DOUBLE) AS threshold, round(p, 6) AS precision, n AS n_above, target_reached FROM c JOIN g USING (bucket, threshold) JOIN n USING (bucket)""")
def calibration_threshold(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").select(F.col("source").alias("bucket"), ((F.col("n_chars") % 15 + 85) / 100).alias("confidence"), (F.col("quality") == 1).alias("full"), F.lit(None).cast("string").alias("error"))
    return analytics.calibrate(rows)


@query("SELECT d.source AS bucket, count(*) AS n, round(avg(CASE WHEN l.quality = 1 THEN 1.0 ELSE 0 END), 6) AS precision FROM documents d JOIN labels l USING (doc_id) GROUP BY 1")
def precision_buckets(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").groupBy(F.col("source").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("quality") == 1).cast("int")), 6).alias("precision"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 70")
def having_over_cap(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 70")


@query("""SELECT count(*) AS n, CAST(sum(CAST('0x' || substring(md5(concat_ws('|', c_custkey, c_name, c_mktsegment)), 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM customer""")
def corpus_fingerprint(t: Tables) -> DataFrame:
    return analytics.fingerprint(t.customer, ["c_custkey", "c_name", "c_mktsegment"])


# triples


def _orders(t: Tables) -> DataFrame:
    return triples.melt(
        t.orders, F.concat(F.lit("o"), F.col("o_orderkey")),
        {"type": F.lit("order"), "owner": F.concat(F.lit("c"), F.col("o_custkey")), "status": F.col("o_orderstatus"), "priority": F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")), "label": F.concat(F.lit("Order "), F.col("o_orderkey"))},
        links=("type", "owner"),
    )


def _customers(t: Tables) -> DataFrame:
    return triples.melt(t.customer, F.concat(F.lit("c"), F.col("c_custkey")), {"type": F.lit("customer"), "nation": F.concat(F.lit("n"), F.col("c_nationkey")), "label": F.col("c_name")}, links=("type", "nation"))


def _graph(t: Tables) -> DataFrame:
    return _orders(t).unionByName(_customers(t))


@query("SELECT 'o' || o_orderkey AS o, 'c' || o_custkey AS c FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_nationkey = 3")
def sparql_bgp(t: Tables) -> DataFrame:
    return triples.basic(_graph(t), ("?o", "status", "F"), ("?o", "owner", "?c"), ("?c", "nation", "n3")).select("o", "c")


@query("SELECT 'o' || o_orderkey AS o, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS p FROM orders WHERE o_orderstatus = 'P'")
def sparql_optional(t: Tables) -> DataFrame:
    g = _orders(t)
    return triples.optional(triples.pattern(g, "?o", "status", "P"), triples.pattern(g, "?o", "priority", "?p"))


@query("SELECT 'o' || o_orderkey AS s FROM orders WHERE o_orderstatus = 'P' UNION SELECT 'c' || c_custkey FROM customer WHERE c_nationkey = 1")
def sparql_union(t: Tables) -> DataFrame:
    g = _graph(t)
    return triples.union(triples.pattern(g, "?s", "status", "P"), triples.pattern(g, "?s", "nation", "n1")).distinct()


@query("SELECT 'o' || o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' AND NOT (o_orderkey % 5 > 0 AND o_orderpriority = '5-LOW')")
def sparql_minus(t: Tables) -> DataFrame:
    g = _orders(t)
    return triples.minus(triples.pattern(g, "?o", "status", "F"), triples.pattern(g, "?o", "priority", "5-LOW"))


@query("SELECT 'c' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def sparql_not_exists(t: Tables) -> DataFrame:
    g = _graph(t)
    owners = triples.basic(g, ("?o", "status", "P"), ("?o", "owner", "?c")).select("c").distinct()
    return triples.minus(triples.pattern(g, "?c", "type", "customer"), owners)


@query("SELECT 'c' || o_custkey AS c, count(*) AS n, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1 HAVING count(*) > 12")
def sparql_group_count(t: Tables) -> DataFrame:
    b = triples.basic(_orders(t), ("?o", "owner", "?c"), ("?o", "status", "?st"))
    return b.groupBy("c").agg(F.count_distinct("o").alias("n"), F.array_join(F.array_sort(F.collect_set("st")), ";").alias("statuses")).where("n > 12")


def _tree(t: Tables) -> DataFrame:
    return triples.melt(t.customer.where("c_custkey > 0"), F.concat(F.lit("c"), F.col("c_custkey")), {"under": F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 6))}, links=("under",))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS s, c_custkey // 6 AS o FROM customer WHERE c_custkey > 0), p(s, o, d) AS (SELECT s, o, 1 FROM e UNION SELECT p.s, e.o, d + 1 FROM p JOIN e ON p.o = e.s WHERE d < 6)
          SELECT DISTINCT 'c' || s AS s, 'c' || o AS o FROM p""")
def sparql_path_plus(t: Tables) -> DataFrame:
    return triples.path_plus(_tree(t), "under")


@query("SELECT 'c' || o_custkey AS s, 'owns' AS p, 'o' || o_orderkey AS o FROM orders UNION SELECT 'o' || o_orderkey, 'ownedBy', 'c' || o_custkey FROM orders")
def sparql_construct(t: Tables) -> DataFrame:
    return triples.construct(triples.pattern(_orders(t), "?o", "owner", "?c"), ("?c", "owns", "?o"), ("?o", "ownedBy", "?c"))


@query("SELECT n_regionkey AS graph_id, 'c' || c_custkey AS c, c_name AS label FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey % 2 = 0")
def sparql_federated(t: Tables) -> DataFrame:
    own = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    g = own.select(F.col("n_regionkey").alias("graph_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("s"), F.explode(F.create_map(F.lit("label"), F.col("c_name"), F.lit("even"), (F.col("c_nationkey") % 2 == 0).cast("string"))).alias("p", "o"))
    return triples.basic(g, ("?c", "even", "true"), ("?c", "label", "?label")).select("graph_id", "c", "label")


@query("SELECT 'c' || c_custkey AS s, c_name AS label FROM customer WHERE c_custkey < 50")
def sparql_template_label(t: Tables) -> DataFrame:
    wanted = t.customer.where("c_custkey < 50").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("s"))
    return triples.label_of(_graph(t)).join(wanted, "s", "left_semi")


@query("SELECT p, count(*) AS n, count(*) FILTER (p IN ('type', 'owner')) AS n_links FROM (SELECT unnest(['type', 'owner', 'status', 'label']) AS p FROM orders UNION ALL SELECT 'priority' FROM orders WHERE o_orderkey % 5 > 0) GROUP BY 1 ORDER BY n DESC, p LIMIT 30")
def property_usage(t: Tables) -> DataFrame:
    return analytics.property_usage(_orders(t))


@query("SELECT n_regionkey AS o, count(*) AS n FROM (SELECT DISTINCT n_nationkey, n_regionkey FROM nation UNION SELECT n_nationkey, n_regionkey FROM nation) GROUP BY 1")
def graph_union(t: Tables) -> DataFrame:
    g = triples.melt(t.nation, F.col("n_name"), {"region": F.col("n_regionkey")})
    return triples.merge(g, g).groupBy(F.col("o").cast("int").alias("o")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'c' || c_custkey AS s, CASE WHEN c_custkey % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM customer WHERE (c_custkey % 2 = 0) <> (c_custkey % 3 = 0) AND (c_custkey % 2 = 0 OR c_custkey % 3 = 0)""")
def graph_except_both(t: Tables) -> DataFrame:
    part = lambda k: triples.melt(t.customer.where(F.col("c_custkey") % k == 0), F.concat(F.lit("c"), F.col("c_custkey")), {"label": F.col("c_name")})
    return triples.difference(part(2), part(3)).select("s", "side")


@query("""SELECT 'c' || c_custkey AS s, 'label' AS p, CASE WHEN c_custkey % 10 = 0 THEN 'New ' || c_custkey ELSE c_name END AS o FROM customer UNION ALL SELECT 'c' || c_custkey, 'nation', 'n' || c_nationkey FROM customer UNION ALL SELECT 'c' || c_custkey, 'type', 'customer' FROM customer""")
def triple_override(t: Tables) -> DataFrame:
    new = triples.melt(t.customer.where("c_custkey % 10 = 0"), F.concat(F.lit("c"), F.col("c_custkey")), {"label": F.concat(F.lit("New "), F.col("c_custkey"))})
    return triples.override(_customers(t), new).select("s", "p", "o")


@query("SELECT 'o' || o_orderkey AS s, CAST(0 AS BIGINT) AS n FROM orders WHERE o_orderkey % 5 = 0")
def shacl_cardinality(t: Tables) -> DataFrame:
    return triples.cardinality_violations(_orders(t), "order", "priority", least=1, most=1)


@query("SELECT l_orderkey AS s, strftime(min(l_shipdate), '%Y-%m-%d') AS a, strftime(max(o_orderdate), '%Y-%m-%d') AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING a > b")
def shacl_date_order(t: Tables) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_shipdate").alias("d"))
    g = triples.melt(shipped, F.col("k"), {"shipped": day("d")}).unionByName(triples.melt(t.orders, F.col("o_orderkey"), {"ordered": day("o_orderdate")}))
    return triples.order_violations(g, "shipped", "ordered")


@query("""SELECT '<c' || c_custkey || '> <label> "' || c_name || '" .' AS value FROM customer UNION ALL SELECT '<c' || c_custkey || '> <nation> <n' || c_nationkey || '> .' FROM customer UNION ALL SELECT '<c' || c_custkey || '> <type> <customer> .' FROM customer""")
def ntriples_lines(t: Tables) -> DataFrame:
    return triples.to_ntriples(triples.from_ntriples(triples.to_ntriples(_customers(t))))


# graphs


def _edges(t: Tables) -> DataFrame:
    pair = lambda a, b, label: (a.alias("a"), b.alias("b"), F.lit(label).alias("label"))
    of = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    return (
        t.customer.select(*pair(of("c", "c_custkey"), of("n", "c_nationkey"), "lives"))
        .union(t.supplier.select(*pair(of("s", "s_suppkey"), of("n", "s_nationkey"), "works")))
        .union(t.nation.select(*pair(of("n", "n_nationkey"), of("r", "n_regionkey"), "in")))
    )


_EDGES = "SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"
_STEPS = f"e AS ({_EDGES}), st AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


@query(f"WITH {_STEPS} SELECT a AS node, count(*) AS degree FROM st GROUP BY 1")
def degree(t: Tables) -> DataFrame:
    return graphs.symmetric(_edges(t)).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


@query(f"WITH {_STEPS} SELECT b AS node, CASE WHEN b LIKE 'c%' THEN 'lives' WHEN b LIKE 's%' THEN 'works' ELSE 'in' END AS label FROM st WHERE a = 'n3'")
def neighbours(t: Tables) -> DataFrame:
    return graphs.neighbours(_edges(t), "n3")


@query(f"WITH RECURSIVE {_STEPS}, w(node, hops) AS (SELECT 'r1', 0 UNION SELECT b, hops + 1 FROM w JOIN st ON a = node WHERE hops < 2) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY 1")
def bfs_radius(t: Tables) -> DataFrame:
    return graphs.within(_edges(t), t.spark.range(1).select(F.lit("r1").alias("node")), 2)


@query("""SELECT 0 AS hop, 'c1' AS node UNION ALL SELECT 1, 'n' || c_nationkey FROM customer WHERE c_custkey = 1 UNION ALL SELECT 2, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1""")
def shortest_path(t: Tables) -> DataFrame:
    region = t.customer.where("c_custkey = 1").join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat(F.lit("r"), "n_regionkey").alias("r")).first()["r"]
    return graphs.shortest_path(_edges(t), "c1", region)


def _nodes(t: Tables) -> DataFrame:
    d = graphs.symmetric(_edges(t)).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    kind = F.substring("id", 1, 1)
    return d.select("id", kind.alias("type"), "degree", (kind == "r").alias("must"), F.concat(F.lit("node "), "id").alias("haystack"))


_NODES = f"WITH {_STEPS}, nd AS (SELECT a AS id, substring(a, 1, 1) AS type, count(*) AS degree, substring(a, 1, 1) = 'r' AS must FROM st GROUP BY 1)"


@query(f"{_NODES} SELECT id, degree FROM nd ORDER BY must DESC, degree DESC, id LIMIT 100")
def viewport_default(t: Tables) -> DataFrame:
    return graphs.viewport(_nodes(t), _edges(t), budget=100).select("id", "degree")


@query(f"{_NODES}, h AS (SELECT id FROM nd WHERE contains(id, 'n1')), x AS (SELECT id FROM h UNION SELECT b FROM st JOIN h ON a = id) SELECT id, degree FROM nd WHERE id IN (SELECT id FROM x) ORDER BY must DESC, degree DESC, id LIMIT 60")
def viewport_search_expand(t: Tables) -> DataFrame:
    return graphs.viewport(_nodes(t), _edges(t), search="N1", budget=60).select("id", "degree")


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS a, o_custkey // 10 * 10 AS b FROM orders WHERE o_custkey % 3 > 0), st AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, b FROM st UNION SELECT r.a, st.b FROM r JOIN st ON r.b = st.a)
          SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY 1""")
def connected_components(t: Tables) -> DataFrame:
    e = t.orders.where("o_custkey % 3 > 0").select(F.col("o_custkey").alias("a"), (F.floor(F.col("o_custkey") / 10) * 10).alias("b"))
    return components.connected_components(e)


# event histories


def _history(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    patch = F.create_map(F.col("event_type"), F.when(F.col("event_id") % 7 > 0, F.get_json_object("props", "$.k")))
    state = F.map_filter(patch, lambda k, v: v.isNotNull())
    return t.events.select(F.col("user_id").alias("entity_id"), n.alias("rev"), "event_id", patch.alias("patch"), state.alias("state")).withColumn("op", F.when(F.col("rev") == 1, "create").otherwise("patch")).withColumn("state", F.when(F.col("rev") == 1, F.col("state")))


def _flat(states: DataFrame) -> DataFrame:
    return states.select("entity_id", F.col("rev").cast("long").alias("rev"), F.explode("state").alias("key", "value"))


def _fold_sql(upto: str) -> str:
    return f"""WITH h AS (SELECT user_id, event_type, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rev FROM events),
               u AS (SELECT * FROM h WHERE rev <= {upto}), m AS (SELECT user_id, max(rev) AS rev FROM u GROUP BY 1),
               l AS (SELECT user_id, event_type, arg_max(CASE WHEN event_id % 7 > 0 THEN coalesce(props->>'$.k', '') END, rev) AS x, max_by(event_id % 7 > 0, rev) AS live, max_by(props->>'$.k', rev) AS v FROM u GROUP BY 1, 2)
               SELECT l.user_id AS entity_id, m.rev AS rev, event_type AS key, v AS value FROM l JOIN m USING (user_id) WHERE live"""


@query(_fold_sql("1000000"))
def replay_state(t: Tables) -> DataFrame:
    return _flat(events.states_at(_history(t)))


@query(_fold_sql("20"))
def state_at_rev(t: Tables) -> DataFrame:
    return _flat(events.states_at(_history(t), 20))


@query(f"""WITH a AS ({_fold_sql("20")}), b AS ({_fold_sql("30")}) SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, coalesce(a.key, b.key) AS key, a.value AS before, b.value AS after
           FROM a FULL JOIN b ON a.entity_id = b.entity_id AND a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def rev_diff(t: Tables) -> DataFrame:
    h = _history(t)
    return events.changed(events.states_at(h, 20), events.states_at(h, 30))


@query(f"""SELECT entity_id, n + 1 AS rev, coalesce(k, 0) AS n_keys FROM (SELECT user_id AS entity_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 20) LEFT JOIN (SELECT entity_id, count(*) AS k FROM ({_fold_sql("20")}) GROUP BY 1) USING (entity_id)""")
def revert_events(t: Tables) -> DataFrame:
    return events.revert(_history(t), 20).select("entity_id", F.col("rev").cast("long").alias("rev"), F.size("state").cast("long").alias("n_keys"))


@query("SELECT event_id, CAST(n + (n - 1) // 49 AS INTEGER) AS rev FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)")
def revisioned_upsert(t: Tables) -> DataFrame:
    return events.number_events(t.events.withColumnRenamed("user_id", "entity_id"), order=["ts", "event_id"]).select("event_id", F.col("rev").cast("int").alias("rev"))


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS bucket, CAST(hour(ts) // 8 AS INTEGER) AS slot, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2, 3""")
def slot_snapshots(t: Tables) -> DataFrame:
    return events.slot_snapshots(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", F.col("bucket").cast("string").alias("bucket"), "slot", "event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r > 40")
def prune_plan(t: Tables) -> DataFrame:
    return events.prune_plan(t.events, "user_id", ["ts", "event_id"], keep=40).select("event_id")


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type, count(*) OVER (PARTITION BY user_id) - 40 AS excess FROM events),
          r AS (SELECT event_id, excess, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM e WHERE event_type NOT IN ('signup', 'view')) SELECT event_id FROM r WHERE place <= excess""")
def prune_plan_anchors(t: Tables) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "view", "snapshot").otherwise("patch")
    return events.prune_plan(t.events.withColumn("op", op), "user_id", ["ts", "event_id"], keep=40).select("event_id")


@query("SELECT event_id FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') > CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 20 END")
def expiry(t: Tables) -> DataFrame:
    days = F.when(F.col("event_type") == "click", 10).when(F.col("event_type") == "view", 20)
    return events.expired(t.events, "ts", F.to_date(F.lit("2024-02-01")), days).select("event_id")


@query("""SELECT user_id, count(*) FILTER (event_type = 'signup') AS n_approved, max_by(event_type, (ts, event_id)) = 'signup' AS approved FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1""")
def approval_fold(t: Tables) -> DataFrame:
    votes = t.events.where("event_type in ('signup', 'error')")
    return votes.groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("n_approved"), (F.max_by("event_type", F.struct("ts", "event_id")) == "signup").alias("approved"))
