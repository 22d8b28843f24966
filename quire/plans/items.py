"""Item, probe and verdict queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import items

from .registry import Tables, query

NOW = "TIMESTAMP '1998-01-01'"


@query("""SELECT DISTINCT l_orderkey AS id, l_returnflag AS property, CAST(l_partkey AS VARCHAR) AS value FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R'
          UNION SELECT o_orderkey, '@name', lower(replace(o_orderpriority, ' ', '')) FROM orders""")
def indexed_facts(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("property"), F.when(F.col("l_linestatus") == "O", "normal").otherwise("deprecated").alias("rank"), F.when(F.col("l_returnflag") == "R", "somevalue").otherwise("value").alias("snaktype"), F.col("l_partkey").cast("string").alias("value"))
    return items.indexed_facts(rows, t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name")))


@query("""WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
          SELECT o_orderkey, coalesce(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY n, l_suppkey), '') AS "values" FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1""")
def statement_values(t: Tables) -> DataFrame:
    x = F.struct("l_linenumber", F.col("l_returnflag").alias("property"), F.col("l_suppkey").alias("value"))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(x)).alias("s"))
    return rows.select("o_orderkey", F.array_join(items.statement_values(F.col("s"), "A").cast("array<string>"), ",").alias("values"))


@query("""WITH i AS (SELECT p_partkey AS id, p_brand AS title, p_size AS record FROM part),
          n AS (SELECT record, title, min(id) AS a, count(*) AS k FROM i GROUP BY ALL), f AS (SELECT title, min(id) AS a, count(*) AS k FROM i GROUP BY ALL),
          s AS (SELECT s_suppkey, 'Brand#' || (11 + s_suppkey % 50) AS title, CAST(s_suppkey % 60 AS INTEGER) AS record FROM supplier)
          SELECT s_suppkey, CASE WHEN n.k = 1 THEN n.a WHEN n.k IS NULL AND f.k = 1 THEN f.a END AS target FROM s LEFT JOIN n ON n.record = s.record AND n.title = s.title LEFT JOIN f ON f.title = s.title""")
def local_references(t: Tables) -> DataFrame:
    all_items = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("title"), F.col("p_size").alias("record"))
    rows = t.supplier.select("s_suppkey", F.concat(F.lit("Brand#"), 11 + F.col("s_suppkey") % 50).alias("title"), (F.col("s_suppkey") % 60).cast("int").alias("record"))
    return items.resolve_references(rows, all_items).select("s_suppkey", "target")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def supported_claims(t: Tables) -> DataFrame:
    claims = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("target"))
    return items.supported_claims(claims, t.customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"))).select("o_orderkey")


@query("SELECT l_orderkey AS statement, l_suppkey AS citation, min(l_linenumber) AS ord, strftime(max(l_shipdate), '%Y-%m-%d') AS retrieved FROM lineitem GROUP BY 1, 2")
def merged_references(t: Tables) -> DataFrame:
    return items.merge_references(t.lineitem.select(F.col("l_orderkey").alias("statement"), F.col("l_suppkey").alias("citation"), F.col("l_linenumber").alias("ord"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("retrieved")))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 1 THEN 'found' WHEN s_suppkey % 2 = 0 THEN 'clear' ELSE 'not_run' END AS status FROM supplier")
def duplicate_status(t: Tables) -> DataFrame:
    live = F.when(F.col("s_nationkey") % 3 == 1, "found").when(F.col("s_nationkey") % 3 == 2, "not_run")
    return t.supplier.select("s_suppkey", items.duplicate_status(live, F.when(F.col("s_suppkey") % 2 == 0, "clear")).alias("status"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS turn FROM customer")
def fair_order(t: Tables) -> DataFrame:
    return items.fair_order(t.customer, "c_mktsegment", "c_custkey").select("c_custkey", "turn")


@query("""SELECT DISTINCT s_suppkey AS pair, a.l_orderkey AS id FROM supplier JOIN lineitem a ON a.l_suppkey = s_suppkey JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_suppkey = s_suppkey % 7 + 1""")
def attributed_hits(t: Tables) -> DataFrame:
    pairs = t.supplier.select(F.col("s_suppkey").alias("pair"), F.lit("by").alias("pid_a"), F.col("s_suppkey").alias("value_a"), F.lit("by").alias("pid_b"), (F.col("s_suppkey") % 7 + 1).alias("value_b"))
    facts = t.lineitem.select(F.col("l_orderkey").alias("id"), F.lit("by").alias("property"), F.col("l_suppkey").alias("value")).distinct()
    return items.attribute_hits(pairs, facts)


@query("""WITH h AS (SELECT DISTINCT o_custkey AS item, o_orderkey % 997 AS qid FROM orders WHERE o_orderkey % 11 = 0),
          u AS (SELECT *, count(*) OVER (PARTITION BY item) AS a, count(*) OVER (PARTITION BY qid) AS b FROM h)
          SELECT item, qid FROM u JOIN customer ON c_custkey = item WHERE a = 1 AND b = 1 AND c_nationkey % 2 = 0""")
def adopted_ids(t: Tables) -> DataFrame:
    hits = t.orders.where("o_orderkey % 11 = 0").select(F.col("o_custkey").alias("item"), (F.col("o_orderkey") % 997).alias("qid"))
    own = t.customer.select(F.col("c_custkey").alias("item"), F.when(F.col("c_nationkey") % 2 == 1, F.lit(-1)).alias("qid"))
    return items.adoptable(hits, own)


@query("""SELECT c_nationkey AS cluster FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) > 1 AND (count(DISTINCT c_custkey % 3) > 1 OR count(DISTINCT c_mktsegment) > 1)""")
def over_merged(t: Tables) -> DataFrame:
    return items.over_merged(t.customer.select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("item"), (F.col("c_custkey") % 3).alias("birth_year"), F.lit(None).cast("int").alias("death_year"), F.col("c_mktsegment").alias("occupation")))


@query("SELECT l_partkey AS cluster, count(DISTINCT l_shipdate) AS names, count(DISTINCT l_suppkey) AS ids FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_shipdate) > 1 AND count(DISTINCT l_suppkey) > 1")
def pair_collisions(t: Tables) -> DataFrame:
    return items.pair_collisions(t.lineitem.select(F.col("l_partkey").alias("cluster"), F.col("l_shipdate").alias("name"), F.col("l_suppkey").alias("authority_id")))


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS status FROM orders GROUP BY 1")
def single_or_none(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s")).select("o_custkey", items.single_or_none(F.col("s")).alias("status"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))")
def type_closure(t: Tables) -> DataFrame:
    rows, types = t.customer.select(F.col("c_custkey").alias("id")), t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("type"))
    up = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("s"), F.concat(F.lit("r"), "n_regionkey").alias("o")).union(t.region.select(F.concat(F.lit("r"), "r_regionkey"), F.when(F.col("r_regionkey").isin(1, 3), "odd").otherwise("even")))
    return items.in_type(rows, types, up, ["odd"]).select(F.col("id").alias("c_custkey"))


@query("""WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part),
          k AS (SELECT p_partkey, a, list_distinct(list_append(b, a[1])) AS b FROM w),
          n AS (SELECT p_partkey, len(list_intersect(a, b)) AS n, least(len(a), len(b)) AS m FROM k)
          SELECT p_partkey, n > 0 AND (n >= 2 OR n = m) AS same FROM n""")
def token_overlap(t: Tables) -> DataFrame:
    other = F.concat_ws(" ", "p_type", F.get(F.split("p_name", " "), F.lit(0)))
    return t.part.select("p_partkey", items.token_overlap(F.col("p_name"), other).alias("same"))


@query("""SELECT s_suppkey AS query, arg_min(p_partkey, struct_pack(a := p_size, b := p_partkey)) AS id FROM supplier JOIN part ON p_brand = 'Brand#' || (11 + s_suppkey % 50) WHERE p_partkey % 2 = 0 GROUP BY 1""")
def typed_lookup(t: Tables) -> DataFrame:
    index = t.part.select(F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "corporate").otherwise("place").alias("kind"), F.col("p_size").alias("tag"), F.col("p_partkey").alias("id"))
    return items.typed_lookup(t.supplier.select(F.col("s_suppkey").alias("query"), F.concat(F.lit("Brand#"), 11 + F.col("s_suppkey") % 50).alias("name")), index, "corporate")


@query("""WITH n AS (SELECT o_orderkey, i - 1 AS place, CASE i WHEN 1 THEN o_orderstatus ELSE o_orderpriority END AS name,
                            CASE WHEN i = 1 THEN 'scribe' WHEN o_orderkey % 2 = 0 THEN 'owner' ELSE 'scribe' END AS role FROM orders, range(1, 3) r(i))
          SELECT o_orderkey, CAST(place AS INTEGER) AS place, name, role FROM n""")
def expanded_names(t: Tables) -> DataFrame:
    role = F.when(F.col("o_orderkey") % 2 == 0, "scribe|owner").otherwise("scribe")
    rows = t.orders.select("o_orderkey", F.concat("o_orderstatus", F.lit(" | "), "o_orderpriority", F.lit("| ")).alias("name"), role.alias("role"))
    return items.expand_names(rows).select("o_orderkey", F.col("at").alias("place"), "name", "role")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, lower(l_returnflag) AS term, CASE WHEN l_linenumber % 2 = 0 THEN 'organization' ELSE 'topic' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN '610' ELSE '650' END AS field FROM lineitem WHERE l_linestatus = 'O'),
          d AS (SELECT l_orderkey, min(l_linenumber) AS k, term, kind, field FROM x GROUP BY ALL)
          SELECT l_orderkey, string_agg(term || kind || field, ' ' ORDER BY k, term) AS subjects FROM d GROUP BY 1""")
def normal_subjects(t: Tables) -> DataFrame:
    term = F.when(F.col("l_linestatus") == "O", F.when(F.col("l_linenumber") > 3, F.lower("l_returnflag")).otherwise(F.col("l_returnflag"))).otherwise(" ")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "corporate")
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", term.alias("term"), kind.alias("type"), F.lit(None).cast("string").alias("field")))).alias("s"))
    found = rows.select("l_orderkey", items.normal_subjects(F.col("s")).alias("s")).where(F.size("s") > 0)
    return found.select("l_orderkey", F.array_join(F.transform("s", lambda x: F.concat(F.lower(x["term"]), x["type"], x["field"])), " ").alias("subjects"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS certain,
                 CAST(CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) - 5 WHEN o_orderkey % 3 > 0 THEN year(o_orderdate) END AS INTEGER) AS earliest,
                 CAST(CASE WHEN o_orderkey % 5 = 0 THEN year(o_orderdate) + 5 WHEN o_orderkey % 3 > 0 THEN year(o_orderdate) END AS INTEGER) AS latest FROM orders""")
def year_band(t: Tables) -> DataFrame:
    y, k = F.year("o_orderdate"), F.col("o_orderkey")
    said = F.struct(F.when(k % 3 > 0, y.cast("string")).otherwise("unknown").alias("year"), F.lit(None).cast("string").alias("date_start"), F.when(k % 2 == 0, F.concat((y - 5).cast("string"), F.lit("-01-01T00"))).alias("year_start"), F.when(k % 5 == 0, (y + 5).cast("string")).alias("date_end"), F.lit("").alias("year_end"))
    return t.orders.select("o_orderkey", said.alias("d")).select("o_orderkey", items.year_band(F.col("d")).alias("b")).select("o_orderkey", "b.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'c' || o_custkey ELSE 'a' || o_orderkey END AS number FROM orders")
def primary_number(t: Tables) -> DataFrame:
    numbers = F.array(F.concat(F.lit("a"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"))
    return t.orders.select("o_orderkey", items.primary_number(numbers, F.lit(None).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x#c"), "o_custkey", F.lit("_1")))).alias("number"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE n_name END AS label FROM customer JOIN nation ON n_nationkey = c_nationkey")
def filled_gaps(t: Tables) -> DataFrame:
    mine = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ").alias("label"))
    other = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("label"))
    return items.fill_gaps(mine, other, "c_custkey", ["label"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand WHEN p_size > 25 THEN p_type ELSE '' END AS genres FROM part")
def folded_genres(t: Tables) -> DataFrame:
    own = F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand"))
    predicted = F.array(F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("other"), F.lit("other"), F.lit(" "))
    return t.part.select("p_partkey", F.array_join(items.fold_genres(own, predicted), ",").alias("genres"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_name ELSE 'row' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END END AS number FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)")
def synthetic_ids(t: Tables) -> DataFrame:
    return items.with_row_ids(t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("number")), "number", "c_custkey")


@query("SELECT doc_id, substr(text, 3, 8) AS span FROM documents WHERE doc_id % 2 = 0 AND length(text) >= 10 AND trim(substr(text, 3, 8), ' ') <> ''")
def grounded_spans(t: Tables) -> DataFrame:
    texts = t.documents.select(F.col("doc_id").alias("record"), "text")
    span = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 3, 8)).otherwise("\x01 not there")
    return items.grounded(t.documents.where(F.length("text") >= 10).select(F.col("doc_id").alias("record"), span.alias("span")), texts).select(F.col("record").alias("doc_id"), "span")


@query("SELECT c_custkey, CAST(length(c_name) + 1 + CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS start FROM customer")
def rebased_spans(t: Tables) -> DataFrame:
    k = F.col("c_custkey").alias("record")
    parts = t.customer.select(k, F.lit(0).alias("part"), F.col("c_name").alias("said")).union(t.customer.select(k, F.lit(1), F.concat(F.lit("!@"), F.lit("א"), "c_mktsegment")))
    spans = t.customer.select(k, F.lit(1).alias("part"), F.when(F.col("c_custkey") % 2 == 0, F.lit("א")).otherwise("!@").alias("text"), F.when(F.col("c_custkey") % 3 == 0, 40).when(F.col("c_custkey") % 2 == 0, 2).otherwise(0).alias("start"), F.lit(0).alias("end"))
    return items.rebase(spans, parts).select(F.col("record").alias("c_custkey"), "start")


@query("SELECT p_name AS title, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(*) = 1")
def title_index(t: Tables) -> DataFrame:
    return items.title_index(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")))


@query("SELECT DISTINCT l_orderkey AS record, l_suppkey AS value FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_suppkey = l.l_suppkey AND m.l_returnflag = 'N')")
def missing_claims(t: Tables) -> DataFrame:
    said = t.lineitem.select(F.col("l_orderkey").alias("record"), F.col("l_suppkey").cast("string").alias("value"))
    claims = t.lineitem.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("record"), F.concat(F.lit(" "), F.col("l_suppkey")).alias("value"))
    return items.missing_claims(said.distinct(), claims).select("record", F.col("value").cast("long").alias("value"))


@query("SELECT c_custkey AS item, CASE WHEN c_custkey % 2 = 0 THEN 'Q' || c_custkey ELSE 'q' || c_custkey END AS value FROM customer WHERE c_custkey % 2 = 1 AND c_nationkey % 3 > 0")
def identifier_errors(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("item"), F.when(F.col("c_nationkey") % 3 > 0, "qid").otherwise("free").alias("property"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "Q").otherwise("q"), "c_custkey").alias("value"))
    return items.identifier_errors(rows, {"qid": r"^Q\d+$"}).select("item", "value")


@query("""SELECT l_orderkey, CAST(count(*) FILTER (l_returnflag = 'R') AS INTEGER) AS fail_count, CAST(count(*) FILTER (l_returnflag = 'N') AS INTEGER) AS error_count, CAST(count(*) FILTER (l_returnflag = 'A') AS INTEGER) AS pass_count,
                 coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (l_returnflag = 'R'), '') AS failing FROM lineitem GROUP BY 1""")
def compact_verdict(t: Tables) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "pass").otherwise("error")
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("rule"), state.alias("state")))).alias("r"))
    return rows.select("l_orderkey", items.compact_verdict(F.col("r")).alias("v")).select("l_orderkey", "v.fail_count", "v.error_count", "v.pass_count", F.array_join(F.col("v.failing").cast("array<string>"), ",").alias("failing"))


@query("SELECT o_orderkey AS local_id, CASE WHEN o_orderkey % 2 = 0 THEN 'disk' ELSE 'stream' END AS said FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def fresh_verdicts(t: Tables) -> DataFrame:
    of = lambda n, said: t.orders.where(F.col("o_orderkey") % n == 0).select(F.col("o_orderkey").alias("local_id"), F.lit(said).alias("said"))
    return items.merge_fresh(of(3, "stream"), of(2, "disk"), "local_id")


@query("SELECT count(*) FILTER (s_suppkey % 4 = 0 OR s_nationkey = 3 OR s_suppkey % 7 = 0) AS failures FROM supplier")
def judge_failures(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    verdicts = t.supplier.select(F.when(k % 4 == 0, "judge_failure").otherwise("full").alias("overall"), F.lit(None).cast("boolean").alias("failed"), F.when(F.col("s_nationkey") == 3, "provider_error").alias("status"), F.when(k % 7 == 0, "timeout").otherwise(" ").alias("error"))
    return verdicts.agg(F.count_if(F.size(items.failure_signs(verdicts)) > 0).alias("failures"))


@query("""WITH s AS (SELECT s_suppkey, list_filter([CASE WHEN s_nationkey > 20 THEN 'scope not covered' END, CASE WHEN s_suppkey % 11 = 0 THEN 'judge failures' END, CASE WHEN s_suppkey % 3 = 1 THEN 'runner failed' END,
                 CASE WHEN s_suppkey % 13 = 0 THEN 'runner never ended' END, CASE WHEN s_suppkey % 17 = 0 THEN 'no judge' END, CASE WHEN s_suppkey % 5 = 0 THEN 'error' END], lambda x: x IS NOT NULL) AS r FROM supplier)
          SELECT s_suppkey, CASE WHEN len(r) > 0 THEN 'partial' ELSE 'complete' END AS outcome, array_to_string(r, '; ') AS reasons FROM s""")
def session_outcome(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    sessions = t.supplier.select(
        "s_suppkey", F.lit(10).alias("scope"), F.when(F.col("s_nationkey") > 20, 9).otherwise(10).alias("judged"), F.lit(2).alias("uncached"), (k % 17 == 0).alias("unavailable"), F.when(k % 11 == 0, 3).otherwise(0).alias("failures"),
        F.when(k % 3 == 1, 2).alias("exit_code"), (k % 13 != 0).alias("saw_exit"), F.when(k % 5 == 0, "lost").when(k % 5 == 1, " ").alias("error"),
    )
    return items.session_reasons(sessions).select("s_suppkey", "outcome", F.array_join("reasons", "; ").alias("reasons"))


@query("SELECT left(sha256(count(*) || '|' || min(o_orderkey) || '|' || max(o_orderkey) || '|plain'), 16) AS signature FROM orders")
def build_signature(t: Tables) -> DataFrame:
    return items.build_signature(t.orders.select(F.col("o_orderkey").alias("k")), "k", "plain")


@query("SELECT strftime((SELECT max(o_orderdate) FROM orders), '%Y-%m-%d %H:%M:%S') || '|-|' || strftime((SELECT max(l_shipdate) FROM lineitem), '%Y-%m-%d %H:%M:%S') AS fingerprint")
def view_fingerprint(t: Tables) -> DataFrame:
    return items.view_fingerprint(t.orders.select("o_orderdate"), t.orders.where("o_orderkey < 0").select("o_orderdate"), t.lineitem.select("l_shipdate"))


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0 OR o_orderdate < {NOW} - INTERVAL 7 DAY")
def stale_rows(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate")).alias("at"))
    return items.stale(rows, "at", F.expr("TIMESTAMP_NTZ '1998-01-01'")).select("o_orderkey")


@query("""WITH k AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 10 > 0), m AS (SELECT max(c_custkey) AS m FROM k)
          SELECT c_custkey AS id, c_custkey AS ord, 'old' AS said FROM k UNION ALL SELECT c_custkey, m + row_number() OVER (ORDER BY c_custkey), 'new' FROM customer, m WHERE c_custkey % 10 = 0""")
def patched_rows(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), F.lit("old").alias("said"))
    return items.patch_rows(rows, rows.where("id % 10 = 0").select("id", F.lit("new").alias("said")), "id", "ord")


@query("""SELECT p_partkey, row_number() OVER (ORDER BY CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 9 END, p_partkey) AS turn FROM part""")
def upload_order(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") % 4 == 0, "Work").when(F.col("p_size") % 4 == 1, "person").when(F.col("p_size") % 4 == 2, "manuscript").otherwise("place")
    return items.in_upload_order(t.part.select("p_partkey", kind.alias("entity_type"), F.col("p_partkey").alias("local_id"))).select("p_partkey", "turn")


@query("SELECT c_custkey, CAST(ceil(row_number() OVER (ORDER BY c_custkey) / 64) AS BIGINT) AS shard FROM customer")
def shard_slices(t: Tables) -> DataFrame:
    return items.shards(t.customer.select("c_custkey"), "c_custkey", 64)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS source FROM customer")
def uploaded_items(t: Tables) -> DataFrame:
    of = lambda n: t.customer.where(F.col("c_custkey") % n == 0).select(F.col("c_custkey").alias("id"), F.lit(n).alias("said"))
    return items.by_authority(of(4), of(2), of(1), key="id").select("id", "source")


@query(f"""SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0 AND o_orderdate >= {NOW} - INTERVAL 7 DAY)""")
def pending_keys(t: Tables) -> DataFrame:
    return items.to_enrich(t.orders, t.orders.where("o_orderkey % 5 = 0").select("o_custkey", F.col("o_orderdate").alias("observed")), ["o_custkey"], F.expr("TIMESTAMP_NTZ '1998-01-01'"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0")
def changed_only(t: Tables) -> DataFrame:
    new = t.customer.select("c_custkey", "c_name")
    old = t.customer.where("c_custkey % 5 > 0").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("c_name"))
    return items.changed_only(new, old, ["c_custkey"], "c_name").select("c_custkey")


@query("SELECT p_brand AS key, count(*) + 1 AS version FROM part GROUP BY 1 UNION ALL SELECT 'new', 1")
def next_version(t: Tables) -> DataFrame:
    had = t.part.groupBy(F.col("p_brand").alias("key")).agg(F.count(F.lit(1)).alias("version"))
    new = t.part.select(F.col("p_brand").alias("key")).distinct().union(t.region.limit(1).select(F.lit("new")))
    return items.next_version(had, new, "key")


@query("SELECT c_nationkey AS place, count(DISTINCT c_mktsegment) AS n, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS items FROM customer WHERE c_nationkey % 4 > 0 GROUP BY 1")
def place_dots(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_nationkey").alias("place"), F.when(F.col("c_nationkey") % 4 > 0, 31.5).alias("lat"), F.lit(35.2).alias("lon"), "c_mktsegment")
    return items.place_dots(rows, "c_mktsegment").select("place", F.col("n").cast("long").alias("n"), F.array_join("items", ",").alias("items"))


@query("SELECT lower(replace(c_name, '#', '')) AS name, c_mktsegment AS kind, 'former_owner' AS role, count(*) AS n FROM customer GROUP BY ALL")
def match_keys(t: Tables) -> DataFrame:
    key = items.match_key(F.lit("1"), F.col("c_name"), F.col("c_mktsegment"), F.lit(" Former owner"))
    return t.customer.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.col("k.name").alias("name"), F.col("k.kind").alias("kind"), F.col("k.role").alias("role"), "n")
