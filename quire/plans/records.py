"""Text, dates, JSON, records and exports on the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import dates, text, values
from quire.operators import paging, projection, rules
from quire.sources import readers, writers

from .registry import Tables, query


@query(r"""SELECT c_custkey, 'urn:quire:person_' || regexp_replace(regexp_replace(c_name, '[^\w\s-]', '', 'g'), '[-\s]+', '_', 'g') AS uri FROM customer""")
def slug(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.mint("person", F.col("c_name")).alias("uri"))


@query("SELECT p_partkey, lower(p_name) AS key FROM part")
def name_key(t: Tables) -> DataFrame:
    shown = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substr("p_name", F.lit(2)), F.lit(" ."))
    return t.part.select("p_partkey", text.name_key(shown).alias("key"))


@query("SELECT n_nationkey, i AS ord, s[i] AS slot FROM (SELECT n_nationkey, [n_name, '', CAST(n_regionkey AS VARCHAR)] AS s FROM nation) x, unnest(range(1, 4)) u(i)")
def slot_split(t: Tables) -> DataFrame:
    cell = F.concat_ws("|", "n_name", F.lit(" "), F.col("n_regionkey").cast("string"))
    return t.nation.select("n_nationkey", F.posexplode(text.split_slots(cell)).alias("p", "slot")).select("n_nationkey", (F.col("p") + 1).cast("long").alias("ord"), "slot")


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS name, string_split(p_type || ' ' || p_brand, ' ')[1] AS value FROM part UNION ALL SELECT p_partkey, string_split(p_name, ' ')[2], string_split(p_type || ' ' || p_brand, ' ')[2] FROM part")
def positional_align(t: Tables) -> DataFrame:
    pairs = text.align(F.split("p_name", " "), F.split(F.concat_ws(" ", "p_type", "p_brand"), " "))
    return t.part.select("p_partkey", F.explode(pairs).alias("x")).select("p_partkey", "x.name", "x.value")


@query("SELECT p_partkey, p_name AS core FROM part")
def title_core(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.title_core(F.concat(F.lit("על חלק "), "p_name", F.lit(" ;. "))).alias("core"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'he' WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 THEN 'en' ELSE 'he' END AS language FROM documents")
def label_language(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.label_language(F.coalesce("text", F.lit(""))).alias("language"))


@query("SELECT a, b, a - 5 <= b + 10 AND b - 5 <= a + 10 AS overlaps FROM (SELECT o_orderkey % 200 + 1400 AS a, o_custkey % 150 + 1420 AS b FROM orders) x")
def dates_overlap(t: Tables) -> DataFrame:
    x = t.orders.select((F.col("o_orderkey") % 200 + 1400).alias("a"), (F.col("o_custkey") % 150 + 1420).alias("b"))
    return x.select("a", "b", dates.overlap(F.col("a"), F.col("a") + 10, F.col("b"), F.col("b") + 10).alias("overlaps"))


#: One text for each form of dates, and what it means: first and last year, whether it is approximate, and the form. ``y`` is a year, ``z`` a later
#: one, ``c`` and ``d`` centuries, ``h`` the letters of year ``y``, ``o`` those of century ``c``, ``e`` those of a Seleucid year.
SAID = [
    ("{h} לשטרות ({y})", "y", "y", "false", "seleucid_era"),
    ("{e} לשטרות", "e + 688", "e + 688", "true", "seleucid_era"),
    ("{h} ({y})", "y", "y", "false", "publication_hebrew_year"),
    ("{y} בערך-{z}", "y", "z", "true", "hebrew_approximate"),
    ("בערך {y}-{z}", "y", "z", "true", "hebrew_approximate"),
    ("נפטר {y}", "NULL", "y", "false", "hebrew_approximate"),
    ("נפטר {y} בערך", "NULL", "y", "true", "hebrew_approximate"),
    ("נולד {y}", "y", "NULL", "false", "hebrew_approximate"),
    ("נולד {y} בערך", "y", "NULL", "true", "hebrew_approximate"),
    ("{y} בערך", "y", "y", "true", "hebrew_approximate"),
    ("פעל במאה ה-{c}-{d}", "100 * c - 99", "100 * d", "true", "hebrew_active"),
    ("פעל במאה ה{o}", "100 * c - 99", "100 * c", "true", "hebrew_active"),
    ("פעיל {y}", "y", "y", "true", "hebrew_active"),
    ("המאה ה-{c}-{d}", "100 * c - 99", "100 * d", "true", "hebrew_century"),
    ("המאה ה-{c}", "100 * c - 99", "100 * c", "true", "hebrew_century"),
    ("המאה ה{o}", "100 * c - 99", "100 * c", "true", "hebrew_century"),
    ("approximately {y}-approximately {z}", "y", "z", "true", "english_approximate"),
    ("Ca. {y}", "y", "y", "true", "english_approximate"),
    ("{c}th-{d}th cent.", "100 * c - 99", "100 * d", "true", "english_century"),
    ("{c}th century", "100 * c - 99", "100 * c", "true", "english_century"),
    ("{y}?-{z}", "y", "z", "true", "gregorian_uncertain_range"),
    ("{y}-", "y", "NULL", "false", "gregorian_open"),
    ("{y}-{z}", "y", "z", "false", "gregorian_range"),
    ("in {y}", "y", "y", "false", "gregorian_single"),
    ("[{y}]", "y", "y", "true", "gregorian_single"),
    ("{h}", "y", "y", "true", "standalone_hebrew_year"),
    ("undated", "NULL", "NULL", "NULL", None),
]


def _meant(i: int, kind: str) -> str:
    cases = " ".join(f"WHEN {n} THEN {x[i]}" if x[i] else "" for n, x in enumerate(SAID))
    return f"CAST(CASE f {cases} END AS {kind})"


_FORMS = " ".join(f"WHEN {n} THEN '{x[4]}'" for n, x in enumerate(SAID) if x[4])
MEANT = f"""WITH n AS (SELECT o_orderkey, o_orderkey % {len(SAID)} AS f, 1301 + 10 * (o_orderkey % 59) + o_orderkey % 9 AS y, 2 + o_orderkey % 19 AS c, 901 + o_orderkey % 90 AS e FROM orders),
            m AS (SELECT *, y + 40 AS z, c + 1 AS d FROM n),
            r AS (SELECT o_orderkey, {_meant(1, "INTEGER")} AS year_start, {_meant(2, "INTEGER")} AS year_end, {_meant(3, "BOOLEAN")} AS approximate, CASE f {_FORMS} END AS source_format FROM m)"""


def _said(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    y, c = 1301 + 10 * (k % 59) + k % 9, 2 + k % 19
    values_of = {"y": y, "z": y + 40, "c": c, "d": c + 1, "h": dates.letters(y - 1240), "o": dates.letters(c), "e": dates.letters(901 + k % 90)}
    text = F.lit(None).cast("string")
    for n, (template, *_) in enumerate(SAID):
        parts = [values_of[x[1:-1]].cast("string") if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w\})", template) if x]
        text = F.when(k % len(SAID) == n, F.concat(*parts)).otherwise(text)
    return t.orders.select("o_orderkey", text.alias("said"))


@query(f"{MEANT} SELECT * FROM r")
def date_resolve(t: Tables) -> DataFrame:
    return _said(t).select("o_orderkey", dates.resolve(F.col("said")).alias("r")).select("o_orderkey", "r.*")


@query(f"""{MEANT}, a AS (SELECT *, coalesce(source_format IN ('hebrew_century', 'english_century', 'hebrew_active') OR year_start = year_end, false) AS active FROM r)
           SELECT o_orderkey, CASE WHEN NOT active THEN year_start END AS birth_year, CASE WHEN NOT active THEN year_end END AS death_year,
                  CAST(CASE WHEN active THEN (year_start + year_end) // 2 END AS INTEGER) AS active_year FROM a""")
def person_dates(t: Tables) -> DataFrame:
    return _said(t).select("o_orderkey", dates.person_dates(F.col("said")).alias("p")).select("o_orderkey", "p.*")


@query("SELECT p_partkey % 5000 + 1 AS n, CAST(p_partkey % 5000 + 1 AS INTEGER) AS back FROM part")
def gematria_value(t: Tables) -> DataFrame:
    n = F.col("p_partkey") % 5000 + 1
    return t.part.select(n.alias("n"), dates.gematria(dates.letters(n)).alias("back"))


@query("""WITH b AS (SELECT s_suppkey AS k, s_nationkey = 7 AS disagrees, s_nationkey % 5 = 0 AS confirms, CASE WHEN s_nationkey = 1 THEN 'low' WHEN s_suppkey % 3 = 2 AND s_acctbal > 5000 THEN 'high' WHEN s_suppkey % 3 >= 1 THEN 'medium' ELSE 'low' END AS base FROM supplier)
          SELECT k AS s_suppkey, CASE WHEN base = 'low' THEN 'low' WHEN disagrees THEN CASE base WHEN 'high' THEN 'medium' ELSE 'low' END WHEN confirms THEN 'high' ELSE base END AS confidence FROM b""")
def confidence_ladder(t: Tables) -> DataFrame:
    n = F.col("s_nationkey")
    level = values.confidence(F.col("s_suppkey") % 3, F.col("s_acctbal") > 5000, concern=n == 1, disagrees=n == 7, confirms=n % 5 == 0)
    return t.supplier.select("s_suppkey", level.alias("confidence"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'New' ELSE p_name END AS en, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS he, CASE WHEN p_partkey % 4 = 0 THEN 'Neu' END AS de FROM part""")
def override_patch(t: Tables) -> DataFrame:
    items = t.part.select("p_partkey", F.create_map(F.lit("en"), F.col("p_name"), F.lit("he"), F.col("p_type")).alias("labels"))
    patch = F.create_map(F.lit("en"), F.lit("New"), F.lit("he"), F.lit(None).cast("string"), F.lit("de"), F.lit("Neu"))
    done = rules.apply_overrides(items, t.part.where("p_partkey % 4 = 0").select("p_partkey", patch.alias("labels")), "p_partkey")
    return done.select("p_partkey", *(F.try_element_at("labels", F.lit(x)).alias(x) for x in ("en", "he", "de")))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE 'Q' || p_partkey END AS label FROM part")
def label_precedence(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    labels = F.map_filter(F.create_map(F.lit("en"), F.when(k == 0, F.col("p_name")), F.lit("he"), F.when(k == 1, F.col("p_type"))), lambda a, v: v.isNotNull())
    return t.part.select("p_partkey", values.display_label(labels, F.concat(F.lit("Q"), "p_partkey")).alias("label"))


@query("SELECT event_type AS property, CAST(props->>'$.k' AS INTEGER) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def json_facts(t: Tables) -> DataFrame:
    facts = t.events.select("event_type", F.from_json("props", "k int").alias("p")).select(F.col("event_type").alias("property"), F.col("p.k").alias("value"))
    return facts.groupBy("property", "value").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_nationkey, sha256('{"name":"' || n_name || '","region":' || n_regionkey || '}') AS digest FROM nation""")
def canonical_hash(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", values.canonical_hash(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("digest"))


@query("""SELECT customer.c_custkey, CASE WHEN c_acctbal IS NULL THEN NULL ELSE c_acctbal END AS x, true AS same FROM customer""")
def loose_numbers(t: Tables) -> DataFrame:
    x = values.loose_number(F.format_string("%.2f", F.col("c_acctbal")))
    return t.customer.select("c_custkey", x.alias("x"), values.same_quantity(F.concat(F.lit("+"), F.col("c_custkey").cast("string")), F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).alias("same"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def html_fields(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


# statements and exports


def _statements(t: Tables) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", "preferred").when(F.col("l_returnflag") == "A", "normal").otherwise("deprecated")
    return t.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("local_id"), F.concat(F.lit("P"), F.col("l_linenumber") % 3).alias("property"), F.col("l_partkey").cast("string").alias("value"), rank.alias("rank"))


@query("""WITH s AS (SELECT 'o' || l_orderkey AS local_id, 'P' || (l_linenumber % 3) AS property, CAST(l_partkey AS VARCHAR) AS value, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS r FROM lineitem)
          SELECT local_id, property, value FROM (SELECT *, max(r) OVER (PARTITION BY local_id, property) AS m FROM s) WHERE r = m AND r > 0""")
def truthy_rank(t: Tables) -> DataFrame:
    return rules.truthy(_statements(t), "local_id").select("local_id", "property", "value")


@query("""SELECT '@misc{' || c_custkey || ',' || chr(10) || '  title = {' || c_name || '},' || chr(10) || '  note = {' || c_mktsegment || '},' || chr(10) || '}' AS value FROM customer""")
def bibtex_rows(t: Tables) -> DataFrame:
    return writers.bibtex(t.customer.withColumn("uri", F.concat(F.lit("urn:x/"), "c_custkey")), key="uri", title="c_name", note="c_mktsegment")


@query("""SELECT 'TY  - GEN' || chr(10) || 'ID  - ' || c_custkey || chr(10) || 'TI  - ' || c_name || chr(10) || 'N1  - ' || c_mktsegment || chr(10) || 'ER  - ' AS value FROM customer""")
def ris_rows(t: Tables) -> DataFrame:
    return writers.ris(t.customer.withColumn("uri", F.concat(F.lit("urn:x/"), "c_custkey")), key="uri", title="c_name", note="c_mktsegment")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, '["' || replace(p_name, ' ', '","') || '"]' AS words, '' AS missing FROM part""")
def csv_complex_to_json(t: Tables) -> DataFrame:
    return writers.flat_cells(t.part.select("p_partkey", F.split("p_name", " ").alias("words")), ["p_partkey", "words", "missing"])


@query("""SELECT 'c' || c_custkey AS local_id, 0 AS ord, 'CREATE' AS value FROM customer WHERE c_custkey % 2 = 0
          UNION ALL SELECT 'c' || c_custkey, 1, CASE WHEN c_custkey % 2 = 0 THEN 'LAST' ELSE 'Q' || c_custkey END || chr(9) || 'Len' || chr(9) || '"' || c_name || '"' FROM customer
          UNION ALL SELECT 'c' || c_custkey, 2, CASE WHEN c_custkey % 2 = 0 THEN 'LAST' ELSE 'Q' || c_custkey END || chr(9) || 'P1' || chr(9) || c_mktsegment FROM customer""")
def quickstatements(t: Tables) -> DataFrame:
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("local_id"), F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("Q"), "c_custkey")).alias("qid"), F.create_map(F.lit("en"), F.col("c_name")).alias("labels"), F.col("c_mktsegment").alias("value"), F.lit("P1").alias("property"))
    return writers.quickstatements(c, c.select("local_id", "property", "value"))


@query("""SELECT s, p, count(*) AS n FROM (SELECT DISTINCT 'o' || l_orderkey AS s, 'wdt:P' || (l_linenumber % 3) AS p, l_partkey FROM (SELECT *, max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_linenumber % 3) AS m FROM lineitem)
          WHERE m > 0 AND m = CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) x GROUP BY 1, 2""")
def items_to_triples(t: Tables) -> DataFrame:
    return writers.items_to_triples(_statements(t)).where(F.startswith("p", F.lit("wdt:"))).groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"))


# records


def _records(t: Tables) -> DataFrame:
    """Orders as field instances: the number, the owner as 100$a, each part as 700$a with its line as $e."""
    field = lambda tag, n, subs, data: F.struct(F.lit(tag).alias("tag"), n.cast("int").alias("occurrence"), F.array(F.lit(" "), F.lit(" ")).alias("indicators"), subs.alias("subfields"), data.alias("data"))
    sub = lambda code, v: F.struct(F.lit(code).alias("code"), v.cast("string").alias("value"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    none = F.lit(None).cast("array<struct<code string, value string>>")
    more = F.transform("l", lambda x, i: field("700", i + 1, F.array(sub("a", x["l_partkey"]), sub("e", x["l_linenumber"])), F.lit(None).cast("string")))
    own = F.array(field("001", F.lit(1), none, F.col("o_orderkey").cast("string")), field("100", F.lit(1), F.array(sub("a", F.col("o_custkey"))), F.lit(None).cast("string")))
    return t.orders.join(lines, "o_orderkey").select(F.lit("").alias("leader"), F.col("o_orderkey").cast("string").alias("control_number"), F.concat(own, more).cast(readers.OCCURRENCE).alias("occurrences"), F.lit(None).cast("string").alias("error"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
          SELECT CAST(o_orderkey AS VARCHAR) AS control_number, CAST(max(o_custkey) AS VARCHAR) AS owner, string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY n) AS parts FROM orders JOIN n ON l_orderkey = o_orderkey GROUP BY 1""")
def record_columns(t: Tables) -> DataFrame:
    flat = readers.flat_columns(_records(t))
    return flat.select("control_number", F.try_element_at("columns", F.lit("100$a")).alias("owner"), F.try_element_at("columns", F.lit("700$a")).alias("parts"))


@query("""WITH f(i, fault) AS (VALUES (0, ''), (1, 'tag'), (2, 'occurrence'), (3, 'repeated'), (4, 'indicators'), (5, 'code'), (6, 'occurrence,repeated'))
          SELECT o_orderkey, fault FROM orders JOIN f ON i = o_orderkey % 7""")
def record_errors(t: Tables) -> DataFrame:
    """Records of two field instances, each with another fault."""
    i = F.col("o_orderkey") % 7
    sub = lambda code: F.array(F.struct(code.alias("code"), F.lit("v").alias("value")))
    field = lambda tag, n, marks, code: F.struct(tag.alias("tag"), n.cast("int").alias("occurrence"), marks.alias("indicators"), sub(code).alias("subfields"), F.lit(None).cast("string").alias("data"))
    good = F.array(F.lit(" "), F.lit("1"))
    number = F.when(i == 2, 0).when(i == 3, 1).when(i == 6, -1).otherwise(2)
    second = field(F.when(i == 1, "24x").otherwise("245"), number, F.when(i == 4, F.array(F.lit(" "))).otherwise(good), F.when(i == 5, "ab").otherwise("a"))
    both = F.array(field(F.lit("245"), F.when(i == 6, -1).otherwise(1), good, F.lit("a")), second)
    return t.orders.select("o_orderkey", F.array_join(readers.occurrence_errors(both), ",").alias("fault"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS control_number, 'p' || l_partkey AS entity, min(l_linenumber) AS first FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def entity_candidates(t: Tables) -> DataFrame:
    """Entities of added-entry fields, each once with where it comes first."""
    each = _records(t).select("control_number", F.explode(F.filter("occurrences", lambda x: x["tag"] == "700")).alias("x"))
    code = lambda c: F.get(F.filter("x.subfields", lambda s: s["code"] == c), F.lit(0))["value"]
    rows = each.select("control_number", F.concat(F.lit("p"), code("a")).alias("entity"), code("e").cast("int").alias("first"))
    return paging.latest(rows.select("control_number", "entity", "first", (-F.col("first")).alias("o")), ["control_number", "entity"], ["o"]).drop("o")


@query("""SELECT 'record:' || o_orderkey AS s, 'author' AS p, 'person:' || o_custkey AS o FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
          UNION SELECT 'record:' || l_orderkey, 'contributor', 'person:' || l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def record_triples(t: Tables) -> DataFrame:
    g = projection.triples_of(projection.values_of(_records(t)))
    return g.where("o_kind = 'uri' and p <> 'type'").select("s", "p", "o")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS control_number, CAST(o_custkey AS VARCHAR) AS author, count(DISTINCT l_partkey) AS n_contributors FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def record_documents(t: Tables) -> DataFrame:
    d = projection.documents_of(projection.values_of(_records(t)))
    return d.select("control_number", F.get(F.try_element_at("fields", F.lit("author")), F.lit(0)).alias("author"), F.size(F.try_element_at("fields", F.lit("contributor"))).cast("long").alias("n_contributors"))


@query("""WITH x AS (SELECT s_suppkey, s_acctbal < 0 AS a, s_nationkey = 3 AS b, s_suppkey % 10 = 0 AS c, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'medium' END AS l FROM supplier)
          SELECT s_suppkey, concat_ws(',', CASE WHEN a THEN 'debt' END, CASE WHEN b THEN 'nation' END, CASE WHEN c THEN 'round' END) AS flags, CASE WHEN b THEN 'low' WHEN a OR c THEN 'medium' ELSE l END AS confidence FROM x""")
def guard_chain(t: Tables) -> DataFrame:
    rows = t.supplier.withColumn("confidence", F.when(F.col("s_suppkey") % 2 == 0, "high").otherwise("medium"))
    out = projection.guard(rows, [("debt", F.col("s_acctbal") < 0, "medium"), ("nation", F.col("s_nationkey") == 3, "low"), ("round", F.col("s_suppkey") % 10 == 0, "medium")])
    return out.select("s_suppkey", F.array_join("flags", ",").alias("flags"), "confidence")


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey % 3 AS prio, o_orderpriority AS src, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS a, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS b FROM orders)
          SELECT k, min((prio, src, a)) FILTER (a IS NOT NULL)[3] AS a, min((prio, src, b)) FILTER (b IS NOT NULL)[3] AS b, min((prio, src, a)) FILTER (a IS NOT NULL)[2] AS a_source, min((prio, src, b)) FILTER (b IS NOT NULL)[2] AS b_source FROM r GROUP BY 1""")
def merged_biodata(t: Tables) -> DataFrame:
    price = lambda s: F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))
    rows = t.orders.select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 3).alias("prio"), F.col("o_orderpriority").alias("src"), price("F").alias("a"), price("O").alias("b"))
    return projection.merge_fields(rows, "k", ["a", "b"], "src", "prio")


@query("""WITH s AS (SELECT user_id AS record, event_type AS type, props->>'$.k' AS text, event_id AS start FROM events WHERE value >= 5 AND event_id % 11 > 0), f AS (SELECT record, type, text, min(start) AS start FROM s GROUP BY 1, 2, 3)
          SELECT record, string_agg(type || ':' || text, '|' ORDER BY start) AS entities FROM f GROUP BY 1""")
def folded_spans(t: Tables) -> DataFrame:
    spans = t.events.select(F.col("user_id").alias("record"), F.col("event_type").alias("type"), F.get_json_object("props", "$.k").alias("text"), F.col("event_id").alias("start"), F.lit(None).cast("boolean").alias("approved"), (F.col("event_id") % 11 == 0).alias("rejected"), (F.col("value") / 10).alias("confidence"))
    folded = projection.fold_spans(t.events.select(F.col("user_id").alias("record")).distinct(), spans)
    return folded.where("entities is not null").select("record", F.array_join("entities", "|").alias("entities"))
