"""Queries that look names up in tiers: parts stand for authorities, orders for records that ask for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import cascades, guards, years

from .registry import Tables, query
from .relational import _TRI

# three of eight orders spell a name right, three wrong, one asks for a name that none is like, one for nothing
_KEY = "p_name || ' ' || p_size % 10"
_ASKED = f"""CASE WHEN o_orderkey % 8 < 3 THEN {_KEY} WHEN o_orderkey % 8 < 6 THEN substring(p_name, 1, length(p_name) - 1) || 'x ' || p_size % 10 WHEN o_orderkey % 8 = 6 THEN 'qqq zzz' ELSE '' END"""
_TAG = "CASE p_size % 4 WHEN 0 THEN '400' WHEN 1 THEN '150' ELSE '100' END"
_YEAR = "960 + p_partkey % 60"


def _key() -> Column:
    return F.concat("p_name", F.lit(" "), F.col("p_size") % 10)


def _orders(t: Tables) -> DataFrame:
    n = F.col("o_orderkey") % 8
    wrong = F.concat(F.expr("substring(p_name, 1, length(p_name) - 1)"), F.lit("x "), F.col("p_size") % 10)
    asked = F.when(n < 3, _key()).when(n < 6, wrong).when(n == 6, "qqq zzz").otherwise("")
    return t.orders.join(t.part, F.col("p_partkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("query_id"), asked.alias("key"), "p_partkey", "p_size")


def _names(t: Tables) -> DataFrame:
    tag = F.when(F.col("p_size") % 4 == 0, "400").when(F.col("p_size") % 4 == 1, "150").otherwise("100")
    year = (960 + F.col("p_partkey") % 60).cast("string")
    return t.part.select(_key().alias("key"), F.col("p_partkey").alias("id"), tag.alias("tag"), F.when(F.col("p_partkey") % 3 > 0, F.concat(year, F.lit("-"), year)).alias("dates"))


_BASE = f"""n AS (SELECT {_KEY} AS key, p_partkey AS id, {_TAG} AS tag, CASE WHEN p_partkey % 3 > 0 THEN {_YEAR} END AS y FROM part),
     q AS (SELECT o_orderkey AS query_id, {_ASKED} AS key, p_partkey, p_size FROM orders JOIN part ON p_partkey = o_custkey),
     k AS (SELECT DISTINCT key AS text FROM n), ng AS (SELECT text AS near, {_TRI} AS g FROM k), qg AS (SELECT text AS key, {_TRI} AS g FROM (SELECT DISTINCT key AS text FROM q WHERE key <> '')),
     sim AS (SELECT key, near, len(list_intersect(qg.g, ng.g)) / (len(qg.g) + len(ng.g) - len(list_intersect(qg.g, ng.g))) AS similarity FROM qg, ng)"""
_PREFER = "CASE tag WHEN '100' THEN 0 WHEN '400' THEN 1 ELSE 2 END, y IS NULL, id"


@query(f"""WITH {_BASE},
     e AS (SELECT query_id, id, tag, y, row_number() OVER (PARTITION BY query_id ORDER BY {_PREFER}) AS place FROM q JOIN n USING (key) WHERE key <> ''),
     s AS (SELECT query_id, id, CASE tag WHEN '100' THEN 100 WHEN '150' THEN -40 ELSE 0 END + CASE WHEN o THEN 50 ELSE 0 END AS score, o
           FROM (SELECT *, y IS NULL OR (y - 5 <= 1000 AND 991 <= y) AS o FROM e WHERE place <= 8)),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM s),
     p AS (SELECT query_id, max(id) FILTER (nth = 1) AS id, coalesce(max(score) FILTER (nth = 1) - max(score) FILTER (nth = 2) <= 15 AND NOT bool_or(nth <= 2 AND o), false) AS tie FROM r GROUP BY 1),
     f AS (SELECT key, id, similarity FROM (SELECT sim.key, id, similarity, row_number() OVER (PARTITION BY sim.key ORDER BY similarity DESC, {_PREFER}) AS nth FROM sim JOIN n ON n.key = near
           WHERE similarity >= 0.45 AND sim.key NOT IN (SELECT key FROM n)) WHERE nth = 1)
     SELECT query_id, CASE WHEN p.query_id IS NOT NULL THEN CASE WHEN tie THEN 'abstained' ELSE 'matched' END WHEN f.key IS NOT NULL THEN 'similar' ELSE 'none' END AS outcome,
            CASE WHEN p.query_id IS NULL THEN f.id WHEN NOT tie THEN p.id END AS id, round(similarity, 6) AS similarity FROM q LEFT JOIN p USING (query_id) LEFT JOIN f USING (key)""")
def person_cascade(t: Tables) -> DataFrame:
    asked = _orders(t).select("query_id", "key", F.lit("996-1000").alias("record_dates"), F.lit(None).cast("int").alias("year"), F.lit("author").alias("role"))
    return cascades.person(asked, _names(t))


@query(f"""WITH {_BASE},
     m AS (SELECT * FROM n WHERE tag = '100'),
     w AS (SELECT query_id, key, p_partkey AS cur, CASE WHEN p_partkey % 2 = 0 THEN {_YEAR} END AS y FROM q WHERE key <> '' AND p_size % 4 <> 2),
     a AS (SELECT query_id, 0 AS tier, min(id) AS id, NULL AS similarity FROM w JOIN m ON m.key = w.key AND m.y = w.y GROUP BY 1),
     b2 AS (SELECT query_id, 1 AS tier, id, NULL AS similarity FROM (SELECT query_id, m.id, row_number() OVER (PARTITION BY query_id ORDER BY m.y IS NULL, m.id) AS nth FROM w JOIN m ON m.key = w.key) WHERE nth = 1),
     c AS (SELECT key, id, similarity FROM (SELECT sim.key, id, similarity, row_number() OVER (PARTITION BY sim.key ORDER BY similarity DESC, y IS NULL, id) AS nth FROM sim JOIN m ON m.key = near
           WHERE similarity >= 0.45 AND sim.key NOT IN (SELECT key FROM m)) WHERE nth = 1),
     h AS (SELECT query_id, arg_min(x, tier) AS x FROM (SELECT query_id, tier, {{id: id, similarity: similarity, tier: tier}} AS x FROM (FROM a UNION ALL FROM b2 UNION ALL SELECT query_id, 2, id, similarity FROM w JOIN c USING (key))) GROUP BY 1)
     SELECT q.query_id, CASE WHEN x IS NULL THEN 'none' WHEN x.id = p_partkey THEN 'same' WHEN x.tier = 2 THEN 'similar' ELSE 'matched' END AS outcome,
            CASE WHEN x.id <> p_partkey THEN x.id END AS id, CASE WHEN x.id <> p_partkey THEN round(x.similarity, 6) END AS similarity FROM q LEFT JOIN h USING (query_id)""")
def personality_rematch(t: Tables) -> DataFrame:
    year = (960 + F.col("p_partkey") % 60).cast("string")
    tag = F.when(F.col("p_size") % 4 == 2, " 100 ").otherwise("400")
    asked = _orders(t).select("query_id", "key", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), year, F.lit("-"), year)).alias("dates"), F.col("p_partkey").alias("current_id"), tag.alias("tag"))
    return cascades.personality(asked, _names(t))


_QID = "CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 < 3 THEN 'Q' || p_size ELSE 'Q' || p_partkey END"


@query(f"""WITH {_BASE},
     pl AS (SELECT p_partkey AS id, nullif({_QID}, '') AS qid, CASE WHEN p_partkey % 4 = 0 THEN {_KEY} ELSE p_name END AS main FROM part),
     e AS (SELECT q.key, min(qid) AS lo, max(qid) AS hi, min(qid) FILTER (main = q.key) AS olo, max(qid) FILTER (main = q.key) AS ohi FROM (SELECT DISTINCT key FROM q WHERE key <> '') q JOIN n USING (key) JOIN pl USING (id) GROUP BY 1),
     t AS (SELECT key, id, max(similarity) AS similarity FROM (SELECT sim.key, id, similarity, row_number() OVER (PARTITION BY sim.key ORDER BY similarity DESC, near, id) AS nth FROM sim JOIN n ON n.key = near
           WHERE similarity >= 0.45 AND sim.key NOT IN (SELECT key FROM n)) WHERE nth <= 12 GROUP BY ALL),
     f AS (SELECT key, min(qid) AS lo, max(qid) AS hi, min(qid) FILTER (main = key) AS olo, max(qid) FILTER (main = key) AS ohi FROM t JOIN pl USING (id) GROUP BY 1),
     c AS (SELECT key, 'matched' AS kind, lo, CASE WHEN lo = hi THEN lo WHEN olo = ohi THEN olo END AS pick FROM e UNION ALL SELECT key, 'similar', lo, CASE WHEN lo = hi THEN lo WHEN olo = ohi THEN olo END FROM f)
     SELECT query_id, CASE WHEN lo IS NULL THEN 'none' WHEN pick IS NULL THEN 'abstained' ELSE kind END AS outcome, pick AS id,
            CASE WHEN kind = 'similar' THEN round((SELECT max(similarity) FROM t JOIN pl USING (id) WHERE t.key = c.key AND qid = pick), 6) END AS similarity FROM q LEFT JOIN c USING (key)""")
def place_cascade(t: Tables) -> DataFrame:
    n = F.col("p_partkey") % 5
    qid = F.when(n == 0, "").when(n < 3, F.concat(F.lit("Q"), "p_size")).otherwise(F.concat(F.lit("Q"), "p_partkey"))
    main = F.when(F.col("p_partkey") % 4 == 0, _key()).otherwise(F.col("p_name"))
    places = t.part.select(F.col("p_partkey").alias("place_id"), qid.alias("qid"), F.array(main).alias("main_keys"))
    return cascades.place(_orders(t).select("query_id", "key"), _names(t).select("key", F.col("id").alias("place_id")), places)


_NAMES8 = ["יעקב", "משה בן מימון הספרדי", 'א"א', "M. J.", "Anonymous of Fez", "אונקלוס,", "Levi ben Gershom", "שלמה כהן"]
_NAME_LIST = "[" + ", ".join("'" + n + "'" for n in _NAMES8) + "]"


@query(f"""WITH m AS (SELECT o_orderkey AS id, {_NAME_LIST}[1 + o_orderkey % 8] AS name, ['scribe', 'author', 'Copyist', 'owner'][1 + o_custkey % 4] AS role, CASE WHEN o_custkey % 5 > 0 THEN 1000 + o_custkey % 950 END AS year,
               CASE WHEN o_orderkey % 3 > 0 THEN 'a' || o_custkey END AS authority_id, CASE WHEN o_orderkey % 4 > 0 THEN 'v' || o_custkey END AS cluster_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Q' || o_custkey END AS item_id,
               CASE WHEN o_custkey % 3 = 0 THEN 'Jacob son of Isaac' WHEN o_custkey % 3 = 1 THEN 'Jacob' END AS latin, CASE WHEN o_orderkey % 7 > 1 THEN 950 + o_orderkey % 990 END AS born, CASE WHEN o_orderkey % 6 > 1 THEN 1000 + (o_orderkey * 7) % 1000 END AS died,
               o_orderkey % 9 = 0 AS over_merged, o_orderkey % 10 = 0 AS disagrees, o_orderkey % 4 = 1 AS confirms, o_orderkey % 5 = 0 AS has_item, o_orderkey % 23 = 0 AS conflict FROM orders),
          f AS (SELECT *, id % 8 IN (2, 3, 4) AS f1, id % 8 = 5 AS f2, coalesce(died < born, false) AS f3, coalesce(born >= 1900, false) AND NOT coalesce(year >= 1900, false) AS f4,
               coalesce(born > year + 5, false) OR (lower(role) IN ('scribe', 'copyist') AND coalesce(died < year - 80, false)) OR (born IS NULL AND coalesce(died > year + 120, false)) AS f5, id % 8 IN (0, 7) AND coalesce(latin, '') = 'Jacob son of Isaac' AS f6 FROM m),
          g AS (SELECT *, CASE WHEN f1 THEN ['placeholder_name'] WHEN f2 THEN ['non_person_heading'] ELSE list_filter([CASE WHEN f3 THEN 'biographical_inconsistency' END, CASE WHEN f4 THEN 'modern_person' END, CASE WHEN f5 THEN 'date_conflict' END,
               CASE WHEN f6 THEN 'short_name_homonym' END, CASE WHEN over_merged THEN 'over_merged' END, CASE WHEN disagrees THEN 'disagrees' END, CASE WHEN confirms THEN 'confirms' END, CASE WHEN has_item THEN 'has_item' END, CASE WHEN conflict THEN 'conflict' END], lambda x: x IS NOT NULL) END AS flags,
               CASE WHEN f1 THEN 'placeholder_name' WHEN f2 THEN 'non_person_heading' WHEN f5 THEN 'date_conflict' WHEN f4 THEN 'modern_person' WHEN f3 THEN 'biographical_inconsistency' END AS reason FROM f),
          b AS (SELECT *, (authority_id IS NOT NULL)::INT + (cluster_id IS NOT NULL)::INT + has_item::INT AS n FROM g),
          c AS (SELECT *, CASE WHEN reason IS NOT NULL OR f6 OR over_merged OR conflict OR n = 0 THEN 'low' WHEN n >= 2 AND latin IS NOT NULL THEN CASE WHEN disagrees THEN 'medium' ELSE 'high' END WHEN disagrees THEN 'low' WHEN confirms THEN 'high' ELSE 'medium' END AS confidence FROM b)
          SELECT id, array_to_string(flags, ',') AS flags, reason, confidence, confidence = 'high' AS matched, CASE WHEN reason IS NULL THEN authority_id END AS authority_id,
                 CASE WHEN reason IS NULL AND NOT over_merged THEN cluster_id END AS cluster_id, CASE WHEN reason IS NULL AND NOT over_merged THEN item_id END AS item_id FROM c""")
def evaluated_matches(t: Tables) -> DataFrame:
    """Matches of names good and bad, with lives that fit their manuscript and lives that do not, under all guards."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda options, n: F.element_at(F.array(*map(F.lit, options)), (n + 1).cast("int"))
    rows = t.orders.select(
        k.alias("id"), pick(_NAMES8, k % 8).alias("name"), pick(["scribe", "author", "Copyist", "owner"], c % 4).alias("role"), F.when(c % 5 > 0, 1000 + c % 950).alias("year"),
        F.when(k % 3 > 0, F.concat(F.lit("a"), c)).alias("authority_id"), F.when(k % 4 > 0, F.concat(F.lit("v"), c)).alias("cluster_id"), F.when(k % 5 == 0, F.concat(F.lit("Q"), c)).alias("item_id"),
        F.when(c % 3 == 0, "Jacob son of Isaac").when(c % 3 == 1, "Jacob").alias("latin"), F.when(k % 7 > 1, 950 + k % 990).alias("born"), F.when(k % 6 > 1, 1000 + k * 7 % 1000).alias("died"),
        (k % 9 == 0).alias("over_merged"), (k % 10 == 0).alias("disagrees"), (k % 4 == 1).alias("confirms"), (k % 5 == 0).alias("has_item"), (k % 23 == 0).alias("conflict"),
    )
    found = guards.evaluated(rows)
    return found.select("id", F.array_join("flags", ",").alias("flags"), "reason", "confidence", "matched", "authority_id", "cluster_id", "item_id")


@query("""WITH m AS (SELECT o_orderkey AS id, o_orderkey % 6 AS kind, 1300 + o_custkey % 400 AS y, CASE WHEN o_orderkey % 4 > 0 THEN 1300 + (o_custkey * 3) % 500 END AS colophon FROM orders),
          d AS (SELECT *, CASE kind WHEN 0 THEN y WHEN 4 THEN -200 END AS year, CASE kind WHEN 1 THEN 1401 WHEN 2 THEN 1350 WHEN 3 THEN y END AS s, CASE kind WHEN 1 THEN 1500 WHEN 2 THEN 1450 END AS e, CASE WHEN kind IN (2, 5) AND id % 5 = 0 THEN y END AS written, kind IN (1, 2, 4) AS vague FROM m),
          w AS (SELECT *, CASE kind WHEN 1 THEN colophon BETWEEN 1401 AND 1500 WHEN 2 THEN colophon BETWEEN 1350 AND 1450 WHEN 4 THEN abs(-200 - colophon) <= 100 END AS fits FROM d)
          SELECT id, CAST(CASE WHEN vague AND colophon IS NOT NULL AND fits THEN colophon WHEN kind = 0 THEN y WHEN kind = 3 THEN y WHEN kind = 4 THEN -200 WHEN kind = 2 AND written BETWEEN 1350 AND 1450 THEN written WHEN kind = 5 AND written IS NOT NULL THEN written ELSE colophon END AS INTEGER) AS year FROM w""")
def production_years(t: Tables) -> DataFrame:
    """Exact years, centuries, wide ranges, years before the common era and texts, with and without a colophon that agrees."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind, y = k % 6, (1300 + c % 400).cast("int")
    none = F.lit(None).cast("int")
    date = F.struct(
        F.when(kind == 0, y).when(kind == 4, -200).alias("year"), F.when(kind == 1, 1401).when(kind == 2, 1350).when(kind == 3, y).otherwise(none).alias("start"), F.when(kind == 1, 1500).when(kind == 2, 1450).otherwise(none).alias("end"),
        F.when(kind == 1, "Century").when(kind == 4, "Century").otherwise("Range").alias("form"), F.when(kind.isin(2, 5) & (k % 5 == 0), F.concat(F.lit("before ("), y, F.lit(")"))).when(kind == 1, "15th century").alias("text"), (kind == 4).alias("bce"),
    )
    colophon = F.when(k % 4 > 0, 1300 + (c * 3) % 500).cast("int")
    return t.orders.select(k.alias("id"), years.production_year(date, colophon).cast("int").alias("year"))


_SPANS = [
    ("בשנת 1648.", "", 1648), ("משנת [=1826]", "", 1826), ('קל"ז', 'note בשנת קל""ז [=1377] more', 1377), ("7[5]16", "צנזור 7[5]16", 1500), ("7[5]16", "", None), ("ב'קל\"ז", "", None), ('תפ"ט', "", 1729), ("", "x", None), ("no year", "", None),
]


@query("SELECT o_orderkey AS id, CAST(CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN {'NULL' if y is None else 'o_custkey % 50 + 1500' if s.startswith('7') else y}" for i, (s, _, y) in enumerate(_SPANS)) + " END AS INTEGER) AS year FROM orders")
def span_years(t: Tables) -> DataFrame:
    """Years of dates in texts, of each form that gives one and each that does not."""
    n = (F.col("o_orderkey") % 9 + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(s[i]) for s in _SPANS)), n)
    return t.orders.select(F.col("o_orderkey").alias("id"), years.year_of_span(pick(0), pick(1), (F.col("o_custkey") % 50 + 1500).cast("int")).cast("int").alias("year"))
