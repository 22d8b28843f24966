"""Names, identifiers, titles and measures in many spellings, built from the driver's tables, and what they must come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import dates, spans, text, values

from .registry import Tables, query


def _of(t: Tables, **columns: Column) -> DataFrame:
    return t.customer.select("c_custkey", *(c.alias(name) for name, c in columns.items()))


def _key_and_name() -> tuple[Column, Column]:
    return F.col("c_custkey"), F.col("c_name")


join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("SELECT c_custkey, 'haifa d''or ' || c_custkey AS place, 'e' || lower(c_name) || ' x' AS label, replace(lower(c_name), '#', ' ') || ' a' AS plain FROM customer")
def name_keys(t: Tables) -> DataFrame:
    k, name = _key_and_name()
    return _of(t, place=text.place_key(join("Haïfa  d'Or ", k, " (Israel)")), label=text.label_key(join("  É", name, "  X ")), plain=text.plain_key(join(name, " - A!")))


@query("SELECT c_custkey, c_name AS quoted, 'מ''' AS short, CAST(c_custkey AS VARCHAR) AS number FROM customer")
def unwrapped(t: Tables) -> DataFrame:
    k, name = _key_and_name()
    return _of(t, quoted=text.entity_text(join('"', name, '"')), short=text.entity_text(F.lit("מ'")), number=text.control_key(join('"', k, ' "')))


@query("SELECT c_custkey, c_name || '|' || c_mktsegment AS \"values\", 'Title ' || c_custkey || '.|Title ' || c_custkey AS variants, 'Main ' || c_custkey AS title, 'rest / by ' || c_name AS rest FROM customer")
def titles(t: Tables) -> DataFrame:
    k, name = _key_and_name()
    parts = text.split_title(join("Main ", k, " : rest / by ", name))
    cell = join('"', name, '";;', F.col("c_mktsegment"), "; ")
    return _of(t, values=F.array_join(text.split_values(cell), "|"), variants=F.array_join(text.title_variants(join("Title ", k, ".")), "|"), title=parts["title"], rest=parts["rest"])


@query("SELECT c_custkey, c_custkey % 4 < 3 AS heading, c_custkey % 2 = 0 AS overlap, c_custkey % 3 = 0 AS inverted FROM customer")
def headings(t: Tables) -> DataFrame:
    k, name = _key_and_name()
    other = F.when(k % 4 == 0, name).when(k % 4 == 1, join(name, "xy")).when(k % 4 == 2, F.lower(name)).otherwise(join("far ", name))
    return _of(t, heading=text.heading_matches(name, other), overlap=text.names_overlap(name, F.when(k % 2 == 0, F.upper(F.substring("c_name", 3, 5))).otherwise("nothing")), inverted=text.is_inverted_name(F.when(k % 3 == 0, join("Cohen, M", k)).otherwise(join("Cohen M", k, ","))))


@query("""SELECT c_custkey, 'x' || c_custkey AS local, 'Q' || (c_custkey + 1) AS qid, CAST(1000 + c_custkey AS VARCHAR) AS viaf, CASE WHEN c_custkey % 2 = 0 THEN '000000012' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || 'X' END AS isni,
                 CASE WHEN c_custkey % 2 = 0 THEN 'n' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS lccn FROM customer""")
def identifiers(t: Tables) -> DataFrame:
    k, name = _key_and_name()
    digits = F.lpad(k.cast("string"), 6, "0")
    return _of(
        t,
        local=text.local_name(F.when(k % 2 == 0, join("http://a/b#x", k)).otherwise(join("http://a/b/x", k))),
        qid=text.qid(F.when(k % 2 == 0, join("http://w/entity/q", k + 1)).otherwise(join(" Q", k + 1, " "))),
        viaf=text.viaf(F.when(k % 2 == 0, join("https://viaf.org/viaf/", k + 1000, "/")).otherwise((k + 1000).cast("string"))),
        isni=text.isni(F.when(k % 2 == 0, join("0000 0001 2", F.substring(digits, 1, 3), " ", F.substring(digits, 4, 3), "x")).otherwise(k.cast("string"))),
        lccn=text.lccn(F.when(k % 2 == 0, join(" N ", F.lpad(k.cast("string"), 8, "0"))).otherwise("n1")),
    )


@query("""SELECT c_custkey, CAST(10 * (c_custkey % 50 + 1) AS DOUBLE) AS height, c_custkey % 30 + 0.5 AS lon, c_custkey % 4 > 0 AS valid, CAST(c_custkey AS DOUBLE) * 1000 AS number, c_custkey % 3 <> 1 AS same FROM customer""")
def measures(t: Tables) -> DataFrame:
    k, name = _key_and_name()
    said = F.when(k % 2 == 0, join("about ", k % 50 + 1, " X 3.5 cm")).otherwise(join(10 * (k % 50 + 1), " x 35mm"))
    return _of(
        t,
        height=values.dimensions(said)["height_mm"],
        lon=values.wkt_point(join("POINT( ", k % 30, ".5 31)"))["lon"],
        valid=values.valid_point(F.when(k % 4 == 0, 0.0).otherwise(31.0), F.when(k % 4 == 0, 0.0).otherwise(35.0)),
        number=values.loose_number(join(" ", k, ",000 ")),
        same=values.same_quantity(join("+", k), F.when(k % 3 == 1, join(k, ".5")).otherwise(join(k, ".0"))),
    )


@query("""SELECT c_custkey, CAST(CASE c_custkey % 6 WHEN 0 THEN 162 + c_custkey % 9 WHEN 1 THEN 30 WHEN 2 THEN 25 WHEN 3 THEN 100 + c_custkey % 9 END AS INTEGER) AS leaves,
                 CASE WHEN c_custkey % 6 < 4 THEN CASE WHEN c_custkey % 6 = 2 THEN 'page' ELSE 'leaf' END END AS unit FROM customer""")
def extents(t: Tables) -> DataFrame:
    k, name = _key_and_name()
    n = k % 9
    said = F.when(k % 6 == 0, join("[2], 16", n, " leaves")).when(k % 6 == 1, join("2 כרכים (10, 20 דף)")).when(k % 6 == 2, join("XX, ה, 0 pages (3 missing)")).when(k % 6 == 3, join('קי"א דף')).when(k % 6 == 4, join("folios 3-", n)).otherwise(join(n, " columns"))
    fixed = F.when(k % 6 == 0, join("[2], ", 160 + n, " leaves")).when(k % 6 == 3, join(100 + n, " דף (חסר)")).otherwise(said)
    return t.customer.select("c_custkey", spans.extent(fixed).alias("x")).select("c_custkey", F.col("x.count").alias("leaves"), "x.unit")


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'topic' WHEN 1 THEN 'place' WHEN 2 THEN 'book of the bible' WHEN 3 THEN 'marked as uncertain' WHEN 4 THEN 'capitals only' ELSE '' END AS doubts, length(c_name) + c_custkey % 90 > 80 AS inscription FROM customer""")
def person_doubts(t: Tables) -> DataFrame:
    k, name = _key_and_name()
    said = F.when(k % 6 == 0, "Talmud").when(k % 6 == 1, "ירושלים").when(k % 6 == 2, "Genesis").when(k % 6 == 3, join("Moshe? ", k)).when(k % 6 == 4, join("ABC ", k)).otherwise(join("Moshe ", k))
    return _of(t, doubts=F.array_join(spans.person_doubts(said, F.lit("before")), ","), inscription=spans.is_inscription(F.lit("OWNER"), F.concat(name, F.repeat(F.lit("x"), (k % 90).cast("int")))))


@query("""SELECT c_custkey, CAST(1241 + c_custkey % 900 AS INTEGER) AS common_era, CAST(5061 + c_custkey % 700 AS INTEGER) AS hebrew, CAST(CASE WHEN c_custkey % 2 = 0 THEN 100 * (c_custkey % 19) ELSE 1 - 100 * (c_custkey % 19 + 1) END AS INTEGER) AS first,
                 CASE WHEN c_custkey % 3 = 0 THEN 'born_after' WHEN c_custkey % 3 = 1 THEN 'copyist_died_before' END AS conflict, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END || lpad(CAST(c_custkey % 2000 + 1 AS VARCHAR), 4, '0') || '-00-00T00:00:00Z' AS time FROM customer""")
def calendars(t: Tables) -> DataFrame:
    k, name = _key_and_name()
    y = k % 2000 + 1
    return _of(
        t,
        common_era=dates.to_common_era((5001 + k % 900).cast("int")),
        hebrew=dates.to_hebrew_year((1301 + k % 700).cast("int")),
        first=dates.century_range((k % 19 + 1).cast("int"), k % 2 == 1)["year_start"].cast("int"),
        conflict=dates.date_conflict(F.lit("Scribe"), F.lit(1500), F.when(k % 3 == 0, 1506), F.when(k % 3 == 1, 1419).when(k % 3 == 2, 1450)),
        time=dates.wikibase_time(F.when(k % 2 == 0, y).otherwise(-y))["time"],
    )


@query("SELECT c_custkey, lower(c_name) || ',b' AS once FROM customer")
def first_of_each(t: Tables) -> DataFrame:
    k, name = _key_and_name()
    return _of(t, once=F.lower(F.array_join(values.first_of_each(F.array(name, F.upper(name), F.lit("b"), F.lit("B"), F.lower(name))), ",")))
