"""A triple store as a DataFrame, and graph patterns as joins.

``triples`` has ``s, p, o, o_kind`` (``uri``, ``blank`` or ``literal``), ``o_lang`` and optionally ``o_datatype`` (an IRI; null for plain
text and for ``xsd:string``, which is the same) and ``graph_id``. Blank nodes are named ``_:`` and a label. It is a set: builders end in ``distinct``. Patterns are built with the functions below instead of parsed
from text; Catalyst orders and pushes down what they declare.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("s", "p", "o", "o_kind", "o_lang")


def melt(rows: DataFrame, subject: Column, properties: dict[str, Column], links: tuple[str, ...] = (), lang: str | None = None) -> DataFrame:
    """Triples of rows: one for each property with a value; those in ``links`` have resources as values."""
    each = F.array(*(F.struct(F.lit(p).alias("p"), c.cast("string").alias("o"), F.lit("uri" if p in links else "literal").alias("o_kind")) for p, c in properties.items()))
    return rows.select(subject.alias("s"), F.explode(each).alias("x")).select("s", "x.p", "x.o", "x.o_kind", F.lit(lang).cast("string").alias("o_lang")).where("o is not null")


def merge(*graphs: DataFrame) -> DataFrame:
    """Union of graphs as a set. Blank nodes are told apart by label: those of different sources need labels of their own, as readers give them."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), graphs).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Triples that only one of two graphs has, with the side. Graphs with blank nodes are compared by ``blank_nodes.difference``."""
    left = a.subtract(b).withColumn("side", F.lit("left"))
    return left.unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def override(graph: DataFrame, new: DataFrame) -> DataFrame:
    """Replaces all values, resources too, of the ``(s, p)`` that ``new`` has. Those that the graph has no value of are left out."""
    known = new.join(graph.select("s", "p").distinct(), ["s", "p"], "left_semi")
    kept = graph.join(known.select("s", "p").distinct(), ["s", "p"], "left_anti")
    return kept.unionByName(known.select(*kept.columns)).distinct()


def pattern(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Bindings of one triple pattern. Parts that start with ``?`` are variables (one column each), others constants.
    A variable that occurs twice must have equal values."""
    rows, seen = triples, {}
    for column, term in zip("spo", (s, p, o), strict=True):
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == term)
        elif term in seen:
            rows = rows.where(F.col(column) == F.col(seen[term]))
        else:
            seen[term] = column
    extra = [c for c in ("graph_id",) if c in triples.columns]
    return rows.select(*(F.col(c).alias(v[1:]) for v, c in seen.items()), *extra).distinct()


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def basic(triples: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Conjunction of triple patterns: a join on the variables they share. Patterns without a shared variable are refused: that
    would be a cross join."""
    out = pattern(triples, *patterns[0])
    for x in patterns[1:]:
        out = both(out, pattern(triples, *x))
    return out


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    on = _shared(a, b)
    if not on or on == ["graph_id"]:
        raise ValueError("patterns share no variable")
    return a.join(b, on)


def optional(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, _shared(a, b), "left")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bindings of ``a`` that agree with none of ``b``; all of them where the two share no variable."""
    on = _shared(a, b)
    return a.join(b, on, "left_anti") if on else a


def exists(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, _shared(a, b), "left_semi")


def construct(bindings: DataFrame, *templates: tuple[str, str, str]) -> DataFrame:
    """Triples of templates for each binding; those with an unbound variable are left out."""
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    made = [bindings.select(*(term(x).cast("string").alias(c) for c, x in zip("spo", t, strict=True))) for t in templates]
    return reduce(lambda a, b: a.unionByName(b), made).dropna().distinct()


COMPACT = 16


def path_plus(triples: DataFrame, p: str) -> DataFrame:
    """Pairs connected by one or more steps of a property. Each round joins only the pairs that are new, until there are none."""
    from quire.sources.shared import written

    step = written(triples.where((F.col("p") == p) & (F.col("o_kind") != "literal")).select("s", "o").distinct(), "path")
    known = new = step
    rounds = 0
    while not new.isEmpty():
        further = new.select("s", F.col("o").alias("m")).join(step.select(F.col("s").alias("m"), "o"), "m").select("s", "o").distinct()
        new = written(further.join(known, ["s", "o"], "left_anti"), "path")
        known, rounds = known.union(new), rounds + 1
        if rounds % COMPACT == 0:  # a union of few tables, however many rounds
            known = written(known, "path")
    return known


def label_of(triples: DataFrame, label: str = "label") -> DataFrame:
    """The longest label of each resource among English, Hebrew and unmarked ones; ties by text."""
    named = triples.where((F.col("p") == label) & (F.col("o_lang").isNull() | F.col("o_lang").isin("en", "he")))
    return named.groupBy("s").agg(F.max_by("o", F.struct(F.length("o"), "o")).alias("label"))


def cardinality_violations(triples: DataFrame, of_type: str, p: str, *, least: int = 0, most: int | None = None) -> DataFrame:
    """Subjects of a type with too few or too many values of a property."""
    targets = triples.where((F.col("p") == "type") & (F.col("o") == of_type)).select("s").distinct()
    n = triples.where(F.col("p") == p).select("s", "o").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    counted = targets.join(n, "s", "left").select("s", F.coalesce("n", F.lit(0)).alias("n"))
    return counted.where((F.col("n") < least) | (F.col("n") > F.lit(most) if most is not None else F.lit(False)))


def order_violations(triples: DataFrame, first: str, second: str) -> DataFrame:
    """Subjects whose first date lies after their second."""
    a, b = pattern(triples, "?s", first, "?a"), pattern(triples, "?s", second, "?b")
    return both(a, b).where("a > b")


XSD = "http://www.w3.org/2001/XMLSchema#"

#: Lexical forms of datatypes, by their names in the XML Schema namespace.
DATATYPES = {"integer": r"^[+-]?\d+$", "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$", "double": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|INF|-INF|NaN)$", "boolean": "^(true|false|1|0)$", "date": r"^-?\d{4,}-\d{2}-\d{2}(Z|[+-]\d{2}:\d{2})?$", "gYear": r"^-?\d{4,}(Z|[+-]\d{2}:\d{2})?$", "year": r"^-?\d{4}$"}


@dataclass(frozen=True)
class Shape:
    """What the subjects of a type must have at a path. ``kind``: ``min_count``, ``max_count``, ``pattern``, ``datatype`` (a name in
    ``DATATYPES`` or an IRI), ``in``, ``class``, ``node_kind`` (``uri``, ``blank`` or ``literal``), ``min_value``, ``max_value``, ``less_than`` (a path)."""

    of_type: str
    path: str
    kind: str
    value: object


def _has_datatype(name: Column, typed: bool) -> Column:
    """Whether the object is a literal of a datatype: of that type where types are known, and in its form where the form is."""
    local = F.when(F.startswith(name, F.lit(XSD)), F.substring(name, F.lit(len(XSD) + 1), F.length(name))).otherwise(name)
    forms = F.create_map(*(F.lit(x) for kv in DATATYPES.items() for x in kv))
    form = F.coalesce(F.try_element_at(forms, local), F.lit(""))
    iri = F.when(F.contains(name, F.lit(":")), name).otherwise(F.concat(F.lit(XSD), name))
    of_type = F.coalesce(F.col("o_datatype"), F.when(F.col("o_lang").isNull(), F.lit(f"{XSD}string")).otherwise(F.lit(""))) == iri if typed else F.lit(True)
    return (F.col("o_kind") == "literal") & of_type & F.rlike("o", form)


def violations(triples: DataFrame, shapes: list[Shape]) -> DataFrame:
    """``s, path, kind, value`` of what breaks a shape; ``value`` is the object, null for a number of them. An object of a datatype that should be a number and is none
    breaks bounds of values too. Where the graph has ``o_datatype``, a datatype is that of the literal and not only the form of its text.

    The shapes are a table that the graph is joined with once; all kinds are decided on the joined rows.
    """
    typed = "o_datatype" in triples.columns
    number = lambda v: float(v) if isinstance(v, (int, float)) else None
    rows = [(i, x.of_type, x.path, x.kind, None if isinstance(x.value, (list, tuple)) else str(x.value), [str(v) for v in x.value] if isinstance(x.value, (list, tuple)) else None, number(x.value)) for i, x in enumerate(shapes)]
    kinds = {"shape": "int", "of_type": "string", "path": "string", "kind": "string", "value": "string", "several": "array<string>", "bound": "double"}
    said = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)
    # literals, whose size Spark knows: rows of a Python list count as of any size, and all subjects would be sorted by their few types to meet them
    table = triples.sparkSession.range(1).select(F.inline(F.array(*(F.struct(*(said(x).alias(n) for x, n in zip(row, kinds, strict=True))) for row in rows)).cast(f"array<struct<{','.join(f'{n}:{k}' for n, k in kinds.items())}>>")))
    types = triples.where("p = 'type'").select("s", F.col("o").alias("of_type")).distinct()
    targets = types.join(table, "of_type")
    said = [c for c in ("o_kind", "o_lang", "o_datatype") if c in triples.columns]
    objects = triples.select("s", F.col("p").alias("path"), "o", *said).distinct()
    met = targets.join(objects, ["s", "path"], "left")

    counted = met.where("kind in ('min_count', 'max_count')").groupBy("s", "path", "kind", "shape", "bound").agg(F.count_distinct("o").alias("n"))
    counts = counted.where(F.when(F.col("kind") == "min_count", F.col("n") < F.col("bound")).otherwise(F.col("n") > F.col("bound")))

    each = met.where("kind not in ('min_count', 'max_count') and o is not null")
    of_class = types.select(F.col("s").alias("o"), F.col("of_type").alias("value"), F.lit(True).alias("of_class"))
    least = triples.join(table.where("kind = 'less_than'").select(F.col("value").alias("p")).distinct(), "p").select("s", F.col("p").alias("value"), F.col("o").try_cast("double").alias("other")).groupBy("s", "value").agg(F.min("other").alias("other"), F.lit(True).alias("has_other"))
    # only what a class or a bound by another path is asked of meets these: joined by object, the few values of a status would be a few large groups
    apart = "coalesce(kind in ('class', 'less_than'), false)"
    classes, lesser = each.where("kind = 'class'").join(of_class, ["o", "value"], "left"), each.where("kind = 'less_than'").join(least, ["s", "value"], "left")
    each = each.where(f"not {apart}").unionByName(classes, allowMissingColumns=True).unionByName(lesser, allowMissingColumns=True)
    amount = F.col("o").try_cast("double")
    fits = (
        F.when(F.col("kind") == "pattern", F.rlike("o", F.col("value")))
        .when(F.col("kind") == "datatype", _has_datatype(F.col("value"), typed))
        .when(F.col("kind") == "in", F.array_contains("several", F.col("o")))
        .when(F.col("kind") == "node_kind", F.col("o_kind") == F.col("value"))
        .when(F.col("kind") == "min_value", amount >= F.col("bound"))
        .when(F.col("kind") == "max_value", amount <= F.col("bound"))
        .when(F.col("kind") == "class", F.col("of_class"))
        .when(F.col("kind") == "less_than", F.col("has_other").isNull() | (amount < F.col("other")))
    )
    broken = each.where(~F.coalesce(fits, F.lit(False))).select("shape", "s", "path", "kind", F.col("o").alias("value")).distinct()
    return counts.select("s", "path", "kind", F.lit(None).cast("string").alias("value")).unionByName(broken.drop("shape"))


# N-Triples

#: What a backslash and one letter stand for.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def escaped(text: Column) -> Column:
    """Text of a literal between quotes."""
    for char, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(char), F.lit(mark))
    return text


def term(value: Column, kind: Column, lang: Column | None = None, datatype: Column | None = None) -> Column:
    """A subject or object as N-Triples and Turtle write it."""
    after = F.concat(F.lit("@"), lang) if lang is not None else F.lit(None)
    typed = F.concat(F.lit("^^<"), datatype, F.lit(">")) if datatype is not None else F.lit(None)
    said = F.concat(F.lit('"'), escaped(value), F.lit('"'), F.coalesce(after, typed, F.lit("")))
    return F.when(kind == "uri", F.concat(F.lit("<"), value, F.lit(">"))).when(kind == "blank", value).otherwise(said)


def subject_kind(s: Column) -> Column:
    return F.when(F.startswith(s, F.lit("_:")), "blank").otherwise("uri")


def object_term(triples: DataFrame) -> Column:
    return term(F.col("o"), F.col("o_kind"), F.col("o_lang"), F.col("o_datatype") if "o_datatype" in triples.columns else None)


def to_ntriples(triples: DataFrame) -> DataFrame:
    """One N-Triples line (``value``) for each triple."""
    return triples.select(F.concat(term(F.col("s"), subject_kind(F.col("s"))), F.lit(" <"), F.col("p"), F.lit("> "), object_term(triples), F.lit(" .")).alias("value"))


def unescaped(said: Column) -> Column:
    """Text of a quoted literal: each backslash with what follows it stands for one character."""
    plain = F.create_map(*(F.lit(x) for kv in ESCAPES.items() for x in kv))
    code = lambda part: F.conv(F.substring(part, F.lit(3), F.length(part)), 16, 10).cast("int")
    utf16 = lambda n: F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(F.concat(F.hex(0xD800 + F.floor((n - 0x10000) / 1024)), F.hex(0xDC00 + (n - 0x10000) % 1024)))
    char = lambda part: F.when(part.rlike(r"^\\[uU]"), F.decode(F.unhex(utf16(code(part))), "UTF-16BE")).when(F.startswith(part, F.lit("\\")), F.try_element_at(plain, F.substring(part, 2, 1))).otherwise(part)
    parts = F.regexp_extract_all(said, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))
    return F.when(F.contains(said, F.lit("\\")), F.array_join(F.transform(parts, char), "")).otherwise(said)


_IRI, _BLANK, _STRING = r"<([^<>\s]*)>", r"(_:[^\s<>\"]+)", r'"((?:[^"\\]|\\.)*)"'
_END = r"\s*\.\s*(?:#.*)?"
LINE = rf"^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*(?:{_IRI}|{_BLANK}|{_STRING}(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^{_IRI})?){_END}$"
#: The groups of a line by spaces, which only the last of them, the text, can hold; before it stands its quote.
_PARTS, _GROUPS = LINE.replace(_STRING, '(")' + _STRING[1:]).removesuffix("$") + r"\s*$", "$1 $2 $3 $4 $5 $8 $9 $6 $7"


def scoped(label: Column, scope: Column | None) -> Column:
    """A blank node's name within its source: equal labels of two sources are two nodes."""
    return label if scope is None else F.concat(F.lit("_:f"), F.substring(F.sha1(scope.cast("binary")), 1, 16), F.lit("."), F.substring(label, F.lit(3), F.length(label)))


def parsed_ntriples(lines: DataFrame, scope: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Triples of N-Triples lines (``value``), and the lines that do not parse; empty lines and comments are neither. Labels of blank nodes hold
    within one ``scope`` (a column of ``lines``, such as the file)."""
    is_triple = F.col("value").rlike(LINE)
    cut = lines.where(is_triple).select(F.split(F.regexp_replace("value", _PARTS, _GROUPS), " ", 9).alias("g"), (F.lit(None) if scope is None else scope).cast("string").alias("scope"))
    part = lambda i: F.nullif(F.get("g", F.lit(i)), F.lit(""))
    iri = lambda i: unescaped(F.get("g", F.lit(i)))
    named = lambda i: scoped(part(i), None if scope is None else F.col("scope"))
    is_literal = part(7).isNotNull()
    kind = F.when(is_literal, "literal").when(part(4).isNotNull(), "blank").otherwise("uri")
    value = F.when(is_literal, iri(8)).otherwise(F.coalesce(named(4), iri(3)))
    datatype = F.when(is_literal, F.nullif(part(6), F.lit(f"{XSD}string")))
    good = cut.select(F.coalesce(named(1), iri(0)).alias("s"), iri(2).alias("p"), value.alias("o"), kind.alias("o_kind"), part(5).alias("o_lang"), datatype.alias("o_datatype")).distinct()
    return good, lines.where(~is_triple & ~F.col("value").rlike(r"^\s*(#.*)?$")).select("value")


def from_ntriples(lines: DataFrame, scope: Column | None = None) -> DataFrame:
    """Triples of N-Triples lines; ``parsed_ntriples`` also returns those that do not parse."""
    return parsed_ntriples(lines, scope)[0]
