"""Turtle files as triples, statement by statement.

Files are split where serializers end a statement: a full stop at the end of a line; a part may hold several statements. Prefixes are gathered first (a bounded
list, as a file declares few). Blank nodes in brackets, nested ones too, are named by the part's text and their place in it, labels hold within
their document (a file, or the part files of a folder). Parts that do not parse are returned with their text instead of being guessed: collections in round brackets, texts in triple quotes, and texts
that hold a full stop at the end of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.let import let
from quire.operators.triples import XSD, object_term, scoped, subject_kind, term, unescaped

from .shared import document_of, written

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
MOST_PREFIXES = 10_000
MOST_OBJECTS = 10_000

LITERAL = r'"(?:[^"\\\n]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^(?:<[^>]*>|[^\s;,<>"\[\]()]*[^\s;,<>"\[\]().]))?'
TERMS = rf'<[^>]*>|{LITERAL}|[;,\[\]]|[^\s;,<>"\[\]()]*[^\s;,<>"\[\]().]|\.'
PREFIX = r"(?i)^\s*@?prefix\s+([^\s:]*):\s*<([^>]*)>\s*\.?\s*$"
_TRIPLE = "struct<s:string,p:string,o:string,o_kind:string,o_lang:string,o_datatype:string>"


def statements(spark: SparkSession, path: str) -> DataFrame:
    """One row (``value``, ``file``: its document) for each statement or prefix, without comment lines and full stops."""
    raw = spark.read.option("lineSep", ".\n").text(path).select("value", document_of(F.col("_metadata.file_path")).alias("file"))
    plain = F.regexp_replace(F.regexp_replace("value", r"(?m)^\s*#[^\n]*$", ""), r"^\s+|\s*\.?\s*$", "")
    return raw.select(plain.alias("value"), "file").where(F.regexp_replace("value", r"\s+", "") != "")


def _iri(t: Column, names: Column) -> Column:
    """IRI of a term in angle brackets or with a prefix; null if it is neither."""
    prefix, rest = F.regexp_extract(t, r"^([^:]*):", 1), F.regexp_extract(t, r"^[^:]*:(.*)$", 1)
    plain = F.regexp_replace(rest, r"\\([_~.!$&'()*+,;=/?#@%-])", "$1")
    return F.when(F.startswith(t, F.lit("<")), unescaped(F.substring(t, F.lit(2), F.length(t) - 2))).when(F.contains(t, F.lit(":")), F.concat(F.try_element_at(names, prefix), plain))


def _term(t: Column, names: Column, file: Column) -> Column:
    """``value, kind, lang, datatype`` of a term; a null value for one that is none. ``file`` is what ``scoped`` puts before the labels of its document."""
    none = F.lit(None).cast("string")

    def made(value: Column, kind: str, lang: Column = none, datatype: Column = none) -> Column:
        return F.struct(value.alias("value"), F.lit(kind).alias("kind"), lang.alias("lang"), datatype.alias("datatype"))

    def literal(body: Column) -> Column:
        after = F.substring(t, F.length(body) + 3, F.length(t))
        text = lambda of_type, datatype: F.when(of_type.isNull() | datatype.isNotNull(), unescaped(body))
        typed = lambda of_type: let(_iri(of_type, names), lambda x: made(text(of_type, x), "literal", none, F.nullif(x, F.lit(f"{XSD}string"))))
        rest = lambda x, n: F.nullif(F.substr(x, F.lit(n)), F.lit(""))
        return let(after, lambda x: F.when(F.startswith(x, F.lit("^^")), let(rest(x, 3), typed)).otherwise(made(unescaped(body), "literal", F.when(F.startswith(x, F.lit("@")), rest(x, 2)))))

    number = F.when(t.rlike(r"^[+-]?\d+$"), "integer").when(t.rlike(r"^[+-]?\d*\.\d+$"), "decimal").when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)[eE][+-]?\d+$"), "double").when(t.isin("true", "false"), "boolean")
    other = let(number, lambda n: F.when(n.isNotNull(), made(t, "literal", none, F.concat(F.lit(XSD), n))).otherwise(made(_iri(t, names), "uri")))
    return (
        F.when(F.startswith(t, F.lit("<")), made(_iri(t, names), "uri"))
        .when(F.startswith(t, F.lit('"')), let(F.regexp_extract(t, r'(?s)^"((?:[^"\\]|\\.)*)"', 1), literal))
        .when(F.startswith(t, F.lit("_:")), made(F.concat(file, F.substr(t, F.lit(3))), "blank"))
        .when(t == "a", made(F.lit(TYPE), "uri"))
        .otherwise(other)
    )


def _flat(terms: Column, names: Column, file: Column) -> Column:
    """Triples of a part without brackets and with nothing after its last object, the usual form; null for any other, which ``_triples`` reads."""
    text = F.array_join(terms, "\n")
    lists = F.transform(F.split(text, "\n;\n"), lambda x, i: F.slice(F.split(x, "\n"), F.when(i == 0, 2).otherwise(1), F.length(x) + 1))
    commas = lambda xs: F.forall(F.filter(xs, lambda _, i: (i > 0) & (i % 2 == 0)), lambda x: x == ",")

    def said(s: Column) -> Column:
        triple = lambda v, x: F.struct(s["value"].alias("s"), v["value"].alias("p"), x["value"].alias("o"), x["kind"].alias("o_kind"), x["lang"].alias("o_lang"), x["datatype"].alias("o_datatype"))
        objects = lambda xs, v: F.transform(F.filter(xs, lambda _, i: i % 2 == 1), lambda t: let(_term(t, names, file), lambda x: triple(v, x)))
        of_verb = lambda xs: let(_term(F.get(xs, F.lit(0)), names, file), lambda v: F.when(v["value"].isNotNull() & (v["kind"] == "uri"), objects(xs, v)))
        out = F.flatten(F.transform(lists, lambda xs: F.when((F.size(xs) > 0) & (F.size(xs) % 2 == 0) & commas(xs), of_verb(xs))))
        return F.when(s["value"].isNotNull() & (s["kind"] != "literal"), out)

    whole = (F.size(terms) > 2) & (F.size(F.split(text, "\n")) == F.size(terms))
    found = F.when(whole, let(_term(F.get(terms, F.lit(0)), names, file), said))
    return let(found, lambda out: F.when(F.forall(out, lambda x: x["o"].isNotNull()), out))


def _triples(value: Column, names: Column, document: Column) -> Column:
    """Triples of one part. A stack of subjects and verbs follows the brackets: after a subject a verb and its objects (between commas), and so on after each
    semicolon; a bracket opens a blank node, whose place in the text names it, and goes on with what holds it. Null if the part does not parse."""
    level = "struct<s:string,p:string,next:string,bracket:boolean>"
    start = F.struct(
        F.expr("array(named_struct('s', cast(null as string), 'p', cast(null as string), 'next', 'subject', 'bracket', false))").cast(f"array<{level}>").alias("stack"),
        F.expr(f"cast(array() as array<{_TRIPLE}>)").alias("out"),
        F.lit(True).alias("ok"),
        F.lit(0).alias("n"),
    )
    seed = F.substring(F.sha1(F.concat_ws("\n", document, value).cast("binary")), 1, 20)

    def read(terms: Column, file: Column) -> Column:
        def lvl(s: Column, p: Column, next_: Column | str, bracket: Column | bool) -> Column:
            lit = lambda x: x if isinstance(x, Column) else F.lit(x)
            return F.struct(s.cast("string").alias("s"), p.cast("string").alias("p"), lit(next_).alias("next"), lit(bracket).alias("bracket"))

        def step(state: Column, t: Column) -> Column:
            n = state["n"] + 1
            bracket_node = F.concat(F.lit("_:b"), seed, F.lit("n"), n.cast("string"))
            opens = F.struct(bracket_node.alias("value"), F.lit("blank").alias("kind"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"))
            x_of = F.when(t == "[", opens).otherwise(_term(t, names, file))

            def moved(x: Column, top: Column) -> Column:
                stack = state["stack"]
                rest = F.slice(stack, 1, F.size(stack) - 1)
                at = top["next"]
                mark = t.isin(";", ",", ".", "]")
                is_object = ~mark & (at == "object")
                triple = F.struct(top["s"].alias("s"), top["p"].alias("p"), x["value"].alias("o"), x["kind"].alias("o_kind"), x["lang"].alias("o_lang"), x["datatype"].alias("o_datatype"))
                here = (
                    F.when(t == ";", lvl(top["s"], top["p"], "verb", top["bracket"]))
                    .when(t == ",", lvl(top["s"], top["p"], "object", top["bracket"]))
                    .when(t == ".", lvl(F.lit(None), F.lit(None), "subject", False))
                    .when(at == "subject", lvl(x["value"], F.lit(None), F.when(t == "[", "mark").otherwise("verb"), False))
                    .when(at == "verb", lvl(top["s"], x["value"], "object", top["bracket"]))
                    .otherwise(lvl(top["s"], top["p"], "mark", top["bracket"]))
                )
                # a subject in brackets may end the statement or have verbs: both marks and verbs may follow it
                after_node = F.when(at == "mark", F.when(~mark & (top["p"].isNull()), lvl(top["s"], x["value"], "object", top["bracket"])))
                below = F.concat(rest, F.array(F.coalesce(after_node, here)))
                pushed = F.concat(below, F.array(lvl(x["value"], F.lit(None), "verb", True)))
                new_stack = F.when(t == "]", rest).when((t == "[") & at.isin("subject", "object"), pushed).otherwise(below)
                is_verb = (at == "verb") | ((at == "mark") & top["p"].isNull())
                fits = (
                    F.when(t == ";", at.isin("mark", "verb"))
                    .when(t == ",", (at == "mark") & top["p"].isNotNull())
                    .when(t == ".", (at.isin("mark", "verb")) & (F.size(stack) == 1))
                    .when(t == "]", at.isin("mark", "verb") & top["bracket"])
                    .when(t == "[", at.isin("subject", "object"))
                    .when(is_verb, x["value"].isNotNull() & (x["kind"] == "uri"))
                    .when(at == "subject", x["value"].isNotNull() & (x["kind"] != "literal"))
                    .otherwise((at == "object") & x["value"].isNotNull())
                )
                return F.struct(
                    new_stack.alias("stack"),
                    F.when(is_object, F.array_append(state["out"], triple)).otherwise(state["out"]).alias("out"),
                    (state["ok"] & F.coalesce(fits, F.lit(False))).alias("ok"),
                    n.alias("n"),
                )

            # once something does not fit nothing more is read
            return F.when(state["ok"], let(x_of, lambda x: let(F.element_at(state["stack"], -1), lambda top: moved(x, top)))).otherwise(state)

        nothing_left = F.regexp_replace(value, rf"{TERMS}|\s+", "") == ""

        def whole(f: Column) -> Column:
            last = F.element_at(f["stack"], -1)
            ended = (F.size(f["stack"]) == 1) & last["next"].isin("mark", "verb", "subject")
            return F.when(f["ok"] & ended & (F.size(f["out"]) > 0) & nothing_left, f["out"])

        flat = let(_flat(terms, names, file), lambda x: F.when(nothing_left, x))
        return F.coalesce(flat, let(F.aggregate(terms, start, step), whole))

    return let(F.regexp_extract_all(value, F.lit(TERMS), F.lit(0)), lambda terms: let(scoped(F.lit("_:"), document), lambda file: read(terms, file)))


def read_turtle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Triples (``s, p, o, o_kind, o_lang, o_datatype``, a set) of the files at ``path``, and the parts (``value``) that do not parse."""
    rows = written(statements(spark, path), "statements")
    is_prefix = F.col("value").rlike(PREFIX)
    declared = rows.where(is_prefix).select(F.regexp_extract("value", PREFIX, 1).alias("prefix"), F.regexp_extract("value", PREFIX, 2).alias("uri")).distinct().limit(MOST_PREFIXES + 1).collect()
    if len(declared) > MOST_PREFIXES or len({r["prefix"] for r in declared}) < len(declared):
        raise ValueError("too many prefixes, or one with two meanings")
    pairs = [F.lit(x) for r in declared for x in (r["prefix"], r["uri"])]
    names = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    parsed = written(rows.where(~is_prefix).select("value", _triples(F.col("value"), names, F.col("file")).alias("t")), "parsed")
    return parsed.select(F.explode("t").alias("t")).select("t.*").distinct(), parsed.where("t is null").select("value")


def to_turtle(triples: DataFrame, *, most: int = MOST_OBJECTS) -> DataFrame:
    """Turtle statements (``value``): the verbs and objects of a subject in order. A subject with more than ``most`` objects is written in several
    statements of about that size, so that none is gathered whole."""
    said = triples.select("s", "p", object_term(triples).alias("o")).distinct()
    sizes = said.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    split = said.join(sizes, "s", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("p", "o"), F.ceil(F.col("n") / most)), F.lit(0)))
    verbs = split.groupBy("s", "part", "p").agg(F.array_join(F.array_sort(F.collect_list("o")), ", ").alias("objects"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p", "objects"))), lambda x: F.concat(F.lit("<"), x["p"], F.lit("> "), x["objects"]))
    return verbs.groupBy("s", "part").agg(F.concat(term(F.col("s"), subject_kind(F.col("s"))), F.lit(" "), F.array_join(lines, " ;\n    "), F.lit(" .")).alias("value")).select("value")
