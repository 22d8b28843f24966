"""Exports as text lines or files, written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Declared columns as text: nested values as JSON, missing and null ones empty."""
    def cell(name: str) -> Column:
        if name not in df.columns:
            return F.lit("").alias(name)
        nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.StructType, T.MapType))
        c = F.to_json(name) if nested else F.col(name).cast("string")
        return F.coalesce(c, F.lit("")).alias(name)

    return df.select(*(cell(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV of the declared columns with CRLF after each line."""
    flat_cells(df, columns).write.csv(path, header=True, lineSep="\r\n", emptyValue="", quoteAll=False, escape='"')


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    from quire.operators.triples import to_ntriples

    to_ntriples(triples).write.text(path)


def bibtex(df: DataFrame, *, key: str, title: str, note: str) -> DataFrame:
    """One BibTeX entry (``value``) per row; the cite key is what follows the last slash."""
    field = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), F.col(c), F.lit("},\n"))).otherwise("")
    return df.select(F.concat(F.lit("@misc{"), F.substring_index(key, "/", -1), F.lit(",\n"), field("title", title), field("note", note), F.lit("}")).alias("value"))


def ris(df: DataFrame, *, key: str, title: str, note: str) -> DataFrame:
    return df.select(F.concat_ws("\n", F.lit("TY  - GEN"), F.concat(F.lit("ID  - "), F.substring_index(key, "/", -1)), F.concat(F.lit("TI  - "), F.col(title)), F.concat(F.lit("N1  - "), F.col(note)), F.lit("ER  - ")).alias("value"))


def quickstatements(items: DataFrame, statements: DataFrame) -> DataFrame:
    """``local_id``, ``ord``, ``value``: a CREATE line for new items, then a line per label and statement."""
    new = items.where("qid is null").select("local_id", F.lit(0).alias("ord"), F.lit("CREATE").alias("value"))
    who = F.coalesce("qid", F.lit("LAST"))
    labels = items.select("local_id", who.alias("who"), F.explode("labels").alias("lang", "text")).select("local_id", F.lit(1).alias("ord"), F.concat(F.col("who"), F.lit("\tL"), F.col("lang"), F.lit('\t"'), F.col("text"), F.lit('"')).alias("value"))
    lines = statements.join(items.select("local_id", who.alias("who")), "local_id").select("local_id", F.lit(2).alias("ord"), F.concat_ws("\t", "who", "property", "value").alias("value"))
    return new.unionByName(labels).unionByName(lines)


def items_to_triples(statements: DataFrame, *, key: str = "local_id") -> DataFrame:
    """Triples of items: a node for each statement with its rank, and a direct one for each statement of best rank."""
    from quire.operators.rules import truthy

    node = F.concat(F.col(key), F.lit("#"), F.sha1(F.concat_ws("|", "property", "value", "rank").cast("binary")))
    triple = lambda s, p, o, kind: F.struct(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    full = statements.select(F.explode(F.array(
        triple(F.col(key), F.concat(F.lit("p:"), "property"), node, "uri"),
        triple(node, F.concat(F.lit("ps:"), "property"), F.col("value"), "literal"),
        triple(node, F.lit("rank"), F.col("rank"), "literal"),
    )).alias("t")).select("t.*")
    direct = truthy(statements, key).select(F.col(key).alias("s"), F.concat(F.lit("wdt:"), "property").alias("p"), F.col("value").alias("o"), F.lit("literal").alias("o_kind"))
    return full.unionByName(direct).distinct()
