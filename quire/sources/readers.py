"""Readers of catalogue formats into DataFrames. All use Spark's own sources and functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD, SUB, RECORD = "\x1e", "\x1f", "\x1d"
SUFFIXES = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "mrc": "marc", "marc": "marc", "xml": "marcxml", "marcxml": "marcxml", "tsv": "tsv", "csv": "csv", "nt": "ntriples", "parquet": "parquet"}

# fixed values: what the columns of a catalogue table are called, by the name they get
COLUMN_NAMES = {
    "control_number": ("control_number", "001", "id", "record_id"),
    "title": ("title", "245$a", "main_title"),
    "authors": ("authors", "author", "100$a", "creator"),
    "contributors": ("contributors", "contributor", "700$a"),
    "subjects": ("subjects", "subject", "650$a"),
}

OCCURRENCE = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("occurrence", T.IntegerType()), T.StructField("indicators", T.ArrayType(T.StringType())), T.StructField("subfields", T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("value", T.StringType())]))), T.StructField("data", T.StringType())]))


def sniff(head: bytes) -> str:
    """Format of a file by its first bytes; raises ``ValueError`` for an empty one."""
    text = head.lstrip(b"\xef\xbb\xbf \t\r\n")
    if not text:
        raise ValueError("empty file")
    if text[:1] == b"<":
        return "marcxml"
    if text[:1] in b"{[":
        return "json" if text[:1] == b"[" else "jsonl"
    if text[:5].isdigit():
        return "marc"
    line = text.split(b"\n", 1)[0]
    return "tsv" if b"\t" in line else "csv" if b"," in line else "jsonl"


def head_of(spark: SparkSession, path: str, size: int = 4096) -> bytes:
    """First bytes of a file, or of the first file in a folder, read through Hadoop's file systems; no more is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if fs.getFileStatus(at).isDirectory():
        inside = sorted(x.getPath().toString() for x in fs.listStatus(at) if x.isFile() and x.getPath().getName()[:1] not in "._")
        if not inside:
            return b""
        at = jvm.org.apache.hadoop.fs.Path(inside[0])
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def format_of(spark: SparkSession, path: str) -> str:
    """Format by suffix, else by content: a bounded look at the first bytes of one file."""
    return SUFFIXES.get(path.rsplit(".", 1)[-1].lower()) or sniff(head_of(spark, path, 64))


# fixed values: encodings of catalogue tables by their first bytes, and the one tried where a text is not UTF-8
MARKS = {b"\xef\xbb\xbf": "UTF-8", b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE"}
HEBREW_ENCODING, ANY_ENCODING = "windows-1255", "ISO-8859-1"


def sniff_encoding(head: bytes) -> str:
    """Encoding of a text by its first bytes: a byte order mark, else UTF-8 if they are (but for a character cut at the end), else the Hebrew
    code page if they can be read in it, else one that reads any bytes."""
    for mark, encoding in MARKS.items():
        if head.startswith(mark):
            return encoding
    for encoding in ("UTF-8", HEBREW_ENCODING):
        try:
            head.decode(encoding)
            return encoding
        except UnicodeDecodeError as e:
            if e.reason == "unexpected end of data":
                return encoding
    return ANY_ENCODING


def sniff_delimiter(head: bytes, encoding: str = "UTF-8", suffix: str = "") -> str:
    """Delimiter by suffix, else a tab if the first line has one, else a comma."""
    if suffix.lower() in ("tsv", "csv"):
        return "\t" if suffix.lower() == "tsv" else ","
    return "\t" if "\t" in head.decode(encoding, "replace").split("\n", 1)[0] else ","


def header_name(name: str) -> str:
    return name.lstrip("﻿").strip().strip('"').lower().replace(" ", "_").replace("-", "_")


def read_table(spark: SparkSession, path: str, *, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV or TSV with a header: names in lower case with underscores, all cells text, known columns under their common names."""
    hebrew = encoding.lower() == HEBREW_ENCODING
    df = spark.read.csv(path, header=True, sep=sep, encoding=ANY_ENCODING if hebrew else encoding, multiLine=True, escape='"', inferSchema=False)
    if hebrew:  # Spark reads no such code page: bytes are read one to one and translated
        signs = {b.decode(ANY_ENCODING): b.decode(HEBREW_ENCODING, "ignore") for b in (bytes([i]) for i in range(128, 256))}
        known = {a: b for a, b in signs.items() if b}
        names = [c.translate(str.maketrans(known)) for c in df.columns]
        cells = df.toDF(*(f"c{i}" for i in range(len(names))))
        df = cells.select(*(F.translate(c, "".join(known), "".join(known.values())) for c in cells.columns)).toDF(*names)
    df = df.toDF(*map(header_name, df.columns))
    common = {alias: name for name, aliases in COLUMN_NAMES.items() for alias in aliases}
    taken: set[str] = set()
    names = []
    for c in df.columns:
        n = common.get(c, c)
        names.append(n if n not in taken else c)
        taken.add(names[-1])
    return df.toDF(*names)


def read_any_table(spark: SparkSession, path: str) -> DataFrame:
    """``read_table`` with the encoding and delimiter that the first bytes show."""
    head = head_of(spark, path)
    encoding = sniff_encoding(head)
    return read_table(spark, path, sep=sniff_delimiter(head, encoding, path.rsplit(".", 1)[-1]), encoding=encoding)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line`` (from 1) and ``value`` of text files. Splits are numbered on their own and shifted by the lines of those before them in
    their file."""
    from quire.sources.shared import written

    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    raw = spark.read.text(path).select("value", at.alias("at"), F.monotonically_increasing_id().alias("_id"))
    lines = written(raw, "lines")
    splits = lines.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"))
    before = Window.partitionBy("at.file").orderBy("at.start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return lines.join(starts, "at").select(F.col("at.file").alias("file"), (F.col("before") + F.col("_id") - F.col("first") + 1).alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Good rows of a JSON-lines file, and its bad lines: ``file``, ``line`` (from 1) and ``value``."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")
    bad, said = F.col("r._bad").isNotNull(), "trim(value) <> ''"
    good = spark.read.text(path).where(said).select(parsed).where(~bad).select(*(F.col(f"r.{f.name}") for f in fields.fields))
    return good, numbered_lines(spark, path).where(said).select("file", "line", "value", parsed).where(bad).select("file", "line", "value")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array or object of records, or JSON lines: lines if the file does not start with a bracket and every line is an object, or if it cannot be
    read as a whole."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    broken = spark.read.text(path).where("trim(value) <> ''").where(parsed["_bad"].isNotNull())
    if sniff(head_of(spark, path, 64)) != "json" and broken.isEmpty():
        return read_jsonl(spark, path, fields)[0]
    whole = spark.read.schema(full).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return whole.drop("_bad") if whole.where("_bad is not null").first() is None else read_jsonl(spark, path, fields)[0]


def read_ntriples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Triples of the files at ``path``, and the lines (``value``) that do not parse. Blank nodes of two documents (files, or folders of part files) are never one node."""
    from quire.operators.triples import parsed_ntriples

    from .shared import document_of

    return parsed_ntriples(spark.read.text(path).select("value", document_of(F.col("_metadata.file_path")).alias("file")), F.col("file"))


def _fields(body: Column, directory: Column) -> Column:
    """Field instances of a binary record: twelve characters of directory for each. Lengths count bytes, so fields are cut at their end marks instead."""
    tags = F.transform(F.regexp_extract_all(directory, F.lit(r"(\d{3})\d{9}"), F.lit(1)), lambda t: t)
    texts = F.slice(F.split(body, FIELD), 1, F.size(tags))
    pairs = F.arrays_zip(tags.alias("tag"), texts.alias("raw"))

    def one(x: Column, i: Column) -> Column:
        control = F.startswith(x["tag"], F.lit("00"))
        subs = F.transform(F.slice(F.split(x["raw"], SUB), 2, 1 << 20), lambda s: F.struct(F.substring(s, 1, 1).alias("code"), F.substr(s, F.lit(2)).alias("value")))
        marks = F.array(F.substring(x["raw"], 1, 1), F.substring(x["raw"], 2, 1))
        nth = F.size(F.filter(F.slice(tags, 1, i + 1), lambda t: t == x["tag"]))
        return F.struct(
            x["tag"].alias("tag"), nth.alias("occurrence"), F.when(~control, marks).alias("indicators"),
            F.when(~control, subs).alias("subfields"), F.when(control, x["raw"]).alias("data"),
        )

    return F.transform(pairs, one).cast(OCCURRENCE)


def read_marc(spark: SparkSession, path: str) -> DataFrame:
    """Binary MARC 21 in UTF-8: ``leader``, ``control_number``, ``occurrences``, and ``error`` for records without a readable leader."""
    raw = spark.read.option("lineSep", RECORD).text(path).select(F.regexp_replace("value", r"^[\r\n]+", "").alias("value")).where("value <> ''")
    parts = raw.select(F.substring("value", 1, 24).alias("leader"), F.substr("value", F.lit(25)).alias("rest"))
    ok = F.col("leader").rlike(r"^\d{5}.{7}\d{5}")
    cut = parts.select("leader", ok.alias("ok"), F.substring_index("rest", FIELD, 1).alias("directory"), F.regexp_replace("rest", f"^[^{FIELD}]*{FIELD}", "").alias("body"))
    return _with_control(cut.select("leader", F.when(F.col("ok"), _fields(F.col("body"), F.col("directory"))).alias("occurrences"), F.when(~F.col("ok"), "bad leader").alias("error")))


def read_marcxml(spark: SparkSession, path: str) -> DataFrame:
    """MARCXML records in the shape of ``read_marc``. Files that declare a document type or an entity, or hold a NUL, raise ``ValueError``."""
    if not spark.read.text(path).where(F.col("value").rlike(r"<!(?i:DOCTYPE|ENTITY)|\x00")).isEmpty():
        raise ValueError("document types, entities and NUL are refused")
    schema = "leader string, controlfield array<struct<_tag string, _VALUE string>>, datafield array<struct<_tag string, _ind1 string, _ind2 string, subfield array<struct<_code string, _VALUE string>>>>"
    rows = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", "true").option("ignoreSurroundingSpaces", "false").schema(schema).load(path)
    none = F.array().cast(OCCURRENCE)
    control = F.transform("controlfield", lambda x: F.struct(x["_tag"].alias("tag"), F.lit(1).alias("occurrence"), F.lit(None).cast("array<string>").alias("indicators"), F.lit(None).cast("array<struct<code string, value string>>").alias("subfields"), x["_VALUE"].alias("data")))
    subs = lambda x: F.transform(x["subfield"], lambda s: F.struct(s["_code"].alias("code"), s["_VALUE"].alias("value")))
    nth = lambda x, i: F.size(F.filter(F.slice("datafield", 1, i + 1), lambda y: y["_tag"] == x["_tag"]))
    data = F.transform("datafield", lambda x, i: F.struct(x["_tag"].alias("tag"), nth(x, i).alias("occurrence"), F.array(x["_ind1"], x["_ind2"]).alias("indicators"), subs(x).alias("subfields"), F.lit(None).cast("string").alias("data")))
    both = F.concat(F.coalesce(control.cast(OCCURRENCE), none), F.coalesce(data.cast(OCCURRENCE), none))
    return _with_control(rows.select("leader", both.alias("occurrences"), F.lit(None).cast("string").alias("error")))


def _with_control(rows: DataFrame) -> DataFrame:
    number = F.get(F.filter("occurrences", lambda x: x["tag"] == "001"), F.lit(0))["data"]
    return rows.select("leader", F.trim(number).alias("control_number"), "occurrences", "error")


def flat_columns(records: DataFrame) -> DataFrame:
    """``control_number``, and a map of ``tag$code`` (or ``tag``) to the values of its occurrences: repeats inside one by space, occurrences by bar, both
    in their order. A record stays one row, so nothing is shuffled. Records without occurrences are left out."""

    def cells(x: Column) -> Column:
        cell = lambda key, v: F.struct(key.alias("key"), x["occurrence"].alias("occurrence"), v.alias("v"))
        subs = F.coalesce(x["subfields"], F.array().cast("array<struct<code string, value string>>"))
        codes = F.array_distinct(F.transform(subs, lambda s: s["code"]))
        of = lambda code: F.array_join(F.transform(F.filter(subs, lambda s: s["code"] == code), lambda s: F.coalesce(s["value"], x["data"])), " ")
        return F.when(F.size(subs) == 0, F.array(cell(x["tag"], F.coalesce(x["data"], F.lit(""))))).otherwise(F.transform(codes, lambda c: cell(F.concat(x["tag"], F.lit("$"), c), of(c))))

    flat = records.where("occurrences is not null").select("control_number", F.flatten(F.transform("occurrences", cells)).alias("cells"))
    # sorted once, so that the cells of a key stand together; each is then put to the text before it or begins one
    order = F.array_sort(F.transform("cells", lambda c, i: F.struct(c["key"].alias("key"), c["occurrence"].alias("occurrence"), i.alias("i"), c["v"].alias("v"))))

    def fold(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(c["key"].alias("key"), F.concat(last["text"], F.lit("|"), c["v"]).alias("text"))
        begun = F.struct(c["key"].alias("key"), c["v"].alias("text"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["key"] == c["key"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.array_append(done, begun))

    texts = F.aggregate(order, F.expr("cast(array() as array<struct<key:string,text:string>>)"), fold)
    return flat.where(F.size("cells") > 0).select("control_number", F.map_from_entries(texts).alias("columns"))


def occurrence_errors(occurrences: Column) -> Column:
    """What is wrong with a record's field instances: tags, indicators, codes, repeated numbers."""
    bad = lambda c, text: F.when(F.coalesce(c, F.lit(False)), F.lit(text))
    ids = F.transform(occurrences, lambda x: F.concat(x["tag"], F.lit(":"), x["occurrence"].cast("string")))
    return F.array_compact(
        F.array(
            bad(F.exists(occurrences, lambda x: ~x["tag"].rlike(r"^\d{3}$")), "tag"),
            bad(F.exists(occurrences, lambda x: x["occurrence"] < 1), "occurrence"),
            bad(F.size(F.array_distinct(ids)) < F.size(ids), "repeated"),
            bad(F.exists(occurrences, lambda x: F.size(x["indicators"]) != 2), "indicators"),
            bad(F.exists(occurrences, lambda x: F.exists(x["subfields"], lambda s: F.length(s["code"]) != 1)), "code"),
        )
    )
