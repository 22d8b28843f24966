"""Imports with partial success: a load is split into rows that are accepted and rows that are refused with reasons, and accepted rows change a
versioned table all at once.

A version is a folder of its own. It counts once a row of ``versions`` names it, which is written last: a load that stops in the middle, or is seen by a reader
halfway, leaves the version before it. A repeated load makes no version.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_dir

KINDS = {"text": "string", "integer": "long", "number": "double", "boolean": "boolean", "date": "date"}


@dataclass(frozen=True)
class Field:
    """A column of a load: its kind, whether it must have a value, and what values are allowed."""

    name: str
    kind: str = "text"
    required: bool = False
    choices: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None


def _cast(said: Column, kind: str) -> Column:
    if kind == "boolean":
        low = F.lower(said)
        return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)
    return said if kind == "text" else said.try_cast(KINDS[kind])


def checked(rows: DataFrame, fields: Sequence[Field], key: Sequence[str], line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Accepted rows with the fields in their kinds, and refused ones (``line``, ``reasons``, ``row`` as JSON).

    ``rows`` has text columns and ``line``, which tells rows apart. A column that is missing counts as empty. Of good rows that share a ``key`` the last line counts
    and the others are refused as ``repeated``. A bad row never keeps another from being accepted.
    """
    said = lambda f: F.nullif(F.trim(F.col(f.name).cast("string")), F.lit("")) if f.name in rows.columns else F.lit(None).cast("string")
    reasons, values = [], []
    for f in fields:
        text, value = said(f), _cast(said(f), f.kind)
        values.append(value.alias(f.name))
        if f.required or f.name in key:
            reasons.append(F.when(text.isNull(), F.lit(f"{f.name}: missing")))
        reasons.append(F.when(text.isNotNull() & value.isNull(), F.lit(f"{f.name}: no {f.kind}")))
        if f.choices:
            reasons.append(F.when(~text.isin(*f.choices), F.lit(f"{f.name}: not allowed")))
        if f.least is not None:
            reasons.append(F.when(value < f.least, F.lit(f"{f.name}: too small")))
        if f.most is not None:
            reasons.append(F.when(value > f.most, F.lit(f"{f.name}: too large")))
    out = rows.select(line, F.array_compact(F.array(*reasons)).alias("reasons"), F.struct(*values).alias("_v"), F.to_json(F.struct(*(c for c in rows.columns if c != line))).alias("row"))
    good = out.where(F.size("reasons") == 0)
    last = good.groupBy(*(F.col(f"_v.{k}").alias(k) for k in key)).agg(F.max(line).alias(line))
    accepted = good.join(last.select(line), line, "left_semi").select("_v.*")
    repeated = good.join(last.select(line), line, "left_anti").select(line, F.array(F.lit("repeated")).alias("reasons"), "row")
    return accepted, out.where(F.size("reasons") > 0).select(line, "reasons", "row").unionByName(repeated)


@dataclass
class Store:
    """A table in versions at ``path``, with one row for each ``key``."""

    spark: SparkSession
    path: str
    schema: str
    key: tuple[str, ...] = field(default=("id",))

    def _versions(self) -> DataFrame | None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        if not at.getFileSystem(conf).exists(at):
            return None
        return self.spark.read.schema("version long, folder string, changed long").parquet(f"{self.path}/versions")

    def version(self) -> int:
        versions = self._versions()
        return 0 if versions is None else versions.agg(F.max("version")).first()[0] or 0

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the latest by default; without any it is empty."""
        versions = self._versions()
        if versions is None:
            return self.spark.createDataFrame([], self.schema)
        row = (versions if version is None else versions.where(F.col("version") == version)).orderBy(F.desc("version")).first()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{row['folder']}") if row else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame) -> dict[str, int]:
        """Adds and replaces rows by key. Returns how many were ``added``, ``changed`` and ``same``, and the ``version``."""
        columns = [f.name for f in T.StructType.fromDDL(self.schema).fields]
        now = self.read()
        old, new = now.select(*self.key, F.struct(*columns).alias("old")), rows.select(*self.key, F.struct(*columns).alias("new"))
        both = old.join(new, list(self.key), "full")
        state = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "added").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
        counts = {r["state"]: r["n"] for r in both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n")).collect()}
        done = {k: counts.get(k, 0) for k in ("added", "changed", "same")}
        if done["added"] + done["changed"]:
            version, folder = self.version() + 1, new_dir(self.spark, "version").rsplit("/", 1)[-1]
            both.select(F.coalesce("new", "old").alias("x")).select("x.*").write.parquet(f"{self.path}/{folder}")
            named = self.spark.createDataFrame([(version, folder, done["added"] + done["changed"])], "version long, folder string, changed long")
            named.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return done | {"version": self.version()}
