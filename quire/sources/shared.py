"""Written intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is the session's ``spark.checkpoint.dir``. Only an application without that
    setting on one machine (a test) gets a temporary folder of its own; on a cluster it raises ``ValueError``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if context.applicationId not in _own:  # the setting itself is fixed once Spark runs
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quire-")
            context.setCheckpointDir(_own[context.applicationId])
        base = _own[context.applicationId]
    return base.rstrip("/")


def document_of(file: Column) -> Column:
    """The document that a file belongs to: the file, or the folder whose part files are one document, as Spark writes it."""
    return F.regexp_replace(file, r"/part-[^/]*$", "")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quire-{tag}-{uuid.uuid4().hex}"


_open: list[Scratch] = []


class Scratch:
    """Tables that are written while something is worked out; at the end all but the kept ones are deleted.

    What is kept is written itself, so nothing that stays depends on what goes.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        path = new_dir(self.spark, tag)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, failed, *_) -> None:
        _open.remove(self)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def discarded(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more. On failure it stays until the shared folder is cleared."""
    path = getattr(df, "_written_at", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = new_dir(df.sparkSession, tag)
    if _open:
        _open[-1].paths.append(path)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back
