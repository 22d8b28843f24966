"""One JSON document written by many tasks, in parts that a second run need not write again.

The document is ``{header, "items": [...]}``. Items are numbered in their order and cut into parts; each part is written by a job of its own whose marker says that it is whole. Read in the order of
their names the parts are the document, byte for byte, whatever wrote them, and ``offsets`` tells where each begins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.paging import ordinals

from .shared import written

PARTS = 8


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_document(items: DataFrame, path: str, *, order: list[str], header: dict, items_key: str = "items", value: Column | None = None, parts: int = PARTS) -> list[int]:
    """Writes the parts that ``path`` does not have yet and returns their numbers.

    ``value`` is an item's JSON, by default that of all its columns; ``order`` tells items apart. ``path`` belongs to one header and one set of items: what these are is
    kept beside the parts, and a run with others raises ``ValueError``.
    """
    spark = items.sparkSession
    if not _exists(spark, f"{path}/items/_SUCCESS"):  # the numbers are written once, so every run cuts the same parts
        said = value if value is not None else F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"})
        placed = ordinals(items.select(F.struct(*order).alias("at"), said.alias("value")), "at")
        placed.select("ordinal", "value").write.mode("overwrite").parquet(f"{path}/items")
    numbered = spark.read.parquet(f"{path}/items")
    total = numbered.count()
    prefix = json.dumps(header, ensure_ascii=False)
    opener = (f"{prefix[:-1]}, " if header else "{") + json.dumps(items_key, ensure_ascii=False) + ": ["
    plan = json.dumps([opener, total, parts])
    if _exists(spark, f"{path}/plan/_SUCCESS"):
        if spark.read.text(f"{path}/plan").first()[0] != plan:
            raise ValueError("another document is at this path")
    else:
        spark.createDataFrame([(plan,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")
    part = F.floor((F.col("ordinal") - 1) * parts / F.lit(max(total, 1)))
    made = []
    for k in range(parts):
        folder = f"{path}/parts/{k:05}"
        if _exists(spark, f"{folder}/_SUCCESS"):
            continue
        line = F.concat(F.when(F.col("ordinal") > 1, ",").otherwise(""), "value")
        rows = numbered.where(part == k).select("ordinal", line.alias("value"))
        ends = [(0, opener)] * (k == 0) + [(total + 1, "]}")] * (k == parts - 1)
        if ends:
            rows = rows.unionByName(spark.createDataFrame(ends, "ordinal long, value string"))
        rows.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("value").write.mode("overwrite").text(folder)
        made.append(k)
    return made


def offsets(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """File, first byte and length of the document's files in order: a prefix sum over their sizes, a row for each file."""
    rows = spark.read.format("binaryFile").load(f"{path}/parts/*/part-*").select("path", "length").orderBy("path").collect()
    out, at = [], 0
    for r in rows:
        out.append((r["path"], at, r["length"]))
        at += r["length"]
    return out


def history_items(events: DataFrame) -> DataFrame:
    """Events as a history export has them, oldest first: ``created_at``, ``id`` and the event as JSON in ``value``."""
    named = [c for c in ("id", "entity_type", "entity_id", "rev", "parent_id", "op", "patch", "state", "actor", "message", "created_at") if c in events.columns]
    return events.select("created_at", "id", F.to_json(F.struct(*named), {"ignoreNullFields": "false"}).alias("value"))


def export_history(events: DataFrame, path: str, *, project: str, entity_type: str | None = None, entity_id: str | None = None) -> list[int]:
    """History of a project, or of one entity, as one document. Type and id of an entity are given together or not at all."""
    if (entity_type is None) != (entity_id is None):
        raise ValueError("entity_type and entity_id go together")
    some = events if entity_id is None else events.where((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id))
    rows = written(history_items(some), "history")
    header = {"project_id": project, "entity_type": entity_type, "entity_id": entity_id, "event_count": rows.count()}
    return write_document(rows, path, order=["created_at", "id"], header=header, items_key="events", value=F.col("value"))
