"""Whole-version snapshots of many tables, replaced in one commit (SNK-03).

A snapshot's tables are first written to folders of their own that nobody reads.  A manifest file that names them is then created in one
step; it is the commit.  Readers follow the newest manifest of a version, so they see all tables of the old snapshot
or all of the new one, also when the writer dies between two tables, and an emptied table is empty rather than old.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFESTS = "manifests"
MANIFEST = "version_id string, number bigint, tables array<struct<name: string, folder: string, rows: bigint, schema: string>>"


class CommitConflict(RuntimeError):
    """Another writer committed this version in the meantime."""


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The newest manifest of every version."""
    path, files = _path(spark, f"{root}/{MANIFESTS}")
    if not files.exists(path):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").json(f"{root}/{MANIFESTS}")
    return rows.groupBy("version_id").agg(F.max("number").alias("number"), F.max_by("tables", "number").alias("tables"))


def stage_snapshot(tables: dict[str, DataFrame], root: str) -> list[dict]:
    """Writes every table to a new folder, in the order given (children before parents); returns the manifest's entries."""
    entries = []
    for name, rows in tables.items():
        folder = f"data/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{root}/{folder}")
        count = rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/{folder}").count()
        entries.append({"name": name, "folder": folder, "rows": count, "schema": rows.schema.json()})
    return entries


def commit_snapshot(spark: SparkSession, root: str, version_id: str, entries: list[dict], after: int) -> int:
    """Creates the manifest that follows number ``after``; fails if it is there already."""
    number = after + 1
    name = f"{uuid.uuid5(uuid.NAMESPACE_URL, version_id).hex}-{number:012d}"
    draft, files = _path(spark, f"{root}/{MANIFESTS}/.{name}-{uuid.uuid4().hex}")
    final, _ = _path(spark, f"{root}/{MANIFESTS}/{name}.json")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps({"version_id": version_id, "number": number, "tables": entries}, ensure_ascii=False).encode()))
    out.close()
    # a rename onto a file that exists fails or does nothing; readers only ever see whole files
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise CommitConflict(f"{version_id}: manifest {number} exists")
    return number


def replace_snapshot(tables: dict[str, DataFrame], root: str, version_id: str) -> int:
    """SNK-03: all tables of a version replaced by these; tables that are not named no longer belong to it.  Returns the manifest's number."""
    spark = next(iter(tables.values())).sparkSession
    last = manifests(spark, root).where(F.col("version_id") == version_id).select("number").first()
    return commit_snapshot(spark, root, version_id, stage_snapshot(tables, root), last["number"] if last else 0)


def read_snapshot(spark: SparkSession, root: str, table: str, *versions: str) -> DataFrame:
    """Rows of a table with their ``version_id``, of all versions or those named; a manifest has one entry per table, few rows in all."""
    current = manifests(spark, root)
    if versions:
        current = current.where(F.col("version_id").isin(*versions))
    found = current.select("version_id", F.explode("tables").alias("t")).where(F.col("t.name") == table).select("version_id", "t.*").orderBy("version_id").collect()
    if not found:
        raise ValueError(f"no snapshot has a table {table}")
    out = None
    for row in found:
        part = spark.read.schema(StructType.fromJson(json.loads(row["schema"]))).parquet(f"{root}/{row['folder']}").withColumn("version_id", F.lit(row["version_id"]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def remove_unnamed(spark: SparkSession, root: str) -> int:
    """Deletes folders that no newest manifest names (older snapshots, writers that died); returns their number.  Not while a writer runs."""
    named = {r["folder"] for r in manifests(spark, root).select(F.explode("tables.folder").alias("folder")).collect()}
    data, files = _path(spark, f"{root}/data")
    gone = 0
    for table in files.listStatus(data) if files.exists(data) else []:
        for folder in files.listStatus(table.getPath()):
            path = folder.getPath()
            if f"data/{table.getPath().getName()}/{path.getName()}" not in named:
                files.delete(path, True)
                gone += 1
    return gone
