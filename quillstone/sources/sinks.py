"""Sinks (SNK-01 .. SNK-03, SNK-05, SNK-07, SNK-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def export_tables(tables: dict[str, DataFrame], folder: str, file_format: str = "json") -> DataFrame:
    """SNK-01 / SNK-02: every table into its own folder; row counts are observed while writing."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, rows in tables.items():
        seen = Observation(name)
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format(file_format).save(f"{folder}/{name}")
        counts.append((name, seen.get["rows"]))
    return spark.createDataFrame(counts, "table_name string, rows bigint")


def replace_version(rows: DataFrame, path: str, *versions: str) -> None:
    """SNK-03: a version's rows replace the same version's rows and leave all other versions alone.

    Dynamic partition overwrite swaps whole ``version_id`` partitions in one commit.  ``versions`` names the versions
    that ``rows`` stands for: one without a row becomes empty.
    """
    spark = rows.sparkSession
    gone = [v for v in versions if rows.where(F.col("version_id") == v).isEmpty()]
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(path)
    for version in gone:
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(version)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version_id={escaped}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """SNK-05: one JSON object per vector and line."""
    vectors.select("embedding_id", "source_type", "source_id", "model", "dimensions", "embedding").write.mode("overwrite").json(path)


def mark_released(versions: DataFrame, version_id: str) -> DataFrame:
    """SNK-07: the version's row becomes released; anything but exactly one such row fails."""
    hit = F.col("version_id") == version_id
    count = versions.where(hit).limit(2).count()
    if count != 1:
        raise ValueError(f"{count} rows for version {version_id}, expected 1")
    return versions.withColumn("status", F.when(hit, "released").otherwise(F.col("status")))


def write_csv(rows: DataFrame, path: str) -> None:
    """SNK-08: CSV with a header; the mark goes before the first header name so that spreadsheets see UTF-8."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).csv(path)


def markdown_table(rows: DataFrame, limit: int = 100) -> str:
    """SNK-09: a small aggregate as a Markdown table, formatted on the driver; says how many rows it leaves out."""
    found = rows.limit(limit).collect()
    total = rows.count() if len(found) == limit else len(found)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in found]
    if total > len(found):
        lines += ["", f"{total - len(found)} further rows are not shown."]
    return "\n".join(lines)


def read_version(spark: SparkSession, path: str, version_id: str) -> DataFrame:
    """Rows of one version; the filter prunes partitions."""
    return spark.read.parquet(path).where(F.col("version_id") == version_id)
