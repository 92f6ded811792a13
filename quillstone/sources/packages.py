"""Package, vector, review and listing sources (SRC-01 .. SRC-04, SRC-10 .. SRC-13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Tables of a complete package.
REQUIRED_TABLES = (
    "metadata", "Chapter_Structure", "Answer_Cards", "Knowledge_Points", "Source_Chunks", "Concept_Comparison",
    "Synonyms_Questions", "Knowledge_Relations", "Resources", "Interactive_Scripts", "Exercises",
    "QA_Evaluation_Testset", "RAG_Config", "Embedding_Corpus", "Prompt_Templates",
)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01 / SRC-04: one row per package file: path, chapter_id (folder) and the JSON text.

    A file whose root is not an object fails the job with its path.
    """
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    root = F.schema_of_variant(F.try_parse_json("json"))
    checked = F.when(F.startswith(root, F.lit("OBJECT")), F.col("json")).otherwise(
        F.raise_error(F.concat(F.lit("package root is not an object: "), F.col("path")))
    )
    return rows.select("path", F.element_at(F.split("path", "/"), -2).alias("chapter_id"), checked.alias("json"))


def package_table(packages: DataFrame, name: str, schema: str) -> DataFrame:
    """SRC-02: rows of one table of every package with their position; none when it is missing."""
    rows = F.from_json(F.get_json_object("json", f"$.{name}"), f"array<struct<{schema}>>")
    return packages.select("chapter_id", F.posexplode(rows).alias("ordinal", "row")).select("chapter_id", "ordinal", "row.*")


def table_counts(packages: DataFrame) -> DataFrame:
    """AGG-01: rows per table; anything but a list counts as one."""
    entries = packages.select("chapter_id", F.explode(F.from_json("json", "map<string,string>")).alias("table_name", "value"))
    size = F.coalesce(F.json_array_length("value"), F.lit(1))
    return entries.select("chapter_id", "table_name", size.alias("rows"))


VECTOR_SCHEMA = "embedding_id string, source_type string, source_id string, model string, dimensions int, embedding array<double>"


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: vectors, one JSON object per line; blank lines are skipped."""
    return spark.read.schema(VECTOR_SCHEMA).json(path).where("embedding_id is not null")


def read_review_rows(spark: SparkSession, path: str, classes: tuple[str, ...]) -> DataFrame:
    """SRC-10: review rows of source chunks in the given classes; the filter is pushed to the reader."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    # a byte order mark belongs to the first header name
    first = rows.columns[0]
    rows = rows.withColumnRenamed(first, first.lstrip("﻿"))
    return rows.where((F.col("item_type") == "source_chunk") & F.col("classification").isin(*classes))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC-11: existing files with size and content hash (AGG-15 finds the duplicates)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(
        "path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length", F.sha2("content", 256).alias("sha256")
    )


def duplicate_files(files: DataFrame) -> DataFrame:
    """AGG-15: hashes shared by several files, with the number of files and the first path."""
    return files.groupBy("sha256").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path")).where("files > 1")


def read_database(spark: SparkSession, url: str, table: str, partition_column: str, bounds: tuple[int, int], parts: int) -> DataFrame:
    """SRC-12: a database table read in parallel ranges over JDBC (needs the driver's jar on the class path)."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
        .load()
    )


def embed(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], model: str, batch: int = 8) -> DataFrame:
    """SRC-13: vectors from a pluggable encoder, ``batch`` texts per call.

    texts(embedding_id, source_type, source_id, embedding_text).  An encoder
    that returns fewer vectors than texts, or an empty one, fails the task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            for start in range(0, len(frame), batch):
                part = frame["embedding_text"].iloc[start : start + batch].tolist()
                got = encoder(part)
                if len(got) != len(part) or any(len(v) == 0 for v in got):
                    raise ValueError(f"encoder returned {len(got)} vectors for {len(part)} texts")
                vectors += [[float(x) for x in v] for v in got]
            result = frame[["embedding_id", "source_type", "source_id"]].copy()
            result["model"] = model
            result["dimensions"] = [len(v) for v in vectors]
            result["embedding"] = vectors
            yield result

    usable = texts.where(F.trim(F.coalesce("embedding_text", F.lit(""))) != "")
    return usable.select("embedding_id", "source_type", "source_id", "embedding_text").mapInPandas(run, VECTOR_SCHEMA)


def vector_summary(vectors: DataFrame) -> DataFrame:
    """AGG-11: count, dimensions and models per source type."""
    return vectors.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("vectors"),
        F.array_join(F.sort_array(F.collect_set(F.col("dimensions").cast("string"))), ",").alias("dimensions"),
        F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"),
    )


