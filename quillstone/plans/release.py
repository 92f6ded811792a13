"""Release gate: ordered steps that stop at the first failure (EVA-06)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.quality import validate_package

Step = tuple[str, Callable[[], tuple[bool, str]]]


def rate_gate(cases: DataFrame, minimum: float) -> tuple[bool, str]:
    """Share of passed cases against the required rate; a single-row aggregate."""
    row = cases.agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("ok")).first()
    rate = row["ok"] / row["n"] if row["n"] else 0.0
    return rate >= minimum, f"{row['ok']}/{row['n']}"


def validation_gate(tables: dict[str, DataFrame], required: dict[str, tuple[str, ...]]) -> tuple[bool, str]:
    row = validate_package(tables, required).agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    ).first()
    return row["errors"] == 0, f"errors={row['errors']} warnings={row['warnings']}"


def vector_gate(vectors: DataFrame, corpus: DataFrame, dimensions: int) -> tuple[bool, str]:
    """Every text of the corpus has a vector of the right size."""
    sound = vectors.where(F.size("embedding") == dimensions).select("embedding_id").distinct()
    missing = corpus.join(sound, "embedding_id", "left_anti").count()
    return missing == 0, f"missing={missing}"


def count_gate(expected: DataFrame, stored: DataFrame) -> tuple[bool, str]:
    """Row counts per table agree after loading.  Both sides hold one row per table."""
    wrong = (
        expected.select("table_name", F.col("rows").alias("_e"))
        .join(stored.select("table_name", F.col("rows").alias("_s")), "table_name", "full_outer")
        .where(~F.col("_e").eqNullSafe(F.col("_s")))
        .count()
    )
    return wrong == 0, f"mismatches={wrong}"


def run_steps(spark: SparkSession, steps: list[Step]) -> DataFrame:
    """(position, name, status, summary); steps after a failure are skipped."""
    rows, failed = [], False
    for position, (name, action) in enumerate(steps, 1):
        if failed:
            rows.append((position, name, "skipped", ""))
            continue
        ok, summary = action()
        failed = not ok
        rows.append((position, name, "passed" if ok else "failed", summary))
    return spark.createDataFrame(rows, "position int, name string, status string, summary string")


def release_status(steps: DataFrame) -> str:
    return "failed" if steps.where("status = 'failed'").count() else "ready"
