"""Registered queries: name -> (Spark plan, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans.kb import KB

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a plan built from the derived tables."""

    def wrap(build: Callable[[KB], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: build(KB(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return build

    return wrap


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from quillstone.plans import answers, audit, details, functions, packaging, quality, relational, resources, retrieval, review, stored  # noqa: F401

    return QUERIES, ORACLE
