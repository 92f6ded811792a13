"""Queries against their SQL on single rows of the larger sample tables that once differed."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import canon_rows  # noqa: E402

LARGER = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    "name, table, rows",
    [
        ("src_08_page_labels", "pages", "page_id in (407, 466, 848, 1324, 1934)"),  # quotes written as references
        ("aud_09_heading_scores", "documents", "doc_id in (2590, 3568, 4417)"),  # fifth decimals that end in a five
    ],
)
def test_single_rows_against_sql(spark, tmp_path, name, table, rows):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        part = spark.read.parquet(f"{LARGER}/{t}.parquet")
        (part.where(rows) if t == table else part.limit(5)).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()[name])
    assert canon_rows(df.columns, df.collect()) == canon_rows([c[0] for c in want.description], want.fetchall())
