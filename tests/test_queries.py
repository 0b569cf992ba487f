"""Every registered query against its SQL on the smallest tables."""

import pytest
from harness import compare

import __spark_entry__ as entry
from folio_spark.plans.registry import ORACLES as SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    rows, problem = compare(spark, name, QUERIES[name], SQL.get(name), FOLDER)
    assert problem is None
    if name in SQL:
        assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_md_report_of_several_key_spans(spark, tmp_path):
    """Reports of one customer in several spans of keys, and of one whose keys all lie in later spans."""
    keys = [(1, 5), (1, 6), (1, 100_000_001), (1, 300_000_002), (2, 200_000_000), (2, 200_000_003)]
    rows = [(c, k, f"{i % 5 + 1}-X", "FOP"[i % 3], 1.0) for i, (c, k) in enumerate(keys)]
    names = "o_custkey long, o_orderkey long, o_orderpriority string, o_orderstatus string, o_totalprice double"
    spark.createDataFrame(rows, names).coalesce(1).toPandas().to_parquet(tmp_path / "orders.parquet")
    count, problem = compare(spark, "md_report", QUERIES["md_report"], SQL["md_report"], str(tmp_path))
    assert problem is None and count == 4
