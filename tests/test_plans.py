"""Plans of operators that join a book's one row to its pages: the pages are read once for it."""

import pytest
from pyspark.sql import functions as F

from folio_spark.operators import ledger as L
from folio_spark.operators import sequence as Q


def scans(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("FileScan")


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "pages")
    spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("book"), F.col("id").alias("page"),
        (F.col("id") % 5 == 0).alias("failed"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_scans(spark, pages):
    # One scan finds the cut, the restart or the state, one delivers the rows.
    cuts = Q.failure_alarm(pages, "book", "page", "failed", 3, name="cut")
    assert scans(Q.cut_after(pages, cuts, "book", "page", "cut")) == 2
    assert scans(Q.pages_since_restart(pages, "book", ["page"], F.col("failed"), Q.page_chunk("page"))) == 2
    states = L.list_states(pages, "book", None, "failed", F.lit(100).cast("bigint"))
    assert scans(L.drop_completed(pages, states, "book", "page")) == 2
    assert scans(states) == 1
