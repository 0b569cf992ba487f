"""The merged ledger: newest rows, replays, compaction that readers use and that drops the deltas."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio_spark.operators import ledger as L
from folio_spark.streaming.table import LedgerTable

SCHEMA = T.StructType([
    T.StructField("book", T.StringType()), T.StructField("page", T.LongType()),
    T.StructField("attempt", T.IntegerType()), T.StructField("status", T.StringType()),
])


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_merge_replay_and_compaction(spark, tmp_path):
    table = LedgerTable(str(tmp_path), SCHEMA, "book", "page", ["attempt"], buckets=4)
    assert rows(table.current(spark)) == []
    batches = [
        [("a", 1, 1, "failed"), ("a", 1, 2, "ok"), ("b", 1, 1, "ok"), (None, 1, 1, "ok")],
        [("a", 1, 3, "late"), ("b", 2, 1, "failed")],
        [("b", 2, 2, "ok"), ("a", 1, 1, "old")],
    ]
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    want = [("a", 1, 3, "late"), ("b", 1, 1, "ok"), ("b", 2, 2, "ok"), (None, 1, 1, "ok")]
    for number in (0, 1, 1):
        table.process(frames[number], number)
    table.compact(spark)
    assert sorted(n for n in os.listdir(tmp_path) if not n.startswith(".")) == ["base-1", "delta", "manifest"]
    assert not [n for n in os.listdir(tmp_path / "delta") if n.startswith("batch")]
    table.process(frames[0], 0)  # a replay of a batch that the base holds
    assert table.deltas(spark, -1) == []
    table.process(frames[2], 2)
    assert rows(table.current(spark)) == sorted(want, key=repr)
    assert rows(table.of_book(spark, ("b",))) == [("b", 1, 1, "ok"), ("b", 2, 2, "ok")]
    assert rows(table.of_book(spark, (None,))) == [(None, 1, 1, "ok")] and rows(table.of_book(spark, ("c",))) == []
    table.compact(spark)
    assert rows(table.current(spark)) == sorted(want, key=repr)
    table.compact(spark)
    assert sorted(n for n in os.listdir(tmp_path) if not n.startswith(".")) == ["base-2", "delta", "manifest"]


def test_cost_behind_a_compaction(spark, tmp_path):
    """Many batches about the same pages: the table read afterwards has the live rows and no shuffle."""
    table = LedgerTable(str(tmp_path), SCHEMA, "book", "page", ["attempt"], buckets=2)
    for number in range(4):
        table.process(spark.range(50).select(F.lit("a"), F.col("id"), F.lit(number), F.lit("ok")).toDF(*SCHEMA.names), number)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan(table.current(spark))
    table.compact(spark)
    assert "Exchange" not in plan(table.current(spark))
    lying = spark.read.parquet(f"{tmp_path}/base-3")
    assert lying.count() == 50 and "PartitionFilters: [isnotnull(bucket" in plan(table.of_book(spark, ("a",)))


def test_delete_books(spark):
    ledger = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "book string, page int")
    named = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "book string")
    kept, answers = L.delete_books(ledger, named, "book")
    assert rows(kept) == [("b", 1), (None, 1)]
    assert rows(answers) == [("a", True, 2), ("c", False, 0), (None, False, 0)]
