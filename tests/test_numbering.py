"""Page numbers by range equal those of a window, with one book's rows in one hour and in many ranges."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folio_spark.operators.numbering import number_by_range


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_numbers(spark, ranges):
    rng = random.Random(ranges)
    rows = [("hot", None, 3600 + i % 50, i) for i in range(2000)]
    rows += [(rng.choice(["a", "b", None]), rng.choice([1, None]), rng.randrange(10_000), 5000 + i) for i in range(4000)]
    rows += [(f"one{i}", 1, 0, 10_000 + i) for i in range(300)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "book string, part int, ts int, id int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = number_by_range(frame, ["book", "part"], ["ts", "id"], start=0).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    window = Window.partitionBy("book", "part").orderBy("ts", "id")
    want = frame.withColumn("page", F.row_number().over(window).cast("bigint") - 1).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_hot_book_lies_in_many_ranges(spark):
    """A third of all rows in one book and hour: no range holds more than about its share."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("book"), F.lit(7).alias("ts"), "id"
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = rows.repartitionByRange("book", "ts", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        numbered = number_by_range(rows, "book", ["ts", "id"])
        assert numbered.where("book = 0").agg(F.max("page"), F.countDistinct("page")).first()[:] == (10_000, 10_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ranges < 2 * 30_000 / 12


def test_empty(spark):
    assert number_by_range(spark.createDataFrame([], "b int, t int"), "b", ["t"]).count() == 0
