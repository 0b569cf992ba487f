"""First deliveries over many batches: late ones are kept, repeats dropped, nothing else is read or held."""

import datetime
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio_spark.streaming import live
from folio_spark.streaming.first import FirstDeliveries

SCHEMA = T.StructType([
    T.StructField("book", T.StringType()), T.StructField("page", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
])


def stamp(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_late_and_repeated(spark, tmp_path):
    table = FirstDeliveries(str(tmp_path / "t"), SCHEMA, ["book", "page"], "ts")
    batches = [
        [("a", 1, stamp(10)), ("a", 2, stamp(10)), (None, 1, None), (None, 1, None)],
        [("a", 3, stamp(11)), ("a", 1, stamp(10))],
        [("b", 1, stamp(1)), (None, 1, None), ("a", 3, stamp(11)), ("a", None, stamp(11))],
        [("a", 2, stamp(10)), ("b", 1, stamp(1)), ("a", None, stamp(11)), ("a", 4, stamp(12))],
    ]
    want = set()
    for number, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, SCHEMA)
        table.process(frame, number)
        table.process(frame, number)  # a replay
        want |= set(batch)
        assert rows(table.pages(spark)) == sorted(want, key=repr)


def test_many_batches_hold_no_state(spark, tmp_path):
    """Every page comes three times over twelve batches; the stream has no state, and a lookup reads its days alone."""
    rng = random.Random(5)
    pages = [(f"b{i % 7}", i, stamp(i % 6 + 1, i % 24)) for i in range(120)]
    dealt = [[] for _ in range(12)]
    for row in pages * 3:
        rng.choice(dealt).append(row)
    folder = str(tmp_path / "in")
    for part in dealt:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    table = FirstDeliveries(str(tmp_path / "t"), SCHEMA, ["book", "page"], "ts")
    stream = live.read_pages(spark, folder, SCHEMA, files_per_batch=1)
    query = table.start(stream, str(tmp_path / "c"))
    query.awaitTermination()
    assert rows(table.pages(spark)) == sorted(pages, key=repr)
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(progress) == 12 and all(not p["stateOperators"] for p in progress)
    known = table.known(spark, [datetime.date(2024, 1, 2)], 99)
    files = {f.split("day=")[1][:10] for f in known.inputFiles()}
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters")[1] and "ReadSchema: struct<book:string,page:bigint>" in plan
    assert known.count() == 20 and "2024-01-02" in files
    assert known.select(F.input_file_name().alias("f")).distinct().where("f NOT LIKE '%day=2024-01-02%'").count() == 0
