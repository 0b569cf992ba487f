"""Streams over several files and micro-batches give the batch result."""

import random

from pyspark.sql import functions as F

from folio_spark.operators import sequence as Q
from folio_spark.streaming import live


def deliver(spark, rows, schema, folder, parts, seed=1):
    """Shuffled pages in several files, so they arrive out of order."""
    random.Random(seed).shuffle(rows)
    for i in range(parts):
        chunk = rows[i::parts]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(folder)


def test_end_pages_over_batches(spark, tmp_path):
    rng = random.Random(3)
    schema = "book int, page bigint, v int"
    rows = [(b, p, rng.randrange(3)) for b in range(12) for p in range(1, rng.randrange(2, 25))]
    folder = str(tmp_path / "in")
    deliver(spark, rows, schema, folder, 4)
    pages = live.read_pages(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    watch = live.SequenceWatch(str(tmp_path / "state"), "book", "page", "v", live.end_detector("v", 3))
    watch.start(pages, str(tmp_path / "ckpt")).awaitTermination()
    got = {r["book"]: r["end"] for r in watch.ends(spark).collect()}
    batch = Q.end_of_sequence(spark.read.parquet(folder), "book", "page", "v", n=3)
    assert got == {r["book"]: r["end_page"] for r in batch.collect()}


def test_anchored_end_and_alarm_over_batches(spark, tmp_path):
    rng = random.Random(4)
    schema = "book int, page bigint, s array<bigint>, failed boolean"
    rows = [(b, p, [rng.randrange(64)], rng.random() < 0.6) for b in range(10) for p in range(1, rng.randrange(2, 25))]
    folder = str(tmp_path / "in")
    deliver(spark, rows, schema, folder, 3)
    table = spark.read.parquet(folder)
    for content, detector, batch in [
        ("s", live.end_detector("s", 3, threshold=2), Q.end_of_sequence(table, "book", "page", "s", n=3, threshold=2, name="end")),
        ("failed", live.failure_detector("failed", 3), Q.failure_alarm(table, "book", "page", "failed", 3, name="end")),
    ]:
        pages = live.read_pages(spark, folder, table.schema, files_per_batch=1)
        watch = live.SequenceWatch(str(tmp_path / f"state-{content}"), "book", "page", content, detector)
        watch.start(pages, str(tmp_path / f"ckpt-{content}")).awaitTermination()
        got = {r["book"]: r["end"] for r in watch.ends(spark).collect()}
        assert got == {r["book"]: r["end"] for r in batch.collect()}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 7), (1, 2, 7), (1, 3, 7), (2, 1, 1)], "book int, page bigint, v int")
    watch = live.SequenceWatch(str(tmp_path / "s"), "book", "page", "v", live.end_detector("v", 3))
    watch.process(df, 0)
    watch.process(df, 0)
    assert [(r["book"], r["end"]) for r in watch.ends(spark).collect()] == [(1, 3)]


def test_ledger_resumes(spark, tmp_path):
    folder, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    schema = "book string, page bigint, attempt int, status string"
    sink = live.LedgerSink(str(tmp_path / "ledger"), "book", "page", ["attempt"])
    spark.createDataFrame([("a", 1, 1, "failed"), ("a", 2, 1, "ok")], schema).write.parquet(folder)
    source = spark.read.parquet(folder).schema
    sink.start(live.read_pages(spark, folder, source), ckpt).awaitTermination()
    spark.createDataFrame([("a", 1, 2, "ok")], schema).write.mode("append").parquet(folder)
    sink.start(live.read_pages(spark, folder, source), ckpt).awaitTermination()
    assert sorted((r["page"], r["attempt"], r["status"]) for r in sink.current(spark).collect()) == [(1, 2, "ok"), (2, 1, "ok")]
    sink.compact(spark, str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 2


def test_repeats_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    # One file and batch each; pages that come hours late are first deliveries all the same.
    for hour, numbers in ((10, range(4, 8)), (1, range(4)), (12, range(6, 10)), (2, range(10))):
        rows = [("a", p, f"2024-01-01 {hour:02d}:00:00") for p in numbers]
        df = spark.createDataFrame(rows, "book string, page bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(folder)
    pages = live.read_pages(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    once = live.drop_repeats(pages, ["book", "page"])
    live.append_pages(once, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
