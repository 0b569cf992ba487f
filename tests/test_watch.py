"""Stateful watches over several micro-batches give the batch result, touch few states, and expire."""

import random
import time

import pytest
from test_live import deliver

from folio_spark.operators import sequence as Q
from folio_spark.streaming import live, watch


def ends_of(spark, tmp_path, folder, rule, content, name, width, book="book"):
    table = spark.read.parquet(folder)
    pages = live.read_pages(spark, folder, table.schema, files_per_batch=1)
    ends = watch.watched(pages, book, "page", content, rule, width=width)
    query = watch.start(ends, str(tmp_path / f"ends-{name}"), str(tmp_path / f"checkpoint-{name}"))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / f"ends-{name}")).collect()
    assert len({r.book for r in rows}) == len(rows) and all(r.missing is None for r in rows)
    return {r.book: r.end for r in rows}


@pytest.mark.parametrize("width", [3, 256])
def test_stream_equals_batch(spark, tmp_path, width):
    rng = random.Random(width)
    schema = "book int, page bigint, v string, s array<bigint>, failed boolean"
    rows = []
    for b in range(14):
        for p in range(1, rng.randrange(2, 25)):
            rows.append((b if b else None, p, f"text {rng.randrange(3)}", [rng.randrange(64)], rng.random() < 0.6))
    rows += rng.sample(rows, 20)  # repeated deliveries
    folder = str(tmp_path / "in")
    deliver(spark, rows, schema, folder, 3)
    table = spark.read.parquet(folder).dropDuplicates(["book", "page"])
    rules = [
        (watch.Repeats(3), "v", Q.end_of_sequence(table, "book", "page", "v", n=3, name="end")),
        (watch.Anchored(3, 2), "s", Q.end_of_sequence(table, "book", "page", "s", n=3, threshold=2, name="end")),
        (watch.Failures(3), "failed", Q.failure_alarm(table, "book", "page", "failed", 3, name="end")),
    ]
    for rule, content, batch in rules if width == 3 else rules[:2]:
        got = ends_of(spark, tmp_path, folder, rule, content, f"{content}-{width}", width)
        assert got == {r["book"]: r["end"] for r in batch.collect()}


def test_untouched_books_stay(spark, tmp_path):
    """The second batch has pages of one book, and only its state and its chunk's are written."""
    folder, schema = str(tmp_path / "in"), "book int, page bigint, v int"
    spark.createDataFrame([(b, p, p) for b in range(50) for p in (1, 2)], schema).coalesce(1).write.mode("append").parquet(folder)
    pages = live.read_pages(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    ends = watch.watched(pages, "book", "page", "v", watch.Repeats(3))
    out = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    watch.start(ends, *out).awaitTermination()
    spark.createDataFrame([(7, 3, 2), (7, 4, 2)], schema).coalesce(1).write.mode("append").parquet(folder)
    query = watch.start(ends, *out)
    query.awaitTermination()
    assert [(r.book, r.end) for r in spark.read.parquet(out[0]).collect()] == [(7, 4)]
    written = [o["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"] for o in p["stateOperators"]]
    assert len(written) == 2 and all(n <= 3 for n in written)


def test_books_that_stop_coming(spark, tmp_path):
    """A book whose third page never comes is emitted with it, and its state is gone."""
    folder, schema = str(tmp_path / "in"), "book string, page bigint, v int"
    rows = [("gap", 1, 0), ("gap", 2, 1), ("gap", 4, 1), ("ends", 1, 5), ("ends", 2, 5), ("ends", 3, 5)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    pages = live.read_pages(spark, folder, spark.read.parquet(folder).schema)
    ends = watch.watched(pages, "book", "page", "v", watch.Repeats(3), patience_ms=1500)
    out = str(tmp_path / "out")
    query = watch.start(ends, out, str(tmp_path / "checkpoint"), processingTime="500 milliseconds")
    try:
        limit = time.time() + 90
        while time.time() < limit and query.isActive:
            done = query.lastProgress and sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]) == 0
            if done and spark.read.schema("book string, end long, missing long").parquet(out).count() == 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted((r.book, r.end, r.missing) for r in spark.read.parquet(out).collect()) == [("ends", 3, None), ("gap", None, 3)]


def test_rule_wider_than_chunk(spark):
    with pytest.raises(ValueError):
        watch.watched(spark.createDataFrame([], "b int, p int, s array<bigint>"), "b", "p", "s", watch.Anchored(9), width=4)
