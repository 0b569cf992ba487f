"""Live pages: intake, sequence watching, the ledger and repeated deliveries.

The watchers run the batch operators inside ``foreachBatch`` on the new pages
plus the few carried over, so a stream gives the result a batch job would, and a
busy book is still spread over tasks. What is carried is a table per micro-batch:
writing it overwrites its own folder, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ledger as L
from ..operators.sequence import (
    end_of_sequence,
    failure_alarm,
    hamming,
    keys_of,
    number_pages,
    page_chunk,
    sequence_states,
)
from .tables import batch_path, exists, remove


def read_pages(
    spark: SparkSession, folder: str, schema: T.StructType, *, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Stream of page rows from Parquet files as they arrive in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def append_pages(pages: DataFrame, folder: str, checkpoint: str, **trigger):
    """Append finished page rows to a table; the checkpoint makes a restart resume."""
    return (
        pages.writeStream.format("parquet")
        .outputMode("append")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drop_repeats(pages: DataFrame, keys: list[str]) -> DataFrame:
    """First delivery of every page, however late it comes.

    All keys stay in the state, dealt to the shuffle partitions by key; a batch
    costs what arrives in it. For many keys choose the RocksDB state store, which
    keeps them on disk.
    """
    return pages.dropDuplicates(keys)


# A detector takes the pages that are ready and returns, per book, the end page
# (or null) and the page from which rows must be kept for the next batch.
Detector = Callable[[DataFrame, list[str], str], DataFrame]


def end_detector(content: str, n: int = 3, threshold: int | None = None) -> Detector:
    """Ends of repeated pages; with a threshold the open anchor is carried on."""

    def anchored(pages: DataFrame, book: list[str], page: str) -> DataFrame:
        differs = lambda a, b: hamming(a, b) > threshold
        return sequence_states(pages, book, page, content, n=n, differs=differs, name="end")

    def exact(pages: DataFrame, book: list[str], page: str) -> DataFrame:
        ends = end_of_sequence(pages, book, page, content, n=n, name="end")
        return with_tail(pages, ends, book, page, n - 1)

    return exact if threshold is None else anchored


def failure_detector(failed: str, k: int = 5) -> Detector:
    def detect(pages: DataFrame, book: list[str], page: str) -> DataFrame:
        return with_tail(pages, failure_alarm(pages, book, page, failed, k, name="end"), book, page, k - 1)

    return detect


def with_tail(pages: DataFrame, ends: DataFrame, book: list[str], page: str, tail: int) -> DataFrame:
    """Ends beside the page from which the last ``tail`` pages are kept."""
    last = pages.groupBy(*book).agg((F.max(page) - (tail - 1)).alias("anchor"))
    return last.join(ends, book, "left").select(*book, "end", "anchor")


@dataclass
class SequenceWatch:
    """Emit the first end of every book of a page stream.

    ``root`` is a shared folder: ``found/batch=i`` holds the ends of a batch,
    ``open/batch=i`` the rows carried out of it. Pages may arrive in any order;
    a page waits until all pages before it are there. Pages of a book that has
    ended, and pages seen before, are dropped.
    """

    root: str
    book: str | list[str]
    page: str
    content: str
    detector: Detector
    first_page: int = 1
    keep_batches: int = 3

    @property
    def keys(self) -> list[str]:
        return keys_of(self.book)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys, page = self.keys, self.page
        fresh = batch.select(*keys, F.col(page).cast("bigint").alias(page), self.content)
        carried_schema = T.StructType([*fresh.schema.fields, T.StructField("_base", T.LongType())])
        found_schema = T.StructType([*[fresh.schema[k] for k in keys], T.StructField("end", T.LongType())])
        before = batch_path(f"{self.root}/open", batch_id - 1)
        # Only the first batch has nothing before it: a folder that is missing later is an error.
        carried = spark.read.schema(carried_schema).parquet(before) if batch_id else spark.createDataFrame([], carried_schema)
        ended = self.ends(spark, found_schema, before=batch_id)

        bases = carried.groupBy(*keys).agg(F.max("_base").alias("_base"))
        known = fresh.join(ended, keys, "left_anti").unionByName(carried.drop("_base"))
        rows = (
            known.dropDuplicates([*keys, page])
            .join(bases, keys, "left")
            .withColumn("_base", F.coalesce("_base", F.lit(self.first_page).cast("bigint")))
            .filter(F.col(page) >= F.col("_base"))
            .persist()
        )
        # With distinct pages, rank = distance from the base exactly as far as nothing is missing.
        ranked = number_pages(rows, keys, [page], page_chunk(page), name="_rank_in_book")
        ready = ranked.filter(F.col("_rank_in_book") == F.col(page) - F.col("_base") + 1)
        states = self.detector(ready.select(*keys, page, self.content), keys, page).persist()
        ends = states.filter(F.col("end").isNotNull()).select(*keys, F.col("end").cast("bigint").alias("end"))
        ends.write.mode("overwrite").parquet(batch_path(f"{self.root}/found", batch_id))

        rest = (
            rows.join(states, keys, "left")
            .filter(F.col("end").isNull())
            .withColumn("_base", F.greatest("_base", F.coalesce(F.col("anchor").cast("bigint"), F.col("_base"))))
            .filter(F.col(page) >= F.col("_base"))
            .select(*[f.name for f in carried_schema.fields])
        )
        rest.write.mode("overwrite").parquet(batch_path(f"{self.root}/open", batch_id))
        states.unpersist()
        rows.unpersist()
        old = batch_path(f"{self.root}/open", batch_id - self.keep_batches)
        if exists(spark, old):
            remove(spark, old)

    def ends(self, spark: SparkSession, schema: T.StructType | None = None, before: int | None = None) -> DataFrame:
        """Ends found so far (in batches before the given one)."""
        folder = f"{self.root}/found"
        if not exists(spark, folder):
            return spark.createDataFrame([], schema)
        reader = spark.read if schema is None else spark.read.schema(
            T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        )
        table = reader.parquet(folder)
        if before is not None:
            table = table.filter(F.col("batch") < before)
        return table.drop("batch")

    def start(self, pages: DataFrame, checkpoint: str, **trigger):
        return (
            pages.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


@dataclass
class LedgerSink:
    """Upsert of page attempts: every batch leaves its newest row per page.

    A batch writes its own folder, so replaying it is harmless; the current
    ledger is the newest row over all batches. ``compact`` folds them into one.
    """

    root: str
    book: str | list[str]
    page: str
    order: list[str]

    @property
    def keys(self) -> list[str]:
        return [*keys_of(self.book), self.page]

    def process(self, batch: DataFrame, batch_id: int) -> None:
        newest = L.latest_state(batch, self.keys, self.order)
        newest.write.mode("overwrite").parquet(batch_path(self.root, batch_id))

    def current(self, spark: SparkSession) -> DataFrame:
        return L.latest_state(spark.read.parquet(self.root).drop("batch"), self.keys, self.order)

    def compact(self, spark: SparkSession, target: str) -> None:
        self.current(spark).write.mode("overwrite").parquet(target)

    def start(self, pages: DataFrame, checkpoint: str, **trigger):
        return (
            pages.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
