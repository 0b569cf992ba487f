"""The progress ledger as a table of a base and deltas, merged when it is read.

``base-<n>/bucket=<k>`` holds the newest row of every key, ``delta/batch=<i>/bucket=<k>`` what a batch brought.
Rows are dealt to buckets by a hash of the book. ``current`` reads the base and the deltas behind it; ``compact``
folds both into the next base, names it in ``manifest`` (one small file, replaced in one step), and removes what
the manifest no longer names. A batch that is delivered again overwrites its own delta, or is skipped if the
base holds it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import latest_state
from ..operators.sequence import keys_of
from .tables import batch_path, exists, file_system, remove

EMPTY = {"base": None, "upto": -1}


@dataclass
class LedgerTable:
    root: str
    schema: T.StructType
    book: str | list[str]
    page: str
    order: list[str]
    buckets: int = 64

    @property
    def keys(self) -> list[str]:
        return [*keys_of(self.book), self.page]

    def manifest(self, spark: SparkSession) -> dict:
        """The base in force, and the last batch that it holds."""
        fs, path = file_system(spark, f"{self.root}/manifest")
        if not fs.exists(path):
            return dict(EMPTY)
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def name_base(self, spark: SparkSession, manifest: dict) -> None:
        """Replace the manifest by one rename."""
        fs, path = file_system(spark, f"{self.root}/manifest")
        _, fresh = file_system(spark, f"{self.root}/manifest-{manifest['base']}")
        stream = fs.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
        replace = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(fresh), fs.makeQualified(path), replace)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= self.manifest(spark)["upto"]:
            return
        bucket = F.pmod(F.xxhash64(*keys_of(self.book)), F.lit(self.buckets)).cast("int")
        newest = latest_state(batch.select(*self.schema.names), self.keys, self.order)
        newest.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(
            batch_path(f"{self.root}/delta", batch_id)
        )

    def deltas(self, spark: SparkSession, after: int) -> list[int]:
        """Numbers of the batches behind the base."""
        fs, path = file_system(spark, f"{self.root}/delta")
        if not fs.exists(path):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(path)]
        numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
        return [n for n in numbers if n > after]

    def parts(self, spark: SparkSession, manifest: dict, upto: list[int]) -> DataFrame:
        kept = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        folders = [f"{self.root}/{manifest['base']}"] if manifest["base"] else []
        folders += [batch_path(f"{self.root}/delta", n) for n in upto]
        out = spark.createDataFrame([], kept)
        for folder in folders:
            out = out.unionByName(spark.read.schema(kept).parquet(folder))
        return out

    def current(self, spark: SparkSession) -> DataFrame:
        """The newest row of every key. Behind a compaction it is the base as it lies: no shuffle."""
        manifest = self.manifest(spark)
        later = self.deltas(spark, manifest["upto"])
        rows = self.parts(spark, manifest, later).select(*self.schema.names)
        return latest_state(rows, self.keys, self.order) if later else rows

    def of_book(self, spark: SparkSession, book: tuple) -> DataFrame:
        """One book's rows, read from its bucket alone."""
        manifest = self.manifest(spark)
        keys = keys_of(self.book)
        number = F.pmod(F.xxhash64(*(F.lit(v).cast(self.schema[k].dataType) for k, v in zip(keys, book))), F.lit(self.buckets))
        rows = self.parts(spark, manifest, self.deltas(spark, manifest["upto"])).where(F.col("bucket") == number.cast("int"))
        for key, value in zip(keys, book):
            rows = rows.where(F.col(key).eqNullSafe(F.lit(value).cast(self.schema[key].dataType)))
        return latest_state(rows.select(*self.schema.names), self.keys, self.order)

    def compact(self, spark: SparkSession) -> None:
        """Fold the deltas into a new base; readers see the old state or the new one."""
        manifest = self.manifest(spark)
        later = self.deltas(spark, manifest["upto"])
        if not later:
            return
        base = f"base-{later[-1]}"
        rows = latest_state(self.parts(spark, manifest, later), self.keys, self.order)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{base}")
        self.name_base(spark, {"base": base, "upto": later[-1]})
        for number in later:
            remove(spark, batch_path(f"{self.root}/delta", number))
        if manifest["base"] and exists(spark, f"{self.root}/{manifest['base']}"):
            remove(spark, f"{self.root}/{manifest['base']}")

    def start(self, pages: DataFrame, checkpoint: str, **trigger):
        return (
            pages.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
