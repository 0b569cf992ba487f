"""First deliveries of pages without a growing state: the page table itself knows what has been there.

A delivery is a repeat if the table holds its key. A page keeps its time when it is delivered again, so only
the days that occur in a batch are looked up, and of them the key columns alone: a batch costs what arrives in
it and what its days hold, not what has ever been seen. No watermark is needed, so a first delivery is kept
however late it comes, and a repeat is dropped however late it comes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import batch_path, exists


@dataclass
class FirstDeliveries:
    """``root/batch=<i>/day=<d>`` holds the pages that batch ``i`` brought first.

    A batch that is processed again compares itself with the batches before it and overwrites its own folder, so
    it changes nothing. Null keys are equal to each other, pages without a time share a day.
    """

    root: str
    schema: T.StructType
    keys: list[str]
    ts: str

    def table(self, spark: SparkSession) -> DataFrame:
        kept = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())])
        if not exists(spark, self.root):
            return spark.createDataFrame([], kept)
        return spark.read.schema(kept).parquet(self.root)

    def pages(self, spark: SparkSession) -> DataFrame:
        return self.table(spark).select(*self.schema.names)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = F.to_date(self.ts).alias("day")
        fresh = batch.select(*self.schema.names, day).dropDuplicates(["day", *self.keys])
        days = [r["day"] for r in fresh.select("day").distinct().collect()]  # one value per day that occurs
        known = self.known(spark, days, batch_id)
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["day", *self.keys]]
        first = fresh.alias("a").join(known.alias("b"), same, "left_anti")
        first.write.mode("overwrite").partitionBy("day").parquet(batch_path(self.root, batch_id))

    def known(self, spark: SparkSession, days: list, batch_id: int) -> DataFrame:
        """Keys of these days in the batches before: other days' folders aren't read."""
        wanted = F.col("day").isin([d for d in days if d is not None])
        if None in days:
            wanted = wanted | F.col("day").isNull()
        return self.table(spark).where((F.col("batch") < batch_id) & wanted).select("day", *self.keys)

    def start(self, pages: DataFrame, checkpoint: str, **trigger):
        return (
            pages.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
