"""Helpers shared by the operators: row-wise Arrow stages, the shared folder, salted joins."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from folio_spark.session import scratch_path


def shared_folder(spark, name: str) -> str:
    """A fresh folder, as a URI or absolute path, below the one named by ``spark.checkpoint.dir``."""
    path = scratch_path(spark, name)
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and "://" not in path else path


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system behind a URI (local, HDFS, S3, GCS), and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: read twice, computed once, safe from lost executors."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark, name), "table")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one file have numbers of so many bits; the files' numbers stand above them.
ROW_BITS = 40


def numbered(table: DataFrame) -> tuple[DataFrame, str]:
    """The rows of a Parquet table with a number each, and the number's column; no copy is made.

    A row's number comes from its file and its place in it, so every reading, also by a task that is run
    again, gives the same. What is broadcast is one number per file, which the driver has listed anyway.
    A frame that isn't read from files is written as a table first.
    """
    name, file, order = (spare_name(table, stem) for stem in ("row", "file", "number"))

    def located(rows: DataFrame) -> DataFrame:
        place = rows.metadataColumn("_metadata")
        return rows.select("*", place["file_path"].alias(file), place["row_index"].alias(name))

    try:
        rows = located(table)
        rows.schema  # analysed here: fails for a frame without files
    except AnalysisException:
        rows = located(written(table, "rows"))
    paths = sorted(r[0] for r in rows.select(file).distinct().collect())
    files = table.sparkSession.createDataFrame(list(enumerate(paths)), f"{order} long, {file} string")
    row = (F.shiftleft(F.col(order), ROW_BITS) + F.col(name)).alias(name)
    return rows.join(F.broadcast(files), file).select(*table.columns, row), name


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the C library of Linux has it
        trim(0)


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't use, letter case aside."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def add_columns(
    df: DataFrame, fields: list[StructField], fill: Callable[[pa.RecordBatch], list[pa.Array]]
) -> DataFrame:
    """The frame with columns that ``fill`` computes for one Arrow batch after the other.

    A column of the input whose name equals a new one, letter case aside, is replaced.
    """
    taken = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    names = [f.name for f in kept]
    places = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fill(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in places] + made, names + [f.name for f in fields]
                )
        give_back()

    return df.mapInArrow(run, StructType(kept + fields))


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column by name; if names differ only in letter case, the exact one."""
    return batch.column(batch.schema.names.index(name))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def byte_lengths(column: pa.Array) -> list[int]:
    return [x or 0 for x in pc.binary_length(column).to_pylist()]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of at most ``limit`` together; an item above it stands alone."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def salted_join(
    rows: DataFrame, table: DataFrame, key: str, deal: str, how: str = "inner", salts: int = 16
) -> DataFrame:
    """Rows joined to a table with one row per key, each key's rows dealt to ``salts`` tasks by ``deal``.

    The table is small beside the rows (one row per key), so repeating it costs little;
    a key that holds a third of the rows no longer meets in one task.
    """
    salt = "_salt"
    spread = rows.withColumn(salt, F.pmod(F.xxhash64(deal), F.lit(salts)).cast("int"))
    repeated = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [key, salt], how).drop(salt)
