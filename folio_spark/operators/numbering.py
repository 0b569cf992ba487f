"""Dense page numbers by range: no window, and no task that holds more than its range of rows.

The rows are dealt by ranges of (book, order), so a book with a third of all rows, even within one hour, lies in
many tasks. Each task counts through its sorted rows; of a range, only the first book can have begun in an earlier
one, so what the ranges must know of each other is one row per range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled
from .sequence import keys_of

_TASK, _RANK = "_task", "_rank"


def same(one: pa.Array, two: pa.Array) -> np.ndarray:
    """Where two columns agree, nulls included."""
    equal = pc.fill_null(pc.equal(one, two), False)
    return np.array(pc.or_(equal, pc.and_(pc.is_null(one), pc.is_null(two))))


def ranked(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number the rows of each run of equal keys, from 1, across the batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, rank = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.names.index(k)) for k in keys]
            equal = np.ones(n, bool)
            for c in columns:
                equal[1:] &= same(c[1:], c[:-1])
            equal[0] = last is not None and all(bool(same(c[:1], v)[0]) for c, v in zip(columns, last))
            begins = np.flatnonzero(~equal)
            place = np.arange(n)
            begin = np.zeros(n, "i8")
            begin[begins] = begins
            begin = np.maximum.accumulate(begin)
            ranks = place - begin + 1
            head = begins[0] if len(begins) else n
            ranks[:head] = place[:head] + 1 + rank
            rank, last = int(ranks[-1]), [c[n - 1 :] for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, task), pa.int32()), pa.array(ranks, pa.int64())],
                [*batch.schema.names, _TASK, _RANK],
            )

    return run


def number_by_range(
    df: DataFrame, book: str | Sequence[str], order: Sequence[str], *, name: str = "page", start: int = 1
) -> DataFrame:
    """Add dense page numbers in ``order`` within each book.

    The numbers are those of a window over the book, for any order without ties. The numbered rows are kept
    as a checkpoint, since ranges are drawn by sampling; select only the columns needed beforehand. Null keys
    are a book of their own.
    """
    keys = keys_of(book)
    ranges = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    added = [T.StructField(_TASK, T.IntegerType()), T.StructField(_RANK, T.LongType())]
    rows = settled(ranges.mapInArrow(ranked(keys), T.StructType([*df.schema.fields, *added])))
    # A range's first row, and its last, whose rank says how many rows of the last book it holds.
    key, position = F.struct(*keys), F.struct(*[F.struct(F.col(k).isNotNull(), k) for k in keys], _RANK)
    ends = rows.groupBy(_TASK).agg(
        F.min_by(key, position).alias("first"), F.max_by(key, position).alias("last"),
        F.max_by(_RANK, position).alias("held"),
    )
    before, open_book, count, found = [], None, 0, False
    for row in sorted(ends.collect(), key=lambda r: r[_TASK]):  # one row per range
        continues = found and row["first"] == open_book
        before.append((row[_TASK], count if continues else 0))
        whole = row["first"] == row["last"]
        count = (count if continues and whole else 0) + row["held"]
        open_book, found = row["last"], True
    table = df.sparkSession.createDataFrame(before, f"{_TASK} int, _before long")
    firsts = ends.select(_TASK, F.col("first").alias("_first")).join(table, _TASK).where("_before > 0")
    joined = rows.join(F.broadcast(firsts), _TASK, "left")
    earlier = F.when(F.struct(*keys).eqNullSafe(F.col("_first")), F.col("_before")).otherwise(0)
    number = F.col(_RANK) + F.coalesce(earlier, F.lit(0)) + F.lit(start - 1)
    return joined.withColumn(name, number.cast("bigint")).drop(_TASK, _RANK, "_first", "_before")
