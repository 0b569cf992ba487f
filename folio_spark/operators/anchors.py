"""Every page against its anchor: the last page of its book that wasn't like the anchor before it.

The rule is a scan along the book, and a run of like pages may span any number of chunks. Three steps
keep a book out of a single task:

* each chunk is reduced to one row: its first signature, how far its pages lie from that, and the anchor
  it is left with if its first page becomes one;
* those rows, one for ``width`` pages, are scanned along the book with one signature in hand. An anchor
  that the first page isn't like is replaced by it, one that all pages are like (by the triangle
  inequality) is passed on; a chunk in between is asked for, and passing on is assumed meanwhile;
* asked chunks are walked, which is exact, and the scan is repeated with their answers until nothing is
  asked. Then all chunks are walked at once from their anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..session import settled
from .sequence import CHUNK, keys_of, page_chunk

_CHUNK = "_chunk"
SIGNATURE = T.ArrayType(T.LongType())
#: What is known of a chunk; ``answers`` are entries that were walked and what they leave.
ANCHOR = T.StructType([T.StructField("page", T.LongType()), T.StructField("signature", SIGNATURE)])
LIST = pa.list_(pa.int64())
PAIR = pa.struct([("page", pa.int64()), ("signature", LIST)])
ANSWER = T.StructType([T.StructField("entry", SIGNATURE), T.StructField("left", ANCHOR)])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype="i8")


def words_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as a matrix of 64-bit words, and which rows have one."""
    lists = column.to_pylist()
    held = np.array([s is not None for s in lists], bool)
    width = max((len(s) for s in lists if s is not None), default=1)
    filled = [s if s is not None else [0] * width for s in lists]
    return np.array(filled, "i8").reshape(-1, width).view("u8"), held


def walk(words: np.ndarray, entry: np.ndarray | None, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each signature the number of its anchor (-1: the entry, -2: none), and its distance from it."""
    n = len(words)
    anchors, distances = np.full(n, -2, "i8"), np.zeros(n, "i8")
    at, number, own = 0, -1, entry
    if own is None and n:
        at, number, own = 1, 0, words[0]
    step = 8
    while at < n:
        found = distance(words[at : at + step], own)
        far = np.flatnonzero(found > threshold)
        end = int(far[0]) + 1 if len(far) else len(found)
        anchors[at : at + end], distances[at : at + end] = number, found[:end]
        at += end
        if len(far):
            number, own, step = at - 1, words[at - 1], 8
        else:
            step *= 2
    return anchors, distances


def left_with(words: np.ndarray, entry: np.ndarray | None, threshold: int) -> int:
    """The number of the anchor behind the last signature, -1 if it is still the entry."""
    anchors, distances = walk(words, entry, threshold)
    return len(words) - 1 if distances[-1] > threshold else int(anchors[-1]) if anchors[-1] != -2 else 0


def signed(words: np.ndarray) -> list[int]:
    return words.view("i8").tolist()


def summary(keys: list[str], page: str, signature: str, threshold: int) -> Callable[[pa.Table], pa.Table]:
    def reduce(table: pa.Table) -> pa.Table:
        table = table.sort_by(page)
        words, held = words_of(table[signature])
        pages, words = np.array(table[page].to_pylist())[held], words[held]
        first, radius, left = None, 0, None
        if len(words):
            last = left_with(words, None, threshold)
            first, radius = signed(words[0]), int(distance(words, words[0]).max())
            left = {"page": int(pages[last]), "signature": signed(words[last])}
        return pa.table({
            **{k: table[k][:1] for k in [*keys, _CHUNK]},
            "first": pa.array([first], LIST), "radius": pa.array([radius], pa.int64()), "left": pa.array([left], PAIR),
        })

    return reduce


def scan(keys: list[str], threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Along the chunks of each book, in order: the anchor each is entered with, and whether it must be walked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, anchor = None, None
        for batch in batches:
            entries, asked = [], []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != book:
                    book, anchor = own, None
                entries.append(anchor)
                ask = False
                if row["first"] is not None:
                    if anchor is None:
                        anchor = row["left"]
                    else:
                        far = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(anchor["signature"], row["first"]))
                        if far > threshold:
                            anchor = row["left"]
                        elif far + row["radius"] > threshold:
                            known = [a["left"] for a in row["answers"] or [] if a["entry"] == anchor["signature"]]
                            ask = not known
                            # An answer without an anchor: the entry is passed on.
                            anchor = known[0] or anchor if known else anchor
                asked.append(ask)
            columns = {k: batch.column(batch.schema.names.index(k)) for k in [*keys, _CHUNK]}
            columns["entry"] = pa.array(entries, PAIR)
            columns["asked"] = pa.array(asked, pa.bool_())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def answer(keys: list[str], page: str, signature: str, threshold: int) -> Callable[[pa.Table], pa.Table]:
    def reduce(table: pa.Table) -> pa.Table:
        table = table.sort_by(page)
        words, held = words_of(table[signature])
        pages, words = np.array(table[page].to_pylist())[held], words[held]
        entry = table["entry"][0].as_py()["signature"]
        last = left_with(words, np.array(entry, "i8").view("u8"), threshold)
        left = None if last < 0 else {"page": int(pages[last]), "signature": signed(words[last])}
        row = {k: table[k][:1] for k in [*keys, _CHUNK]}
        return pa.table({**row, "asked_entry": pa.array([entry], LIST), "left": pa.array([left], PAIR)})

    return reduce


def anchored(
    df: DataFrame, book: str | Sequence[str], page: str, signature: str, threshold: int = 5, *, width: int = CHUNK
) -> DataFrame:
    """The rows with ``anchor_page`` and ``distance``, the bits in which a page differs from its anchor.

    A book's first page has none (null). A page further than ``threshold`` from its anchor is the next
    page's anchor. A page without a signature has no anchor and becomes none. Page numbers are whole,
    not null and differ within a book; keys of books may be null.
    """
    keys = keys_of(book)
    rows = settled(df.withColumn(_CHUNK, page_chunk(page, width)))
    by_type = {f.name: f for f in rows.schema.fields}
    key_fields = [by_type[k] for k in [*keys, _CHUNK]]
    wide = rows.select(*keys, _CHUNK, page, signature)
    chunks = settled(
        wide.groupBy(*keys, _CHUNK).applyInArrow(
            summary(keys, page, signature, threshold),
            T.StructType([
                *key_fields, T.StructField("first", SIGNATURE), T.StructField("radius", T.LongType()),
                T.StructField("left", ANCHOR),
            ]),
        )
    ).withColumn("answers", F.lit(None).cast(T.ArrayType(ANSWER)))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, _CHUNK]]
    entry_fields = T.StructType([*key_fields, T.StructField("entry", ANCHOR), T.StructField("asked", T.BooleanType())])
    while True:
        ordered = chunks.repartition(*keys).sortWithinPartitions(*keys, _CHUNK)
        entries = settled(ordered.mapInArrow(scan(keys, threshold), entry_fields))
        if entries.where("asked").isEmpty():
            break
        wanted = wide.alias("a").join(entries.where("asked").alias("b"), same).select("a.*", "b.entry")
        found = wanted.groupBy(*keys, _CHUNK).applyInArrow(
            answer(keys, page, signature, threshold),
            T.StructType([*key_fields, T.StructField("asked_entry", SIGNATURE), T.StructField("left", ANCHOR)]),
        )
        own = F.array(F.struct(F.col("b.asked_entry").alias("entry"), F.col("b.left").alias("left")))
        none = F.array().cast(T.ArrayType(ANSWER))
        answers = F.concat(F.coalesce("a.answers", none), F.when(F.col("b.asked_entry").isNotNull(), own).otherwise(none))
        chunks = settled(
            chunks.alias("a").join(found.alias("b"), same, "left").select(
                *[f"a.{c}" for c in chunks.columns if c != "answers"], answers.alias("answers")
            )
        )
    entered = rows.alias("a").join(entries.alias("b"), same).select("a.*", F.col("b.entry").alias("_entry"))
    added = [T.StructField("anchor_page", T.LongType()), T.StructField("distance", T.LongType())]
    kept = [f for f in df.schema.fields if f.name not in ("anchor_page", "distance")]
    names = [f.name for f in kept]

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by(page)
        words, held = words_of(table[signature])
        entry = table["_entry"][0].as_py()
        anchors, distances = walk(
            words[held], None if entry is None else np.array(entry["signature"], "i8").view("u8"), threshold
        )
        pages = np.array(table[page].to_pylist())[held]
        of, far = np.full(len(held), None, object), np.full(len(held), None, object)
        own = [None if a == -2 else entry["page"] if a == -1 else int(pages[a]) for a in anchors.tolist()]
        of[held], far[held] = own, [None if a == -2 else d for a, d in zip(anchors.tolist(), distances.tolist())]
        out = table.select(names)
        return out.append_column("anchor_page", pa.array(of.tolist(), pa.int64())).append_column(
            "distance", pa.array(far.tolist(), pa.int64())
        )

    return entered.groupBy(*keys, _CHUNK).applyInArrow(finish, T.StructType(kept + added))


def similarity_score(
    df: DataFrame, book, page: str, signature: str, bits: int = 256, threshold: int = 5, *, width: int = CHUNK
) -> DataFrame:
    """Distance and score (1: equal, 0: no bit in common) of each page against its anchor."""
    out = anchored(df, book, page, signature, threshold, width=width)
    return out.withColumn("score", F.lit(1.0) - F.col("distance") / F.lit(float(bits)))
