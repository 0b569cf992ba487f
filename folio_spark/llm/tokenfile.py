"""Token files: one zstandard frame per document, a trailing seek table, a checksum per frame.

A file is a series of independent frames, each the ids of one document as little-endian unsigned
32-bit integers; then a skippable frame with the documents' ids; then the seek table of the public
seekable zstandard format (sizes and checksum of every frame). Any zstandard reader can decompress
the file from front to back; a reader of some documents reads the tail, finds their frames and
decompresses those alone.

Null and repeated cases: a null text is empty, an empty text is the end id alone; a null document id
comes first; rows that share an id are kept, ordered by their text. An empty table gives no files
and no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from folio_spark.llm.common import as_bytes, file_system, slices
from folio_spark.llm.tokens import encoder

# Fixed values of the seekable zstandard format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])
FOOTER = "<IBI"
HEADER = "<II"
FOOTER_SIZE, HEADER_SIZE = struct.calcsize(FOOTER), struct.calcsize(HEADER)
#: Skippable frame with the document ids, in a number of its own.
DIRECTORY = 0x184D2A50

MANIFEST = "part int, path string, n_docs long, n_tokens long, first_id long, last_id long"
#: Bytes that a reader fetches at once when it reads neighbouring frames.
FETCH = 4 << 20


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    level: int = 3,
) -> DataFrame:
    """Encode all texts and write them in ascending id order; returns the manifest, also kept in ``folder``.

    Documents are dealt by ranges of their id, so each task writes one file and files follow each
    other in order. A task that runs twice writes two files; the manifest names the one that counts.
    """
    spark = docs.sparkSession
    system, root = file_system(folder)
    system.create_dir(f"{root}/data")
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        encode = encoder(tokenizer).encode
        pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        part = TaskContext.get().partitionId()
        name = f"{root}/data/{part:06d}-{uuid.uuid4().hex}.tokens"
        out, ids, entries, tokens = None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or system.open_output_stream(name, compression=None)
            ids.extend(batch.column(0).to_pylist())
            for text in as_bytes(batch.column(1)):
                plain = encode(text) + end
                frame = pack.compress(plain)
                out.write(frame)
                tokens += len(plain) // 4
                entries.append((len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        if out is None:
            return
        known = np.array([x is not None for x in ids], "u1")
        body = known.tobytes() + np.array([x or 0 for x in ids], "<i8").tobytes()
        out.write(struct.pack(HEADER, DIRECTORY, len(body)) + body)
        table = np.array(entries, ENTRY).tobytes() + struct.pack(FOOTER, len(entries), CHECKSUMS, SEEKABLE)
        out.write(struct.pack(HEADER, SKIPPABLE, len(table)) + table)
        out.close()
        real = [x for x in ids if x is not None]
        row = [part, name, len(ids), tokens, real[0] if real else None, real[-1] if real else None]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x], t)
                for x, t in zip(row, [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])
            ],
            ["part", "path", "n_docs", "n_tokens", "first_id", "last_id"],
        )

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(width, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file, with the number of ids in all files before it."""
    from pyspark.sql import Window

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # One row per file of many documents: few rows, so their running sum may run in one task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class TokenFile:
    """The seek table and the directory of one file; frames are fetched on demand."""

    def __init__(self, system, path: str):
        self.source = system.open_input_file(path)
        size = self.source.size()
        n, flags, magic = struct.unpack(FOOTER, self.source.read_at(FOOTER_SIZE, size - FOOTER_SIZE))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError(f"{path}: no seek table with checksums")
        at = size - FOOTER_SIZE - n * ENTRY.itemsize
        self.entries = np.frombuffer(self.source.read_at(n * ENTRY.itemsize, at), ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype="i8")])
        body = self.source.read_at(9 * n, int(self.starts[-1]) + HEADER_SIZE)
        self.known = np.frombuffer(body[:n], "u1").astype(bool)
        self.ids = np.frombuffer(body[n:], "<i8")
        counts = self.entries["plain"] // 4
        self.before = np.concatenate([[0], np.cumsum(counts, dtype="i8")])
        self.unpack = zstandard.ZstdDecompressor()

    def frames(self, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Plain bytes of the frames at these places (ascending); neighbours are fetched together."""
        runs = np.split(places, np.flatnonzero(np.diff(places) > 1) + 1) if len(places) else []
        for run in runs:
            for a, b in slices(self.entries["packed"][run].tolist(), FETCH):
                first = int(self.starts[run[a]])
                data = self.source.read_at(int(self.starts[run[b - 1] + 1]) - first, first)
                for i in run[a:b].tolist():
                    frame = data[int(self.starts[i]) - first : int(self.starts[i + 1]) - first]
                    plain = self.unpack.decompress(frame, max_output_size=int(self.entries["plain"][i]))
                    if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != int(self.entries["checksum"][i]):
                        raise ValueError(f"frame {i}: checksum differs")
                    yield i, plain

    def places(self, wanted: np.ndarray | None) -> np.ndarray:
        if wanted is None:
            return np.arange(len(self.entries))
        return np.flatnonzero(self.known & np.isin(self.ids, wanted))


def read_tokens(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """Documents of the files: ``doc_id, start`` (ids of all documents before it) and ``ids`` (binary).

    With ``wanted``, a list of ids that fits a task, only files whose id range can have one of them
    are opened and only those documents' frames are decompressed.
    """
    files = read_manifest(spark, folder)
    some = None if wanted is None else np.array(sorted(set(wanted)), "i8")
    if some is not None:
        low, high = (int(some[0]), int(some[-1])) if len(some) else (1, 0)
        files = files.where((F.col("last_id") >= low) & (F.col("first_id") <= high))
    shape = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(system, path)
                rows, size = [], 0
                for i, plain in file.frames(file.places(some)):
                    known = int(file.ids[i]) if file.known[i] else None
                    rows.append((known, base + int(file.before[i]), plain))
                    size += len(plain)
                    if size > FETCH:
                        yield block(rows)
                        rows, size = [], 0
                if rows:
                    yield block(rows)

    def block(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), shape)], schema=shape)

    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (
        files.select("path", "base").repartition(width).mapInArrow(read, "doc_id long, start long, ids binary")
    )
