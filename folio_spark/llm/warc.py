"""WARC archives and their two-level capture index.

Archives hold one gzip member per record. Of captures with equal payloads of ``least`` bytes or more
the one with the smallest id is a response and the others are revisits that name it.

The index has a line per capture under its reversed-host key (``com,example,www)/path``). Lines are
sorted over the whole corpus, cut into compressed blocks, and every index file ends with its sparse
block directory: the first and last key of each block and where it lies. A lookup goes from the
manifest (one row per index file) to a file's directory to one block by binary search, and from the
block's line to a range read of one record.

Cases: a null payload is empty; a null URL has the empty key; a capture with a null id is a response;
rows that share an id and a payload are all responses if theirs is the smallest id; an empty table
gives no archives and no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folio_spark.llm.common import as_bytes, file_system, salted_join, slices

# Fixed values of the format.
RESPONSE = "application/http;msgtype=response"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:capture:{}>"
GZIP = 31
TAIL = "<QQ"
TAIL_SIZE = struct.calcsize(TAIL)
#: Captures in an index block, and bytes fetched at once when neighbouring records are read.
BLOCK = 2000
FETCH = 4 << 20

CAPTURES = "key string, page_id long, path string, at long, size long"
PARTS = "part int, path string, first_key string, last_key string, n_blocks int"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def host_key(url: Column) -> Column:
    """The URL with its host's labels reversed, without scheme, user, port and fragment."""
    text = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(host == "", text).otherwise(
        F.concat(labels, F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    )


def judged(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """Captures with payload digest and size, and the id of the response that a revisit names."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    shared = (
        rows.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    named = salted_join(rows, shared, "digest", "page_id", "left")
    return named.withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first"))).drop("first")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {RECORD_ID.format('' if page_id is None else page_id)}",
        f"WARC-Date: {date}",
        f"Content-Type: {RESPONSE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {RECORD_ID.format(refers_to)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def fields_of(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in lines.decode().split("\r\n")[1:])
    return {name.lower(): value for name, _, value in pairs}


def parsed(member: bytes) -> tuple:
    """A record's row; a response's payload is checked against its digest."""
    head, _, rest = zlib.decompress(member, GZIP).partition(b"\r\n\r\n")
    head = fields_of(head)
    http, _, payload = rest[: int(head["content-length"])].partition(b"\r\n\r\n")
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    number = head["warc-record-id"].removeprefix("<urn:capture:").removesuffix(">")
    refers = head.get("warc-refers-to", "").removeprefix("<urn:capture:").removesuffix(">")
    if not refers:
        found = hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError(f"capture {number}: payload digest differs")
    size = int(fields_of(http)["content-length"])
    return (
        int(number) if number else None,
        head.get("warc-target-uri"),
        size,
        digest,
        head["warc-type"],
        int(refers) if refers else None,
        None if refers else payload,
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = 100,
    date: str = "1970-01-01T00:00:00Z",
    block: int = BLOCK,
) -> None:
    """Write archives and their index below ``folder``.

    Each task writes one file of its own; of a task that ran twice only the file named in the
    manifest counts.
    """
    spark = pages.sparkSession
    system, root = file_system(folder)
    system.create_dir(f"{root}/archive")
    system.create_dir(f"{root}/index")
    made = pa.schema(
        [("key", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64())]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        name = f"{root}/archive/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or system.open_output_stream(name, compression=None)
            keys, ids, urls, digests, refers = (batch.column(i).to_pylist() for i in range(5))
            sizes = []
            for row in zip(ids, urls, as_bytes(batch.column(5)), digests, refers):
                member = record(*row, date)
                out.write(member)
                sizes.append(len(member))
            begins = [at]
            for size in sizes:
                begins.append(begins[-1] + size)
            at = begins.pop()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip((keys, ids, [name] * len(ids), begins, sizes), made)], schema=made
            )
        if out:
            out.close()

    judged(pages, id_col, url_col, payload_col, least).select(
        host_key(F.col("url")).alias("key"), "page_id", "url", "digest", "refers_to", "payload"
    ).mapInArrow(write, CAPTURES).write.parquet(f"{folder}/captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        part = TaskContext.get().partitionId()
        name = f"{root}/index/{part:06d}-{uuid.uuid4().hex}.index"
        out, at, directory, waiting = None, 0, [], []

        def flush():
            nonlocal at, waiting
            packed = zlib.compress("\n".join(json.dumps(x) for x in waiting).encode(), 6)
            out.write(packed)
            directory.append([waiting[0][0], waiting[-1][0], at, len(packed)])
            at, waiting = at + len(packed), []

        for batch in batches:
            if batch.num_rows:
                out = out or system.open_output_stream(name, compression=None)
            for line in zip(*(batch.column(i).to_pylist() for i in range(5))):
                waiting.append(line)
                if len(waiting) == block:
                    flush()
        if out is None:
            return
        if waiting:
            flush()
        tail = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(tail + struct.pack(TAIL, at, len(tail)))
        out.close()
        row = (part, name, directory[0][0], directory[-1][1], len(directory))
        types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip(row, types)], ["part", "path", "first_key", "last_key", "n_blocks"]
        )

    captures = spark.read.schema(CAPTURES).parquet(f"{folder}/captures")
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    captures.repartitionByRange(width, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(
        index, PARTS
    ).write.parquet(f"{folder}/parts")


class IndexFile:
    """The block directory of one index file."""

    def __init__(self, system, path: str):
        self.source = system.open_input_file(path)
        size = self.source.size()
        at, length = struct.unpack(TAIL, self.source.read_at(TAIL_SIZE, size - TAIL_SIZE))
        self.directory = json.loads(zlib.decompress(self.source.read_at(length, at)))

    def lines(self, number: int) -> list[list]:
        """Lines of a block: key, page_id, archive, offset, size."""
        _, _, at, length = self.directory[number]
        text = zlib.decompress(self.source.read_at(length, at)).decode()
        return [json.loads(line) for line in text.split("\n")]

    def matches(self, key: str) -> Iterator[list]:
        """Lines with this key: found by binary search, in the directory and in each block."""
        number = bisect_left(self.directory, key.encode(), key=lambda d: d[1].encode())
        while number < len(self.directory) and self.directory[number][0].encode() <= key.encode():
            lines = self.lines(number)
            at = bisect_left(lines, key.encode(), key=lambda line: line[0].encode())
            while at < len(lines) and lines[at][0] == key:
                yield lines[at]
                at += 1
            number += 1


def members(system, lines: list[list]) -> Iterator[bytes]:
    """The records of index lines; records that lie side by side are fetched together."""
    lines = sorted(lines, key=itemgetter(2, 3))
    begin = 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or lines[i][2] != lines[i - 1][2] or lines[i][3] != lines[i - 1][3] + lines[i - 1][4]:
            run = lines[begin:i]
            with system.open_input_file(run[0][2]) as source:
                for a, b in slices([x[4] for x in run], FETCH):
                    first = run[a][3]
                    data = source.read_at(run[b - 1][3] + run[b - 1][4] - first, first)
                    for x in run[a:b]:
                        yield data[x[3] - first : x[3] - first + x[4]]
            begin = i


def rows_of(found: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in found:
        rows.append(row)
        size += len(row[6] or b"")
        if size > FETCH or len(rows) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


RECORD_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
RECORD_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record, read from the archives block by block of the index."""
    parts = spark.read.schema(PARTS).parquet(f"{folder}/parts")
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = parts.select("path", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)

        def found():
            for batch in batches:
                for path, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for member in members(system, IndexFile(system, path).lines(number)):
                        yield parsed(member)

        yield from rows_of(found(), RECORD_NAMES, RECORD_TYPES)

    return blocks.repartition(width).mapInArrow(read, RECORDS)


def lookup(urls: DataFrame, folder: str, url_col: str = "url") -> DataFrame:
    """The captures of each URL asked for, with the key they were found by.

    The manifest, one row for each index file, is joined by key range; directories and blocks are
    read where they are needed.
    """
    spark = urls.sparkSession
    parts = spark.read.schema(PARTS).parquet(f"{folder}/parts")
    asked = urls.select(host_key(F.col(url_col)).alias("key")).distinct()
    # Few rows: one for each index file.
    shared = spark.sparkContext.broadcast(
        sorted((r["last_key"].encode(), r["first_key"].encode(), r["path"]) for r in parts.collect())
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)

        def found():
            for batch in batches:
                for key in batch.column(0).to_pylist():
                    at = bisect_left(shared.value, key.encode(), key=itemgetter(0))
                    while at < len(shared.value) and shared.value[at][1] <= key.encode():
                        lines = list(IndexFile(system, shared.value[at][2]).matches(key))
                        for member in members(system, lines):
                            yield (*parsed(member), key)
                        at += 1

        yield from rows_of(found(), [*RECORD_NAMES, "key"], [*RECORD_TYPES, pa.string()])

    return asked.mapInArrow(find, RECORDS + ", key string")
