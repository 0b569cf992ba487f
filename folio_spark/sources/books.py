"""A sink of one text file per book, in any character set, with byte order mark and line ends.

A Python data source: ``df.write.format("books")``. Rows come sorted by book and page, so a task has one
file open and one page in memory, however long a book is. A task writes below a folder of its attempt;
the driver moves the files to their names when all tasks have succeeded. A failed job, or an attempt that
was lost, leaves nothing at the target.
"""

from __future__ import annotations

import codecs
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.assemble import front_matter
from ..operators.sequence import page_chunk

#: Marks in front of a file.
MARKS = {
    "utf-8": codecs.BOM_UTF8, "utf-16-le": codecs.BOM_UTF16_LE, "utf-16-be": codecs.BOM_UTF16_BE,
    "utf-32-le": codecs.BOM_UTF32_LE, "utf-32-be": codecs.BOM_UTF32_BE,
}
PAGE_SPAN = 100_000


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system behind a path or URI, and the path in it."""
    if "://" not in path:
        path = "file://" + os.path.abspath(path.removeprefix("file:"))
    return pyarrow.fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: where they are, and their names below the target."""

    files: list[tuple[str, str]]


class BookWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.encoding = codecs.lookup(options.get("encoding", "utf-8")).name
        self.mark = options.get("bom", "false").lower() == "true"
        self.newline = options.get("newline", "\n")
        self.job = uuid.uuid4().hex
        if self.mark and self.encoding not in MARKS:
            raise ValueError(f"{self.encoding} has no byte order mark")

    def folder(self) -> tuple[pyarrow.fs.FileSystem, str, str]:
        fs, root = file_system(self.path)
        return fs, root, f"{root}/_temporary-{self.job}"

    def encoded(self, text: str) -> bytes:
        return text.replace("\n", self.newline).encode(self.encoding)

    def write(self, iterator: Iterator[Row]) -> Written:
        """Rows ``name, piece`` in order: all pieces of a name make one file."""
        fs, _, folder = self.folder()
        own = f"{folder}/{TaskContext.get().taskAttemptId()}"
        fs.create_dir(own, recursive=True)
        files, name, out = [], None, None
        try:
            for row in iterator:
                if row["name"] != name:
                    if out is not None:
                        out.close()
                    name = row["name"]
                    files.append((f"{own}/{len(files)}", name))
                    out = fs.open_output_stream(files[-1][0])
                    if self.mark:
                        out.write(MARKS[self.encoding])
                out.write(self.encoded(row["piece"]))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root, folder = self.folder()
        if self.overwrite:
            for info in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
                if info.path.rstrip("/") != folder.rstrip("/"):
                    (fs.delete_dir if info.type == pyarrow.fs.FileType.Directory else fs.delete_file)(info.path)
        for message in messages:
            for source, name in message.files if message else []:
                target = f"{root}/{name}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                fs.move(source, target)
        self.clean(fs, folder)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _, folder = self.folder()
        self.clean(fs, folder)

    def clean(self, fs: pyarrow.fs.FileSystem, folder: str) -> None:
        if fs.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(folder)


class Books(DataSource):
    @classmethod
    def name(cls) -> str:
        return "books"

    def writer(self, schema: StructType, overwrite: bool) -> BookWriter:
        if [f.name for f in schema.fields] != ["name", "piece"]:
            raise ValueError("books are written from rows of name and piece")
        return BookWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Books)


def book_name(book: Column) -> Column:
    """A file name for a key: letters, digits, ``-`` and ``_`` stay, other bytes become ``%`` and their number."""
    safe = F.replace(F.replace(F.url_encode(book.cast("string")), F.lit("+"), F.lit("%20")), F.lit("."), F.lit("%2E"))
    return F.coalesce(safe, F.lit("__none__"))


def name_of(book: str) -> str:
    """The same in Python, to find a book's file."""
    return quote(book, safe="*").replace("~", "%7E").replace(".", "%2E")


def write_books(
    pages: DataFrame,
    path: str,
    book: str,
    page: str,
    text: str,
    *,
    separator: str = "\n\n---\n\n",
    metadata: Column | None = None,
    mode: str = "create",
    encoding: str = "utf-8",
    bom: bool = False,
    newline: str = "\n",
    page_span: int = PAGE_SPAN,
) -> bool:
    """Write ``<book>.txt`` files of pages in order; false for an unknown mode or an existing target of ``create``.

    A book of more than ``page_span`` pages gets a file for each span of page numbers
    (``<book>.0000000001.txt`` behind ``<book>.txt``), so no task writes more; read in order they are the
    document. Front matter and byte order mark stand at the begin of files; the separator stands between
    pages, at the begin of a later span's first page. ``append`` adds files and replaces those of its books.
    A character that the encoding lacks fails the job. Pages without text are empty ones; books without a
    key share one file.
    """
    if mode not in ("create", "append", "overwrite"):
        return False
    fs, root = file_system(path)
    if mode == "create" and fs.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
        return False
    span = page_chunk(page, page_span)
    rows = pages.select(
        book_name(F.col(book)).alias("_book"), span.alias("_span"), F.col(page).alias("_page"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        (F.lit("") if metadata is None else F.concat(front_matter(metadata), F.lit("\n"))).alias("_head"),
    )
    # Whether a page is its book's first: the least span of each book, then the first row of that span's file.
    firsts = rows.groupBy("_book", "_span").agg(F.min("_page").alias("_least"))
    lowest = firsts.groupBy("_book").agg(F.min(F.struct("_span", "_least")).alias("_begin"))
    opening = firsts.join(lowest, "_book").select(
        "_book", "_span", F.when(F.col("_span") == F.col("_begin._span"), F.col("_least")).alias("_opens"),
        F.col("_begin._span").alias("_lowest"),
    )
    placed = rows.join(opening, ["_book", "_span"])
    number = F.col("_span") - F.col("_lowest")
    name = F.concat(
        "_book", F.when(number > 0, F.concat(F.lit("."), F.lpad(number.cast("string"), 10, "0"))).otherwise(""), F.lit(".txt")
    )
    lead = F.when(F.col("_page") == F.col("_opens"), F.col("_head")).otherwise(F.lit(separator))
    ordered = placed.repartition("_book", "_span").sortWithinPartitions("_book", "_span", "_page")
    register(pages.sparkSession)
    (
        ordered.select(name.alias("name"), F.concat(lead, "_text").alias("piece"))
        .write.format("books")
        .mode("overwrite" if mode == "overwrite" else "append")
        .options(path=path, encoding=encoding, bom=str(bom).lower(), newline=newline)
        .save()
    )
    return True
