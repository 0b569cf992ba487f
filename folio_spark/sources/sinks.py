"""Text, Markdown, state and metric sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOC_TITLE, table_of_contents
from ..operators.assemble import PART_PAGES, assemble_pages, front_matter
from ..operators.sequence import keys_of, page_chunk
from ..operators.skew import join_by_chunk
from ..streaming.tables import exists

MODES = {"create": "errorifexists", "append": "append", "overwrite": "overwrite"}
BOM = "﻿"
ENCODINGS = ["UTF-8", "UTF-8-SIG", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "US-ASCII", "ISO-8859-1"]


def write_text(
    df: DataFrame, path: str, *, mode: str = "create", partition_by: list[str] | None = None, line_sep: str = "\n"
) -> bool:
    """Write a single text column; false for an unknown mode or an existing target of ``create``."""
    if mode not in MODES:
        return False
    if mode == "create" and exists(df.sparkSession, path):
        return False
    writer = df.write.mode(MODES[mode])
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("lineSep", line_sep).text(path)
    return True


def write_pages(
    pages: DataFrame, path: str, book: str, page: str, text: str, *,
    separator: str = "\n\n---\n\n", metadata: Column | None = None, mode: str = "create", page_span: int = 100_000,
) -> bool:
    """Write every book's pages in order, below ``book=...`` folders.

    Rows are shuffled by book and page span, so an ordinary book is one file and
    a huge one several, whose names sort in page order. The separator stands
    before every page but the first, the front matter before the first. Spark ends
    every row with a line separator, for which the first character of ``separator``
    serves: the files are the assembled text plus that character at the end.
    """
    if not separator:
        raise ValueError("pages need a separator")
    firsts = pages.groupBy(book).agg(F.min(page).alias("_first"))
    lead = F.lit("") if metadata is None else F.concat(front_matter(metadata), F.lit("\n"))
    opened = F.when(F.col(page) == F.col("_first"), lead).otherwise(F.lit(separator[1:]))
    rows = join_by_chunk(pages, firsts, [book], {"_chunk": page_chunk(page)}).select(
        book,
        F.concat(F.lit("span-"), F.lpad(F.floor(F.col(page) / page_span).cast("string"), 10, "0")).alias("span"),
        page,
        F.concat(opened, F.col(text)).alias("value"),
    )
    ordered = rows.repartition(book, "span").sortWithinPartitions(book, "span", page)
    return write_text(ordered.select(book, "span", "value"), path, mode=mode, partition_by=[book, "span"], line_sep=separator[0])


def with_toc(text: Column) -> Column:
    toc = table_of_contents(text)
    return F.when(toc == "", text).otherwise(F.concat(F.lit(TOC_TITLE + "\n\n"), toc, F.lit("\n\n"), text))


def title_from_path(path: Column) -> Column:
    """``some/where/quick.md`` to ``quick``."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def markdown_path(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".md"), path).otherwise(
        F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".md"))
    )


def markdown_document(title: Column, text: Column, *, metadata: Column | None = None, toc: bool = False) -> Column:
    """Title heading, optional front matter and contents, then the text."""
    parts = [F.concat(F.lit("# "), title)]
    if metadata is not None:
        parts.append(F.rtrim(front_matter(metadata), F.lit("\n")))
    parts.append(with_toc(text) if toc else text)
    return F.concat_ws("\n\n", *parts)


def markdown_parts(
    pages: DataFrame, book: str, page: str, text: str, *,
    title: Column, metadata: Column | None = None, sep: str = "\n\n", part_pages: int = PART_PAGES,
) -> DataFrame:
    """A book's Markdown document as rows ``(book, section, part, text)``.

    Section 0 is the title with the front matter and the heading of the contents, 1
    the contents, 2 the pages. In that order, joined by a blank line (contents parts
    by a line break), they are the document. Contents and pages of a long book take several parts, so the
    contents always list all its headings. ``title`` and ``metadata`` may use the
    book's key and its page count ``pages``.
    """
    body = assemble_pages(pages, book, page, text, sep=sep, part_pages=part_pages)
    entries = pages.select(book, page, table_of_contents(F.col(text)).alias("_toc")).filter("_toc <> ''")
    toc = assemble_pages(entries, book, page, "_toc", sep="\n", part_pages=part_pages)
    listed = F.max(table_of_contents(F.col(text)) != "").alias("_listed")
    counted = pages.groupBy(book).agg(F.count(F.lit(1)).alias("pages"), listed)
    lines = [F.concat(F.lit("# "), title)]
    if metadata is not None:
        lines.append(F.rtrim(front_matter(metadata), F.lit("\n")))
    lines.append(F.when(F.col("_listed"), F.lit(TOC_TITLE)))
    head = counted.withColumns({"part": F.lit(0).cast("bigint"), "text": F.concat_ws("\n\n", *lines)})
    section = lambda df, n: df.select(book, F.lit(n).alias("section"), "part", "text")
    return section(head, 0).unionByName(section(toc, 1)).unionByName(section(body, 2))


def encoded(text: Column, encoding: str = "UTF-8", *, bom: bool = False, newline: str = "\n") -> Column:
    """Bytes of the text with the wanted line end and byte order mark.

    Spark encodes to UTF, ISO-8859-1 and ASCII; Shift-JIS is rejected.
    """
    name = encoding.upper().replace("_", "-")
    if name not in ENCODINGS:
        raise ValueError(f"unsupported encoding {encoding!r}; one of {', '.join(ENCODINGS)}")
    if name == "UTF-8-SIG":
        name, bom = "UTF-8", True
    out = text if newline == "\n" else F.replace(text, F.lit("\n"), F.lit(newline))
    return F.encode(F.concat(F.lit(BOM), out) if bom else out, name)


def save_states(states: DataFrame, path: str) -> None:
    """Append state rows; the newest per book counts when they are read."""
    states.write.mode("append").json(path)


def replace_books(states: DataFrame, path: str, book: str) -> None:
    """Overwrite only the folders of the books present in ``states``."""
    (
        states.repartition(*keys_of(book))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys_of(book))
        .parquet(path)
    )


def write_metrics(metrics: DataFrame, folder: str, stamp: str) -> str:
    """Metric records as JSON in a folder named by the given time stamp."""
    path = f"{folder}/performance_metrics_{stamp}"
    metrics.write.mode("errorifexists").json(path)
    return path
