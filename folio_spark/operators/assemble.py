"""Ordered concatenation of pages, blocks and words into documents.

A document is delivered in *parts*: ``(book, part, text)`` with one part for
every ``part_pages`` page numbers. Ordinary books have a single part 0; a very
long book is spread over many rows instead of being gathered into one value.
Joining the parts in order with the same separator gives the whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import keys_of, page_chunk
from .skew import join_by_chunk

PART_PAGES = 1000
PARTS_TOGETHER = 64
SECTION_SEPARATOR = "\n\n---\n\n"
RULE_SEPARATOR = "\n" + "=" * 80 + "\n\n"

# The characters that count as whitespace at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind."""
    return F.btrim(text, F.lit(WHITESPACE))


def ordered_join(order: str, text: str, sep: str) -> Column:
    """Aggregate: the texts of a bounded group in ``order``."""
    items = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text).alias("_t"))))
    return F.array_join(F.transform(items, lambda i: i["_t"]), sep)


def assemble_pages(
    df: DataFrame,
    book,
    page: str,
    text: str,
    *,
    sep: str = SECTION_SEPARATOR,
    part_pages: int = PART_PAGES,
    name: str = "text",
) -> DataFrame:
    """One row per book and part: its page texts in page order."""
    parts = df.withColumn("part", page_chunk(page, part_pages))
    return parts.groupBy(*keys_of(book), "part").agg(
        F.count(F.lit(1)).alias("pages"),
        F.min(page).alias("first_page"),
        F.max(page).alias("last_page"),
        ordered_join(page, text, sep).alias(name),
    )


def assemble_reading_order(
    blocks: DataFrame,
    page_keys,
    order: str,
    text: str,
    *,
    sep: str = "\n\n",
    part_blocks: int = PART_PAGES,
    name: str = "text",
) -> DataFrame:
    """Stripped non-empty blocks of every page in reading order."""
    cleaned = blocks.withColumn(text, strip(F.col(text))).filter(F.col(text) != "")
    return assemble_pages(
        cleaned, page_keys, order, text, sep=sep, part_pages=part_blocks, name=name
    ).drop("first_page", "last_page").withColumnRenamed("pages", "blocks")


def nested_text(blocks: Column) -> Column:
    """Text of ``array<array<array<array<string>>>>``.

    Blocks hold paragraphs, paragraphs words, words symbols. Symbols and words
    join without a space, every paragraph ends its line, the whole is stripped.
    """

    def paragraph(words):
        return F.concat(F.array_join(F.transform(words, lambda w: F.array_join(w, "")), ""), F.lit("\n"))

    return strip(
        F.array_join(
            F.transform(blocks, lambda b: F.array_join(F.transform(b, paragraph), "")), ""
        )
    )


def joined_blocks(blocks: Column, sep: str = "\n") -> Column:
    """Full text of an ``array<struct<text,...>>`` layout column."""
    return F.array_join(F.transform(blocks, lambda b: b["text"]), sep)


def front_matter(metadata: Column) -> Column:
    """``Key: value`` lines of a map between two rules, keys capitalised, in key order."""
    entries = F.sort_array(F.map_entries(metadata))
    lines = F.transform(
        entries, lambda e: F.concat(capitalised(e["key"]), F.lit(": "), e["value"])
    )
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.length(word))))


def with_front_matter(
    documents: DataFrame, book, metadata: Column, *, text: str = "text", top: bool = True
) -> DataFrame:
    """Put the front matter before the first part, or behind the last one."""
    keys = keys_of(book)
    edge = F.min("part") if top else F.max("part")
    edges = documents.groupBy(*keys).agg(edge.alias("_edge"))
    matter = front_matter(metadata)
    pieces = [matter, F.lit("\n"), F.col(text)] if top else [F.col(text), F.lit("\n"), matter]
    marked = F.when(F.col("part") == F.col("_edge"), F.concat(*pieces)).otherwise(F.col(text))
    joined = join_by_chunk(documents, edges, keys, {"_chunk": page_chunk("part", PARTS_TOGETHER)})
    return joined.withColumn(text, marked).drop("_edge")
