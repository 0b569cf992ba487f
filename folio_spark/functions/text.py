"""Text cleaning and structuring as column expressions (one page text per row).

Lines are handled as arrays inside the row, so none of this shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.assemble import strip
from .binding import let

# Fixed values of the formatting rules.
CONTROL_CHARACTERS = r"[\x00-\x08\x0b-\x1f\x7f]"
SPACE_RUN = r"[ \t\x{3000}]+"
PAGE_NUMBER_LINE = r"^\s*[0-9]+\s*$"
RULE_LINE = r"^\s*[-=_*#~.]{3,}\s*$"
REPEATED_CHARACTER = r"(.)\1{4,}"
CHAPTER_LINE = "^第.+[章節部]"
SENTENCE_END = r"[。．.!?、]$"
MARKDOWN_HEADING = r"^(#{1,6}) (.*)$"
SHORT_LINE = 30
LONG_LINE = 50
HEIGHT_RATIO = 1.2
LEVEL_RATIOS = {1: 2.0, 2: 1.5}
TOC_TITLE = "## 目次"


def clean_text(
    text: Column,
    *,
    remove_extra_spaces: bool = True,
    normalize_linebreaks: bool = True,
    remove_hyphenation: bool = True,
) -> Column:
    out = text
    if normalize_linebreaks:
        out = F.regexp_replace(out, "\r\n|\r", "\n")
    out = F.regexp_replace(out, CONTROL_CHARACTERS if normalize_linebreaks else r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    if remove_hyphenation:
        out = F.regexp_replace(out, "-\n", "")
    if remove_extra_spaces:
        out = F.regexp_replace(out, SPACE_RUN, " ")
    return out


def output_text(
    text: Column,
    *,
    preserve_linebreaks: bool = True,
    trim_whitespace: bool = True,
    normalize_spaces: bool = True,
) -> Column:
    """Output switches: line breaks to blanks, trimmed ends, single blanks."""
    out = text if preserve_linebreaks else F.regexp_replace(text, "\n+", " ")
    if normalize_spaces:
        out = F.regexp_replace(out, SPACE_RUN, " ")
    return strip(out) if trim_whitespace else out


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def drop_noise_lines(text: Column) -> Column:
    """Without digit-only lines and lines made of rule characters."""
    kept = F.filter(lines_of(text), lambda s: ~s.rlike(PAGE_NUMBER_LINE) & ~s.rlike(RULE_LINE))
    return F.array_join(kept, "\n")


def remove_artifacts(text: Column) -> Column:
    return F.regexp_replace(drop_noise_lines(text), REPEATED_CHARACTER, "")


def organize_paragraphs(text: Column) -> Column:
    """One blank line between paragraphs; a line after a long one continues it."""
    paragraphs = F.split(F.regexp_replace(text, "\n{3,}", "\n\n"), "\n\n")

    def glue(line, before):
        continues = (F.length(before) > LONG_LINE) & ~before.startswith("#") & ~line.startswith("#")
        lead = F.when(before.isNull() | continues, F.lit("")).otherwise(F.lit("\n"))
        return F.concat(lead, line)

    def joined(paragraph):
        return let(
            lines_of(paragraph),
            lambda lines: F.array_join(F.zip_with(lines, shifted_back(lines), glue), ""),
        )

    return F.array_join(F.transform(paragraphs, joined), "\n\n")


def shifted_back(lines: Column) -> Column:
    """The line before each line, null for the first."""
    return F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, 1, F.size(lines) - 1))


def looks_like_heading(line: Column, following: Column) -> Column:
    """Chapter line, or a short line without sentence end before a blank one or the end."""
    blank_next = F.coalesce(strip(following) == "", F.lit(True))
    short = (
        (strip(line) != "")
        & (F.length(line) <= SHORT_LINE)
        & ~line.rlike(SENTENCE_END)
        & ~line.startswith("#")
        & blank_next
    )
    return line.rlike(CHAPTER_LINE) | short


def format_headings(text: Column, *, markdown: bool = True, detect_headings: bool = True) -> Column:
    """Mark plain-text headings with ``## ``."""
    if not (markdown and detect_headings):
        return text

    def mark(line, following):
        heading = looks_like_heading(line, following)
        return F.when(heading, F.concat(F.lit("## "), line)).otherwise(line)

    # zip_with pads the shorter array: the last line is followed by null.
    return let(
        lines_of(text),
        lambda lines: F.array_join(F.zip_with(lines, F.slice(lines, 2, F.size(lines)), mark), "\n"),
    )


def format_full_text(text: Column, *, markdown: bool = True, detect_headings: bool = True) -> Column:
    """Clean, mark headings, remove artefacts, organise paragraphs."""
    out = clean_text(text)
    out = format_headings(out, markdown=markdown, detect_headings=detect_headings)
    out = remove_artifacts(out)
    return organize_paragraphs(out)


def is_heading(block_kind: Column, height: Column, average: Column, text: Column) -> Column:
    tall = (average > 0) & (height >= average * HEIGHT_RATIO)
    return (block_kind == "heading") | tall | (F.length(text) <= SHORT_LINE)


def heading_level(height: Column, average: Column) -> Column:
    ratio = F.try_divide(height, average)
    level = F.lit(3)
    for number in sorted(LEVEL_RATIOS, reverse=True):
        level = F.when(ratio >= LEVEL_RATIOS[number], F.lit(number)).otherwise(level)
    return level


def heading_marker(level: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "))


def heading_score(tall: Column, first_on_page: Column, position_weight: float = 0.7) -> Column:
    return tall.cast("int") * round(1 - position_weight, 10) + first_on_page.cast("int") * position_weight


def table_of_contents(text: Column) -> Column:
    """``- title`` for every Markdown heading, indented by level; empty without headings."""
    headings = F.filter(lines_of(text), lambda s: s.rlike(MARKDOWN_HEADING))

    def entry(line):
        level = F.length(F.regexp_extract(line, MARKDOWN_HEADING, 1))
        return F.concat(
            F.repeat(F.lit("  "), level - 1), F.lit("- "), F.regexp_extract(line, MARKDOWN_HEADING, 2)
        )

    return F.array_join(F.transform(headings, entry), "\n")
