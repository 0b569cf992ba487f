"""Row expectations: rules, violation reports and quarantine splits."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assemble import strip

# The accepted names and limits.
IMAGE_FORMATS = ["png", "jpg", "jpeg", "bmp", "tiff"]
ENGINES = ["yomitoku", "tesseract"]
LOG_LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
MAX_TITLE = 200
UNSAFE_NAME = r'[<>:"/\\|?*\x00-\x1f]'
UNTITLED = "untitled"


@dataclass(frozen=True)
class Rule:
    """``holds`` is true for a good row; null counts as a violation."""

    name: str
    holds: Column
    message: str

    @property
    def broken(self) -> Column:
        return ~F.coalesce(self.holds, F.lit(False))


def whole_number(value: Column) -> Column:
    """The value as a bigint if it is a whole number, else null; nothing is cut off."""
    number = value.try_cast("bigint")
    return F.when(value.try_cast("double") == number, number)


def title_rule(title: Column) -> Rule:
    trimmed = strip(title)
    return Rule("title", (trimmed != "") & (F.length(trimmed) <= MAX_TITLE), f"1 to {MAX_TITLE} characters")


def page_number_rule(page: Column, low: int = 1, high: Column | int | None = None) -> Rule:
    number = whole_number(page)
    holds = number >= low
    if high is not None:
        holds = holds & (number <= high)
    return Rule("page_number", holds, f"an integer from {low}")


def page_range_rule(start: Column, end: Column, high: Column | int | None = None) -> Rule:
    first, last = whole_number(start), whole_number(end)
    holds = (first >= 1) & (end.isNull() | (last >= F.greatest(first, F.lit(1))))
    if high is not None:
        holds = holds & (first <= high) & (end.isNull() | (last <= high))
    return Rule("page_range", holds, "start from 1 and end not before start")


def confidence_rule(value: Column) -> Rule:
    return Rule("confidence", value.try_cast("double").between(0.0, 1.0), "between 0 and 1")


def membership_rule(name: str, value: Column, allowed: list[str], upper: bool = False) -> Rule:
    fold = F.upper if upper else F.lower
    return Rule(name, fold(strip(value)).isin(allowed), "one of " + ", ".join(allowed))


def image_format_rule(value: Column) -> Rule:
    return membership_rule("image_format", value, IMAGE_FORMATS)


def engine_rule(value: Column, engines: list[str] = ENGINES) -> Rule:
    return membership_rule("engine", value, engines)


def log_level_rule(value: Column) -> Rule:
    return membership_rule("log_level", value, LOG_LEVELS, upper=True)


def positive_rule(value: Column) -> Rule:
    return Rule("positive", whole_number(value) > 0, "an integer above 0")


def non_negative_rule(value: Column) -> Rule:
    return Rule("non_negative", value.try_cast("double") >= 0, "0 or more")


def validate(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Add ``violations array<string>`` with the names of the broken rules."""
    hits = [F.when(r.broken, F.lit(r.name)) for r in rules]
    return df.withColumn("violations", F.array_compact(F.array(*hits)))


def split_valid(df: DataFrame, rules: Iterable[Rule]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined)"""
    checked = validate(df, rules)
    clean = F.size("violations") == 0
    return checked.filter(clean).drop("violations"), checked.filter(~clean)


def rule_report(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """One row per rule with checked and failed counts: a single pass over the rows."""
    rules = list(rules)
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(r.broken).alias(f"_r{i}") for i, r in enumerate(rules)],
    )
    rows = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"),
            F.col("_n").alias("checked"),
            F.col(f"_r{i}").alias("failed"),
            F.lit(r.message).alias("message"),
        )
        for i, r in enumerate(rules)
    ])
    return counts.select(F.inline(rows))


def sanitize_filename(name: Column) -> Column:
    safe = F.regexp_replace(name, UNSAFE_NAME, "_")
    safe = F.regexp_replace(safe, r"^[. ]+|[. ]+$", "")
    return F.when(F.coalesce(safe, F.lit("")) == "", F.lit(UNTITLED)).otherwise(safe)


def state_key(title: Column) -> Column:
    """File name of a book's state record."""
    safe = F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "_")
    return F.concat(F.regexp_replace(strip(safe), " ", "_"), F.lit("_state.json"))


def log_key(title: Column) -> Column:
    """Unlike the state key, unwanted characters are dropped."""
    return F.regexp_replace(strip(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "")), " ", "_")


CLEANERS = {
    "title": strip,
    "filename": sanitize_filename,
    "format": lambda c: F.lower(strip(c)),
    "engine": lambda c: F.lower(strip(c)),
    "log_level": lambda c: F.upper(strip(c)),
}


def normalised(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace columns by their cleaned values; ``columns`` maps a column to its kind."""
    return df.withColumns({name: CLEANERS[kind](F.col(name)) for name, kind in columns.items()})
