"""Progress, stage and confidence statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import CHUNK, keys_of, micros, previous_page

DEFAULT_CONFIDENCE = 0.95


def average_or(values: Column, default: float) -> Column:
    return F.coalesce(F.avg(values), F.lit(default))


def average_confidence(raw: Column) -> Column:
    """Mean share of percentages, negative sentinels left out, 0 without any."""
    return average_or(F.when(raw >= 0, raw / 100.0), 0.0)


def percentage(current: Column, total: Column, start: Column | int = 1) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    done = F.greatest(current - start + 1, F.lit(0))
    share = F.least(done / (total - start + 1) * 100.0, F.lit(100.0))
    return F.when(total == 0, F.lit(0.0)).otherwise(share)


def remaining_seconds(average: Column, current: Column, total: Column) -> Column:
    left = total - current
    return F.when(average.isNull(), F.lit(None)).when(left <= 0, F.lit(0.0)).otherwise(average * left)


def pages_per_minute(average: Column) -> Column:
    return F.when(average != 0, F.lit(60.0) / average)


def format_duration(seconds: Column) -> Column:
    """``1h 2m 3s``, ``2m 3s`` or ``3s``; fractions are cut."""
    s = F.floor(seconds).cast("bigint")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    text = lambda number, unit: F.concat(number.cast("bigint").cast("string"), F.lit(unit))
    short = text(rest, "s")
    middle = F.concat_ws(" ", text(minutes, "m"), short)
    return (
        F.when(hours > 0, F.concat_ws(" ", text(hours, "h"), middle))
        .when(minutes > 0, middle)
        .otherwise(short)
    )


def one_decimal(value: Column) -> Column:
    return F.round(value, 1).cast("decimal(38,1)").cast("string")


def progress_bar(pct: Column, width: int = 50) -> Column:
    filled = F.floor(F.lit(width) * pct / 100.0).cast("int")
    return F.concat(
        F.lit("["),
        F.repeat(F.lit("█"), filled),
        F.repeat(F.lit("░"), F.lit(width) - filled),
        F.lit("] "),
        one_decimal(pct),
        F.lit("%"),
    )


def page_durations(ledger: DataFrame, book, page: str, ts: str, *, width: int = CHUNK) -> DataFrame:
    """Seconds since the book's previous page, as ``seconds``; null on its first page."""
    stamped = ledger.withColumn("_micros", micros(ts))
    out = previous_page(stamped, book, page, {"_before": "_micros"}, width=width)
    return out.withColumn("seconds", (F.col("_micros") - F.col("_before")) / 1_000_000.0).drop(
        "_before"
    )


def progress_summary(
    ledger: DataFrame, book, page: str, ts: str, failed: str, total: Column, *, start: int = 1, width: int = CHUNK
) -> DataFrame:
    """Progress of every book. Time spent on a failed page is dropped, not passed on."""
    timed = page_durations(ledger, book, page, ts, width=width)
    out = timed.groupBy(*keys_of(book)).agg(
        F.max(page).alias("current_page"),
        total.cast("bigint").alias("total_pages"),
        ((F.max("_micros") - F.min("_micros")) / 1_000_000.0).alias("elapsed_seconds"),
        F.avg(F.when(~F.col(failed), F.col("seconds"))).alias("average_page_time"),
        F.count_if(F.col(failed)).alias("failed_pages_count"),
    )
    current, goal, average = F.col("current_page"), F.col("total_pages"), F.col("average_page_time")
    return out.withColumns({
        "progress_percentage": percentage(current, goal, start),
        "remaining_seconds": remaining_seconds(average, current, goal),
        "pages_per_minute": pages_per_minute(average),
    })


def progress_display(summary: DataFrame, width: int = 50, *, verbose: bool = False) -> DataFrame:
    """Bar and text line of a progress summary.

    The verbose text also has the mean per page, the pages per minute and the failed pages, each only
    where there is one.
    """
    pct = F.col("progress_percentage")
    left = F.coalesce(format_duration(F.col("remaining_seconds")), F.lit("Calculating..."))
    head = F.concat(
        F.lit("Progress: "), F.col("current_page"), F.lit("/"), F.col("total_pages"),
        F.lit(" pages ("), one_decimal(pct), F.lit("%)"),
    )
    lines = [
        head,
        F.concat(F.lit("Elapsed: "), format_duration(F.col("elapsed_seconds"))),
        F.concat(F.lit("Remaining: "), left),
    ]
    if verbose:
        mean = F.round(F.col("average_page_time"), 2).cast("decimal(38,2)").cast("string")
        lines += [
            F.concat(F.lit("Avg time per page: "), mean, F.lit("s")),
            F.concat(F.lit("Pages per minute: "), one_decimal(F.col("pages_per_minute"))),
            F.when(F.col("failed_pages_count") > 0, F.concat(F.lit("Failed pages: "), F.col("failed_pages_count"))),
        ]
    return summary.withColumns({"bar": progress_bar(pct, width), "display": F.concat_ws("\n", *lines)})


def stage_report(metrics: DataFrame, stages: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Count, sum, average, minimum and maximum per stage; no rows without data.

    ``stages`` maps a stage name to its column. All stages are aggregated in one
    pass and turned into rows afterwards.
    """
    by = by or []
    aggregates = []
    for name, column in stages.items():
        c = F.col(column)
        aggregates += [
            F.sum(c).alias(f"{name}_sum"),
            F.avg(c).alias(f"{name}_avg"),
            F.min(c).alias(f"{name}_min"),
            F.max(c).alias(f"{name}_max"),
        ]
    wide = metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *aggregates).filter("_n > 0")
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("stage"),
            F.col("_n").alias("samples"),
            F.col(f"{name}_sum").alias("total"),
            F.col(f"{name}_avg").alias("average"),
            F.col(f"{name}_min").alias("minimum"),
            F.col(f"{name}_max").alias("maximum"),
        )
        for name in stages
    ])
    return wide.select(*by, F.inline(rows))


def severity_counts(df: DataFrame, severity: Column, by: list[str] | None = None) -> DataFrame:
    """Totals by severity, computed from the issues themselves."""
    by = by or []
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(severity == s).alias(f"{s}_severity") for s in ("high", "medium", "low")],
    )
