"""Filters and projections over pages, blocks and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .assemble import strip
from .grid import sized

# Names of the layout levels, default region line pitch, luma weights.
BLOCK_LEVELS = {2: "block", 3: "paragraph", 4: "line", 5: "word"}
DEFAULT_LINE_BOX = {"left": 0, "pitch": 30, "width": 800, "height": 30}
LUMA_WEIGHTS = {"r": 0.299, "g": 0.587, "b": 0.114}


def min_confidence(df: DataFrame, confidence: str, at_least: float = 0.0) -> DataFrame:
    return df.filter(F.col(confidence) >= at_least)


def drop_blank_text(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, strip(F.col(text))).filter(F.col(text) != "")


def scaled_confidence(raw: Column) -> Column:
    """Percent to share; negative sentinels become 0."""
    return F.greatest(raw / 100.0, F.lit(0.0))


def block_type(level: Column) -> Column:
    kind = F.lit("text")
    for number, label in BLOCK_LEVELS.items():
        kind = F.when(level == number, F.lit(label)).otherwise(kind)
    return kind


def bbox(left, top, width, height, confidence) -> Column:
    return F.struct(
        left.cast("int").alias("left"),
        top.cast("int").alias("top"),
        width.cast("int").alias("width"),
        height.cast("int").alias("height"),
        confidence.cast("double").alias("confidence"),
    )


def bbox_from_polygon(vertices: Column) -> Column:
    """Bounding box of ``array<struct<x,y>>``; fewer than four vertices give zeros."""
    zero = F.lit(0)
    none = bbox(zero, zero, zero, zero, F.lit(0.0))

    def box(points):
        xs = F.transform(points, lambda p: p["x"])
        ys = F.transform(points, lambda p: p["y"])
        corner = F.struct(
            F.array_min(xs).alias("l"), F.array_min(ys).alias("t"), F.array_max(xs).alias("r"), F.array_max(ys).alias("b")
        )
        full = let(corner, lambda c: bbox(c["l"], c["t"], c["r"] - c["l"], c["b"] - c["t"], F.lit(0.95)))
        return F.when(F.size(points) >= 4, full).otherwise(none)

    return F.coalesce(let(vertices, box), none)


def bbox_from_corners(corners: Column, index: Column, confidence: Column) -> Column:
    """``[x1, y1, x2, y2]`` to a box; without corners a default line box by index."""
    d = DEFAULT_LINE_BOX
    whole = [F.get(corners, F.lit(i)).cast("int") for i in range(4)]
    boxed = bbox(
        F.get(corners, F.lit(0)),
        F.get(corners, F.lit(1)),
        (F.get(corners, F.lit(2)) - F.get(corners, F.lit(0))),
        (F.get(corners, F.lit(3)) - F.get(corners, F.lit(1))),
        confidence,
    )
    present = F.lit(True)
    for c in whole:
        present = present & c.isNotNull()
    return F.when(present, boxed).otherwise(
        bbox(F.lit(d["left"]), index * d["pitch"], F.lit(d["width"]), F.lit(d["height"]), confidence)
    )


def region_or_null(left, top, width, height) -> Column:
    """A region struct only when all four numbers are there."""
    parts = {"left": left, "top": top, "width": width, "height": height}
    present = F.lit(True)
    for c in parts.values():
        present = present & c.isNotNull()
    return F.when(present, F.struct(*[c.cast("int").alias(k) for k, c in parts.items()]))


def page_range(df: DataFrame, page: str, start: int, end: int | None = None) -> DataFrame:
    """Inclusive page range, starting at 1 at the earliest; reaches the scan as a filter."""
    kept = df.filter(F.col(page) >= max(start, 1))
    return kept if end is None else kept.filter(F.col(page) <= end)


def page_placeholder(page: Column) -> Column:
    return F.concat(F.lit("\n[Page "), page.cast("string"), F.lit(" - No text detected]\n\n"))


def text_or_placeholder(success: Column, text: Column, page: Column) -> Column:
    usable = F.coalesce(success & (strip(text) != ""), F.lit(False))
    return F.when(usable, text).otherwise(page_placeholder(page))


def eligible_for_resume(df: DataFrame) -> DataFrame:
    return df.filter((F.col("status") == "in_progress") & (F.col("current_page") < F.col("total_pages")))


def project_known_fields(df: DataFrame, updates: dict[str, Column], stamp: str = "last_update"):
    """Apply the updates whose names the table has; ignore the others; stamp the row."""
    known = {k: v for k, v in updates.items() if k in df.columns and k != stamp}
    return df.withColumns({**known, stamp: F.current_timestamp()})


def low_confidence(confidence: Column, threshold: float = 0.5) -> Column:
    return confidence < threshold


def checkpoint_rows(df: DataFrame, page: str, interval: int = 10) -> DataFrame:
    return df.filter(F.col(page) % interval == 0)


def luma(r: Column, g: Column, b: Column) -> Column:
    w = LUMA_WEIGHTS
    return r * w["r"] + g * w["g"] + b * w["b"]


def max_size_guard(grid: DataFrame, max_width: int = 3000, max_height: int = 3000) -> DataFrame:
    """Every cell with ``within_limit``: whether its whole grid is no larger than the limit."""
    return sized(grid).withColumn("within_limit", (F.col("h") <= max_height) & (F.col("w") <= max_width))
