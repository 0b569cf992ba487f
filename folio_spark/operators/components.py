"""Connected regions of grid cells, and what is built on them: trimming, edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .grid import CELL, binarize, join_per_grid, morphology, sized, thin_edges

SPAN = 256

# Fixed values of margin trimming.
TRIM_MARGIN, TRIM_SLACK, TRIM_KERNEL, TRIM_PAD, TRIM_FULL = 240, 50, (10, 10), 10, 0.95


def block_labels(cells: DataFrame, span: int = SPAN) -> DataFrame:
    """Add ``block``, the row and column of the cell's square block, and ``id``, the number of the first cell
    of its region within that block.

    A block is at most ``span`` x ``span`` cells, so a task holds little on grids of any size.
    """
    blocks = cells.withColumns({
        "_by": F.floor(F.col("y") / span).cast("int"), "_bx": F.floor(F.col("x") / span).cast("int"),
        "id": F.col("y").cast("bigint") * F.col("w") + F.col("x"),
    })

    def least_neighbours(y: np.ndarray, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The least number of each cell's region (eight neighbours), for the cells of one block."""
        y, x = y.astype("i8") - y.min(), x.astype("i8") - x.min()
        at = np.full((y.max() + 2, x.max() + 3), -1, "i8")
        places = np.unique(y * (x.max() + 1) + x, return_inverse=True)[1]
        at[y, x + 1] = places
        own, met = [], []
        for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
            other = at[y + dy, x + 1 + dx]
            own.append(places[other >= 0])
            met.append(other[other >= 0])
        a, b = np.concatenate(own), np.concatenate(met)
        label = np.arange(places.max() + 1)
        while True:
            # Roots are hooked to lesser roots beside them, then every place points to its root.
            one, two = label[a], label[b]
            low, high = np.minimum(one, two), np.maximum(one, two)
            apart = low < high
            if not apart.any():
                break
            np.minimum.at(label, high[apart], low[apart])
            while (label[label] != label).any():
                label = label[label]
        least = np.full(len(label), np.iinfo("i8").max)
        np.minimum.at(least, label[places], number)
        return least[label[places]]

    # Both are part of the function sent to the tasks, which need no library but numpy for it.
    def label(block: pa.Table) -> pa.Table:
        least = least_neighbours(np.array(block["y"]), np.array(block["x"]), np.array(block["id"]))
        return block.set_column(block.schema.get_field_index("id"), "id", pa.array(least, pa.int64()))

    found = blocks.groupBy("gid", "_by", "_bx").applyInArrow(label, blocks.schema)
    return found.withColumn("block", F.struct("_by", "_bx")).drop("_by", "_bx")


def border_links(labelled: DataFrame, span: int = SPAN) -> DataFrame:
    """Pairs of regions of two blocks that touch (eight neighbours), both ways.

    Cells along the borders of blocks send their region to the cells behind the border; a cell that
    receives one links the two. Nothing is paired beyond touching regions.
    """
    reach = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in reach])
    beside = ((F.col("y") + 1) % span < 2) | ((F.col("x") + 1) % span < 2)
    sent = labelled.where(beside).select("gid", "y", "x", "id", "block", F.explode(offsets).alias("o"))
    sent = sent.select(
        "gid", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "id", "block",
        ((F.col("o.dy") == 0) & (F.col("o.dx") == 0)).alias("own"),
    )
    home = (F.floor(F.col("y") / span) == F.col("block._by")) & (F.floor(F.col("x") / span) == F.col("block._bx"))
    met = sent.where(F.col("own") | ~home).groupBy("gid", "y", "x").agg(
        F.max(F.when(F.col("own"), F.col("id"))).alias("a"),
        F.collect_set(F.when(~F.col("own"), F.col("id"))).alias("_others"),
    )
    pairs = met.filter(F.col("a").isNotNull()).select("gid", "a", F.explode("_others").alias("b")).distinct()
    return pairs.unionByName(pairs.select("gid", F.col("b").alias("a"), F.col("a").alias("b")))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest reachable node id per node: ``(gid, id, label)``.

    Labels are hooked to the grandparents of neighbours and shortened by jumping,
    so the number of rounds grows with the logarithm of the size. Every round is
    checkpointed; only a count of changed labels reaches the driver.
    """
    links = settled(links)
    labels = nodes.select("gid", "id", F.col("id").alias("f"))
    while True:
        parents = labels.select("gid", F.col("id").alias("f"), F.col("f").alias("g"))
        grand = labels.join(parents, ["gid", "f"]).select("gid", "id", "f", "g")
        nearest = (
            links.join(grand.select("gid", F.col("id").alias("b"), "g"), ["gid", "b"])
            .groupBy("gid", F.col("a").alias("id"))
            .agg(F.min("g").alias("m"))
        )
        near = grand.join(nearest, ["gid", "id"], "left")
        offers = near.select(
            "gid",
            F.inline(F.array(
                F.struct(F.col("id"), F.least("f", "g", "m").alias("offer"), F.col("f").alias("old")),
                F.struct(F.col("f").alias("id"), F.least("g", "m").alias("offer"), F.lit(None).cast("bigint").alias("old")),
            )),
        )
        new = offers.groupBy("gid", "id").agg(F.min("offer").alias("f"), F.max("old").alias("old"))
        new = settled(new)
        changed = new.filter(F.col("f") != F.col("old")).limit(1).count()
        labels = new.select("gid", "id", "f")
        if not changed:
            return labels.select("gid", "id", F.col("f").alias("label"))


def regions(cells: DataFrame, *, span: int = SPAN) -> DataFrame:
    """Add ``label``, the connected region of each cell (eight neighbours): the number of its first cell.

    Regions are found block by block; only those that touch across the borders of blocks go through
    the rounds of ``components``. Cells without a grid or a place have no region.
    """
    placed = cells.where("gid IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL AND w IS NOT NULL")
    found = settled(block_labels(placed, span))
    links = settled(border_links(found, span))
    if links.isEmpty():
        return found.drop("block").withColumnRenamed("id", "label")
    joined = components(links.select("gid", F.col("a").alias("id")).distinct(), links)
    named = found.drop("block").join(joined.hint("merge"), ["gid", "id"], "left")
    return named.withColumn("label", F.coalesce("label", "id")).drop("id")


def bounding_boxes(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("area"),
        F.min("y").alias("top"), F.max("y").alias("bottom"),
        F.min("x").alias("left"), F.max("x").alias("right"),
    )


def content_boxes(grid: DataFrame, *, threshold: float, kernel: tuple[int, int] | None, largest: bool) -> DataFrame:
    """Box of the bright content per grid: its largest region, or all of it."""
    mask = binarize(grid, "simple", threshold)
    if kernel:
        mask = morphology(morphology(mask, "close", kernel), "open", kernel)
    bright = mask.filter("v > 0")
    if not largest:
        return bounding_boxes(bright, ["gid", "h", "w"])
    boxes = bounding_boxes(regions(bright), ["gid", "h", "w", "label"])
    chosen = F.max_by(F.struct("area", "top", "bottom", "left", "right"), F.struct("area", -F.col("label")))
    return boxes.groupBy("gid", "h", "w").agg(chosen.alias("b")).select("gid", "h", "w", "b.*")


def trim_margins(
    grid: DataFrame,
    *,
    margin_threshold: float = TRIM_MARGIN,
    kernel: tuple[int, int] | None = TRIM_KERNEL,
    pad: int = TRIM_PAD,
    largest: bool = True,
) -> DataFrame:
    """Cut every grid to its bright content plus padding and move the origin.

    Grids without content, or whose box keeps more than 95 % of both sides, stay
    as they are.
    """
    grid = sized(grid)
    boxes = content_boxes(grid, threshold=margin_threshold - TRIM_SLACK, kernel=kernel, largest=largest)
    edge = lambda c, limit: F.least(F.col(c) + 1 + pad, F.col(limit))
    boxes = boxes.select(
        "gid", "h", "w",
        F.greatest(F.col("top") - pad, F.lit(0)).alias("_top"), edge("bottom", "h").alias("_bottom"),
        F.greatest(F.col("left") - pad, F.lit(0)).alias("_left"), edge("right", "w").alias("_right"),
    )
    full = ((F.col("_right") - F.col("_left")) > F.col("w") * TRIM_FULL) & (
        (F.col("_bottom") - F.col("_top")) > F.col("h") * TRIM_FULL
    )
    boxes = boxes.filter(~full).drop("h", "w")
    joined = join_per_grid(grid, boxes, "left")
    kept = joined.filter(
        F.col("_top").isNull()
        | (F.col("y") >= F.col("_top")) & (F.col("y") < F.col("_bottom"))
        & (F.col("x") >= F.col("_left")) & (F.col("x") < F.col("_right"))
    )
    moved: dict[str, Column] = {
        "h": F.coalesce(F.col("_bottom") - F.col("_top"), F.col("h")),
        "w": F.coalesce(F.col("_right") - F.col("_left"), F.col("w")),
        "y": F.col("y") - F.coalesce("_top", F.lit(0)),
        "x": F.col("x") - F.coalesce("_left", F.lit(0)),
    }
    return kept.select("gid", *[c.cast("int").alias(n) for n, c in moved.items()], "v")


def edges(grid: DataFrame, low: float = 50, high: float = 150) -> DataFrame:
    """Edge cells: ridges connected to at least one strong cell."""
    labelled = regions(thin_edges(grid, low, high))
    anchored = labelled.filter("strong").select("gid", "label").distinct()
    return join_per_grid(labelled, anchored, "left_semi", keys=("gid", "label")).select(*CELL)
