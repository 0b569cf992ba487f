"""Neighbourhood analytics on grid tables ``(gid, y, x, v)``: many dense 2-D arrays.

Three building blocks carry most operators:

* ``stencil`` sends every cell to the cells whose window it lies in and reduces
  there. The shuffle key is the single cell, so neither a huge grid nor a hot
  ``gid`` ends up in one task, and sums, minima and maxima combine map-side.
* ``along_axis`` does the same for one axis; a separable window costs 2k sends
  per cell instead of k*k;
* ``over_windows`` packs cells into small tiles with their surroundings, for
  reductions that cannot be combined on the way.

Offsets and weights are literals of fixed size inside the plan, not joined tables.
Cells outside the grid exist only virtually: border rules say at which outside
coordinates a cell also appears. Grids carry their size in ``h`` and ``w``; ``sized``
adds it once. Values are doubles; ``u8=True`` rounds half-to-even and clips to 0-255.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from .skew import join_by_chunk, salted_join

CELL = ["gid", "h", "w", "y", "x"]
REFLECT, REPLICATE, NEUTRAL = "reflect", "replicate", "neutral"

# Smoothing weights used for these widths when no sigma is given,
# sharpening kernels, and the coefficients of cubic interpolation when rotating.
SMALL_GAUSSIANS = {
    1: [1.0],
    3: [0.25, 0.5, 0.25],
    5: [0.0625, 0.25, 0.375, 0.25, 0.0625],
    7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125],
}
SHARPEN_CROSS = [[0, -1, 0], [-1, 5, -1], [0, -1, 0]]
SHARPEN_STRONG = [[-1, -1, -1], [-1, 9, -1], [-1, -1, -1]]
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
CUBIC = -0.75


BLOCK = 64


def block_of() -> dict[str, Column]:
    """Square blocks of cells: the pieces a large grid is joined by."""
    return {
        "_by": F.floor(F.col("y") / BLOCK).cast("int"),
        "_bx": F.floor(F.col("x") / BLOCK).cast("int"),
    }


def join_per_grid(grid: DataFrame, per_grid: DataFrame, how: str = "inner", keys: Sequence[str] = ("gid",)):
    """Join a table with one row per grid (or ``keys``) to the cells, block by block.

    Steps multiply cells, which the plan's size guess leaves out, so its size check would broadcast
    whole grids. The hint on the cells holds for both joins that they go into: these are merged.
    """
    return join_by_chunk(grid.hint("merge"), per_grid, list(keys), block_of(), how)


def sized(grid: DataFrame) -> DataFrame:
    """Add height and width unless present.

    Extents are reduced to one row per block of cells; only those rows are looked
    at grid by grid.
    """
    if "h" in grid.columns and "w" in grid.columns:
        return grid
    cells = grid.withColumns(block_of())
    blocks = cells.groupBy("gid", "_by", "_bx").agg(F.max("y").alias("_y"), F.max("x").alias("_x"))
    whole = Window.partitionBy("gid")
    sizes = blocks.select(
        "gid", "_by", "_bx",
        (F.max("_y").over(whole) + 1).cast("int").alias("h"),
        (F.max("_x").over(whole) + 1).cast("int").alias("w"),
    )
    return cells.join(sizes.hint("merge"), ["gid", "_by", "_bx"]).drop("_by", "_bx")


def as_u8(value: Column, u8: bool = True) -> Column:
    return F.least(F.greatest(F.rint(value), F.lit(0.0)), F.lit(255.0)) if u8 else value


def appearances(i: Column, n: Column, reach: int, border: str) -> Column:
    """Coordinates in ``[-reach, n - 1 + reach]`` at which cell ``i`` of ``n`` shows up.

    An array, possibly with nulls to be dropped after exploding. It is built without
    higher-order functions, so the explode stays inside generated code.
    """
    alone = F.array(i)
    if border == NEUTRAL or reach == 0:
        return alone
    last = n - 1
    everywhere = F.sequence(F.lit(-reach), F.lit(reach))
    if border == REPLICATE:
        return (
            F.when((i > 0) & (i < last), alone)
            .when(n == 1, everywhere)
            .when(i == 0, F.sequence(F.lit(-reach), F.lit(0)))
            .otherwise(F.sequence(last, last + reach))
        )
    # Mirrored without repeating the edge: once when the grid is wider than the
    # reach, else with period 2(n-1) in both directions.
    inner = (i > 0) & (i < last)
    low = F.when((i > 0) & (i <= reach), -i)
    high = F.when((i < last) & (i >= last - reach), last * 2 - i)
    places = []
    for turn in range(-reach, reach + 1):
        shifted, flipped = i + last * (2 * turn), last * (2 * turn) - i
        places.append(F.when(shifted.between(-reach, last + reach), shifted))
        places.append(F.when(inner & flipped.between(-reach, last + reach), flipped))
    return (
        F.when((i > reach) & (i < last - reach), alone)
        .when(last >= reach, F.array(i, low, high))
        .when(n == 1, everywhere)
        .otherwise(F.array(*places))
    )


def extended(grid: DataFrame, reach_y: int, reach_x: int, border: str) -> DataFrame:
    """Every cell at all coordinates where the border rule shows it."""
    out = grid
    for axis, size, reach in (("y", "h", reach_y), ("x", "w", reach_x)):
        if border != NEUTRAL and reach:
            places = appearances(F.col(axis).cast("int"), F.col(size).cast("int"), reach, border)
            out = out.withColumn(axis, F.explode(places)).filter(F.col(axis).isNotNull())
    return out


def _literal(rows: Sequence[Sequence], names: Sequence[str]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def spread(
    grid: DataFrame, offsets: Sequence[tuple], names: Sequence[str], border: str, keep: Sequence[str] = ("v",)
) -> DataFrame:
    """Send every cell to all targets that see it; ``offsets`` rows start with (dy, dx)."""
    ry, rx = max(abs(o[0]) for o in offsets), max(abs(o[1]) for o in offsets)
    fields = ["_dy", "_dx", *names]
    out = extended(sized(grid), ry, rx, border)
    out = out.select("gid", "h", "w", "y", "x", *keep, F.explode(_literal(offsets, fields)).alias("_o"))
    y, x = F.col("y") - F.col("_o._dy"), F.col("x") - F.col("_o._dx")
    placed = out.select(
        "gid", "h", "w", y.cast("int").alias("y"), x.cast("int").alias("x"), *keep,
        *[F.col(f"_o.{n}").alias(n) for n in names],
        *[F.col(f"_o.{n}").alias(n) for n in ("_dy", "_dx")],
    )
    return placed.filter((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") < F.col("w")))


def weighted(kernel: Sequence[Sequence[float]]) -> list[tuple]:
    """Non-zero offsets of a kernel centred on its middle cell (correlation, not flipped)."""
    cy, cx = len(kernel) // 2, len(kernel[0]) // 2
    return [
        (j - cy, i - cx, float(wt))
        for j, row in enumerate(kernel)
        for i, wt in enumerate(row)
        if wt != 0
    ]


def stencil(grid: DataFrame, kernel, *, border: str = REFLECT, u8: bool = False) -> DataFrame:
    """Weighted window sum for any kernel."""
    offsets = weighted(kernel)
    if not offsets:
        return sized(grid).withColumn("v", F.lit(0.0))
    sent = spread(grid, offsets, ["_wt"], border)
    return sent.groupBy(*CELL).agg(as_u8(F.sum(F.col("v") * F.col("_wt")), u8).alias("v"))


def along_axis(
    grid: DataFrame, axis: str, weights: Sequence[float], *, border: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Weighted window sum along one axis; ``keep`` columns stay with their cell."""
    reach = len(weights) // 2
    rows = [
        ((k - reach, 0, float(wt)) if axis == "y" else (0, k - reach, float(wt)))
        for k, wt in enumerate(weights)
    ]
    sent = spread(grid, rows, ["_wt"], border, keep=("v", *keep))
    home = F.col(f"_d{axis}") == 0
    return sent.groupBy(*CELL).agg(
        F.sum(F.col("v") * F.col("_wt")).alias("v"), *[F.max(F.when(home, F.col(k))).alias(k) for k in keep]
    )


def gaussian_weights(size: int, sigma: float = 0.0) -> list[float]:
    if sigma <= 0 and size in SMALL_GAUSSIANS:
        return SMALL_GAUSSIANS[size]
    if sigma <= 0:
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [r / sum(raw) for r in raw]


def gaussian(
    grid: DataFrame, size: tuple[int, int] = (5, 5), sigma: float = 0.0, *, border: str = REFLECT,
    u8: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """Smooth with ``size`` = (width, height)."""
    rows = along_axis(sized(grid), "y", gaussian_weights(size[1], sigma), border=border, keep=keep)
    out = along_axis(rows, "x", gaussian_weights(size[0], sigma), border=border, keep=keep)
    return out.withColumn("v", as_u8(F.col("v"), u8))


def beside_smooth(grid: DataFrame, size, sigma: float = 0.0, **options) -> DataFrame:
    """Own value ``v`` and smoothed value ``_smooth``: both travel together, no join."""
    both = gaussian(sized(grid).withColumn("_own", F.col("v")), size, sigma, keep=("_own",), **options)
    return both.select(*CELL, F.col("_own").alias("v"), F.col("v").alias("_smooth"))


def square(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


TILE = 32


def tiles(grid: DataFrame, reach: int, border: str, span: int = TILE) -> DataFrame:
    """One row per ``span`` x ``span`` tile with the values of its cells and their surroundings.

    ``_vals`` holds the tile row by row with ``reach`` cells around it. For windows
    that cannot be combined on the way (medians, likeness weights) this ships a
    cell about ``(1 + 2 reach / span)**2`` times instead of once per window place.
    """
    out = extended(sized(grid), reach, reach, border)
    for axis, size in (("y", "h"), ("x", "w")):
        u = F.col(axis)
        first = F.greatest(F.floor((u - reach) / span), F.lit(0)).cast("int")
        last = F.floor(F.least(u + reach, F.col(size) - 1) / span).cast("int")
        out = out.withColumn(f"_t{axis}", F.explode(F.sequence(first, last)))
    cells = F.sort_array(F.collect_list(F.struct("y", "x", "v")))
    packed = out.groupBy("gid", "h", "w", "_ty", "_tx").agg(
        F.transform(cells, lambda c: c["v"]).alias("_vals")
    )
    side = lambda t, n: F.least((F.col(t) + 1) * span, F.col(n)) - F.col(t) * span
    packed = packed.withColumns({"_rows": side("_ty", "h"), "_cols": side("_tx", "w")})
    full = (F.col("_rows") + 2 * reach) * (F.col("_cols") + 2 * reach)
    dense = F.when(F.size("_vals") == full, F.col("_vals")).otherwise(
        F.raise_error(F.lit("grid has missing or repeated cells")).cast("array<double>")
    )
    return packed.withColumn("_vals", dense)


def over_windows(grid: DataFrame, offsets: Sequence[tuple], names: Sequence[str], border: str, value, span=TILE):
    """``value(places, at, centre)`` for every cell.

    ``places`` is the literal array of offsets, ``at(place)`` the value there and
    ``centre`` the cell's own value.
    """
    reach = max(max(abs(o[0]), abs(o[1])) for o in offsets)
    places = _literal(offsets, ["dy", "dx", *names])
    width = F.col("_cols") + 2 * reach

    def of_cell(p):
        home = (F.floor(p / F.col("_cols")).cast("int") + reach) * width + p % F.col("_cols") + reach
        return let(
            home,
            lambda b: let(
                F.get("_vals", b),
                lambda c: value(places, lambda o: F.get("_vals", b + o["dy"] * width + o["dx"]), c),
            ),
        )

    cells = F.sequence(F.lit(0), F.col("_rows") * F.col("_cols") - 1)
    done = tiles(grid, reach, border, span).select(
        "gid", "h", "w", "_ty", "_tx", "_cols", F.posexplode(F.transform(cells, of_cell)).alias("_p", "v")
    )
    return done.select(
        "gid", "h", "w",
        (F.col("_ty") * span + F.floor(F.col("_p") / F.col("_cols"))).cast("int").alias("y"),
        (F.col("_tx") * span + F.col("_p") % F.col("_cols")).cast("int").alias("x"),
        "v",
    )


def median(grid: DataFrame, size: int = 3) -> DataFrame:
    """Median of the window, edges repeated."""
    middle = F.lit(size * size // 2)
    return over_windows(
        grid, square(size), [], REPLICATE,
        lambda places, at, c: F.get(F.sort_array(F.transform(places, at)), middle),
    )


def bilateral(
    grid: DataFrame, diameter: int = 9, sigma_color: float = 75.0, sigma_space: float = 75.0, *, u8: bool = False
) -> DataFrame:
    """Smooth by distance and likeness over a round window."""
    r = diameter // 2
    near = [
        (dy, dx, math.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2)))
        for dy, dx in square(diameter)
        if dy * dy + dx * dx <= r * r
    ]
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))

    def smooth(places, at, c):
        def term(o):
            return let(at(o), lambda v: F.struct(
                v.alias("v"), (o["wt"] * F.exp((v - c) * (c - v) / (2 * sigma_color**2))).alias("t")
            ))

        return F.aggregate(
            F.transform(places, term),
            zero,
            lambda a, n: F.struct((a["s"] + n["v"] * n["t"]).alias("s"), (a["t"] + n["t"]).alias("t")),
            lambda a: a["s"] / a["t"],
        )

    out = over_windows(grid, near, ["wt"], REFLECT, smooth)
    return out.withColumn("v", as_u8(F.col("v"), u8))


def sharpen_kernel(kind: str = "default", strength: float = 1.0) -> list[list[float]]:
    base = SHARPEN_STRONG if kind == "strong" else SHARPEN_CROSS
    unit = [[float(j == 1 and i == 1) for i in range(3)] for j in range(3)]
    return [[unit[j][i] + strength * (base[j][i] - unit[j][i]) for i in range(3)] for j in range(3)]


def sharpen(grid: DataFrame, kind: str = "default", strength: float = 1.0, *, u8: bool = True) -> DataFrame:
    return stencil(grid, sharpen_kernel(kind, strength), u8=u8)


def extreme(grid: DataFrame, size: tuple[int, int], iterations: int, largest: bool) -> DataFrame:
    """Windowed minimum or maximum of a (width, height) rectangle, one axis after the other.

    Several iterations of a rectangle equal one larger rectangle. Cells outside
    the grid take no part.
    """
    reduce = F.max if largest else F.min
    out = sized(grid)
    for axis, length in (("y", size[1]), ("x", size[0])):
        low = -(length // 2) * iterations
        high = (length - 1 - length // 2) * iterations
        rows = [((d, 0) if axis == "y" else (0, d)) for d in range(low, high + 1)]
        out = spread(out, rows, [], NEUTRAL).groupBy(*CELL).agg(reduce("v").alias("v"))
    return out


def morphology(grid: DataFrame, operation: str = "close", size: tuple[int, int] = (5, 5), iterations: int = 1):
    """Erode, dilate, open or close; an unknown operation leaves the grid as it is."""
    steps = {
        "erode": [False], "dilate": [True], "open": [False, True], "close": [True, False],
    }.get(operation, [])
    out = sized(grid)
    for largest in steps:
        out = extreme(out, size, iterations, largest)
    return out


def unsharp_mask(
    grid: DataFrame, size: tuple[int, int] = (5, 5), sigma: float = 1.0, amount: float = 1.5,
    threshold: float = 0.0, *, u8: bool = False,
) -> DataFrame:
    """Add ``amount`` of the difference to the smoothed grid where it exceeds the threshold."""
    both = beside_smooth(grid, size, sigma, u8=u8)
    v, blur = F.col("v"), F.col("_smooth")
    sharp = as_u8(v * (1.0 + amount) - blur * amount, u8)
    if threshold > 0:
        sharp = F.when(F.abs(v - blur) > threshold, sharp).otherwise(v)
    return both.select(*CELL, sharp.alias("v"))


def unsharp_radius(grid: DataFrame, radius: float = 2.0, percent: float = 150, threshold: float = 3, *, u8=False):
    """Unsharp mask by blur radius and percentage (a Gaussian of that deviation)."""
    size = 2 * math.ceil(3 * radius) + 1
    return unsharp_mask(grid, (size, size), radius, percent / 100.0, threshold, u8=u8)


def histogram(grid: DataFrame) -> DataFrame:
    """Cells per rounded value: at most 256 rows per grid."""
    level = as_u8(F.col("v")).cast("int").alias("level")
    return grid.groupBy("gid", level).agg(F.count(F.lit(1)).alias("n"))


def otsu_threshold(grid: DataFrame) -> DataFrame:
    """The level with the greatest between-class variance, lowest first.

    Windows run over histogram rows only.
    """
    along = Window.partitionBy("gid").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("gid")
    weight = F.col("n") * F.col("level")
    stats = histogram(grid).select(
        "gid", "level",
        F.sum("n").over(along).alias("n1"), F.sum(weight).over(along).alias("s1"),
        F.sum("n").over(whole).alias("n"), F.sum(weight).over(whole).alias("s"),
    )
    n1, n2 = F.col("n1"), F.col("n") - F.col("n1")
    gap = F.col("s1") / n1 - (F.col("s") - F.col("s1")) / n2
    spread_ = F.when(n2 > 0, F.round(n1 / F.col("n") * (n2 / F.col("n")) * gap * gap, 9)).otherwise(F.lit(0.0))
    best = stats.withColumn("_b", spread_)
    return best.groupBy("gid").agg(F.max_by("level", F.struct("_b", -F.col("level"))).alias("threshold"))


def cut(value: Column, above: Column) -> Column:
    return F.when(value > above, F.lit(255.0)).otherwise(F.lit(0.0))


def binarize(grid: DataFrame, method: str = "otsu", threshold: float = 127, block: int = 11, c: float = 2):
    """0/255 by Otsu's level, by a smoothed local mean, or by a fixed level."""
    grid = sized(grid)
    if method == "otsu":
        levels = otsu_threshold(grid)
        return join_per_grid(grid, levels).select(*CELL, cut(F.col("v"), F.col("threshold")).alias("v"))
    if method == "adaptive":
        block += 1 - block % 2
        both = beside_smooth(grid, (block, block), border=REPLICATE, u8=True)
        return both.select(*CELL, cut(F.col("v") - F.col("_smooth"), F.lit(-float(math.ceil(c)))).alias("v"))
    return grid.withColumn("v", cut(F.col("v"), F.lit(float(threshold))))


def equalize(grid: DataFrame) -> DataFrame:
    """Plain histogram equalisation: cumulative share of the cells, stretched to 0-255."""
    along = Window.partitionBy("gid").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("gid")
    levels = histogram(grid).select(
        "gid", "level", F.sum("n").over(along).alias("_cum"), F.sum("n").over(whole).alias("_n")
    ).withColumn("_low", F.min("_cum").over(whole))
    share = (F.col("_cum") - F.col("_low")) / (F.col("_n") - F.col("_low"))
    mapped = F.when(F.col("_n") == F.col("_low"), F.col("level").cast("double")).otherwise(F.rint(share * 255.0))
    table = levels.select("gid", "level", mapped.alias("_v")).groupBy("gid").agg(
        F.map_from_entries(F.collect_list(F.struct("level", "_v"))).alias("_map")
    )
    cells = join_per_grid(sized(grid), table)
    return cells.select(*CELL, F.element_at("_map", as_u8(F.col("v")).cast("int")).alias("v"))


def clahe(grid: DataFrame, clip: float = 2.0, tiles: tuple[int, int] = (8, 8)) -> DataFrame:
    """Contrast-limited equalisation per tile, blended between the four nearest tiles.

    A tile is reduced to one row holding its 256-entry level map before cells
    are joined to it. Sizes that do not divide by the tile count are extended by
    mirrored cells for the histograms.
    """
    nx, ny = tiles
    grid = sized(grid)
    odd = (F.col("h") % ny != 0) | (F.col("w") % nx != 0)
    full = lambda n, parts: F.when(odd, n + parts - n % parts).otherwise(n)
    cells = grid.select(
        *CELL, as_u8(F.col("v")).cast("int").alias("level"),
        full(F.col("h"), ny).alias("_fh"), full(F.col("w"), nx).alias("_fw"),
    ).withColumns({"_th": (F.col("_fh") / ny).cast("int"), "_tw": (F.col("_fw") / nx).cast("int")})

    shown = extended(cells, ny, nx, REFLECT).filter("y >= 0 AND x >= 0 AND y < _fh AND x < _fw")
    tile = [F.floor(F.col("y") / F.col("_th")).cast("int").alias("ty"), F.floor(F.col("x") / F.col("_tw")).cast("int").alias("tx")]
    counts = shown.groupBy("gid", *tile, (F.col("_th") * F.col("_tw")).alias("area"), "level").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_tile = counts.groupBy("gid", "ty", "tx", "area").agg(
        F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("_hist")
    )
    limit = F.greatest(F.floor(F.lit(clip) * F.col("area") / 256), F.lit(1)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    dense = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.element_at("_hist", i), zero))
    per_tile = per_tile.select("gid", "ty", "tx", "area", limit.alias("_limit"), dense.alias("_bins"))
    excess = F.aggregate("_bins", zero, lambda a, n: a + F.greatest(n - F.col("_limit"), zero))
    per_tile = per_tile.withColumn("_excess", excess).withColumns({
        "_share": F.floor(F.col("_excess") / 256), "_rest": F.col("_excess") % 256,
    })
    step = F.greatest(F.floor(F.lit(256) / F.greatest(F.col("_rest"), F.lit(1))), F.lit(1))

    def clipped(n, i):
        extra = (i % step == 0) & (i / step < F.col("_rest"))
        return F.least(n, F.col("_limit")) + F.col("_share") + extra.cast("bigint")

    per_tile = per_tile.withColumn("_bins", F.transform("_bins", clipped))
    running = F.aggregate(
        "_bins",
        F.struct(zero.alias("s"), F.array().cast("array<double>").alias("out")),
        lambda a, n: F.struct(
            (a["s"] + n).alias("s"),
            F.concat(a["out"], F.array(as_u8((a["s"] + n) * (F.lit(255.0) / F.col("area"))))).alias("out"),
        ),
        lambda a: a["out"],
    )
    maps = per_tile.select("gid", "ty", "tx", running.alias("_map"))

    fy, fx = F.col("y") / F.col("_th") - 0.5, F.col("x") / F.col("_tw") - 0.5
    placed = cells.withColumns({"_y1": F.floor(fy), "_x1": F.floor(fx)}).withColumns(
        {"_ya": fy - F.col("_y1"), "_xa": fx - F.col("_x1")}
    )
    corner = lambda c, d, n: F.least(F.greatest(F.col(c) + d, F.lit(0)), F.lit(n - 1)).cast("int")
    corners = F.array(*[
        F.struct(
            corner("_y1", dy, ny).alias("ty"),
            corner("_x1", dx, nx).alias("tx"),
            ((F.col("_ya") if dy else 1 - F.col("_ya")) * (F.col("_xa") if dx else 1 - F.col("_xa"))).alias("wt"),
        )
        for dy in (0, 1) for dx in (0, 1)
    ])
    asked = placed.select(*CELL, "level", F.explode(corners).alias("_c")).select(*CELL, "level", "_c.*")
    mapped = join_per_grid(asked, maps, keys=("gid", "ty", "tx"))
    value = F.sum(F.col("wt") * F.element_at("_map", F.col("level") + 1))
    return mapped.groupBy(*CELL).agg(as_u8(F.round(value, 9)).alias("v"))


def _triangle(t: Column) -> Column:
    return F.greatest(F.lit(1.0) - F.abs(t), F.lit(0.0))


def _cubic(t: Column, a: float = -0.5) -> Column:
    t = F.abs(t)
    inner = ((a + 2) * t - (a + 3)) * t * t + 1
    outer = (((t - 5) * t + 8) * t - 4) * a
    return F.when(t < 1, inner).when(t < 2, outer).otherwise(F.lit(0.0))


def _lanczos(t: Column) -> Column:
    p = t * math.pi
    body = F.sin(p) / p * F.sin(p / 3) / (p / 3)
    return F.when(t == 0, F.lit(1.0)).when(F.abs(t) < 3, body).otherwise(F.lit(0.0))


RESAMPLING = {"bilinear": (1.0, _triangle), "bicubic": (2.0, _cubic), "lanczos": (3.0, _lanczos)}


def resampled(cells: DataFrame, i: str, n: str, m: Column, method: str) -> DataFrame:
    """Send source line ``i`` of ``n`` to the lines ``to`` of ``m`` it counts for, with weight ``wt``."""
    at = F.col(i)
    scale = F.col(n) / m
    if method == "nearest":
        first, last = F.ceil(at / scale - 0.5), F.ceil((at + 1) / scale - 0.5) - 1
        weight = F.lit(1.0)
    else:
        support, shape = RESAMPLING.get(method, RESAMPLING["lanczos"])
        wide = F.greatest(scale, F.lit(1.0))
        first = F.greatest(F.ceil((at + 0.5 - wide * support) / scale - 0.5), F.lit(0))
        last = F.least(F.floor((at + 0.5 + wide * support) / scale - 0.5), (m - 1).cast("bigint"))
        weight = shape((at + 0.5 - (F.col("to") + 0.5) * scale) / wide)
    reached = F.when(first <= last, F.sequence(first, last))
    return cells.withColumn("to", F.explode(reached)).withColumn("wt", weight).filter(F.col("wt") != 0)


def resize_to(grid: DataFrame, height: Column, width: Column, method: str = "lanczos", *, u8: bool = False):
    """Resample both axes; the weights of every target are normalised to 1."""
    out = sized(grid).withColumns({"_nh": height.cast("int"), "_nw": width.cast("int")})
    axes = (("y", "h", "_nh"), ("x", "w", "_nw"))
    if method == "nearest":
        # A target has a single source, so only cells that come several times are combined, before they are sent.
        weight = F.sum(F.lit(1.0))
        out = out.groupBy("gid", "h", "w", "_nh", "_nw", "y", "x").agg((F.sum(F.col("v") * F.lit(1.0)) / weight).alias("v"))
        for axis, size, new in axes:
            out = resampled(out, axis, size, F.col(new), method).withColumn(axis, F.col("to").cast("int")).drop("to", "wt")
        axes = ()
    for axis, size, new in axes:
        other = "x" if axis == "y" else "y"
        sent = resampled(out, axis, size, F.col(new), method)
        out = sent.groupBy("gid", "h", "w", "_nh", "_nw", other, F.col("to").cast("int").alias(axis)).agg(
            (F.sum(F.col("v") * F.col("wt")) / F.sum("wt")).alias("v")
        )
    return out.select(
        "gid", F.col("_nh").alias("h"), F.col("_nw").alias("w"), "y", "x", as_u8(F.col("v"), u8).alias("v")
    )


def resize(grid: DataFrame, factor: float = 2.0, method: str = "lanczos", *, u8: bool = False) -> DataFrame:
    """Scale by a factor, target sizes truncated; an unknown method means Lanczos."""
    side = lambda n: F.greatest(F.floor(F.col(n) * factor), F.lit(1))
    return resize_to(grid, side("h"), side("w"), method.lower(), u8=u8)


def gradients(grid: DataFrame) -> DataFrame:
    """Both Sobel sums and their absolute total ``m``, edges repeated."""
    both = [
        (dy, dx, float(SOBEL_X[dy + 1][dx + 1]), float(SOBEL_Y[dy + 1][dx + 1]))
        for dy, dx in square(3) if (dy, dx) != (0, 0)
    ]
    sent = spread(grid, both, ["_wx", "_wy"], REPLICATE)
    out = sent.groupBy(*CELL).agg(
        F.sum(F.col("v") * F.col("_wx")).alias("gx"), F.sum(F.col("v") * F.col("_wy")).alias("gy")
    )
    return out.withColumn("m", F.abs("gx") + F.abs("gy"))


def thin_edges(grid: DataFrame, low: float = 50, high: float = 150) -> DataFrame:
    """Cells whose gradient is a ridge above ``low``; ``strong`` marks those above ``high``."""
    slopes = gradients(grid)
    sent = spread(slopes, square(3), [], NEUTRAL, keep=("m", "gx", "gy"))
    at = lambda dy, dx: (F.col("_dy") == dy) & (F.col("_dx") == dx)
    around = sent.groupBy(*CELL).agg(
        *[F.coalesce(F.max(F.when(at(dy, dx), F.col("m"))), F.lit(0.0)).alias(f"m{dy + 1}{dx + 1}") for dy, dx in square(3)],
        F.max(F.when(at(0, 0), F.col("gx"))).alias("gx"),
        F.max(F.when(at(0, 0), F.col("gy"))).alias("gy"),
    )
    m, ax, ay = F.col("m11"), F.abs("gx"), F.abs("gy")
    flat = ay < ax * math.tan(math.pi / 8)
    steep = ay > ax * math.tan(3 * math.pi / 8)
    falling = (F.col("gx") * F.col("gy")) < 0
    ridge = (
        F.when(flat, (m > F.col("m10")) & (m >= F.col("m12")))
        .when(steep, (m > F.col("m01")) & (m >= F.col("m21")))
        .when(falling, (m > F.col("m02")) & (m > F.col("m20")))
        .otherwise((m > F.col("m00")) & (m > F.col("m22")))
    )
    return around.filter((m > low) & ridge).select(*CELL, m.alias("m"), (m > high).alias("strong"))


def line_votes(points: DataFrame) -> DataFrame:
    """Votes per (distance, whole-degree angle) of the points in each grid."""
    thrown = points.select("gid", "y", "x", F.explode(F.sequence(F.lit(0), F.lit(179))).alias("theta"))
    angle = F.radians(F.col("theta").cast("double"))
    distance = F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle)
    rho = F.rint(F.round(distance, 9)).cast("int")
    return thrown.groupBy("gid", rho.alias("rho"), "theta").agg(F.count(F.lit(1)).alias("votes"))


def lines(points: DataFrame, votes: int = 200) -> DataFrame:
    """Cells of the vote table above ``votes`` that top their four neighbours.

    Ties go to the smaller distance or angle. Each vote is sent to its
    neighbours and reduced there, as for any other window.
    """
    table = line_votes(points)
    around = [(0, 0, "own"), (-1, 0, "before"), (1, 0, "behind"), (0, -1, "before"), (0, 1, "behind")]
    sent = table.select("gid", "rho", "theta", "votes", F.explode(_literal(around, ["dr", "dt", "side"])).alias("o"))
    sent = sent.select(
        "gid", (F.col("rho") - F.col("o.dr")).alias("rho"), (F.col("theta") - F.col("o.dt")).alias("theta"),
        "votes", "o.side",
    )
    top = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("votes"))), F.lit(0))
    seen = sent.groupBy("gid", "rho", "theta").agg(
        top("own").alias("votes"), top("before").alias("_a"), top("behind").alias("_b")
    )
    return seen.filter((F.col("votes") > votes) & (F.col("votes") > F.col("_a")) & (F.col("votes") >= F.col("_b"))).drop("_a", "_b")


def dominant_angle(points: DataFrame, votes: int = 200, least: float = 0.5) -> DataFrame:
    """Median tilt of the lines within 45 degrees of level; small tilts are left out."""
    tilt = F.col("theta") - 90
    found = lines(points, votes).filter(F.abs(tilt) < 45)
    angles = found.groupBy("gid").agg(F.median(tilt).alias("angle"))
    return angles.filter(F.abs("angle") >= least)


def projection_angle(points: DataFrame, limit: int = 10) -> DataFrame:
    """Angle at which the points crowd into the fewest rows; the flattest such angle on ties.

    The measure is the sum of squared row counts. It orders angles as the variance
    over all rows would, and empty rows need not be listed for it.
    """
    turned = points.select("gid", "y", "x", F.explode(F.sequence(F.lit(-limit), F.lit(limit))).alias("angle"))
    a = F.radians(F.col("angle").cast("double"))
    row = F.rint(F.round(F.col("y") * F.cos(a) - F.col("x") * F.sin(a), 9)).cast("int")
    rows = turned.groupBy("gid", "angle", row.alias("row")).agg(F.count(F.lit(1)).alias("n"))
    crowded = rows.groupBy("gid", "angle").agg(F.sum(F.col("n") * F.col("n")).alias("energy"))
    best = F.max_by(F.struct("angle", "energy"), F.struct("energy", -F.abs("angle"), -F.col("angle")))
    return crowded.groupBy("gid").agg(best.alias("b")).select("gid", "b.*")


def rotate(grid: DataFrame, angles: DataFrame, *, method: str = "cubic", u8: bool = False) -> DataFrame:
    """Turn each grid by its angle about the centre, same size, edges repeated.

    Grids without an angle pass through. Every target asks for its taps, and the
    taps meet the source cells in an equi-join on the cell, a merge at every size.
    """
    grid = sized(grid)
    asked = join_per_grid(grid.select(*CELL), angles.select("gid", "angle"))
    a = F.radians("angle")
    cy, cx = F.floor(F.col("h") / 2), F.floor(F.col("w") / 2)
    dy, dx = F.col("y") - cy, F.col("x") - cx
    asked = asked.withColumns({
        "_sy": F.round(cy + F.sin(a) * dx + F.cos(a) * dy, 9), "_sx": F.round(cx + F.cos(a) * dx - F.sin(a) * dy, 9),
    })
    shape, taps = (_triangle, (0, 1)) if method == "bilinear" else (lambda t: _cubic(t, CUBIC), (-1, 0, 1, 2))
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.col(n) - 1).cast("int")
    # Weights are columns of their own: written out in every tap they outgrow the code of one method.
    weights = {f"_w{c}{k}": shape(F.col(f"_s{c}") - F.floor(f"_s{c}") - i) for c in "yx" for k, i in enumerate(taps)}
    asked = asked.withColumns(weights)
    tap = F.array(*[
        F.struct(
            clamp(F.floor("_sy") + j, "h").alias("ty"), clamp(F.floor("_sx") + i, "w").alias("tx"),
            (F.col(f"_wy{m}") * F.col(f"_wx{n}")).alias("wt"),
        )
        for m, j in enumerate(taps) for n, i in enumerate(taps)
    ])
    wanted = asked.select(*CELL, F.inline(tap)).filter(F.col("wt") != 0)
    source = grid.select("gid", F.col("y").alias("ty"), F.col("x").alias("tx"), "v")
    turned = wanted.join(source.hint("merge"), ["gid", "ty", "tx"]).groupBy(*CELL).agg(
        as_u8(F.sum(F.col("v") * F.col("wt")), u8).alias("v")
    )
    still = join_per_grid(grid, angles.select("gid"), "left_anti")
    return turned.unionByName(still.select(*CELL, as_u8(F.col("v"), u8).alias("v")))


WEIGHT_SALTS = 64


def phash(grid: DataFrame, hash_size: int = 16, factor: int = 4) -> DataFrame:
    """Perceptual signature: low frequencies of the shrunk grid, one bit above their median.

    Shrinking and the cosine transform are linear along an axis, so both are
    folded into one weight table per occurring size, with one row per line.
    ``signature`` is an ``array<bigint>`` of 64-bit words, lowest coefficient in
    the lowest bit.
    """
    side = hash_size * factor
    grid = sized(grid)
    sizes_seen = grid.select("h", "w").distinct()
    for axis, size in (("y", "h"), ("x", "w")):
        other = "x" if axis == "y" else "y"
        sizes = sizes_seen.select(F.col(size).alias("_n")).distinct()
        source = sizes.select("_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
        fine = resampled(source, "_i", "_n", F.lit(side), "lanczos")
        norm = fine.groupBy("_n", "to").agg(F.sum("wt").alias("_sum"))
        wave = F.cos(F.col("k") * (F.col("to") * 2 + 1) * (math.pi / (2 * side)))
        table = (
            fine.join(norm, ["_n", "to"])
            .select("_n", "_i", "to", (F.col("wt") / F.col("_sum")).alias("wt"), F.explode(F.sequence(F.lit(0), F.lit(hash_size - 1))).alias("k"))
            .groupBy("_n", "_i", "k")
            .agg(F.sum(F.col("wt") * wave * 2).alias("wt"))
        )
        folded = table.groupBy(F.col("_n").alias(size), F.col("_i").alias(axis)).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("k", "wt"))), lambda s: s["wt"]).alias("_wave")
        )
        # All grids may be of one size, so a line of weights is met in shares of the grids.
        sent = salted_join(grid, folded, [size, axis], "gid", salts=WEIGHT_SALTS).select(
            "gid", "h", "w", other, "v", F.posexplode("_wave").alias("_k", "_wt")
        )
        grid = sent.groupBy("gid", "h", "w", other, F.col("_k").alias(axis)).agg(
            F.sum(F.col("v") * F.col("_wt")).alias("v")
        )
    position = F.col("y") * hash_size + F.col("x")
    coefficients = grid.groupBy("gid").agg(
        F.sort_array(F.collect_list(F.struct(position.alias("p"), F.round("v", 6).alias("v")))).alias("_c"),
    )
    ranked = F.sort_array(F.transform("_c", lambda c: c["v"]))
    half = hash_size * hash_size // 2
    middle = F.get(ranked, F.lit(half))
    if hash_size % 2 == 0:
        middle = (F.get(ranked, F.lit(half - 1)) + middle) / 2
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def packed(m):
        def bit(c):
            return F.when(c["v"] > m, F.call_function("shiftleft", one, c["p"] % 64)).otherwise(zero)

        return F.transform(
            F.sequence(F.lit(0), F.lit((hash_size * hash_size - 1) // 64)),
            lambda word: F.aggregate(
                F.slice("_c", word * 64 + 1, F.lit(64)), zero, lambda acc, c: acc.bitwiseOR(bit(c))
            ),
        )

    words = let(middle, packed)
    return coefficients.select("gid", words.alias("signature"))
