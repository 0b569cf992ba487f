"""Queries of the grid operators over vectors and event counts laid out as grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import anchors as A
from ..operators import components as C
from ..operators import grid as G
from ..operators import prepare as P
from ..operators import sequence as Q
from ..operators.select import luma
from .registry import query

# Two families of grids. ``vectors``: every 64-number embedding as 8 x 8 cells of 0-255,
# one grid per row of the table. ``activity``: value per day and hour, one grid for every event type
# and hundred users, scaled so that a grid's greatest cell is 255.
VECTORS_SQL = """g AS (SELECT vec_id AS gid, (i // 8)::INT AS y, (i % 8)::INT AS x, 8 AS h, 8 AS w,
    least(255, greatest(0, round_even(128 + 256 * embedding[i + 1]::DOUBLE, 0))) AS v
  FROM embeddings, range(64) r(i))"""
ACTIVITY_SQL = """raw AS (SELECT event_type || '-' || user_id // 100 AS gid, dayofmonth(ts) - 1 AS y, hour(ts) AS x, round(sum(value), 6) AS s FROM events GROUP BY ALL),
sums AS (SELECT gid, y, x, floor(round(255 * s / max(s) OVER (PARTITION BY gid), 6)) AS v FROM raw),
frame AS (SELECT gid, y, x FROM (SELECT DISTINCT gid FROM raw), range(31) a(y), range(24) b(x)),
g AS (SELECT gid, y::INT AS y, x::INT AS x, 31 AS h, 24 AS w, coalesce(v, 0.0) AS v FROM frame LEFT JOIN sums USING (gid, y, x))"""



def mirror(u, n):
    """Index with mirrored borders, as SQL."""
    return f"(CASE WHEN {n} = 1 THEN 0 ELSE ({n} - 1) - abs(({n} - 1) - ((({u}) % (2*{n}-2) + (2*{n}-2)) % (2*{n}-2))) END)"


def clamp(u, n):
    return f"greatest(0, least({n} - 1, {u}))"


def kernel_sql(offsets):
    return "k(dy, dx, wt) AS (VALUES " + ", ".join(f"({dy}, {dx}, {wt!r}::DOUBLE)" for dy, dx, wt in offsets) + ")"


def window_sql(name, source, kernel, index, value):
    """CTE ``name``: ``value`` aggregated over the window of every cell of ``source``."""
    return f"""{name} AS (SELECT t.gid, t.h, t.w, t.y, t.x, {value} AS v FROM {source} t, {kernel} k, {source} s
  WHERE s.gid = t.gid AND s.y = {index('t.y + k.dy', 't.h')} AND s.x = {index('t.x + k.dx', 't.w')}
  GROUP BY ALL)"""


U8 = "least(255.0, greatest(0.0, round_even({v}, 0)))"


def vectors(t):
    cells = F.posexplode(F.transform("embedding", lambda e: G.as_u8(128 + 256 * e.cast("double")))).alias("i", "v")
    # A vector becomes 64 cells, and more once these are enlarged.
    flat = t.spread("embeddings", "vec_id", "embedding", piece=2**20).select(F.col("vec_id").alias("gid"), cells)
    return flat.select(
        "gid",
        F.floor(F.col("i") / 8).cast("int").alias("y"),
        (F.col("i") % 8).cast("int").alias("x"),
        F.lit(8).alias("h"),
        F.lit(8).alias("w"),
        "v",
    )


def activity(t):
    """One 31 x 24 grid per event type and hundred users; cells without events are 0.

    The sums are aggregated before they are scaled and the empty frame is added, so
    a grid has at most 744 rows by then, whatever the number of events.
    """
    users = F.floor(F.col("user_id") / 100).cast("string")
    sums = t.events.groupBy(
        F.concat(F.col("event_type"), F.lit("-"), users).alias("gid"),
        (F.dayofmonth("ts") - 1).alias("y"),
        F.hour("ts").alias("x"),
    ).agg(F.round(F.sum("value"), 6).alias("s"))
    scaled = F.floor(F.round(255 * F.col("s") / F.max("s").over(Window.partitionBy("gid")), 6)).cast("double")
    sums = sums.select("gid", "y", "x", scaled.alias("v"))
    frame = sums.select("gid").distinct()
    frame = frame.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(30))))
    frame = frame.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("v", F.lit(0.0))
    cells = sums.unionByName(frame).groupBy("gid", "y", "x").agg(F.max("v").alias("v"))
    return cells.withColumns({"h": F.lit(31), "w": F.lit(24)})


def shown(grid, digits=4):
    return grid.select("gid", "y", "x", F.round("v", digits).alias("v"))


OUT = "SELECT gid, y, x, round(v, 4) AS v FROM out"
SQUARE3 = kernel_sql([(dy, dx, 1.0) for dy, dx in G.square(3)])


def gauss_cte(name, source, size, sigma, index, u8=False):
    wts = G.gaussian_weights(size, sigma)
    r = size // 2
    k = kernel_sql([(a - r, b - r, wts[a] * wts[b]) for a in range(size) for b in range(size)])
    value = "round(sum(s.v * k.wt), 9)"
    return k.replace("k(", f"k_{name}(") + ", " + window_sql(name, source, f"k_{name}", index, U8.format(v=value) if u8 else value)


@query("grid_luma", """
SELECT vec_id AS gid, (n // 4)::INT AS y, (n % 4)::INT AS x, round(0.299::DOUBLE * embedding[4 * n + 1]::DOUBLE
  + 0.587::DOUBLE * embedding[4 * n + 2]::DOUBLE + 0.114::DOUBLE * embedding[4 * n + 3]::DOUBLE, 6) AS v
FROM embeddings, range(16) r(n)
""")
def grid_luma(t):
    """Every four numbers of a vector are a pixel of four channels, the last unused: a grid of 4 x 4."""
    e = lambda i: F.get("embedding", 4 * F.col("n") + i).cast("double")
    pixels = t.embeddings.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("n"))
    place = [F.floor(F.col("n") / 4).cast("int").alias("y"), (F.col("n") % 4).alias("x")]
    return pixels.select(F.col("vec_id").alias("gid"), *place, F.round(luma(e(0), e(1), e(2)), 6).alias("v"))


@query("grid_median", f"WITH {VECTORS_SQL}, {SQUARE3}, " + window_sql("out", "g", "k", clamp, "median(s.v)") + OUT)
def grid_median(t):
    return shown(G.median(vectors(t), 3))


@query("grid_gauss", f"WITH {VECTORS_SQL}, " + gauss_cte("out", "g", 5, 0.0, mirror) + OUT)
def grid_gauss(t):
    return shown(G.gaussian(vectors(t)))


NEAR = [(dy, dx, G.math.exp(-(dy * dy + dx * dx) / (2 * 75.0**2))) for dy, dx in G.square(9) if dy * dy + dx * dx <= 16]


@query("grid_bilateral", f"WITH {VECTORS_SQL}, {kernel_sql(NEAR)}, " + window_sql(
    "out", "g", "k", mirror,
    "sum(s.v * k.wt * exp(-((s.v - t.v) ** 2) / (2 * 75.0 ** 2))) / sum(k.wt * exp(-((s.v - t.v) ** 2) / (2 * 75.0 ** 2)))",
).replace("GROUP BY ALL", "GROUP BY t.gid, t.h, t.w, t.y, t.x, t.v") + OUT)
def grid_bilateral(t):
    return shown(G.bilateral(vectors(t)))


def sharpen_sql(kind, strength):
    k = kernel_sql(G.weighted(G.sharpen_kernel(kind, strength)))
    return f"WITH {VECTORS_SQL}, {k}, " + window_sql("out", "g", "k", mirror, U8.format(v="round(sum(s.v * k.wt), 9)")) + OUT


@query("grid_sharpen", sharpen_sql("strong", 0.5))
def grid_sharpen(t):
    return shown(G.sharpen(vectors(t), "strong", 0.5))


RIDGE = [[1.0, 2.0, 0.0, -2.0, -1.0], [0.5, 0.0, 3.0, 0.0, 0.5], [0.0, -1.0, 0.0, 1.0, 0.25]]


@query("grid_kernel", f"WITH {VECTORS_SQL}, {kernel_sql(G.weighted(RIDGE))}, " + window_sql("out", "g", "k", mirror, "sum(s.v * k.wt)") + OUT)
def grid_kernel(t):
    return shown(G.stencil(vectors(t), RIDGE))


def extreme_cte(name, source, fn, ky, kx):
    box = [(dy, dx, 1.0) for dy in range(-(ky // 2), ky - ky // 2) for dx in range(-(kx // 2), kx - kx // 2)]
    k = kernel_sql(box).replace("k(", f"k_{name}(")
    return k + ", " + window_sql(name, source, f"k_{name}", lambda u, n: f"({u})", f"{fn}(s.v)")


@query("grid_morph", f"WITH {VECTORS_SQL}, " + extreme_cte("a", "g", "max", 3, 4) + ", " + extreme_cte("out", "a", "min", 3, 4) + OUT)
def grid_morph(t):
    return shown(G.morphology(vectors(t), "close", (4, 3)))


@query("grid_unsharp", f"WITH {VECTORS_SQL}, " + gauss_cte("b", "g", 5, 1.0, mirror) + """
, out AS (SELECT g.gid, g.y, g.x, CASE WHEN abs(g.v - b.v) > 6 THEN g.v * 2.5 - b.v * 1.5 ELSE g.v END AS v
  FROM g JOIN b ON g.gid = b.gid AND g.y = b.y AND g.x = b.x)
""" + OUT)
def grid_unsharp(t):
    return shown(G.unsharp_mask(vectors(t), threshold=6))


@query("grid_histogram", f"WITH {VECTORS_SQL} SELECT gid, v::INT AS level, count(*) AS n FROM g GROUP BY ALL")
def grid_histogram(t):
    return G.histogram(vectors(t))


OTSU_SQL = """
, levels AS (SELECT DISTINCT gid, v FROM g),
split AS (SELECT l.gid, l.v AS level, count(*) FILTER (g.v <= l.v) AS n1, avg(g.v) FILTER (g.v <= l.v) AS m1,
    count(*) FILTER (g.v > l.v) AS n2, avg(g.v) FILTER (g.v > l.v) AS m2 FROM levels l JOIN g USING (gid) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY
    CASE WHEN n2 = 0 THEN 0.0 ELSE round(n1::DOUBLE / (n1 + n2) * n2 / (n1 + n2) * (m1 - m2) ** 2, 6) END DESC, level) AS rn FROM split)
"""


@query("grid_otsu", f"WITH {VECTORS_SQL} {OTSU_SQL}" + """
SELECT g.gid, y, x, CASE WHEN v > level THEN 255.0 ELSE 0.0 END::DOUBLE AS v FROM g JOIN best ON g.gid = best.gid AND rn = 1
""")
def grid_otsu(t):
    return shown(G.binarize(vectors(t), "otsu"))


@query("grid_otsu_level", f"WITH {ACTIVITY_SQL} {OTSU_SQL} SELECT gid, level::INT AS threshold FROM best WHERE rn = 1")
def grid_otsu_level(t):
    return G.otsu_threshold(activity(t))


@query("grid_adaptive", f"WITH {VECTORS_SQL}, " + gauss_cte("b", "g", 11, 0.0, clamp, True) + """
SELECT g.gid, g.y, g.x, CASE WHEN g.v > b.v - 2 THEN 255.0 ELSE 0.0 END::DOUBLE AS v
FROM g JOIN b ON g.gid = b.gid AND g.y = b.y AND g.x = b.x
""")
def grid_adaptive(t):
    return shown(G.binarize(vectors(t), "adaptive", block=10))


@query("grid_equalize", f"WITH {VECTORS_SQL}" + """
, c AS (SELECT t.gid, t.y, t.x, count(*) FILTER (s.v <= t.v) AS cum, count(*) AS n,
    count(*) FILTER (s.v = m.low) AS first FROM g t JOIN g s USING (gid) JOIN (SELECT gid, min(v) AS low FROM g GROUP BY gid) m USING (gid) GROUP BY ALL)
SELECT gid, y, x, round_even((cum - first) / (n - first) * 255.0, 0) AS v FROM c
""")
def grid_equalize(t):
    return shown(G.equalize(vectors(t)))


# 31 x 24 cells in 4 x 4 tiles: neither side divides, so both grow (to 32 x 28).
CLAHE_SQL = f"""
, full_ AS (SELECT g.gid, a.y // 8 AS ty, b.x // 7 AS tx, g.v::INT AS lv FROM range(32) a(y), range(28) b(x), g
   WHERE g.y = {mirror('a.y', 31)} AND g.x = {mirror('b.x', 24)}),
hist AS (SELECT gid, ty, tx, lv, count(*) AS n FROM full_ GROUP BY ALL),
bins AS (SELECT t.gid, t.ty, t.tx, l.lv, coalesce(n, 0) AS n FROM (SELECT DISTINCT gid, ty, tx FROM hist) t CROSS JOIN range(256) l(lv)
   LEFT JOIN hist h ON h.gid = t.gid AND h.ty = t.ty AND h.tx = t.tx AND h.lv = l.lv),
over_ AS (SELECT gid, ty, tx, sum(greatest(n - 1, 0)) AS ex FROM bins GROUP BY ALL),
fixed AS (SELECT b.*, least(n, 1) + ex // 256 + CASE WHEN ex % 256 > 0 AND lv % greatest(256 // greatest(ex % 256, 1), 1) = 0
   AND lv // greatest(256 // greatest(ex % 256, 1), 1) < ex % 256 THEN 1 ELSE 0 END AS m FROM bins b JOIN over_ o USING (gid, ty, tx)),
lut AS (SELECT gid, ty, tx, lv, least(255.0, round_even(sum(m) OVER (PARTITION BY gid, ty, tx ORDER BY lv) * (255.0::DOUBLE / 56), 0)) AS out_ FROM fixed),
pos AS (SELECT gid, y, x, v::INT AS lv, y / 8.0::DOUBLE - 0.5 AS fy, x / 7.0::DOUBLE - 0.5 AS fx FROM g),
taps AS (SELECT p.*, greatest(0, least(3, floor(fy) + j)) AS ty, greatest(0, least(3, floor(fx) + i)) AS tx,
   (CASE j WHEN 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE i WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS wt
   FROM pos p, range(2) a(j), range(2) b(i))
SELECT t.gid, t.y, t.x, least(255.0, greatest(0.0, round_even(round(sum(wt * out_), 9), 0))) AS v
FROM taps t JOIN lut l ON l.gid = t.gid AND l.ty = t.ty AND l.tx = t.tx AND l.lv = t.lv GROUP BY t.gid, t.y, t.x
"""


@query("grid_clahe", f"WITH {ACTIVITY_SQL} {CLAHE_SQL}")
def grid_clahe(t):
    return shown(G.clahe(activity(t), 2.0, (4, 4)))


def bilinear_sql(n, factor):
    """Source weights of one axis for the doubled vector grids."""
    m = int(n * factor)
    rows = []
    for to in range(m):
        centre = (to + 0.5) * n / m
        raw = [(i, max(0.0, 1 - abs(i + 0.5 - centre))) for i in range(n)]
        total = sum(wt for _, wt in raw)
        rows += [(to, i, wt / total) for i, wt in raw if wt > 0]
    return "k(dst, src, wt) AS (VALUES " + ", ".join(f"({a}, {b}, {c!r}::DOUBLE)" for a, b, c in rows) + ")"


@query("grid_resize", f"WITH {VECTORS_SQL}, {bilinear_sql(8, 1.5)}" + """
SELECT gid, a.dst AS y, b.dst AS x, round(sum(v * a.wt * b.wt), 4) AS v FROM g JOIN k a ON a.src = g.y JOIN k b ON b.src = g.x GROUP BY ALL
""")
def grid_resize(t):
    return shown(G.resize(vectors(t), 1.5, "bilinear"))


@query("grid_nearest", f"WITH {VECTORS_SQL}" + """
SELECT gid, a.d::INT AS y, b.d::INT AS x, v FROM g JOIN range(20) a(d) ON floor((a.d + 0.5) * 8 / 20) = g.y JOIN range(20) b(d) ON floor((b.d + 0.5) * 8 / 20) = g.x
""")
def grid_nearest(t):
    return shown(G.resize(vectors(t), 2.5, "nearest"))


@query("grid_box", f"WITH {ACTIVITY_SQL} SELECT gid, count(*) AS area, min(y) AS top, max(y) AS bottom, min(x) AS \"left\", max(x) AS \"right\" FROM g WHERE v > 100 GROUP BY gid")
def grid_box(t):
    return C.content_boxes(activity(t), threshold=100, kernel=None, largest=False).drop("h", "w")


REACH_SQL = """
, reach(gid, y, x, root) AS (SELECT gid, y, x, y * 24 + x FROM m
  UNION SELECT m.gid, m.y, m.x, r.root FROM reach r JOIN m ON m.gid = r.gid AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1),
region AS (SELECT gid, y, x, min(root) AS label FROM reach GROUP BY gid, y, x)
"""


@query("grid_regions", "WITH RECURSIVE " + ACTIVITY_SQL + ", m AS (SELECT * FROM g WHERE v > 190)" + REACH_SQL
       + "SELECT gid, label::BIGINT AS label, count(*) AS area, min(y) AS top, max(y) AS bottom, min(x) AS \"left\", max(x) AS \"right\" FROM region GROUP BY gid, label")
def grid_regions(t):
    bright = activity(t).filter("v > 190")
    return C.bounding_boxes(C.regions(bright), ["gid", "label"])


@query("grid_trim", "WITH RECURSIVE " + ACTIVITY_SQL + ", b AS (SELECT gid, h, w, y, x, CASE WHEN v > 110 THEN 255.0 ELSE 0.0 END AS v FROM g), "
       + ", ".join([extreme_cte("a1", "b", "max", 2, 2), extreme_cte("a2", "a1", "min", 2, 2),
                    extreme_cte("a3", "a2", "min", 2, 2), extreme_cte("a4", "a3", "max", 2, 2)])
       + ", m AS (SELECT * FROM a4 WHERE v > 0)" + REACH_SQL + """
, boxes AS (SELECT gid, label, count(*) AS area, greatest(0, min(y) - 1) AS y0, least(31, max(y) + 2) AS y1,
    greatest(0, min(x) - 1) AS x0, least(24, max(x) + 2) AS x1 FROM region GROUP BY gid, label),
best AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY area DESC, label) AS rn FROM boxes),
used AS (SELECT * FROM best WHERE rn = 1 AND NOT (x1 - x0 > 24 * 0.95 AND y1 - y0 > 31 * 0.95))
SELECT g.gid, (y - coalesce(y0, 0))::INT AS y, (x - coalesce(x0, 0))::INT AS x, v FROM g LEFT JOIN used u ON g.gid = u.gid
WHERE u.gid IS NULL OR (y >= y0 AND y < y1 AND x >= x0 AND x < x1)
""")
def grid_trim(t):
    return shown(C.trim_margins(activity(t), margin_threshold=160, kernel=(2, 2), pad=1))


def sobel_cte(name, kernel):
    k = kernel_sql(G.weighted(kernel)).replace("k(", f"k_{name}(")
    return k + ", " + window_sql(name, "g", f"k_{name}", clamp, "sum(s.v * k.wt)")


EDGES_SQL = ", " + sobel_cte("gx", G.SOBEL_X) + ", " + sobel_cte("gy", G.SOBEL_Y) + """
, slope AS (SELECT gid, y, x, gx.v AS a, gy.v AS b, abs(gx.v) + abs(gy.v) AS m FROM gx JOIN gy USING (gid, y, x)),
way AS (SELECT *, CASE WHEN abs(b) < abs(a) * tan(pi() / 8) THEN 0 WHEN abs(b) > abs(a) * tan(3 * pi() / 8) THEN 1 ELSE 2 END AS dir,
   CASE WHEN a * b < 0 THEN -1 ELSE 1 END AS s FROM slope WHERE m > 150),
ridge AS (SELECT w.gid, w.y, w.x, w.m > 400 AS strong FROM way w
   LEFT JOIN slope p ON p.gid = w.gid AND p.y = w.y - CASE dir WHEN 0 THEN 0 ELSE 1 END AND p.x = w.x - CASE dir WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE s END
   LEFT JOIN slope n ON n.gid = w.gid AND n.y = w.y + CASE dir WHEN 0 THEN 0 ELSE 1 END AND n.x = w.x + CASE dir WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE s END
   WHERE w.m > coalesce(p.m, 0) AND CASE dir WHEN 2 THEN w.m > coalesce(n.m, 0) ELSE w.m >= coalesce(n.m, 0) END),
kept(gid, y, x) AS (SELECT gid, y, x FROM ridge WHERE strong
   UNION SELECT r.gid, r.y, r.x FROM kept k JOIN ridge r ON r.gid = k.gid AND abs(r.y - k.y) <= 1 AND abs(r.x - k.x) <= 1)
SELECT gid, y, x FROM kept
"""


@query("grid_edges", f"WITH RECURSIVE {ACTIVITY_SQL} {EDGES_SQL}")
def grid_edges(t):
    return C.edges(activity(t), 150, 400).select("gid", "y", "x")


VOTES_SQL = """
, pts AS (SELECT gid, y, x FROM g WHERE v > 30),
votes AS (SELECT gid, round_even(round(x * cos(radians(a)) + y * sin(radians(a)), 9), 0)::INT AS rho, a AS theta, count(*) AS n FROM pts, range(180) t(a) GROUP BY ALL),
tops AS (SELECT v.* FROM votes v LEFT JOIN votes p ON p.gid = v.gid AND p.theta = v.theta AND p.rho = v.rho - 1
   LEFT JOIN votes q ON q.gid = v.gid AND q.theta = v.theta AND q.rho = v.rho + 1
   LEFT JOIN votes r ON r.gid = v.gid AND r.theta = v.theta - 1 AND r.rho = v.rho
   LEFT JOIN votes s ON s.gid = v.gid AND s.theta = v.theta + 1 AND s.rho = v.rho
   WHERE v.n > 12 AND v.n > coalesce(p.n, 0) AND v.n >= coalesce(q.n, 0) AND v.n > coalesce(r.n, 0) AND v.n >= coalesce(s.n, 0))
"""


@query("dominant_angle", f"WITH {ACTIVITY_SQL} {VOTES_SQL}" + """
SELECT gid, median(theta - 90)::DOUBLE AS angle FROM tops WHERE abs(theta - 90) < 45 GROUP BY gid HAVING abs(median(theta - 90)) >= 0.5
""")
def dominant_angle(t):
    return G.dominant_angle(activity(t).filter("v > 30"), votes=12)


@query("grid_projection", f"WITH {ACTIVITY_SQL}" + """
, pts AS (SELECT gid, y, x FROM g WHERE v > 150),
rows_ AS (SELECT gid, a AS angle, round_even(round(y * cos(radians(a)) - x * sin(radians(a)), 9), 0)::INT AS r, count(*) AS n FROM pts, range(-10, 11) t(a) GROUP BY ALL),
energies AS (SELECT gid, angle, sum(n * n)::BIGINT AS energy FROM rows_ GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY energy DESC, abs(angle), angle) AS rn FROM energies)
SELECT gid, angle::INT AS angle, energy FROM best WHERE rn = 1
""")
def grid_projection(t):
    return G.projection_angle(activity(t).filter("v > 150"))


@query("grid_rotate", f"WITH {VECTORS_SQL}" + f"""
, tilt AS (SELECT gid, h, w, y, x, radians((gid % 21 - 10)::DOUBLE) AS a FROM g),
pos AS (SELECT gid, h, w, y, x, round(4 + sin(a) * (x - 4) + cos(a) * (y - 4), 9) AS sy, round(4 + cos(a) * (x - 4) - sin(a) * (y - 4), 9) AS sx FROM tilt),
taps AS (SELECT p.*, floor(sy)::INT + j AS ty, floor(sx)::INT + i AS tx, (CASE j WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END)
   * (CASE i WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) AS wt FROM pos p, range(2) a(j), range(2) b(i))
SELECT t.gid, t.y, t.x, round(sum(wt * s.v), 4) AS v FROM taps t JOIN g s ON s.gid = t.gid AND s.y = {clamp('ty', 't.h')} AND s.x = {clamp('tx', 't.w')}
GROUP BY t.gid, t.y, t.x
""")
def grid_rotate(t):
    grid = vectors(t)
    angles = t.embeddings.select(F.col("vec_id").alias("gid"), (F.col("vec_id") % 21 - 10).cast("double").alias("angle"))
    return shown(G.rotate(grid, angles, method="bilinear"))


def lanczos_rows(n, m):
    """Weights that spread n cells over m, then the first 8 cosine waves over those."""
    import math

    def shape(t):
        if t == 0:
            return 1.0
        p = math.pi * t
        return math.sin(p) / p * math.sin(p / 3) / (p / 3) if abs(t) < 3 else 0.0

    out = []
    for k in range(8):
        acc = [0.0] * n
        for to in range(m):
            raw = [shape(i + 0.5 - (to + 0.5) * n / m) for i in range(n)]
            total = sum(raw)
            for i in range(n):
                acc[i] += raw[i] / total * 2 * math.cos(math.pi * k * (2 * to + 1) / (2 * m))
        out += [(k, i, acc[i]) for i in range(n)]
    return ", ".join(f"({k}, {i}, {wt!r}::DOUBLE)" for k, i, wt in out)


PHASH_SQL = f"""WITH {VECTORS_SQL}, f(k, src, wt) AS (VALUES {lanczos_rows(8, 32)}),
c AS (SELECT gid, a.k * 8 + b.k AS p, round(sum(v * a.wt * b.wt), 6) AS v FROM g JOIN f a ON a.src = g.y JOIN f b ON b.src = g.x GROUP BY ALL),
m AS (SELECT gid, median(v) AS mid FROM c GROUP BY gid),
bits AS (SELECT gid, string_agg(CASE WHEN v > mid THEN '1' ELSE '0' END, '' ORDER BY p) AS bits FROM c JOIN m USING (gid) GROUP BY gid)
"""


def signatures(t):
    return G.phash(vectors(t), hash_size=8)


@query("grid_phash", PHASH_SQL + "SELECT gid, bits FROM bits")
def grid_phash(t):
    """Shown as a string of bits, lowest coefficient first."""
    word = F.conv(F.get("signature", F.lit(0)).cast("string"), 10, 2)
    return signatures(t).select("gid", F.reverse(F.lpad(word, 64, "0")).alias("bits"))


def books(t):
    """Vectors of one label, in blocks of ten ids, as the pages of a book."""
    numbered = t.embeddings.select(F.col("vec_id").alias("gid"), (F.col("vec_id") % 5).alias("book"), F.floor(F.col("vec_id") / 5).alias("page"))
    return numbered.join(signatures(t), "gid").drop("gid")


@query("similarity_score", PHASH_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """
, pg AS (SELECT gid % 5 AS book, gid // 5 AS page, bits FROM bits),
walk(book, page, distance, anchor_page, anchor, kept) AS (
  SELECT book, page, NULL::BIGINT, NULL::BIGINT, bits, page FROM pg WHERE page = 0
  UNION ALL
  SELECT p.book, p.page, hamming(w.anchor, p.bits), w.kept,
         CASE WHEN hamming(w.anchor, p.bits) <= 30 THEN w.anchor ELSE p.bits END,
         CASE WHEN hamming(w.anchor, p.bits) <= 30 THEN w.kept ELSE p.page END
  FROM walk w JOIN pg p ON p.book = w.book AND p.page = w.page + 1)
SELECT book, page, anchor_page, distance, 1 - distance / 64.0::DOUBLE AS score FROM walk
""")
def similarity_score(t):
    """Each page against its anchor; random vectors are far apart, so the threshold is wide."""
    out = A.similarity_score(books(t), "book", "page", "signature", bits=64, threshold=30)
    return out.select("book", "page", "anchor_page", "distance", "score")


@query("end_page_similar", PHASH_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """
, pg AS (SELECT gid % 5 AS book, gid // 5 AS page, bits FROM bits),
walk(book, page, anchor, n, done) AS (
  SELECT book, page, bits, 0, false FROM pg WHERE page = 0
  UNION ALL
  SELECT p.book, p.page, CASE WHEN hamming(w.anchor, p.bits) <= 30 THEN w.anchor ELSE p.bits END,
         CASE WHEN hamming(w.anchor, p.bits) <= 30 THEN w.n + 1 ELSE 0 END,
         hamming(w.anchor, p.bits) <= 30 AND w.n + 1 >= 2
  FROM walk w JOIN pg p ON p.book = w.book AND p.page = w.page + 1 WHERE NOT w.done)
SELECT book, page AS end_page FROM walk WHERE done
""")
def end_page_similar(t):
    """The anchor rule; random vectors are far apart, so the threshold is wide."""
    return Q.end_of_sequence(books(t), "book", "page", "signature", n=3, threshold=30)


@query("similar_pages", PHASH_SQL + """
SELECT a.gid AS page, hamming(a.bits, b.bits) AS distance, 1 - hamming(a.bits, b.bits) / 64.0::DOUBLE AS score, hamming(a.bits, b.bits) <= 28 AS similar
FROM bits a JOIN bits b ON b.gid = a.gid + 1 WHERE a.gid % 2 = 0
""")
def similar_pages(t):
    """Two editions compared page by page: even vectors against the odd ones behind them."""
    pages = signatures(t).withColumn("page", F.col("gid") - F.col("gid") % 2)
    left = pages.filter("gid % 2 = 0").select("page", F.col("signature").alias("a"))
    right = pages.filter("gid % 2 = 1").select("page", F.col("signature").alias("b"))
    return Q.similar_pages(left.join(right, "page"), "a", "b", threshold=28, bits=64).drop("a", "b")


def chain_sql():
    """The steps of ``grid_chain`` one after the other, each on the table that the step before it leaves."""
    # Median of the activity grids, as ``g``; the tiled equalisation of ``g``, as ``eq``.
    raw = ACTIVITY_SQL.replace("g AS (SELECT gid, y::INT", "g0 AS (SELECT gid, y::INT")
    median = f"{SQUARE3}, " + window_sql("g", "g0", "k", clamp, "median(s.v)")
    tables, last = CLAHE_SQL.rsplit("SELECT t.gid, t.y, t.x, ", 1)
    equalised = tables.rstrip() + ", eq AS (SELECT t.gid, 31 AS h, 24 AS w, t.y, t.x, " + last.rstrip() + ")"
    bright = ", b AS (SELECT gid, h, w, y, x, CASE WHEN v > 110 THEN 255.0 ELSE 0.0 END AS v FROM eq), " + ", ".join([
        extreme_cte("a1", "b", "max", 2, 2), extreme_cte("a2", "a1", "min", 2, 2),
        extreme_cte("a3", "a2", "min", 2, 2), extreme_cte("a4", "a3", "max", 2, 2),
    ]) + ", m AS (SELECT * FROM a4 WHERE v > 0)"
    trimmed = """
, boxes AS (SELECT gid, label, count(*) AS area, greatest(0, min(y) - 1) AS y0, least(31, max(y) + 2) AS y1,
    greatest(0, min(x) - 1) AS x0, least(24, max(x) + 2) AS x1 FROM region GROUP BY gid, label),
largest AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY area DESC, label) AS rn FROM boxes),
used AS (SELECT * FROM largest WHERE rn = 1 AND NOT (x1 - x0 > 24 * 0.95 AND y1 - y0 > 31 * 0.95)),
cut_ AS (SELECT e.gid, (y - coalesce(y0, 0))::INT AS y, (x - coalesce(x0, 0))::INT AS x, v FROM eq e LEFT JOIN used u ON e.gid = u.gid
  WHERE u.gid IS NULL OR (y >= y0 AND y < y1 AND x >= x0 AND x < x1))"""
    level = OTSU_SQL.replace("gid, v FROM g)", "gid, v FROM cut_)").replace("levels l JOIN g USING", "levels l JOIN cut_ g USING")
    return f"WITH RECURSIVE {raw}, {median}{equalised}{bright}{REACH_SQL}{trimmed}{level}" + """
SELECT c.gid, y, x, CASE WHEN v > level THEN 255.0 ELSE 0.0 END::DOUBLE AS v FROM cut_ c JOIN best ON c.gid = best.gid AND best.rn = 1
"""


@query("grid_chain", chain_sql())
def grid_chain(t):
    """The default chain without turning: median, tiled equalisation, trimming to the content, Otsu's cut."""
    options = P.preset("default", tiles=(4, 4), deskew=None, margin_threshold=160, trim_kernel=(2, 2), trim_pad=1)
    return shown(P.prepare(activity(t), options))


@query("grid_prepare")
def grid_prepare(t):
    options = P.preset(
        "default", upscale=2.0, interpolation="bilinear", sharpen=True, tiles=(4, 4), votes=40, margin_threshold=160,
        trim_kernel=(3, 3), trim_pad=2,
    )
    return shown(P.prepare(activity(t), options))
