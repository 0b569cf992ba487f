"""Grid operators against brute force on small random grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio_spark.operators import components as C
from folio_spark.operators import grid as G
from folio_spark.operators import prepare as P
from folio_spark.session import settled


def table(spark, grids):
    rows = [
        (gid, y, x, float(v)) for gid, a in grids.items() for y, line in enumerate(a) for x, v in enumerate(line)
    ]
    return spark.createDataFrame(rows, "gid string, y int, x int, v double")


def arrays(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["gid"], {})[(r["y"], r["x"])] = r["v"]
    result = {}
    for gid, cells in out.items():
        h, w = max(y for y, _ in cells) + 1, max(x for _, x in cells) + 1
        assert len(cells) == h * w
        result[gid] = np.array([[cells[(y, x)] for x in range(w)] for y in range(h)])
    return result


def randoms(seed=0, shapes=((7, 9), (3, 4), (1, 5), (12, 2), (1, 1))):
    rng = np.random.default_rng(seed)
    return {f"g{i}": rng.integers(0, 256, s).astype(float) for i, s in enumerate(shapes)}


def padded(a, ry, rx, mode):
    if mode == "edge":
        return np.pad(a, ((ry, ry), (rx, rx)), mode="edge")
    return np.pad(a, ((ry, ry), (rx, rx)), mode="reflect") if min(a.shape) > 1 else reflect_small(a, ry, rx)


def reflect_small(a, ry, rx):
    def index(u, n):
        if n == 1:
            return 0
        u = abs(u) % (2 * n - 2)
        return u if u < n else 2 * n - 2 - u

    h, w = a.shape
    return np.array([[a[index(y, h), index(x, w)] for x in range(-rx, w + rx)] for y in range(-ry, h + ry)])


def windows(a, ky, kx, mode):
    p = padded(a, ky // 2, kx // 2, mode)
    return np.lib.stride_tricks.sliding_window_view(p, (ky, kx))


def check(got, want, places=6):
    assert got.keys() == want.keys()
    for gid in want:
        np.testing.assert_allclose(got[gid], want[gid], atol=10**-places)


def test_median(spark):
    grids = randoms()
    check(arrays(G.median(table(spark, grids), 3)), {g: np.median(windows(a, 3, 3, "edge"), axis=(2, 3)) for g, a in grids.items()})


def test_gaussian_and_stencil(spark):
    grids = randoms(1)
    k = np.outer(G.SMALL_GAUSSIANS[5], G.SMALL_GAUSSIANS[5])
    want = {g: (windows(a, 5, 5, "reflect") * k).sum(axis=(2, 3)) for g, a in grids.items()}
    check(arrays(G.gaussian(table(spark, grids))), want)
    kernel = np.arange(15).reshape(3, 5) - 6.0
    want = {g: (windows(a, 3, 5, "reflect") * kernel).sum(axis=(2, 3)) for g, a in grids.items()}
    check(arrays(G.stencil(table(spark, grids), kernel.tolist())), want)
    assert abs(sum(G.gaussian_weights(11)) - 1) < 1e-12


def test_bilateral(spark):
    grids = randoms(2, ((11, 10), (6, 7)))
    want = {}
    for g, a in grids.items():
        win = windows(a, 9, 9, "reflect")
        dy, dx = np.mgrid[-4:5, -4:5]
        space = np.where(dy**2 + dx**2 <= 16, np.exp(-(dy**2 + dx**2) / (2 * 75.0**2)), 0)
        wt = space * np.exp(-((win - a[..., None, None]) ** 2) / (2 * 75.0**2))
        want[g] = (wt * win).sum(axis=(2, 3)) / wt.sum(axis=(2, 3))
    check(arrays(G.bilateral(table(spark, grids))), want)


@pytest.mark.parametrize("op", ["erode", "dilate", "open", "close", "unknown"])
def test_morphology(spark, op):
    grids = randoms(3, ((9, 8), (4, 11)))

    def one(a, largest):
        fill = -math.inf if largest else math.inf
        p = np.pad(a, ((1, 1), (2, 1)), constant_values=fill)
        win = np.lib.stride_tricks.sliding_window_view(p, (3, 4))
        return win.max(axis=(2, 3)) if largest else win.min(axis=(2, 3))

    steps = {"erode": [False], "dilate": [True], "open": [False, True], "close": [True, False]}.get(op, [])
    want = {}
    for g, a in grids.items():
        for s in steps:
            a = one(a, s)
        want[g] = a
    check(arrays(G.morphology(table(spark, grids), op, (4, 3))), want)


def test_iterations_equal_repeats(spark):
    grids = table(spark, randoms(4, ((9, 9),)))
    twice = G.morphology(G.morphology(grids, "erode", (3, 3)), "erode", (3, 3))
    check(arrays(G.morphology(grids, "erode", (3, 3), iterations=2)), arrays(twice))


def test_constant_stays_constant(spark):
    flat = table(spark, {"c": np.full((12, 12), 128.0)})
    for out in [
        G.median(flat), G.gaussian(flat), G.bilateral(flat), G.sharpen(flat), G.sharpen(flat, "strong", 0.3),
        G.morphology(flat, "close"), G.unsharp_mask(flat), G.unsharp_radius(flat), G.resize(flat, 1.5),
        G.resize(flat, 0.5, "bicubic"), G.rotate(flat, spark.createDataFrame([("c", 7.0)], "gid string, angle double")),
    ]:
        values = out.agg(F.min("v"), F.max("v")).first()
        assert abs(values[0] - 128) < 1e-6 and abs(values[1] - 128) < 1e-6


def test_otsu(spark):
    grids = randoms(5, ((9, 9), (5, 5)))
    grids["two"] = np.array([[10.0] * 5, [200.0] * 5])
    got = {r["gid"]: r["threshold"] for r in G.otsu_threshold(table(spark, grids)).collect()}
    for g, a in grids.items():
        best, level = -1.0, None
        for t in sorted(set(a.ravel())):
            low, high = a[a <= t], a[a > t]
            b = len(low) * len(high) / a.size**2 * (low.mean() - high.mean()) ** 2 if len(high) else 0.0
            if round(b, 6) > best:
                best, level = round(b, 6), t
        assert got[g] == level


def test_adaptive_and_simple(spark):
    grids = randoms(6, ((13, 14),))
    wts = np.array(G.gaussian_weights(11))
    want = {}
    for g, a in grids.items():
        mean = np.rint((windows(a, 11, 11, "edge") * np.outer(wts, wts)).sum(axis=(2, 3)))
        want[g] = np.where(a - mean > -2, 255.0, 0.0)
    check(arrays(G.binarize(table(spark, grids), "adaptive", block=10)), want)
    check(arrays(G.binarize(table(spark, grids), "simple", 100)), {g: np.where(a > 100, 255.0, 0) for g, a in grids.items()})


def brute_clahe(a, clip, tx, ty):
    h, w = a.shape
    ph, pw = (0, 0) if h % ty == 0 and w % tx == 0 else (ty - h % ty, tx - w % tx)
    full = np.array([[a[mirror(y, h), mirror(x, w)] for x in range(w + pw)] for y in range(h + ph)]).astype(int)
    th, tw = full.shape[0] // ty, full.shape[1] // tx
    area, luts = th * tw, {}
    limit = max(int(clip * area / 256), 1)
    for j in range(ty):
        for i in range(tx):
            hist = np.bincount(full[j * th:(j + 1) * th, i * tw:(i + 1) * tw].ravel(), minlength=256)
            excess = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + excess // 256
            rest = excess % 256
            if rest:
                step = max(256 // rest, 1)
                for b in list(range(0, 256, step))[:rest]:
                    hist[b] += 1
            luts[j, i] = np.clip(np.rint(np.cumsum(hist) * (255.0 / area)), 0, 255)
    out = np.zeros(a.shape)
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y1, x1 = math.floor(fy), math.floor(fx)
            total = 0.0
            for dy in (0, 1):
                for dx in (0, 1):
                    wt = ((fy - y1) if dy else 1 - (fy - y1)) * ((fx - x1) if dx else 1 - (fx - x1))
                    j, i = min(max(y1 + dy, 0), ty - 1), min(max(x1 + dx, 0), tx - 1)
                    total += wt * luts[j, i][int(a[y, x])]
            out[y, x] = np.clip(np.rint(round(total, 9)), 0, 255)
    return out


def mirror(u, n):
    if n == 1:
        return 0
    u = abs(u) % (2 * n - 2)
    return u if u < n else 2 * n - 2 - u


def test_clahe(spark):
    grids = randoms(7, ((16, 24), (19, 13)))
    check(arrays(G.clahe(table(spark, grids), 2.0, (4, 4))), {g: brute_clahe(a, 2.0, 4, 4) for g, a in grids.items()}, 0)


@pytest.mark.parametrize("method,support", [("bilinear", 1), ("bicubic", 2), ("lanczos", 3)])
@pytest.mark.parametrize("factor", [1.7, 0.4])
def test_resize(spark, method, support, factor):
    def shape(t):
        t = abs(t)
        if method == "bilinear":
            return max(0.0, 1 - t)
        if method == "bicubic":
            return 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * (t**3 - 5 * t**2 + 8 * t - 4) if t < 2 else 0.0
        return np.sinc(t) * np.sinc(t / 3) if t < 3 else 0.0

    def matrix(n):
        m = int(n * factor)
        scale = max(n / m, 1.0)
        rows = np.array([[shape((i + 0.5 - (t + 0.5) * n / m) / scale) for i in range(n)] for t in range(m)])
        return rows / rows.sum(axis=1, keepdims=True)

    grids = randoms(8, ((9, 11), (5, 6)))
    want = {g: matrix(a.shape[0]) @ a @ matrix(a.shape[1]).T for g, a in grids.items()}
    check(arrays(G.resize(table(spark, grids), factor, method)), want)


def flood(mask):
    labels, h, w = {}, *mask.shape
    for start in [(y, x) for y in range(h) for x in range(w) if mask[y, x]]:
        if start in labels:
            continue
        stack, name = [start], start[0] * w + start[1]
        while stack:
            y, x = stack.pop()
            if (y, x) in labels or not (0 <= y < h and 0 <= x < w) or not mask[y, x]:
                continue
            labels[y, x] = name
            stack += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return labels


@pytest.mark.parametrize("span", [3, 4096])
def test_regions(spark, span):
    rng = np.random.default_rng(9)
    masks = {f"m{i}": rng.random((14, 15)) < p for i, p in enumerate((0.3, 0.45, 0.7))}
    snake = np.zeros((9, 9), bool)
    snake[::2] = True
    snake[1, 8] = snake[3, 0] = snake[5, 8] = snake[7, 0] = True
    masks["snake"] = snake
    grid = G.sized(table(spark, {g: m.astype(float) for g, m in masks.items()}))
    got = C.regions(grid.filter("v > 0"), span=span).collect()
    for g, m in masks.items():
        mine = {(r["y"], r["x"]): r["label"] for r in got if r["gid"] == g}
        want = flood(m)
        assert mine.keys() == want.keys()
        pairs = {(mine[c], want[c]) for c in want}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_regions_of_blocks_need_no_rounds(spark, monkeypatch):
    """Regions that stay in their blocks are found by one pass; cells without a place have none."""
    monkeypatch.setattr(C, "components", lambda *_: pytest.fail("no region crosses a border"))
    rng = np.random.default_rng(10)
    masks = {f"m{i}": rng.random((40, 30)) < 0.45 for i in range(3)}
    grid = G.sized(table(spark, {g: m.astype(float) for g, m in masks.items()})).filter("v > 0")
    lost = grid.limit(1).withColumn("y", F.lit(None).cast("int"))
    nowhere = grid.limit(1).withColumn("gid", F.lit(None).cast("string"))
    got = C.regions(grid.unionByName(lost).unionByName(nowhere)).collect()
    for g, m in masks.items():
        assert {(r["y"], r["x"]): r["label"] for r in got if r["gid"] == g} == {
            c: min(y * 30 + x for (y, x), n in flood(m).items() if n == name) for c, name in flood(m).items()
        }
    assert len(got) == sum(int(m.sum()) for m in masks.values())


def test_trim(spark):
    page = np.zeros((60, 50))
    page[15:45, 12:40] = 255
    page[2:4, 2:4] = 255
    white = np.full((40, 40), 255.0)
    out = arrays(C.trim_margins(table(spark, {"page": page, "white": white, "black": page * 0}), kernel=(3, 3), pad=2))
    assert out["white"].shape == (40, 40) and out["black"].shape == (60, 50)
    assert out["page"].shape == (34, 32)
    np.testing.assert_array_equal(out["page"], page[13:47, 10:42])


def brute_edges(a, low, high):
    win = windows(a, 3, 3, "edge")
    gx, gy = (win * np.array(G.SOBEL_X)).sum(axis=(2, 3)), (win * np.array(G.SOBEL_Y)).sum(axis=(2, 3))
    m = np.pad(np.abs(gx) + np.abs(gy), 1)
    h, w = a.shape
    kept = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            c, ax, ay = m[y + 1, x + 1], abs(gx[y, x]), abs(gy[y, x])
            if c <= low:
                continue
            if ay < ax * math.tan(math.pi / 8):
                ok = c > m[y + 1, x] and c >= m[y + 1, x + 2]
            elif ay > ax * math.tan(3 * math.pi / 8):
                ok = c > m[y, x + 1] and c >= m[y + 2, x + 1]
            else:
                s = -1 if gx[y, x] * gy[y, x] < 0 else 1
                ok = c > m[y, x + 1 - s] and c > m[y + 2, x + 1 + s]
            kept[y, x] = 0 if not ok else 2 if c > high else 1
    labels = flood(kept > 0)
    strong = {labels[y, x] for y, x in labels if kept[y, x] == 2}
    return {c for c, name in labels.items() if name in strong}


def test_edges(spark):
    grids = randoms(10, ((15, 16), (9, 12)))
    got = C.edges(table(spark, grids), 300, 600).collect()
    for g, a in grids.items():
        assert {(r["y"], r["x"]) for r in got if r["gid"] == g} == brute_edges(a, 300, 600)


def test_angle_of_a_line(spark):
    points = [("a", 20 + round(x * math.tan(math.radians(5))), x) for x in range(120)] + [("flat", 10, x) for x in range(120)]
    df = spark.createDataFrame(points, "gid string, y int, x int")
    got = {r["gid"]: r["angle"] for r in G.dominant_angle(df, votes=50).collect()}
    assert set(got) == {"a"} and abs(got["a"] - 5) <= 1
    projected = {r["gid"]: r["angle"] for r in G.projection_angle(df).collect()}
    assert projected["flat"] == 0 and abs(projected["a"] - 5) <= 1


def test_rotation_levels_a_line(spark):
    a = np.zeros((41, 41))
    for x in range(41):
        a[20 + round((x - 20) * math.tan(math.radians(9))), x] = 255
    angles = spark.createDataFrame([("a", 9.0)], "gid string, angle double")
    out = arrays(G.rotate(table(spark, {"a": a, "b": a}), angles, method="bilinear"))
    assert out["a"].sum(axis=1).argmax() == 20 and out["a"].sum(axis=1).max() > 2 * a.sum(axis=1).max()
    np.testing.assert_array_equal(out["b"], a)


def test_phash(spark):
    grids = randoms(11, ((20, 30), (64, 64)))
    grids["same"] = np.clip(grids["g0"] + 1, 0, 255)
    got = {r["gid"]: r["signature"] for r in G.phash(table(spark, grids), hash_size=8).collect()}

    def matrix(n, m):
        scale = max(n / m, 1.0)
        rows = np.array([[np.sinc(t) * np.sinc(t / 3) if abs(t) < 3 else 0 for t in ((i + 0.5 - (k + 0.5) * n / m) / scale for i in range(n))] for k in range(m)])
        return rows / rows.sum(axis=1, keepdims=True)

    for g, a in grids.items():
        small = matrix(a.shape[0], 32) @ a @ matrix(a.shape[1], 32).T
        wave = np.array([[2 * math.cos(math.pi * k * (2 * i + 1) / 64) for i in range(32)] for k in range(8)])
        coef = np.round(wave @ small @ wave.T, 6).ravel()
        want = sum(int(c > np.median(coef)) << i for i, c in enumerate(coef))
        assert got[g][0] & (2**64 - 1) == want
    wide = G.phash(table(spark, {"g0": grids["g0"]})).first()["signature"]
    assert len(wide) == 4
    assert bin((got["g0"][0] ^ got["same"][0]) & (2**64 - 1)).count("1") <= 5


def test_prepare(spark):
    page = np.zeros((60, 50))
    page[15:45, 12:40] = 255
    options = P.preset("default", tiles=(2, 2), contrast="equalize", trim_kernel=(3, 3), trim_pad=2, deskew=None)
    out = arrays(P.prepare(table(spark, {"p": page}), options))["p"]
    assert out.shape == (34, 32) and set(out.ravel()) <= {0.0, 255.0}
    assert P.preset("unknown") == P.DEFAULT and P.preset("aggressive").binary == "adaptive"
    same = table(spark, {"p": page})
    assert P.filter_preset(same, "unknown") is same
    for name in ("denoise", "sharpen", "ocr"):
        assert P.filter_preset(same, name).count() == 3000


def test_cells_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Steps multiply cells beyond the size that Spark guesses, so no step leaves a join to its size check."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 * 2**20
    plans = []

    def planned(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return frame

    monkeypatch.setattr(P, "settled", lambda frame: settled(planned(frame)))
    page = np.zeros((24, 20))
    page[6:18, 5:15] = 255
    table(spark, {"p": page}).write.parquet(f"{tmp_path}/grid")  # of files Spark knows, or guesses, the size
    grid = settled(planned(G.sized(spark.read.parquet(f"{tmp_path}/grid"))))
    options = P.preset("default", denoise=None, tiles=(2, 2), trim_kernel=(3, 3), trim_pad=2)
    planned(P.prepare(grid, options))
    planned(C.regions(grid.filter("v > 0"), span=3))
    # The size, the equalisation, the turning, the cut to the box, the level and the regions have joins.
    assert len([p for p in plans if "SortMergeJoin" in p]) == 6
    assert not [p for p in plans if "Broadcast" in p]
