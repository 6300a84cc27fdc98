"""Tracking, splines, subsets, matching and masks against plain arrays, and their errors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import discs, grid, images, kinematics, masks, matching, patches, splines, tracking
from fieldloom.sources import frames, session

KEY = ("frame_id",)


def image(spark, values, k=0):
    rows = [(k, y, x, float(v)) for y, line in enumerate(values) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "frame_id int, y int, x int, val double")


def array(rows, c, h, w):
    out = np.full((h, w), np.nan)
    for r in rows.collect():
        out[r["y"], r["x"]] = r[c]
    return out


# Tracking ------------------------------------------------------------------------------------


def track_by_hand(points, seed, answers, n_frames, spacing, least):
    """Frames in a loop over dictionaries; answers[t][(y, x)] = (du, dv, gradient, corr)."""

    def grow(active, t):
        seen = {}
        while active:
            done = {}
            for at, p in active.items():
                if at in answers[t]:
                    du, dv, g, corr = answers[t][at]
                    done[at] = ((p[0] + du, p[1] + dv, g, 0.0, 0.0, g), corr, corr < 2 and abs(du) < spacing + 1 and abs(dv) < spacing + 1)
                else:
                    done[at] = (None, None, False)
            seen |= done
            fresh = {}
            for dy, dx in ((-spacing, 0), (spacing, 0), (0, -spacing), (0, spacing)):
                for (y, x), (p, _, ok) in done.items():
                    to = (y + dy, x + dx)
                    if ok and to in points and to not in seen and to not in fresh:
                        fresh[to] = (p[0] + p[2] * dx + p[3] * dy, p[1] + p[4] * dx + p[5] * dy, *p[2:])
            active = fresh
        return seen

    out, before = {}, None
    for t in range(n_frames):
        start = {seed: (float(t), 0.0, 0.0, 0.0, 0.0, 0.0)}
        got = grow(start if before is None else {a: p for a, (p, _, ok) in before.items() if ok}, t)
        if before is not None and sum(ok for _, _, ok in got.values()) / len(points) < least:
            got = grow(start, t)
        out |= {(t, *a): v for a, v in got.items()}
        before = got
    return out


def test_track_by_hand(spark, monkeypatch):
    monkeypatch.setattr(tracking, "FOLD", 3)
    rng = random.Random(3)
    points = {(y, x) for y in range(0, 18, 3) for x in range(0, 18, 3) if rng.random() < 0.9}
    seed = min(points, key=lambda a: (a[0] - 9) ** 2 + (a[1] - 9) ** 2)
    answers = []
    for bad in (0.1, 0.2, 0.8, 0.1):
        answers.append({a: (float(rng.choice([-1, 0, 0.5, 1, 1, 4 if rng.random() < bad else 1])), rng.choice([0.0, 0.25]), rng.choice([-1, 0, 1]) / 64, rng.choice([0.5, 1.0, 2.0 if rng.random() < bad else 1.5])) for a in points if a == seed or rng.random() > bad / 3})
        answers[-1][seed] = (0.0, 0.0, 0.0, 0.5)
    rows = [("s", t, y, x, *v) for t, frame in enumerate(answers) for (y, x), v in frame.items()]
    table = spark.createDataFrame(rows, "key string, t int, y int, x int, du double, dv double, g double, c double").cache()

    def solve(active, t):
        met = active.join(table.where(F.col("t") == t), ["key", "y", "x"])
        zero = F.lit(0.0)
        return met.select("key", "y", "x", (F.col("u") + F.col("du")).alias("u"), (F.col("v") + F.col("dv")).alias("v"), F.col("g").alias("du_dx"), zero.alias("du_dy"), zero.alias("dv_dx"), F.col("g").alias("dv_dy"), F.col("c").alias("corr"))

    where = spark.createDataFrame([("s", y, x) for y, x in points], "key string, y int, x int").cache()
    seeds = spark.createDataFrame([("s", t, *seed, float(t), 0.0) for t in range(4)], "key string, frame_idx int, y int, x int, u double, v double")
    for least in (0.6,):
        got = {(r["frame_idx"], r["y"], r["x"]): (tuple(r[p] for p in tracking.PARAMS) if r["u"] is not None else None, r["corr"], r["ok"]) for r in tracking.track(seeds, where, solve, 4, 3, ("key",), least=least).collect()}
        want = track_by_hand(points, seed, answers, 4, 3, least or 0)
        assert got == want
        lost = {a for a in points if not want.get((1, *a), (0, 0, False))[2] and want.get((0, *a), (0, 0, False))[2]}
        assert any(want.get((t, *a), (0, 0, False))[2] for a in lost for t in (2, 3))  # one that fails comes back
    assert tracking.propagate(tracking.starts(seeds.limit(0), ("key",)), where, lambda a: solve(a, 0), 3, keys=("key",)).count() == 0


# Splines -------------------------------------------------------------------------------------


def coefficients_by_hand(values):
    n = len(values)
    spline = np.zeros((n, n))
    fold = lambda i: i if n == 1 else (lambda m: 2 * (n - 1) - m if m > n - 1 else m)(i % (2 * (n - 1)))
    for i in range(n):
        for k in range(-2, 3):
            spline[i, fold(i + k)] += splines.quintic(k)
    return np.linalg.solve(spline, values)


@pytest.mark.parametrize(("h", "w", "segment"), [(9, 140, 128), (30, 31, 16), (2, 5, 128)])
def test_spline_coefficients(spark, monkeypatch, h, w, segment):
    monkeypatch.setattr(splines, "SEGMENT", segment)
    values = np.random.default_rng(1).normal(size=(h, w))
    want = coefficients_by_hand(coefficients_by_hand(values).T).T
    got = splines.coefficients(image(spark, values), h, w).cache()
    assert np.allclose(array(got, "val", h, w), want, atol=1e-11)
    at = [(0, i, float(y), float(x)) for i, (y, x) in enumerate((y, x) for y in range(h) for x in range(0, w, 3))]
    read = splines.sample(spark.createDataFrame(at, "frame_id int, id int, y double, x double"), got, h, w, tile=8)
    assert all(r["value"] == pytest.approx(values[int(r["y"]), int(r["x"])], abs=1e-10) for r in read.collect())


def test_spline_gradients(spark):
    h, w = 40, 44
    y, x = np.mgrid[0:h, 0:w]
    coeff = splines.coefficients(image(spark, 0.5 * x - 2.0 * y + 0.01 * x * x + 0.02 * x * y), h, w).cache()
    gx, gy = 0.5 + 0.02 * x + 0.02 * y, -2.0 + 0.02 * x
    inner = (slice(14, -14), slice(14, -14))  # mirrored borders bend the surface near them
    whole = splines.image_gradient(coeff, h, w).cache()
    assert np.allclose(array(whole, "gx", h, w)[inner], gx[inner], atol=1e-6) and np.allclose(array(whole, "gy", h, w)[inner], gy[inner], atol=1e-6)
    at = spark.createDataFrame([(0, 1, 20.25, 21.5), (0, 2, -20.25, 21.5), (0, 3, 20.25, 2 * 43 - 21.5)], "frame_id int, id int, y double, x double")
    got = {r["id"]: (r["gx"], r["gy"]) for r in splines.gradient_at(at, coeff, h, w, tile=16).collect()}
    want = (0.5 + 0.02 * 21.5 + 0.02 * 20.25, -2.0 + 0.02 * 21.5)
    assert got[1] == pytest.approx(want, abs=1e-6)
    assert got[2] == pytest.approx((want[0], -want[1]), abs=1e-6) and got[3] == pytest.approx((-want[0], want[1]), abs=1e-6)


def test_tiles_mirror_and_lack(spark):
    values = np.arange(20.0).reshape(4, 5)
    tiles = patches.tile_arrays(image(spark, values), KEY, 4, 5, 6, tile=4).collect()
    pad = np.pad(values, 6, mode="reflect")
    for t in tiles:
        cells = np.array(t["cells"]).reshape(-1, t["width"])
        assert np.array_equal(cells, pad[t["y0"] + 6 :, t["x0"] + 6 :][: cells.shape[0], : cells.shape[1]])
    assert {t["cells"] is None for t in patches.tile_arrays(image(spark, values).where("x > 0"), KEY, 4, 5, 1, tile=8).collect()} == {True}


# Subsets -------------------------------------------------------------------------------------


def test_disc_sums(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 9, (14, 17))
    cells = image(spark, values)
    for r in (0, 1, 5, 30):
        got = array(discs.disc_sums(cells.where("(y + x) % 2 = 0"), cells, {"s": F.col("val")}, r, KEY, 0, 16), "s", 14, 17)
        y, x = np.mgrid[0:14, 0:17]
        for a in range(14):
            for b in range(17):
                if (a + b) % 2 == 0:
                    assert got[a, b] == values[(y - a) ** 2 + (x - b) ** 2 <= r * r].sum()


def test_disc_plane_fit_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(f, 3 * y, 3 * x, float(rng.randrange(50)), float(rng.randrange(50))) for f in range(2) for y in range(12) for x in range(13) if rng.random() < 0.8]
    field = spark.createDataFrame(rows, "frame_idx int, y int, x int, u double, v double")
    got = {(r["frame_idx"], r["y"], r["x"]): (r["du_dx"], r["dv_dy"]) for r in kinematics.plane_fit(field, ["u", "v"], 15, 3, shape="disc").collect() if r["u"] is not None}
    assert len(got) == len(rows)
    for f, y, x, _, _ in rows:
        near = [(1.0, b - x, a - y, u, v) for g, a, b, u, v in rows if g == f and (a - y) ** 2 + (b - x) ** 2 <= 225]
        m = np.array(near)
        fit = np.linalg.lstsq(m[:, :3], m[:, 3:], rcond=None)[0]
        assert got[f, y, x] == pytest.approx((fit[1, 0], fit[2, 1]), abs=1e-8)
    with pytest.raises(ValueError):
        kinematics.plane_fit(field, ["u"], 15, 3, shape="ring")


def test_subset_validity(spark):
    rng = np.random.default_rng(5)
    h, w, r = 24, 24, 6
    speckle, stripes, flat = rng.random((h, w)), np.tile(np.sin(np.arange(w)), (h, 1)), np.full((h, w), 0.5)
    for values, valid in ((speckle, True), (stripes, False), (flat, False)):
        px = image(spark, values)
        gy, gx = np.gradient(values)
        whole = px.join(image(spark, gx).withColumnRenamed("val", "gx"), ["frame_id", "y", "x"]).join(image(spark, gy).withColumnRenamed("val", "gy"), ["frame_id", "y", "x"])
        got = matching.subset_quality(px.where("y % 6 = 0 and x % 6 = 0").select("frame_id", "y", "x"), whole, r, h, w).collect()
        assert len(got) == 16 and all(g["valid"] == valid for g in got)
        if not valid:
            continue
        for g in got:
            ys, xs = np.mgrid[0:h, 0:w]
            on = (ys - g["y"]) ** 2 + (xs - g["x"]) ** 2 <= r * r
            f, dx, dy = values[on], xs[on] - g["x"], ys[on] - g["y"]
            sigma = math.sqrt(((f - f.mean()) ** 2).sum())
            sd = np.column_stack([gx[on], gy[on], gx[on] * dx, gx[on] * dy, gy[on] * dx, gy[on] * dy]) / sigma
            normal = sd.T @ sd
            assert (g["n_px"], g["sigma"]) == (on.sum(), pytest.approx(sigma))
            assert all(g[f"h{i}{j}"] == pytest.approx(normal[i, j], abs=1e-8) for i in range(6) for j in range(i, 6))
            assert g["logdet"] == pytest.approx(np.linalg.slogdet(normal)[1])
    corner = matching.subset_quality(px.where("y = 0 and x = 0").select("frame_id", "y", "x"), whole, 1, h, w).first()
    assert (corner["n_px"], corner["valid"]) == (3, False)


def test_coarse_search_finds_the_shift(spark):
    rng = np.random.default_rng(6)
    big = rng.random((60, 60))
    ref, cur = big[10:50, 10:50], big[7:47, 12:52]  # everything moved by u = -2, v = 3
    points = spark.createDataFrame([(0, y, x, 0.0, 0.0, "tag") for y in range(8, 30, 6) for x in range(8, 30, 6)] + [(0, 20, 20, -3.5, 1.25, "far")], "frame_id int, y int, x int, u double, v double, name string")
    got = matching.coarse_search(points, image(spark, ref), image(spark, cur), 5, 40, 40, KEY, KEY).collect()
    assert len(got) == 17
    for g in got:
        if g["name"] == "tag":
            assert (g["u"], g["v"]) == (-2.0, 3.0) and g["score"] == pytest.approx(0, abs=1e-8)
        else:
            assert abs(g["u"] + 2) <= 0.5 and abs(g["v"] - 3) <= 0.25


def test_template_match_guess_and_fallback(spark):
    rng = np.random.default_rng(7)
    big = rng.random((80, 80))
    ref, cur = big[20:60, 20:60], big[8:48, 30:70]  # moved by u = -10, v = 12
    px = image(spark, cur, 5)
    seeds = spark.createDataFrame([(1, 15, 25, -9.0, 11.0), (2, 15, 25, 0.0, 0.0), (3, 2, 38, -9.5, 12.0), (4, 20, 20, 90.0, 0.0), (5, 20, 20, None, None)], "id int, y int, x int, gu double, gv double")
    found = matching.template_match(seeds, image(spark, ref).drop("frame_id"), px, 4, 3, 40, 40)
    got = {r["id"]: (r["u0"], r["v0"], r["score"]) for r in found.collect()}
    assert got[1] == (-10.0, 12.0, 1.0) and got[3] == (-10.0, 12.0, 1.0)
    assert got[2][2] < 1 and got[4] == (90.0, 0.0, 0.0) and len(got) == 5
    assert {r["score"] for r in matching.template_match(seeds, image(spark, ref).drop("frame_id"), px, 0, 3, 40, 40).collect()} == {0.0}


# Masks and grids -----------------------------------------------------------------------------


def test_contour_area_decides_near_ties(spark):
    # A full block of 3 x 3 (area 4, 9 pixels) against a cross of 13 pixels with long arms (area 2) and a ring with a hole.
    block = {(y, x) for y in range(3) for x in range(3)}
    cross = {(10, x) for x in range(7)} | {(y, 3) for y in range(7, 14)}
    mask = spark.createDataFrame([(0, y, x) for y, x in block | cross], "frame_id int, y int, x int")
    assert {(r["y"], r["x"]) for r in masks.largest_component(mask, 20, 20, KEY).collect()} == block
    ring = {(y, x) for y in range(12, 16) for x in range(12, 16)} - {(13, 13), (13, 14), (14, 13), (14, 14)}
    mask = spark.createDataFrame([(0, y, x) for y, x in block | ring], "frame_id int, y int, x int")
    assert {(r["y"], r["x"]) for r in masks.largest_component(mask, 20, 20, KEY).collect()} == {(y, x) for y in range(12, 16) for x in range(12, 16)}


def test_nearest_by_brute_force(spark):
    rng = random.Random(8)
    spots = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    points = [(i, rng.randrange(-10, 60), rng.randrange(-10, 60)) for i in range(200)]
    got = grid.snap(spark.createDataFrame(points, "id int, y int, x int"), spark.createDataFrame(spots, "y int, x int"))
    want = {i: min(spots, key=lambda s: ((s[0] - y) ** 2 + (s[1] - x) ** 2, s)) for i, y, x in points}  # noqa: B023
    assert {r["id"]: (r["y"], r["x"]) for r in got.collect()} == want


def test_fill_nearest_far_gap(spark):
    cells = spark.range(300).select(F.lit(0).alias("frame_idx"), F.col("id").cast("int").alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(299))).alias("col"))
    cells = cells.withColumn("u", F.when(F.col("col") < 150, F.col("row") * 1000.0 + F.col("col")))
    filled = grid.fill_nearest(cells, "u")
    assert filled.where("col >= 150 and u = row * 1000.0 + 149").count() == 300 * 150 and filled.where("col < 150 and u = row * 1000.0 + col").count() == 300 * 150


def test_spread_needs_centred_runs(spark):
    px = image(spark, np.zeros((3, 3)))
    with pytest.raises(ValueError):
        masks.spread_rows(px, "val", [(0, 0), (0, 1)], KEY, F.max)
    assert images.dynamic_mask(px, 3, 3, "None").count() == 0


# Errors and exports --------------------------------------------------------------------------


def test_errors(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    for manifest, limit in ((paths("a.png"), None), (paths("a.png", "roi.png"), None), (paths("a.png", "b.png"), 0)):
        with pytest.raises(ValueError):
            frames.select_frames(manifest, 1, limit)
    assert frames.select_frames(paths("a.png", "b.png")).count() == 2
    with pytest.raises(ValueError):
        frames.pick_mask(spark.createDataFrame([("a", 0), ("a", 2)], "name string, val int"))
    with pytest.raises(ValueError):
        grid.build_grid(spark.createDataFrame([(1, 1)], "y int, x int"), 10, 10, 5, 3)


def test_csv_files(spark, tmp_path):
    field = spark.createDataFrame([(0, 0, 0, *[float(i) for i in range(22)])], "frame_idx int, y int, x int, " + ", ".join(f"{c} double" for c in session.FIELDS))
    session.export_csv(field, 0, 2, 2, f"file://{tmp_path}/img")
    assert {p.name for p in tmp_path.iterdir()} == {f"img_{c}.csv" for c in "u v Exx Exy Eyy Eeff Vx Vy Veff dVx_dx dVx_dy dVy_dx dVy_dy Exx_rate Exy_rate Eyy_rate Eeff_rate corr".split()}
    assert spark.read.text(f"file://{tmp_path}/img_corr.csv").count() == 2
