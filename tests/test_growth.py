"""Work and tables that must not grow with what repeats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import grid, matching, patches, splines

KEY = ("frame_id",)


def image(spark, values, k=0):
    rows = [(k, y, x, float(v)) for y, line in enumerate(values) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "frame_id int, y int, x int, val double")


def written(monkeypatch, module):
    """Rows of each table that ``module`` writes from now on."""
    counts, write = {}, module.materialise

    def noted(df, name):
        out = write(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(module, "materialise", noted)
    return counts


def match_by_hand(ref, cur, y, x, gu, gv, r, search, zero_mean):
    h, w = ref.shape
    r1, r2, c1, c2 = max(y - r, 0), min(y + r + 1, h), max(x - r, 0), min(x + r + 1, w)
    t, best = ref[r1:r2, c1:c2], None
    ty, tx = round(y + gv), round(x + gu)
    for a in range(max(ty - r - search, 0), min(ty + r + search + 1, h) - t.shape[0] + 1):
        for b in range(max(tx - r - search, 0), min(tx + r + search + 1, w) - t.shape[1] + 1):
            i = cur[a : a + t.shape[0], b : b + t.shape[1]]
            f, g = (t - t.mean(), i - i.mean()) if zero_mean else (t, i)
            score = round(float((f * g).sum() / np.sqrt((f * f).sum() * (g * g).sum())), 9)
            if best is None or score > best[2]:
                best = (b - c1, a - r1, score)
    return best


@pytest.mark.parametrize(("zero_mean", "cells"), [(False, 250_000), (True, 0)])
def test_seeds_of_a_place_and_guess_are_matched_once(spark, monkeypatch, zero_mean, cells):
    rng = np.random.default_rng(11)
    ref, cur = rng.random((40, 45)), {k: rng.random((40, 45)) for k in (1, 2)}
    spots = [(3, 4, 0.0, 0.0), (3, 4, 2.0, -1.0), (30, 31, -1.5, 2.0), (39, 44, 0.5, 0.0), (20, 20, 90.0, 0.0)]
    seeds = spark.createDataFrame([(None if i == 7 else i, *spots[i % 5]) for i in range(60)], "id int, y int, x int, gu double, gv double")
    if hasattr(matching, "readers"):
        monkeypatch.setattr(matching, "readers", lambda points, at: patches.readers(points, at, cells))
    monkeypatch.setattr(matching, "BAND", 5_000, raising=False)
    counts = written(monkeypatch, matching)
    px = image(spark, cur[1], 1).unionByName(image(spark, cur[2], 2))
    got = matching.template_match(seeds, image(spark, ref).drop("frame_id"), px, 4, 3, 40, 45, zero_mean).collect()
    assert counts["templates"] == 3 and len(got) == 120
    for k in (1, 2):
        want = [match_by_hand(ref, cur[k], *s, 4, 3, zero_mean) or (90.0, 0.0, 0.0) for s in spots[:4]] + [(90.0, 0.0, 0.0)]
        rows = {r["id"]: (r["u0"], r["v0"], r["score"]) for r in got if r["frame_id"] == k}
        assert set(rows) == {None, *range(60)} - {7}
        for i, (u, v, score) in rows.items():
            at = want[(7 if i is None else i) % 5]
            assert (u, v, score) == (at[0], at[1], pytest.approx(at[2], abs=2e-9))


def test_matches_of_a_place_follow_each_other(spark):
    """So the ids that read it come again in the same order for each frame, and pack well where they are written."""
    rng = np.random.default_rng(14)
    px = image(spark, rng.random((20, 20)), 1)
    for k in range(2, 9):
        px = px.unionByName(image(spark, rng.random((20, 20)), k))
    seeds = spark.createDataFrame([(i, i % 3 * 6 + 3, 10, float(i % 2), 0.0) for i in range(30)], "id int, y int, x int, gu double, gv double")
    found = matching.template_match(seeds, image(spark, rng.random((20, 20))).drop("frame_id"), px.coalesce(1), 3, 2, 20, 20, True)
    got = found.withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == 240
    spot = [(r["part"], r["id"] % 6) for r in got]
    assert sum(a != b for a, b in zip(spot, spot[1:])) == len(set(spot)) - 1


def test_tiles_of_lines(spark):
    values = np.arange(7 * 50).reshape(7, 50)
    for halo in (0, 3, 60):
        for t in patches.tile_arrays(image(spark, values).withColumn("val", F.struct("val")), KEY, 7, 50, halo, tile=16).collect():
            ys, xs = np.mgrid[t["y0"] : t["y0"] + len(t["cells"]) // t["width"], t["x0"] : t["x0"] + t["width"]]
            fold = lambda c, n: np.where(c % (2 * n - 2) > n - 1, 2 * n - 2 - c % (2 * n - 2), c % (2 * n - 2))
            assert [c["val"] for c in t["cells"]] == values[fold(ys, 7), fold(xs, 50)].ravel().tolist()


@pytest.mark.parametrize("cells", [250_000, 0])
def test_points_of_a_place_are_snapped_once(spark, monkeypatch, cells):
    at = spark.createDataFrame([(f, y, x) for f in (1, 2) for y in range(0, 40, 4 * f) for x in range(1, 40, 5)], "frame_id int, y int, x int")
    points = spark.createDataFrame([(None if i == 5 else i, i % 3 * 9, i % 3 * 13 + 1) for i in range(90)], "id int, y int, x int")
    asked, seek = [], grid.nearest
    monkeypatch.setattr(grid, "nearest", lambda points, *rest: asked.append(points.count()) or seek(points, *rest))
    if hasattr(grid, "readers"):
        monkeypatch.setattr(grid, "readers", lambda points, at: patches.readers(points, at, cells))
    got = {(r["frame_id"], r["id"]): (r["y"], r["x"]) for r in grid.snap(points, at, KEY).collect()}
    assert asked == [6] and len(got) == 180
    spots = [(r["frame_id"], r["y"], r["x"]) for r in at.collect()]
    for (f, i), found in got.items():
        y, x = (5 if i is None else i) % 3 * 9, (5 if i is None else i) % 3 * 13 + 1
        assert found == min((a, b) for g, a, b in spots if g == f and (a - y) ** 2 + (b - x) ** 2 == min((c - y) ** 2 + (d - x) ** 2 for h, c, d in spots if h == f))


def test_coarse_search_by_hand_and_without_pixels(spark, monkeypatch):
    monkeypatch.setattr(matching, "BAND", 1_000)
    rng = np.random.default_rng(12)
    ref, cur = rng.random((40, 70)), rng.random((40, 70))
    rows = [(0, int(y), int(x), float(u), float(v), None if x % 2 else "n") for y, x, u, v in zip(rng.integers(0, 40, 30), rng.integers(0, 20, 30), rng.uniform(-9, 9, 30), rng.uniform(-9, 9, 30))]
    points = spark.createDataFrame(rows, "frame_id int, y int, x int, u double, v double, name string")
    fold = lambda c, n: c % (2 * n - 2) if c % (2 * n - 2) < n else 2 * n - 2 - c % (2 * n - 2)
    disc = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]

    def unit(v):
        v = np.array(v) - np.mean(v)
        return v / np.sqrt((v * v).sum())

    def at(y, x):
        i, j = int(np.floor(y)), int(np.floor(x))
        return sum(cur[fold(i + a, 40), fold(j + b, 70)] * (y - i if a else 1 - y + i) * (x - j if b else 1 - x + j) for a in (0, 1) for b in (0, 1))

    def by_hand(y, x, u, v):
        f = unit([ref[fold(y + a, 40), fold(x + b, 70)] for a, b in disc])
        tries = [(round(float(((f - unit([at(y + v + sy + a, x + u + sx + b) for a, b in disc])) ** 2).sum()), 9), sx, sy) for sx in (-1, 0, 1) for sy in (-1, 0, 1)]
        return min(tries)

    got = matching.coarse_search(points, image(spark, ref), image(spark, cur), 2, 40, 70, KEY, KEY, 1).collect()
    assert len(got) == 30
    for y, x, u, v, name in (r[1:] for r in rows):
        score, sx, sy = by_hand(y, x, u, v)
        assert any((g["y"], g["x"], g["name"]) == (y, x, name) and g["u"] == u + sx and g["v"] == v + sy and abs(g["score"] - score) < 2e-9 for g in got)
    far = spark.createDataFrame([(0, 20, 10, 0.0, 0.0), (0, 20, 60, 0.25, 0.5)], "frame_id int, y int, x int, u double, v double")
    lost = image(spark, cur).where("not (y = 20 and x = 62)")
    got = {g["x"]: g for g in matching.coarse_search(far, image(spark, ref), lost, 2, 40, 70, KEY, KEY, 1).collect()}
    assert got[10]["score"] is not None and tuple(got[60])[3:] == (0.25, 0.5, None)


def test_lines_are_filtered_together():
    values = np.random.default_rng(13).normal(size=(3, 150))
    want = values.copy()
    for z in splines.POLES:
        for line in want:
            line *= (1 - z) * (1 - 1 / z)
            for k in range(1, 150):
                line[k] += line[k - 1] * z
            line[149] *= -z
            for k in range(148, -1, -1):
                line[k] = (line[k + 1] - line[k]) * z
    assert np.allclose(splines.recursed(values), want, atol=1e-12)


def test_image_gradient_filters_each_line_once(spark):
    h, w = 37, 70
    values = np.random.default_rng(15).normal(size=(h, w))
    whole = splines.image_gradient(splines.coefficients(image(spark, values, 3), h, w), h, w)
    got = {(r["y"], r["x"]): (r["gx"], r["gy"]) for r in whole.collect()}
    assert len(got) == h * w
    coeff = np.zeros((h, w))
    for r in splines.coefficients(image(spark, values, 3), h, w).collect():
        coeff[r["y"], r["x"]] = r["val"]
    pad, (value, slope) = np.pad(coeff, 3, mode="reflect"), splines.kernels()
    for (y, x), found in got.items():
        near = pad[y : y + 7, x : x + 7]
        assert found == pytest.approx((np.dot(value, near @ slope), np.dot(slope, near @ value)), abs=1e-9)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3


def test_subsets_of_an_image_with_holes(spark, monkeypatch):
    monkeypatch.setattr(matching, "BAND", 2_000)
    rng, h, w, r = np.random.default_rng(16), 40, 45, 4
    layers, there = rng.random((3, h, w)), rng.random((h, w)) < 0.8
    there[10] = False
    rows = [(0, y, x, *map(float, layers[:, y, x])) for y in range(h) for x in range(w) if there[y, x]]
    ref = spark.createDataFrame(rows, "frame_id int, y int, x int, val double, gx double, gy double")
    spots = [(y, x) for y in range(-3, h + 3, 3) for x in range(-2, w + 3, 4)]
    got = {(g["y"], g["x"]): g for g in matching.subset_quality(spark.createDataFrame([(0, *s) for s in spots], "frame_id int, y int, x int"), ref, r, h, w).collect()}
    ys, xs = np.mgrid[0:h, 0:w]
    for y, x in spots:
        on = there & ((ys - y) ** 2 + (xs - x) ** 2 <= r * r)
        if not on.any():
            assert (y, x) not in got
            continue
        g, f = got.pop((y, x)), layers[0][on]
        sigma = np.sqrt(((f - f.mean()) ** 2).sum())
        assert (g["n_px"], g["sigma"]) == (on.sum(), pytest.approx(sigma, abs=1e-7))
        if on.sum() >= 6:
            gx, gy, dx, dy = layers[1][on], layers[2][on], xs[on] - x, ys[on] - y
            sd = np.column_stack([gx, gy, gx * dx, gx * dy, gy * dx, gy * dy]) / sigma
            assert all(g[f"h{i}{j}"] == pytest.approx((sd.T @ sd)[i, j]) for i in range(6) for j in range(i, 6))
    assert not got
