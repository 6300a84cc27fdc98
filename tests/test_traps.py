"""Semantics that are easy to lose, on hand-made fields."""

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import expressions as X
from fieldloom.operators import grid, kinematics, masks, matching, stats
from fieldloom.sources import frames, session

FIELD = "frame_idx int, y int, x int, u double, v double"


def frame(spark, rows, schema=FIELD):
    return spark.createDataFrame(rows, schema)


def test_velocity_exists_where_u_is_missing(spark):
    v = kinematics.velocity(frame(spark, [(0, 0, 0, 1.0, 0.0), (2, 0, 0, 5.0, 2.0)]), 3, 2.0).where("frame_idx = 1").first()
    assert (v["u"], v["Vx"], v["Vy"]) == (None, 4.0, 2.0)


def test_one_frame_has_no_velocity_and_two_are_one_sided(spark):
    one = kinematics.velocity(frame(spark, [(0, 0, 0, 1.0, 0.0)]), 1, 2.0).first()
    assert one["Vx"] is None
    two = kinematics.velocity(frame(spark, [(0, 0, 0, 1.0, 0.0), (1, 0, 0, 2.0, 0.0)]), 2, 2.0)
    assert [r["Vx"] for r in two.collect()] == [2.0, 2.0]


def test_linear_velocity_gives_exact_gradient_at_edges_too(spark):
    rows = [(0, y, x, 0.0, 0.0, 2.0 * x + 3.0 * y, -1.0 * x) for y in range(0, 15, 3) for x in range(0, 15, 3)]
    fit = kinematics.plane_fit(frame(spark, rows, FIELD + ", Vx double, Vy double"), ["Vx", "Vy"], 6, 3).collect()
    assert all(abs(r["dVx_dx"] - 2) < 1e-9 and abs(r["dVx_dy"] - 3) < 1e-9 and abs(r["dVy_dx"] + 1) < 1e-9 for r in fit)


def test_few_points_have_no_gradient(spark):
    rows = [(0, 0, x, 0.0, 0.0, 1.0 * x, 0.0) for x in (0, 3, 6)]
    assert all(r["dVx_dx"] is None for r in kinematics.plane_fit(frame(spark, rows, FIELD + ", Vx double, Vy double"), ["Vx", "Vy"], 6, 3).collect())


def test_strain_goes_on_through_gaps(spark):
    rows = [(0, 0, 0, 1.0, 1.0), (1, 0, 0, None, 1.0), (2, 0, 0, None, 1.0), (3, 0, 0, 1.0, 1.0)]
    f = frame(spark, [(i, y, x, u, r) for i, y, x, u, r in rows], "frame_idx int, y int, x int, u double, Exx_rate double").withColumns({"Eyy_rate": F.lit(None).cast("double"), "Exy_rate": F.lit(0.0)})
    got = {r["frame_idx"]: r["Exx"] for r in kinematics.integrate_strain(f, 1.0).collect()}
    assert got == {0: 0.0, 1: None, 2: None, 3: 3.0}


def test_effective_needs_all_components(spark):
    r = frame(spark, [(0, 0, 0, 1.0, None)]).select(X.effective(F.col("u"), F.col("v"), F.col("u")).alias("e")).first()
    assert r["e"] is None


def test_trajectory_ends_at_first_gap(spark):
    rows = [(i, 0, 0, float(i), 0.0) for i in (0, 1, 3)]
    path = kinematics.trajectories(frame(spark, rows), 3, 1).first()["path"]
    assert [p["frame_idx"] for p in path] == [-1, 0, 1]
    assert kinematics.trajectories(frame(spark, rows), -1).count() == 0


def test_dynamic_mask_rounds_half_to_even(spark):
    disp = frame(spark, [(0, 0, 0, 0.5, 0.0), (0, 0, 2, 0.5, 0.0), (0, 0, 3, 0.5, 0.0)])
    mask = spark.createDataFrame([(0, 0, 0), (0, 0, 2)], "frame_idx int, y int, x int")
    assert sorted(r["x"] for r in masks.apply_dynamic_mask(disp, mask, 4, 4).collect()) == [0, 2]


def test_warp_composed_with_itself_is_none(spark):
    p = [F.lit(v) for v in (1.5, -2.0, 0.1, 0.02, -0.03, 0.05)]
    got = spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(X.compose_affine(p, p))]).first()
    assert all(abs(v) < 1e-12 for v in got)


def test_domains_follow_equal_chunks(spark):
    g = masks.roi_rect(spark, 100, 100, 0, 0, 29, 7)
    sizes = [r["count"] for r in grid.assign_domain(g, 8).groupBy("domain").count().orderBy("domain").collect()]
    assert sizes == [26, 26, 26, 25, 25, 25, 25, 25]
    assert grid.assign_domain(g.limit(10), 8).select("domain").distinct().count() == 1


def test_holes_and_largest_component(spark):
    ring = [(y, x) for y in range(1, 6) for x in range(1, 6) if (y, x) != (3, 3)] + [(8, 8)]
    mask = spark.createDataFrame(ring, "y int, x int")
    assert masks.mask_fill_holes(mask, 10, 10).count() == 26
    assert masks.largest_component(mask, 10, 10).count() == 25


def test_range_of_nothing(spark):
    none = frame(spark, [(0, 0, 0, None, None)])
    assert tuple(stats.global_range(none, "u").first()) == (0.0, 1.0)


def test_polygon_needs_three_points(spark):
    with pytest.raises(ValueError):
        masks.roi_polygon(spark, 5, 5, [(0, 0), (1, 1)])


def test_planted_shift_is_found(spark):
    px = lambda d: spark.createDataFrame([(1, y, x, float((y - 2 * d) ** 2 * 7 % 31 + (x - d) ** 3 % 23)) for y in range(24) for x in range(24)], "frame_id int, y int, x int, val double")
    seeds = spark.createDataFrame([(1, 12, 12)], "id int, y int, x int")
    got = matching.template_match(seeds, px(0).drop("frame_id"), px(1), 4, 4, 24, 24).first()
    assert (got["u0"], got["v0"], got["score"]) == (1, 2, 1.0)


def test_empty_windows_and_absent_frames_have_no_gradient(spark):
    rows = [(f, y, x, 0.0, 0.0, 1.0 * x, 0.0) for f, n in ((0, 15), (1, 3)) for y in range(0, n, 3) for x in range(0, 60, 3) if f == 0 or x > 45]
    fit = kinematics.plane_fit(frame(spark, rows, FIELD + ", Vx double, Vy double"), ["Vx", "Vy"], 6, 3).collect()
    assert len(fit) == 200 and all((r["dVx_dx"] is None) == (r["frame_idx"] == 1) for r in fit)


def test_gradient_far_from_the_origin(spark):
    o = 10_000_000
    rows = [(0, o + y, o + x, 0.0, 0.0, 2.0 * x, 0.5 * y) for y in range(0, 15, 3) for x in range(0, 15, 3)]
    fit = kinematics.plane_fit(frame(spark, rows, FIELD + ", Vx double, Vy double"), ["Vx", "Vy"], 6, 3).collect()
    assert all(abs(r["dVx_dx"] - 2) < 1e-9 and abs(r["dVy_dy"] - 0.5) < 1e-9 for r in fit)


def test_normalising_a_constant_field(spark):
    field = frame(spark, [(0, 0, x, 1e6, 1e6) for x in range(3)] + [(0, 0, 9, None, 0.0)])
    got = stats.normalize(field, "u", stats.scale_range(stats.robust_range(field, "u"), False)).orderBy("x").collect()
    assert [r["u_norm"] for r in got] == [0.0, 0.0, 0.0, None]


def test_warp_without_inverse_is_null(spark):
    zero, minus = F.lit(0.0), F.lit(-1.0)
    got = spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(X.compose_affine([zero] * 6, [zero, zero, minus, zero, zero, minus]))]).first()
    assert list(got) == [None] * 6


def test_files_are_listed_by_extension(spark, tmp_path):
    for name in ("a.PNG", "b.txt", "c.jpeg", "d"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.png").write_bytes(b"x")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in frames.scan_frames(spark, f"file://{tmp_path}").collect()) == ["a.PNG", "c.jpeg"]


def test_ranks_cover_all_rows_in_order(spark):
    rows = spark.range(1000).selectExpr("cast(id * 7919 % 1000 as string) as path")
    got = {r["path"]: r["rn"] for r in frames.ranked(rows, ["path"]).collect()}
    assert got == {p: i for i, p in enumerate(sorted(map(str, range(1000))))}


def test_mask_choice_breaks_ties_by_name(spark):
    rows = [("b", 1), ("a", 1), ("c", 2)]
    assert tuple(frames.pick_mask(spark.createDataFrame(rows, "name string, val int")).first()) == ("a", 1)


def test_csv_export(spark, tmp_path):
    session.export_csv(frame(spark, [(0, 0, 1, 2.0, 0.5)]), 0, 2, 2, f"file://{tmp_path}/out")
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/out_u.csv").collect()] == ["nan,2.0", "nan,nan"]


def test_components_reach_over_tiles(spark):
    snake = [(0, y, x) for y in range(0, 21, 2) for x in range(21)] + [(0, y, 20 if y % 4 == 1 else 0) for y in range(1, 20, 2)] + [(1, 3, 3), (1, 4, 4)]
    mask = spark.createDataFrame(snake, "frame_id int, y int, x int")
    for tile in (4, 256):
        count = lambda diagonal, tile=tile: {r["frame_id"]: r["n"] for r in masks.label_components(mask, diagonal, ("frame_id",), tile).groupBy("frame_id").agg(F.countDistinct("label").alias("n")).collect()}
        assert count(False) == {0: 1, 1: 2} and count(True) == {0: 1, 1: 1}


def test_flat_images_match_without_a_score(spark):
    px = spark.createDataFrame([(1, y, x, 0.0) for y in range(20) for x in range(20)], "frame_id int, y int, x int, val double")
    seeds = spark.createDataFrame([(1, 10, 10)], "id int, y int, x int")
    for zero_mean in (False, True):
        assert tuple(matching.template_match(seeds, px.drop("frame_id"), px, 2, 3, 20, 20, zero_mean).first()) == (1, 1, -3, -3, 0.0)


def test_nearest_of_far_points_and_empty_frames(spark):
    cells = spark.createDataFrame([(0, 0, 0, 5.0), (0, 0, 30, None), (1, 0, 0, None)], "frame_idx int, row int, col int, u double")
    assert {(r["frame_idx"], r["col"]): r["u"] for r in grid.fill_nearest(cells, "u").collect()} == {(0, 0): 5.0, (0, 30): 5.0, (1, 0): None}
