"""The measurement grid: lattice, domains, seeds, neighbours, and dense rasters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators.masks import lattice
from fieldloom.operators.patches import readers
from fieldloom.runtime import materialise, ship, sized

#: Fewer points are not split into domains.
LEAST_SPLIT = 200


def build_grid(mask: DataFrame, h: int, w: int, r: int, s: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, iy, ix, y, x of the points with origin r and pitch s that lie in the mask; none at all is an error."""
    on = lambda c, n: F.col(c).between(r, n - r - 1) & ((F.col(c) - r) % s == 0)
    inside = mask.select(*keys, "y", "x").where(on("y", h) & on("x", w)).distinct()
    if inside.isEmpty():
        raise ValueError("no grid point lies in the mask")
    return inside.select(*keys, ((F.col("y") - r) / s).cast("int").alias("iy"), ((F.col("x") - r) / s).cast("int").alias("ix"), "y", "x")


def disc_offsets(spark: SparkSession, r: int) -> DataFrame:
    return lattice(spark, -r, r + 1, -r, r + 1).where(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= r * r).select(F.col("y").alias("dy"), F.col("x").alias("dx"))


def default_seed(mask: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return mask.groupBy(*keys).agg(F.floor(F.avg("x")).cast("int").alias("x"), F.floor(F.avg("y")).cast("int").alias("y"))


def nearest(points: DataFrame, spots: DataFrame, keys: list[str], ids: list[str], carry: list[str]) -> DataFrame:
    """keys, ids and m (d2, y, x and ``carry``) of the nearest spot (keys, y, x, carry) to each point (keys, ids, y, x).

    Ties go to the first in (y, x); points of a group without a spot get none. An
    exact distance transform in two passes: in each column the nearest spot above
    and below every row that has a point, by windows; then in each such row the least
    over its columns, outwards from the point until no column can be nearer. A task
    holds one row of a raster. Places are whole numbers.
    """
    ship(points.sparkSession)
    rows = points.select(*keys, "y").distinct()
    columns = spots.select(*keys, "x").distinct()
    raster = rows.join(columns.hint("merge"), keys) if keys else rows.join(sized(columns), F.lit(True))
    both = raster.select(*keys, "x", "y", F.lit(None).cast("long").alias("_s"), F.lit(True).alias("_q")).unionByName(spots.select(*keys, "x", "y", F.col("y").cast("long").alias("_s"), F.lit(False).alias("_q")))
    line = Window.partitionBy(*keys, "x").orderBy("y")
    up = F.last("_s", ignorenulls=True).over(line.rangeBetween(Window.unboundedPreceding, 0))
    down = F.first("_s", ignorenulls=True).over(line.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"_up": up, "_down": down}).where("_q")
    spot = F.when(F.col("_down").isNull() | (F.col("y") - F.col("_up") <= F.col("_down") - F.col("y")), F.col("_up")).otherwise(F.col("_down"))
    lists = near.groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.struct("x", spot.alias("s")))).alias("columns"))
    asked = points.groupBy(*keys, "y").agg(F.collect_list(F.struct(*ids, F.col("x").alias("_px"))).alias("points"))
    pairs = asked.join(lists.hint("merge"), [*keys, "y"])
    kinds = {c: points.schema[c].dataType.simpleString() for c in (*keys, *ids)}

    def kernel(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tables:
            out = []
            for row in pdf.itertuples(index=False):
                cx, cy = (np.array([c[k] for c in row.columns], dtype=np.int64) for k in ("x", "s"))
                px = np.array([p["_px"] for p in row.points], dtype=np.int64)
                best = nearest_in_row(row.y, px, cx, cy)
                held = [getattr(row, k) for k in keys]
                out += [(*held, *[p[c] for c in ids], int(cy[b]), int(cx[b]), float((cy[b] - row.y) ** 2 + (cx[b] - p["_px"]) ** 2)) for p, b in zip(row.points, best, strict=True)]
            yield pd.DataFrame(out, columns=[*kinds, "_y", "_x", "_d2"])

    found = pairs.mapInPandas(kernel, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", _y long, _x long, _d2 double")
    held = spots.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), *[F.col(c).alias(f"_c_{c}") for c in carry]).dropDuplicates([*keys, "_y", "_x"])
    met = found.join(held.hint("merge"), [*keys, "_y", "_x"])
    return met.select(*keys, *ids, F.struct(F.col("_d2").alias("d2"), F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x"), *[F.col(f"_c_{c}").alias(c) for c in carry]).alias("m"))


def nearest_in_row(y: int, px: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """For each point (y, px) the number of the column whose spot (cy, cx) is nearest, ties to the first in (cy, cx); cx is sorted."""
    order = np.lexsort((cx, cy))
    rank = np.empty(len(cx), dtype=np.int64)
    rank[order] = np.arange(len(cx))
    rows = (cy - y) ** 2
    least = np.full(len(px), np.iinfo(np.int64).max)
    best = np.zeros(len(px), dtype=np.int64)
    right = np.searchsorted(cx, px)
    left = right - 1
    live = np.arange(len(px))
    while len(live):
        again = np.zeros(len(live), dtype=bool)
        for side in (left, right):
            at = side[live]
            inside = (at >= 0) & (at < len(cx))
            safe = np.where(inside, at, 0)
            across = (cx[safe] - px[live]) ** 2
            d2 = rows[safe] + across
            better = inside & ((d2 < least[live]) | ((d2 == least[live]) & (rank[safe] < rank[best[live]])))
            least[live[better]], best[live[better]] = d2[better], safe[better]
            again |= inside & (across <= least[live])
        left[live] -= 1
        right[live] += 1
        live = live[again]
    return best


def snap(points: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The nearest grid point of each point (id, x, y) in every frame of the grid; ties go to the first in (y, x).

    What is nearest depends on the place alone, so it is sought once for each place
    of a frame, and the points there read it.
    """
    if grid.isEmpty():
        return grid.select(*keys, F.lit(None).cast(points.schema["id"].dataType).alias("id"), "y", "x")
    seeds = materialise(points.select("id", F.col("y").alias("_at_y"), F.col("x").alias("_at_x")), "points")
    spots = seeds.select("_at_y", "_at_x").distinct()
    if keys:  # every place is asked of every frame
        spots = grid.select(*keys).distinct().join(sized(materialise(spots, "places")), F.lit(True))
    near = nearest(spots.select("*", F.col("_at_y").alias("y"), F.col("_at_x").alias("x")), grid, list(keys), ["_at_y", "_at_x"], [])
    # Every point is told every frame: that is the result's size.
    told = near.join(readers(seeds, ["_at_y", "_at_x"]), ["_at_y", "_at_x"]).select(*keys, F.explode("points").alias("p"), "m")
    return told.select(*keys, "p.id", F.col("m.y").alias("y"), F.col("m.x").alias("x"))


def assign_domain(grid: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """k nearly equal contiguous chunks of each frame's points in the order of (y, x); one if there are few points.

    Positions come from counts of rows before each row of the grid, so no task
    holds a grid; a window ranks the rows of a frame only.
    """
    of = Window.partitionBy(*keys)
    rows = grid.groupBy(*keys, "y").agg(F.count("*").alias("_m"))
    rows = rows.withColumns({"_before": F.coalesce(F.sum("_m").over(of.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_m").over(of)})
    placed = grid.join(rows.select(*keys, "y", "_before", "_n").hint("merge"), [*keys, "y"]).withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x")) - 1)
    size, more, at = F.floor(F.col("_n") / k), F.col("_n") % k, F.col("_at")
    long = more * (size + 1)
    domain = F.when(at < long, F.floor(at / (size + 1))).otherwise(more + F.floor((at - long) / F.greatest(size, F.lit(1))))
    return placed.withColumn("domain", F.when(F.col("_n") < LEAST_SPLIT, 0).otherwise(domain).cast("int")).select(*grid.columns, "domain")


def domain_seeds(grid: DataFrame, seed: tuple[float, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Domain 0 takes its point nearest to the seed (x, y), others the one nearest to their centroid."""
    centre = grid.groupBy(*keys, "domain").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    aim = centre.select(*keys, "domain", F.when(F.col("domain") == 0, seed[1]).otherwise(F.col("cy")).alias("cy"), F.when(F.col("domain") == 0, seed[0]).otherwise(F.col("cx")).alias("cx"))
    d2 = (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))
    near = grid.join(aim.hint("merge"), [*keys, "domain"]).groupBy(*keys, "domain").agg(F.min(F.struct(d2.alias("d2"), "y", "x")).alias("m"))
    return near.select(*keys, "domain", F.col("m.y").alias("y"), F.col("m.x").alias("x"))


def neighbours(grid: DataFrame, s: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of grid points one pitch apart within a domain: y, x, ny, nx, direction (up, down, left, right)."""
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("direction"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(((-s, 0), (s, 0), (0, -s), (0, s)))])).alias("m")
    out = grid.select(*keys, "domain", "y", "x", moves).select(*keys, "domain", "y", "x", (F.col("y") + F.col("m.dy")).alias("ny"), (F.col("x") + F.col("m.dx")).alias("nx"), F.col("m.direction").alias("direction"))
    return out.join(grid.select(*keys, "domain", F.col("y").alias("ny"), F.col("x").alias("nx")).hint("merge"), [*keys, "domain", "ny", "nx"]).select(*keys, "domain", "y", "x", "ny", "nx", "direction")


def densify(field: DataFrame, h: int, w: int) -> DataFrame:
    """Every pixel of every frame of ``field``; NULL off the points."""
    frames = field.select("frame_idx").distinct().select("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y"))
    return frames.select("frame_idx", "y", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x")).join(field.hint("merge"), ["frame_idx", "y", "x"], "left")


def crop_decimate(field: DataFrame, c: str, s: int) -> DataFrame:
    """Every s-th row and column of the bounding box of each frame's valid points."""
    box = field.where(F.col(c).isNotNull()).groupBy("frame_idx").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    rows = box.select("frame_idx", "x0", "x1", "y0", F.explode(F.sequence("y0", "y1", F.lit(s))).alias("y"))
    cells = rows.select("frame_idx", "y", F.explode(F.sequence("x0", "x1", F.lit(s))).alias("x"), "y0", "x0")
    return cells.join(field.select("frame_idx", "y", "x", c).hint("merge"), ["frame_idx", "y", "x"], "left").select("frame_idx", ((F.col("y") - F.col("y0")) / s).cast("int").alias("row"), ((F.col("x") - F.col("x0")) / s).cast("int").alias("col"), c)


def fill_nearest(cells: DataFrame, c: str) -> DataFrame:
    """Missing cells (frame_idx, row, col) take the value of the nearest valid one; ties to the first in (row, col).

    Frames without a valid cell stay as they are.
    """
    place = [F.col("row").alias("y"), F.col("col").alias("x")]
    spots = materialise(cells.where(F.col(c).isNotNull()).select("frame_idx", *place, F.col(c).alias("v")), "valid")
    points = cells.where(F.col(c).isNull()).select("frame_idx", "row", "col", *place)
    near = nearest(points, spots, ["frame_idx"], ["row", "col"], ["v"]).select("frame_idx", "row", "col", F.col("m.v").alias("_v"))
    return cells.join(near.hint("merge"), ["frame_idx", "row", "col"], "left").withColumn(c, F.coalesce(c, "_v")).select(*cells.columns)
