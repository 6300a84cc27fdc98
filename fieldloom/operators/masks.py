"""Regions of interest as sparse tables (y, x): shapes, algebra and morphology."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions.expressions import in_polygon, on_edge
from fieldloom.operators.graph import components
from fieldloom.runtime import materialise, ship, sized


def lattice(spark: SparkSession, y0: int, y1: int, x0: int, x1: int, step: int = 1) -> DataFrame:
    """Points of [y0, y1) x [x0, x1); rows are made in parallel, one range element each."""
    y = spark.range(y0, max(y0, y1), step).select(F.col("id").cast("int").alias("y"))
    if x1 <= x0:
        return y.select("y", F.lit(0).alias("x")).limit(0)
    return y.select("y", F.explode(F.sequence(F.lit(x0), F.lit(x1 - 1), F.lit(step))).alias("x"))


def roi_full(spark: SparkSession, h: int, w: int) -> DataFrame:
    return lattice(spark, 0, h, 0, w)


def roi_rect(spark: SparkSession, h: int, w: int, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Half open, coordinates truncated, clipped to the image."""
    clip = lambda v, n: min(max(int(v), 0), n)
    return lattice(spark, clip(y1, h), clip(y2, h), clip(x1, w), clip(x2, w))


def roi_circle(spark: SparkSession, h: int, w: int, cx: float, cy: float, r: float) -> DataFrame:
    return roi_full(spark, h, w).where((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy) <= r * r)


def roi_polygon(spark: SparkSession, h: int, w: int, points: list[tuple[float, float]]) -> DataFrame:
    """Inside by the even-odd rule, or on an edge."""
    if len(points) < 3:
        raise ValueError("a polygon needs three vertices or more")
    x, y = F.col("x"), F.col("y")
    return roi_full(spark, h, w).where(in_polygon(x, y, points) | on_edge(x, y, points))


def disc(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of the elliptic structuring element of odd ``size``."""
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for half in [round(r * (1 - dy * dy / (r * r)) ** 0.5)] for dx in range(-half, half + 1)]


def square(size: int) -> list[tuple[int, int]]:
    """Offsets of a square of ``size``, its anchor at size // 2."""
    return [(dy - size // 2, dx - size // 2) for dy in range(size) for dx in range(size)]


CROSS = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def shifted(mask: DataFrame, offsets: list[tuple[int, int]], keys: tuple[str, ...] = ()) -> DataFrame:
    """Every point moved by every offset."""
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])).alias("o")
    return mask.select(*keys, "y", "x", moves).select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))


def roi_erase(mask: DataFrame, centres: list[tuple[int, int]], r: int) -> DataFrame:
    """``mask`` without the discs of radius r around ``centres`` (x, y)."""
    gone: Column = F.lit(False)
    for cx, cy in centres:
        gone = gone | ((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy) <= r * r)
    return mask.where(~gone)


def roi_union(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return a.select(*keys, "y", "x").union(b.select(*keys, "y", "x")).distinct()


def roi_of_frames(mask: DataFrame, h: int, w: int, keys: tuple[str, ...]) -> DataFrame:
    """The full image of every frame that ``mask`` names by its keys."""
    if not keys:
        return roi_full(mask.sparkSession, h, w)
    rows = mask.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y"))
    return rows.select(*keys, "y", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x"))


def mask_dilate(mask: DataFrame, h: int, w: int, offsets: list[tuple[int, int]], keys: tuple[str, ...] = ()) -> DataFrame:
    inside = F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1)
    return shifted(mask, [(-dy, -dx) for dy, dx in offsets], keys).where(inside).distinct()


def mask_erode(mask: DataFrame, h: int, w: int, offsets: list[tuple[int, int]], keys: tuple[str, ...] = (), outside: bool = True) -> DataFrame:
    """Points all of whose neighbours are in the mask; ``outside`` says whether those beyond the image count as in it."""
    hits = shifted(mask, [(-dy, -dx) for dy, dx in offsets], keys).groupBy(*keys, "y", "x").agg(F.count("*").alias("_n"))
    if outside:
        # Neighbours inside the image, counted by runs of offsets in a row: terms grow with the height of the shape only.
        runs = [(dy, dx) for dy, dx in offsets if (dy, dx - 1) not in offsets]
        ends = [(dy, dx) for dy, dx in offsets if (dy, dx + 1) not in offsets]
        span = lambda a, b: F.greatest(F.lit(0), F.least(F.col("x") + b, F.lit(w - 1)) - F.greatest(F.col("x") + a, F.lit(0)) + 1)
        needed = sum((F.when((F.col("y") + dy).between(0, h - 1), span(a, b)).otherwise(0) for (dy, a), (_, b) in zip(sorted(runs), sorted(ends), strict=True)), F.lit(0))
    else:
        needed = F.lit(len(offsets))
    inside = F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1)
    return hits.where(inside & (F.col("_n") == needed)).drop("_n")


def spread_rows(image: DataFrame, c: str, offsets: list[tuple[int, int]], keys: tuple[str, ...], f) -> DataFrame:
    """``image`` (keys, y, x and column c at every pixel) with c as the f (F.max or F.min) over ``offsets``, whose rows are
    runs centred on the point. For each length of a run one window along the row, then one value from each row: no pixel
    is copied, whatever the size of the shape. Places beyond the image don't take part."""
    half = {}
    for dy, dx in offsets:
        half[dy] = max(half.get(dy, 0), abs(dx))
    if sorted(offsets) != sorted((dy, dx) for dy, n in half.items() for dx in range(-n, n + 1)):
        raise ValueError("each row of the shape must be one run centred on the point")
    row, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    wide = image.withColumns({f"_{n}": f(c).over(row.rangeBetween(-n, n)) for n in set(half.values())})
    return wide.withColumn(c, (F.greatest if f is F.max else F.least)(*[f(f"_{n}").over(column.rangeBetween(dy, dy)) for dy, n in half.items()])).drop(*[f"_{n}" for n in set(half.values())])


def morph_close(mask: DataFrame, h: int, w: int, size: int = 15, keys: tuple[str, ...] = ()) -> DataFrame:
    """The mask dilated and then eroded by an ellipse; what lies beyond the image counts neither way."""
    shape = ellipse(size)
    image = roi_of_frames(mask, h, w, keys).join(mask.select(*keys, "y", "x").distinct().withColumn("_on", F.lit(1)).hint("merge"), [*keys, "y", "x"], "left").withColumn("_on", F.coalesce("_on", F.lit(0)))
    closed = spread_rows(spread_rows(image, "_on", shape, keys, F.max), "_on", shape, keys, F.min)
    return closed.where("_on = 1").select(*keys, "y", "x")


def mask_border(mask: DataFrame, h: int, w: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points of the mask with a 4-neighbour outside it; beyond the image is outside."""
    core = mask_erode(mask, h, w, [(0, 0), *CROSS], keys, outside=False)
    return mask.select(*keys, "y", "x").join(core.hint("merge"), [*keys, "y", "x"], "left_anti")


def complement(mask: DataFrame, h: int, w: int, keys: tuple[str, ...] = ()) -> DataFrame:
    return roi_of_frames(mask, h, w, keys).join(mask.select(*keys, "y", "x").hint("merge"), [*keys, "y", "x"], "left_anti")


#: Side of the tiles that are labelled by themselves.
TILE = 256


def tile_labels(y: np.ndarray, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first pixel of each pixel's component; pixels come sorted by (y, x)."""
    new = np.append(True, (np.diff(y) != 0) | (np.diff(x) != 1))
    first = np.flatnonzero(new)
    ry, a, b = y[first].tolist(), x[first].tolist(), x[np.append(first[1:], len(y)) - 1].tolist()
    parent = list(range(len(first)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    i = 0
    for j in range(len(ry)):  # runs of the row above that can still touch a run from j on
        while i < j and (ry[i] < ry[j] - 1 or (ry[i] == ry[j] - 1 and b[i] + reach < a[j])):
            i += 1
        k = i
        while k < j and ry[k] == ry[j] - 1 and a[k] <= b[j] + reach:
            p, q = root(k), root(j)
            parent[max(p, q)] = min(p, q)
            k += 1
    of = first[[root(i) for i in range(len(first))]][np.cumsum(new) - 1]
    return y[of], x[of]


def label_components(mask: DataFrame, diagonal: bool = False, keys: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """keys, y, x and label (row and column of the component's first pixel in the tile that sorts first).

    Tiles are labelled each by itself, in one pass; only labels that touch over
    the edges of tiles are then searched for components, however long these are.
    """
    ship(mask.sparkSession)
    place = [F.floor(F.col(c) / tile).cast("int") for c in ("y", "x")]
    reach = 1 if diagonal else 0

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], ignore_index=True)
        ly, lx = tile_labels(pdf["y"].to_numpy(), pdf["x"].to_numpy(), reach)
        return pdf.assign(ly=ly, lx=lx)[[*keys, "y", "x", "ly", "lx"]]

    base = mask.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    tiled = base.withColumns({"ty": place[0], "tx": place[1]})
    kinds = ", ".join(f"{k} {base.schema[k].dataType.simpleString()}" for k in keys)
    local = materialise(tiled.groupBy(*keys, "ty", "tx").applyInPandas(label, f"{kinds + ', ' if keys else ''}y int, x int, ly int, lx int"), "labels")
    node = F.struct(*keys, "ly", "lx")
    moves = [(-1, 0), (0, -1), *([(-1, -1), (-1, 1)] if diagonal else [])]
    across = local.select(*keys, node.alias("a"), F.col("y").alias("y0"), F.col("x").alias("x0"), F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in moves])).alias("m"))
    across = across.select(*keys, "a", "y0", "x0", (F.col("y0") + F.col("m.dy")).alias("y"), (F.col("x0") + F.col("m.dx")).alias("x")).where((F.floor(F.col("y") / tile) != F.floor(F.col("y0") / tile)) | (F.floor(F.col("x") / tile) != F.floor(F.col("x0") / tile)))
    edges = materialise(across.join(local.select(*keys, "y", "x", node.alias("b")).hint("merge"), [*keys, "y", "x"]).select("a", "b").distinct(), "edges")
    named = local.select(*keys, "y", "x", node.alias("label"))
    if edges.isEmpty():
        return named
    found = sized(components(edges).withColumnRenamed("node", "label"))
    return named.join(found, "label", "left").select(*keys, "y", "x", F.coalesce("comp", "label").alias("label"))


def enclosed(mask: DataFrame, h: int, w: int, keys: tuple[str, ...]) -> DataFrame:
    """The labelled parts of the background that touch no edge of the image."""
    parts = materialise(label_components(complement(mask, h, w, keys), keys=keys), "ground")
    edge = (F.col("y") == 0) | (F.col("y") == h - 1) | (F.col("x") == 0) | (F.col("x") == w - 1)
    return parts.join(sized(materialise(parts.where(edge).select("label").distinct(), "outside")), "label", "left_anti")


def mask_fill_holes(mask: DataFrame, h: int, w: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The mask and all background that 4-connected paths don't join to the image's edge."""
    return mask.select(*keys, "y", "x").union(enclosed(mask, h, w, keys).select(*keys, "y", "x"))


def largest_component(mask: DataFrame, h: int, w: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The 8-connected component of each frame whose outer contour encloses the most area, filled; ties to the first.

    The contour runs through the centres of pixels. What it encloses of a unit
    cell between four of them is the whole cell where all four belong to the filled
    component, half of it where three do, and nothing else.
    """
    parts = materialise(label_components(mask, diagonal=True, keys=keys), "parts")
    # A hole lies in the component of the pixel left of its first one.
    holes = materialise(enclosed(mask, h, w, keys), "holes")
    first = holes.groupBy("label").agg(F.min(F.struct("y", "x", *keys)).alias("p")).select("label", *[F.col(f"p.{k}").alias(k) for k in keys], F.col("p.y").alias("y"), (F.col("p.x") - 1).alias("x"))
    owner = first.join(parts.select(*keys, "y", "x", F.col("label").alias("owner")).hint("merge"), [*keys, "y", "x"]).select("label", "owner")
    filled = parts.select(*keys, "y", "x", F.col("label").alias("owner")).unionByName(holes.join(owner.hint("merge"), "label").select(*keys, "y", "x", "owner"))
    filled = materialise(filled, "filled")
    corners = shifted(filled, [(0, 0), (0, -1), (-1, 0), (-1, -1)], (*keys, "owner")).groupBy(*keys, "owner", "y", "x").agg(F.count("*").alias("_m"))
    sizes = corners.groupBy(*keys, "owner").agg(F.sum(F.when(F.col("_m") == 4, 2).when(F.col("_m") == 3, 1).otherwise(0)).alias("n"))
    best = sizes.groupBy(*keys).agg(F.min_by("owner", F.struct(-F.col("n"), F.col("owner"))).alias("owner")).select("owner")
    return filled.join(sized(materialise(best, "best")), "owner", "left_semi").select(*keys, "y", "x")


def seed_in_roi(seed: tuple[int, int], mask: DataFrame) -> DataFrame:
    """The seed (x, y) as one row if it lies in the mask, else none."""
    return mask.distinct().where((F.col("x") == seed[0]) & (F.col("y") == seed[1]))


def roi_size(mask: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return mask.groupBy(*keys).agg(F.count("*").alias("n_pixels"))


def apply_dynamic_mask(disp: DataFrame, mask: DataFrame, h: int, w: int) -> DataFrame:
    """Only the points that land inside their frame's mask (frame_idx, y, x), positions rounded half to even."""
    to_y, to_x = F.rint(F.col("y") + F.col("v")).cast("int"), F.rint(F.col("x") + F.col("u")).cast("int")
    moved = disp.withColumns({"_y": to_y, "_x": to_x}).where(F.col("_y").between(0, h - 1) & F.col("_x").between(0, w - 1))
    inside = mask.select("frame_idx", F.col("y").alias("_y"), F.col("x").alias("_x"))
    return moved.join(inside.hint("merge"), ["frame_idx", "_y", "_x"], "left_semi").drop("_y", "_x")
