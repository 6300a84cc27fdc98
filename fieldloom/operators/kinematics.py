"""Velocities, strain rates, strains and trajectories of gridded fields (frame_idx, y, x, ...).

A missing value is NULL. Frames are 0 to n_frames - 1 whether or not they hold a
point; every operator that looks along time first makes each point's frames
complete, since a window over rows would jump over absent ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.expressions import effective
from fieldloom.operators.discs import disc_sums
from fieldloom.runtime import materialise

LEAST_POINTS, LEAST_DET = 6, 1e-12


def dense_frames(field: DataFrame, n_frames: int) -> DataFrame:
    """Every point of ``field`` at every frame; values are NULL where it has none."""
    points = field.select("y", "x").distinct()
    full = points.select(F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))).alias("frame_idx"), "y", "x")
    return full.join(field.hint("merge"), ["frame_idx", "y", "x"], "left")


def along_time() -> Window:
    return Window.partitionBy("y", "x").orderBy("frame_idx")


def finite_diff(c: str, n_frames: int, fps: float) -> Column:
    """Central difference in time, one-sided at both ends; expects dense frames."""
    if n_frames < 2:
        return F.lit(None).cast("double")
    dt, w, v = 1.0 / max(fps, 1e-9), along_time(), F.col(c)
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    return F.when(F.col("frame_idx") == 0, (after - v) / dt).when(F.col("frame_idx") == n_frames - 1, (v - before) / dt).otherwise((after - before) / (2 * dt))


def velocity(field: DataFrame, n_frames: int, fps: float) -> DataFrame:
    """``field`` on dense frames with Vx, Vy and Veff. A velocity may exist where u itself is missing."""
    dense = dense_frames(field, n_frames)
    both = dense.withColumns({"Vx": finite_diff("u", n_frames, fps), "Vy": finite_diff("v", n_frames, fps)})
    return both.withColumn("Veff", F.sqrt(F.col("Vx") * F.col("Vx") + F.col("Vy") * F.col("Vy")))


def complete_lattice(field: DataFrame, spacing: int) -> DataFrame:
    """Every lattice point of the bounding box in every frame of ``field``, with the box's origin (y0, x0).

    The box is one row and frames are few against points, so both are broadcast.
    """
    box = field.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).where("y0 is not null")
    rows = box.select("y0", "x0", "x1", F.explode(F.sequence("y0", "y1", F.lit(spacing))).alias("y")).select("y", F.explode(F.sequence("x0", "x1", F.lit(spacing))).alias("x"), "y0", "x0")
    frames = field.select("frame_idx").distinct().agg(F.sort_array(F.collect_set("frame_idx")).alias("frames"))
    points = rows.join(frames.hint("broadcast"), F.lit(True)).select(F.explode("frames").alias("frame_idx"), "y", "x", "y0", "x0")
    return points.join(field.hint("merge"), ["frame_idx", "y", "x"], "left")


def plane_fit(field: DataFrame, columns: list[str], radius: int, spacing: int, valid: Column | None = None, shape: str = "square") -> DataFrame:
    """Slopes d<c>_dx and d<c>_dy of the least-squares plane over the square, or disc, of ``radius`` pixels.

    Only valid points take part and get a result, which also needs six points
    and a regular system. Sums go over y within a column and then over x within
    a row, on the complete lattice: no self-join. A disc's sums are taken line by
    line (``disc_sums``). Coordinates count from the
    origin of the bounding box, since large ones would cancel in the sums.
    """
    if shape not in ("square", "disc"):
        raise ValueError("a neighbourhood is a square or a disc")
    ok = valid if valid is not None else F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    lattice = complete_lattice(field, spacing).withColumn("_w", F.coalesce(ok, F.lit(False)).cast("double"))
    x, y, w = (F.col("x") - F.col("x0")).cast("double"), (F.col("y") - F.col("y0")).cast("double"), F.col("_w")
    moments = {"n": w, "sx": w * x, "sy": w * y, "sxx": w * x * x, "syy": w * y * y, "sxy": w * x * y}
    for c in columns:
        v = F.when(w > 0, F.col(c)).otherwise(0.0)
        moments |= {f"s_{c}": v, f"sx_{c}": v * x, f"sy_{c}": v * y}
    if shape == "disc":
        lattice = materialise(lattice, "lattice")
        box = lattice.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
        sums = disc_sums(lattice.where(w > 0), lattice, moments, radius, ("frame_idx",), box["low"] or 0, box["high"] or 0, spacing)
        lattice = lattice.join(sums.withColumnsRenamed({k: f"_{k}" for k in moments}).hint("merge"), ["frame_idx", "y", "x"], "left")
    for keys, order in () if shape == "disc" else ((("frame_idx", "x"), "y"), (("frame_idx", "y"), "x")):
        span = Window.partitionBy(*keys).orderBy(order).rangeBetween(-radius, radius)
        source = moments if order == "y" else {k: F.col(f"_{k}") for k in moments}
        lattice = lattice.withColumns({f"_{k}": F.sum(m).over(span) for k, m in source.items()})
    s = {k: F.col(f"_{k}") for k in moments}
    # Divisors are NULL where they may not be used: a shared division can be computed outside of the condition that guards it.
    n = F.when(s["n"] >= LEAST_POINTS, s["n"])
    cxx, cyy, cxy = s["sxx"] - s["sx"] * s["sx"] / n, s["syy"] - s["sy"] * s["sy"] / n, s["sxy"] - s["sx"] * s["sy"] / n
    det = cxx * cyy - cxy * cxy
    det = F.when((w > 0) & (det > LEAST_DET), det)
    slopes = {}
    for c in columns:
        cux, cuy = s[f"sx_{c}"] - s[f"s_{c}"] * s["sx"] / n, s[f"sy_{c}"] - s[f"s_{c}"] * s["sy"] / n
        slopes[f"d{c}_dx"] = (cux * cyy - cuy * cxy) / det
        slopes[f"d{c}_dy"] = (cuy * cxx - cux * cxy) / det
    return lattice.select(*field.columns, *[v.alias(k) for k, v in slopes.items()])


def strain_rate(field: DataFrame, radius: int, spacing: int, valid: Column | None = None) -> DataFrame:
    """Exx_rate, Eyy_rate, Exy_rate and Eeff_rate from the gradient of the velocity."""
    fit = plane_fit(field, ["Vx", "Vy"], radius, spacing, valid)
    rates = fit.withColumns({"Exx_rate": F.col("dVx_dx"), "Eyy_rate": F.col("dVy_dy"), "Exy_rate": 0.5 * (F.col("dVx_dy") + F.col("dVy_dx"))})
    return rates.withColumn("Eeff_rate", effective(F.col("Exx_rate"), F.col("Eyy_rate"), F.col("Exy_rate")))


def integrate_strain(field: DataFrame, fps: float) -> DataFrame:
    """Exx, Eyy, Exy and Eeff: running trapezoid of the rates on dense frames.

    A missing rate counts as 0 and the sum goes on through gaps; only the output
    is missing where u is.
    """
    dt, w = 1.0 / max(fps, 1e-9), along_time()
    out = {}
    for c in ("Exx", "Eyy", "Exy"):
        r = F.coalesce(F.col(f"{c}_rate"), F.lit(0.0))
        field = field.withColumn(f"_{c}", F.when(F.col("frame_idx") == 0, 0.0).otherwise(0.5 * (F.coalesce(F.lag(r).over(w), F.lit(0.0)) + r) * dt))
        out[c] = F.when(F.col("u").isNotNull(), F.sum(f"_{c}").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    done = field.withColumns(out).drop("_Exx", "_Eyy", "_Exy")
    return done.withColumn("Eeff", effective(F.col("Exx"), F.col("Eyy"), F.col("Exy")))


def kinematics(disp: DataFrame, n_frames: int, fps: float, radius: int, spacing: int, roi: DataFrame | None = None) -> DataFrame:
    """Velocities, rates and strains of a displacement field; rates only inside ``roi`` (y, x)."""
    field = velocity(disp, n_frames, fps)
    if roi is not None:
        inside = roi.select("y", "x", F.lit(True).alias("_in")).distinct()
        field = field.join(inside.hint("merge"), ["y", "x"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    rated = strain_rate(field, radius, spacing, F.col("_in") if roi is not None else None)
    rated = rated.join(field.select("y", "x").distinct().hint("merge"), ["y", "x"], "left_semi").drop("_in")
    return integrate_strain(rated, fps)


def green_lagrange(field: DataFrame, radius: int, spacing: int, shape: str = "square") -> DataFrame:
    """GExx, GEyy, GExy from the displacement gradient, plane-fitted over a square or a disc."""
    fit = plane_fit(field, ["u", "v"], radius, spacing, shape=shape)
    ux, uy, vx, vy = (F.col(c) for c in ("du_dx", "du_dy", "dv_dx", "dv_dy"))
    return fit.withColumns({"GExx": 0.5 * (2 * ux + ux * ux + vx * vx), "GEyy": 0.5 * (2 * vy + uy * uy + vy * vy), "GExy": 0.5 * (uy + vx + ux * uy + vx * vy)})


def trajectories(field: DataFrame, max_frame: int, step: int = 10) -> DataFrame:
    """y, x and path (frame_idx, x, y) of every step-th row and column valid at frame 0, up to its first missing frame."""
    if max_frame < 0:
        return field.sparkSession.createDataFrame([], "y int, x int, path array<struct<frame_idx:int,x:double,y:double>>")
    start = field.where("frame_idx = 0 and u is not null and v is not null").select("y", "x")
    # A grid has at most as many rows or columns as an image has pixels on a side, so each list is ranked by itself and broadcast.
    rank = lambda c: start.select(c).distinct().withColumn("_r", F.row_number().over(Window.orderBy(c)) - 1).where(F.col("_r") % step == 0).select(c)
    seeds = start.join(rank("y").hint("broadcast"), "y").join(rank("x").hint("broadcast"), "x")
    dense = dense_frames(field.where(F.col("frame_idx") <= max_frame).select("frame_idx", "y", "x", "u", "v").join(seeds.hint("merge"), ["y", "x"], "left_semi"), max_frame + 1)
    gone = F.max((F.col("u").isNull() | F.col("v").isNull()).cast("int")).over(along_time().rowsBetween(Window.unboundedPreceding, 0))
    live = dense.withColumn("_gone", gone).where("_gone = 0")
    node = F.struct("frame_idx", (F.col("x") + F.col("u")).alias("x"), (F.col("y") + F.col("v")).alias("y"))
    paths = live.groupBy("y", "x").agg(F.array_sort(F.collect_list(node)).alias("path"))
    begin = F.array(F.struct(F.lit(-1).alias("frame_idx"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    return paths.select("y", "x", F.concat(begin, "path").alias("path")).where(F.size("path") > 1)


def probe(field: DataFrame, x: float, y: float) -> DataFrame:
    return field.where((F.col("x") == int(x)) & (F.col("y") == int(y)))


def trapz_error(series: DataFrame, rate: str, value: str, fps: float) -> DataFrame:
    """A per-frame series with its rate integrated again, and the relative error of that.

    The series has one row per frame, hence one window over all of it.
    """
    w = Window.orderBy("frame_idx")
    r = F.coalesce(F.col(rate), F.lit(0.0))
    part = F.when(F.row_number().over(w) == 1, 0.0).otherwise(0.5 * (F.lag(r).over(w) + r) / fps)
    again = series.withColumn("_part", part).withColumn("again", F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_part")
    return again.withColumn("error", F.when(F.col(value) != 0, F.abs(F.col("again") - F.col(value)) / F.abs(F.col(value))))
