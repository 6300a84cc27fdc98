"""Operators on pixel tables (frame_id, y, x, val); borders mirror without repeating the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the 5-tap smoothing kernels (fixed values).
GAUSS = [1, 4, 6, 4, 1]
BOX = [1, 1, 1, 1, 1]


def with_halo(pixel: DataFrame, c: str, r: int, axis: str, n: int) -> DataFrame:
    """``pixel`` extended by r mirrored pixels at both ends of ``axis``."""
    a = F.col(axis)
    low = pixel.where(a.between(1, r)).withColumn(axis, -a)
    high = pixel.where(a.between(n - 1 - r, n - 2)).withColumn(axis, 2 * (n - 1) - a)
    return pixel.unionByName(low).unionByName(high)


def along(axis: str, keys: tuple[str, ...] = ("frame_id",)) -> Window:
    other = "x" if axis == "y" else "y"
    return Window.partitionBy(*keys, other).orderBy(axis)


def filtered(pixel: DataFrame, columns: dict[str, tuple[str, list[int]]], axis: str, n: int) -> DataFrame:
    """New columns, each the weighted sum of a source column over neighbours along ``axis``."""
    r = max(len(k) for _, k in columns.values()) // 2
    w = along(axis)
    out = {}
    for name, (source, kernel) in columns.items():
        half = len(kernel) // 2
        terms = [F.lag(F.col(source), -o).over(w) * k for o, k in zip(range(-half, half + 1), kernel, strict=True) if k]
        total: Column = terms[0]
        for t in terms[1:]:
            total = total + t
        out[name] = total
    return with_halo(pixel, "", r, axis, n).withColumns(out).where(F.col(axis).between(0, n - 1))


def local_std(pixel: DataFrame, h: int, w: int, size: int = 9) -> DataFrame:
    ones = [1] * size
    p = pixel.withColumn("sq", F.col("val") * F.col("val"))
    p = filtered(p, {"s1": ("val", ones), "s2": ("sq", ones)}, "y", h)
    p = filtered(p, {"t1": ("s1", ones), "t2": ("s2", ones)}, "x", w)
    n = float(size * size)
    mean = F.col("t1") / n
    return p.select("frame_id", "y", "x", F.sqrt(F.greatest(F.col("t2") / n - mean * mean, F.lit(0.0))).alias("val"))


def sobel(pixel: DataFrame, h: int, w: int) -> DataFrame:
    p = filtered(pixel, {"sy": ("val", [1, 2, 1]), "dy": ("val", [-1, 0, 1])}, "y", h)
    p = filtered(p, {"gx": ("sy", [-1, 0, 1]), "gy": ("dy", [1, 2, 1])}, "x", w)
    return p.select("frame_id", "y", "x", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("val"))


def smooth(pixel: DataFrame, h: int, w: int, kind: str) -> DataFrame:
    """Gaussian or box of 5 x 5 on greyscale codes, rounded half to even."""
    kernel = GAUSS if kind == "gauss" else BOX
    p = filtered(filtered(pixel, {"s": ("val", kernel)}, "y", h), {"t": ("s", kernel)}, "x", w)
    return p.select("frame_id", "y", "x", F.rint(F.col("t") / float(sum(kernel) ** 2)).alias("val"))


def to_u8(metric: DataFrame) -> DataFrame:
    """Metric over its frame's maximum, in 0 to 255, truncated; frames that are zero throughout stay zero."""
    top = metric.groupBy("frame_id").agg(F.max("val").alias("_top"))
    both = metric.join(top.hint("merge"), "frame_id")
    return both.select("frame_id", "y", "x", F.when(F.col("_top") > 0, F.floor(F.col("val") / F.col("_top") * 255.0)).otherwise(0).cast("int").alias("val"))


def otsu(codes: DataFrame) -> DataFrame:
    """frame_id, threshold: the code that maximises the variance between the classes <= t and > t; the first among equals."""
    hist = codes.groupBy("frame_id", "val").agg(F.count("*").alias("n"))
    w = Window.partitionBy("frame_id").orderBy("val")
    whole = Window.partitionBy("frame_id")
    h = hist.withColumns({"n0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("val")).over(w), "n1": F.sum("n").over(whole), "s1": F.sum(F.col("n") * F.col("val")).over(whole)})
    n0, s0, rest, s1 = F.col("n0"), F.col("s0"), F.col("n1") - F.col("n0"), F.col("s1") - F.col("s0")
    gap = s0 / n0 - F.when(rest > 0, s1 / rest)
    between = F.coalesce(n0.cast("double") * rest * gap * gap, F.lit(0.0))
    return h.withColumn("b", F.round(between, 6)).groupBy("frame_id").agg(F.max_by("val", F.struct(F.col("b"), -F.col("val"))).alias("threshold"))


def above(codes: DataFrame, thresholds: DataFrame) -> DataFrame:
    return codes.join(thresholds.hint("merge"), "frame_id").where(F.col("val") > F.col("threshold")).select("frame_id", "y", "x")


def mask_from_pixels(pixel: DataFrame) -> DataFrame:
    """Pixels over half of their image's maximum."""
    top = pixel.groupBy("frame_id").agg(F.max("val").alias("_top"))
    return pixel.join(top.hint("merge"), "frame_id").where(F.col("val") > 0.5 * F.col("_top")).select("frame_id", "y", "x")


def dynamic_mask(pixel: DataFrame, h: int, w: int, method: str = "Hybrid") -> DataFrame:
    """Thresholded texture of each frame, closed, and of that the largest component, filled. Unknown methods give no mask."""
    from fieldloom.operators.masks import largest_component, morph_close
    from fieldloom.runtime import materialise

    if method not in ("Contrast", "Edge Detection", "Hybrid"):
        return pixel.select("frame_id", "y", "x").limit(0)
    parts = {"Contrast": [local_std], "Edge Detection": [sobel], "Hybrid": [local_std, sobel]}[method]
    # Each step is used twice (values and their maximum), so it is written once.
    scaled = lambda metric: to_u8(materialise(metric, "metric"))
    codes = scaled(parts[0](pixel, h, w))
    for f in parts[1:]:
        more = scaled(f(pixel, h, w)).withColumnRenamed("val", "val2")
        codes = scaled(codes.join(more.hint("merge"), ["frame_id", "y", "x"]).select("frame_id", "y", "x", (F.col("val") + F.col("val2")).cast("double").alias("val")))
    blurred = materialise(smooth(codes.withColumn("val", F.col("val").cast("double")), h, w, "box" if method == "Edge Detection" else "gauss").withColumn("val", F.col("val").cast("int")), "blurred")
    closed = materialise(morph_close(above(blurred, otsu(blurred)), h, w, 15, ("frame_id",)), "closed")
    return largest_component(closed, h, w, ("frame_id",))
