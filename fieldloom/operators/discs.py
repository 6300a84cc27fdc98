"""Sums over discs of a lattice from running sums along its rows."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def disc_sums(points: DataFrame, cells: DataFrame, sums: dict[str, Column], r: int, keys: tuple[str, ...], low: int, high: int, spacing: int = 1) -> DataFrame:
    """keys, y, x of ``points`` and, for each name, the sum of its column over the cells at most r away.

    ``cells`` (keys, y, x, ...) fill the lattice of pitch ``spacing`` from column
    ``low`` to ``high`` in every row they have. A disc is one run of cells in each of its
    rows, and the sum of a run is the difference of two running sums. So a point
    asks for two rows of each of its 2 r + 1 lines, not for all cells of its disc.
    """
    line = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    running = cells.select(*keys, "y", "x", *[F.sum(c).over(line).alias(f"_{k}") for k, c in sums.items()])
    runs = [(dy, isqrt(r * r - dy * dy) // spacing * spacing) for dy in range(-(r // spacing) * spacing, r + 1, spacing)]
    ends = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(sign).alias("sign")) for dy, half in runs for dx, sign in ((half, 1.0), (-half - spacing, -1.0))])
    asked = points.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(ends).alias("e"))
    asked = asked.select(*keys, "_y", "_x", (F.col("_y") + F.col("e.dy")).alias("y"), F.least(F.col("_x") + F.col("e.dx"), F.lit(high)).alias("x"), F.col("e.sign").alias("_sign")).where(F.col("x") >= low)
    met = asked.join(running.hint("merge"), [*keys, "y", "x"])
    got = met.groupBy(*keys, "_y", "_x").agg(*[F.sum(F.col("_sign") * F.col(f"_{k}")).alias(k) for k in sums])
    return got.withColumnsRenamed({"_y": "y", "_x": "x"})
