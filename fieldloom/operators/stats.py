"""Statistics and scaling of a field's column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.expressions import normalised, symmetric, widened


def frames_of(n_frames: int, spark) -> DataFrame:
    return spark.range(n_frames).select(F.col("id").cast("int").alias("frame_idx"))


def field_stats(field: DataFrame, c: str, n_frames: int) -> DataFrame:
    """Mean, population deviation, least, largest and number of valid values of every frame."""
    got = field.groupBy("frame_idx").agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("n_valid"))
    return frames_of(n_frames, field.sparkSession).join(got.hint("merge"), "frame_idx", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))


def frame_range(field: DataFrame, c: str) -> DataFrame:
    return field.groupBy("frame_idx").agg(F.min(c).alias("lo"), F.max(c).alias("hi"))


def global_range(field: DataFrame, c: str) -> DataFrame:
    return field.agg(F.coalesce(F.min(c), F.lit(0.0)).alias("lo"), F.coalesce(F.max(c), F.lit(1.0)).alias("hi"))


def robust_range(field: DataFrame, c: str) -> DataFrame:
    """2nd and 98th percentile of every frame, interpolated."""
    p = F.percentile(c, F.array(F.lit(0.02), F.lit(0.98)))
    return field.groupBy("frame_idx").agg(p.alias("p")).select("frame_idx", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def scale_range(ranges: DataFrame, sym: bool) -> DataFrame:
    lo, hi = F.col("lo"), F.col("hi")
    lo, hi = symmetric(lo, hi) if sym else (lo, hi)
    return ranges.withColumns({"lo": lo, "hi": widened(lo, hi)})


def normalize(field: DataFrame, c: str, ranges: DataFrame) -> DataFrame:
    """``field`` with <c>_norm in [0, 1]; ``ranges`` holds one row per frame."""
    both = field.join(ranges.select("frame_idx", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).hint("merge"), "frame_idx", "left")
    return both.withColumn(f"{c}_norm", normalised(F.col(c), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def survival(disp: DataFrame, n_grid: int, n_frames: int, least: float = 0.6) -> DataFrame:
    """Valid points of every frame, their share of the grid, and whether the frame must be redone."""
    got = disp.where("u is not null").groupBy("frame_idx").agg(F.count("*").alias("n"))
    rate = F.col("n_valid") / F.lit(float(max(1, n_grid)))
    full = frames_of(n_frames, disp.sparkSession).join(got.hint("merge"), "frame_idx", "left").select("frame_idx", F.coalesce("n", F.lit(0)).alias("n_valid"))
    return full.select("frame_idx", "n_valid", rate.alias("survival"), (rate < least).alias("redo"))


def next_guess(disp: DataFrame) -> DataFrame:
    """Exact median u and v of every frame's survivors."""
    return disp.where("u is not null").groupBy("frame_idx").agg(F.percentile("u", F.lit(0.5)).alias("u0"), F.percentile("v", F.lit(0.5)).alias("v0"))


def agreement(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """R squared, bias and limits of agreement of the same column in two fields."""
    both = a.select("frame_idx", "y", "x", F.col(c).alias("a")).join(b.select("frame_idx", "y", "x", F.col(c).alias("b")), ["frame_idx", "y", "x"]).where("a is not null and b is not null")
    d = F.col("a") - F.col("b")
    got = both.agg(F.count("*").alias("n"), F.pow(F.corr("a", "b"), 2).alias("r2"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"))
    return got.select("n", "r2", "bias", (F.col("bias") - 1.96 * F.col("sd")).alias("low"), (F.col("bias") + 1.96 * F.col("sd")).alias("high"))


def mean_series(field: DataFrame, c: str) -> DataFrame:
    return field.groupBy("frame_idx").agg(F.avg(c).alias("mean"))
