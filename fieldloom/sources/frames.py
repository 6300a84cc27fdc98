"""Frame manifests: listing, selection, timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.runtime import materialise, sized

EXTENSIONS = ("png", "tif", "tiff", "jpg", "jpeg", "bmp")


def scan_frames(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path of every image in the folder itself, whatever the case of its extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions))


def ranked(rows: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """``rows`` with their place (from 0) in the order of ``order``, which has no ties.

    Rows are written in sorted ranges; the ranges' counts are summed (one number
    per range) and each range is numbered by itself, so no task sees all rows.
    """
    part = F.spark_partition_id()
    held = materialise(rows.repartitionByRange(*order).withColumn("_part", part), "ranges")
    before = held.groupBy("_part").agg(F.count("*").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return held.join(sized(before), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_before")


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def detect_roi(manifest: DataFrame) -> DataFrame:
    """The largest path whose name holds "roi"; NULL if none does."""
    return manifest.where(base_name(F.col("path")).contains("roi")).agg(F.max("path").alias("roi_path"))


def select_frames(manifest: DataFrame, step: int = 1, limit: int | None = None) -> DataFrame:
    """frame_idx, path, is_reference: files sorted by name without ROI files; the first is the
    reference (frame_idx -1), of the rest every step-th, ``limit`` at most.
    Fewer than two images, or none left by the limit, are an error.
    """
    files = ranked(manifest.where(~base_name(F.col("path")).contains("roi")), ["path"])
    if files.where("rn = 1").isEmpty():
        raise ValueError("there are fewer than two images")
    if limit is not None and limit < 1:
        raise ValueError("no deformed image is selected")
    kept = files.where((F.col("rn") == 0) | ((F.col("rn") - 1) % step == 0)).select("path", (F.col("rn") == 0).alias("is_reference"), F.when(F.col("rn") == 0, -1).otherwise(((F.col("rn") - 1) / step).cast("int")).alias("frame_idx"))
    return kept if limit is None else kept.where(F.col("frame_idx") < limit)


def sample_range(frames: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """Frames (idx) from start to end, both included, every step-th."""
    if end < start:
        raise ValueError("the range ends before it starts")
    return frames.where(F.col("idx").between(start, end) & (F.pmod(F.col("idx") - start, F.lit(step)) == 0))


def split_reference(frames: DataFrame, ref_idx: int) -> DataFrame:
    """frame_idx -1 for the reference (clamped to the last file), 0, 1, ... for all others in order."""
    top = frames.agg(F.max("idx").alias("_top"))
    ref = F.least(F.lit(ref_idx), F.col("_top"))
    both = frames.join(top.hint("broadcast"), F.lit(True))
    return both.select("path", (F.col("idx") == ref).alias("is_reference"), F.when(F.col("idx") == ref, -1).otherwise(F.col("idx") - (F.col("idx") > ref).cast("int")).cast("int").alias("frame_idx"))


def effective_fps(meta: DataFrame, user: float | None, step: int) -> DataFrame:
    """fps of the metadata (column fps), else the user's, else 1, divided by the step."""
    return meta.agg(F.max("fps").alias("m")).select((F.coalesce(F.col("m"), F.lit(user).cast("double"), F.lit(1.0)) / step).alias("fps"))


def with_time(frames: DataFrame, fps: float) -> DataFrame:
    return frames.withColumn("t_sec", F.col("frame_idx") / F.lit(float(fps)))


def pick_mask(candidates: DataFrame) -> DataFrame:
    """The name of the table (name, val) that holds only 0 and 1 with the largest sum; ties to the first name. No such table is an error."""
    sums = candidates.groupBy("name").agg(F.min(F.col("val").isin(0, 1)).alias("ok"), F.sum("val").alias("n")).where("ok")
    if sums.isEmpty():
        raise ValueError("no candidate holds only 0 and 1")
    return sums.agg(F.min_by(F.struct("name", "n"), F.struct(-F.col("n"), F.col("name"))).alias("m")).select(F.col("m.name").alias("name"), F.col("m.n").alias("n"))


def shapes_agree(meta: DataFrame) -> DataFrame:
    """same: whether all images (h, w) have one shape."""
    return meta.agg((F.countDistinct(F.struct("h", "w")) <= 1).alias("same"))
