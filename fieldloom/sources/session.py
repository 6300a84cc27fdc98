"""Results on disk: session folders, masks and CSV matrices."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a session, in the order of its schema (fixed values).
FIELDS = "u v Exx Exy Eyy Eeff Vx Vy Veff du_dx du_dy dv_dx dv_dy dVx_dx dVx_dy dVy_dx dVy_dy Exx_rate Exy_rate Eyy_rate Eeff_rate corr".split()
#: Fields of a CSV export (fixed values): no displacement gradients.
CSV_FIELDS = "u v Exx Exy Eyy Eeff Vx Vy Veff dVx_dx dVx_dy dVy_dx dVy_dy Exx_rate Exy_rate Eyy_rate Eeff_rate corr".split()
#: quantity -> unit and its fields, by rank of the quantity.
QUANTITIES = {
    "displacement": ("px", {"u": "x", "v": "y"}),
    "velocity": ("px/s", {"Vx": "x", "Vy": "y", "Veff": "speed"}),
    "strain": ("1", {"Exx": "xx", "Eyy": "yy", "Exy": "xy", "Eeff": "effective"}),
    "strain rate": ("1/s", {"Exx_rate": "xx", "Eyy_rate": "yy", "Exy_rate": "xy", "Eeff_rate": "effective"}),
}
DEFAULTS = {"fps": 1.0}


def field_dim(spark: SparkSession) -> DataFrame:
    """name, quantity, component and unit of every field that a viewer offers."""
    rows = [(name, quantity, part, unit) for quantity, (unit, fields) in QUANTITIES.items() for name, part in fields.items()]
    return spark.createDataFrame(rows, "name string, quantity string, component string, unit string")


def long_form(field: DataFrame) -> DataFrame:
    """frame_idx, y, x, name, value, quantity, component and unit: one row per present value of a catalogued field."""
    names = [c for _, fields in QUANTITIES.values() for c in fields if c in field.columns]
    values = field.unpivot(["frame_idx", "y", "x"], names, "name", "value").where("value is not null")
    # The catalogue has one row per field of the schema, hence the broadcast.
    return values.join(field_dim(field.sparkSession).hint("broadcast"), "name").select("frame_idx", "y", "x", "name", "value", "quantity", "component", "unit")


def write_session(field: DataFrame, roi: DataFrame, meta: dict, path: str) -> None:
    """Folders meta, roi and field (one partition per frame, floats, gzip)."""
    spark = field.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    roi.select("y", "x").write.mode("overwrite").option("compression", "gzip").parquet(f"{path}/roi")
    has = [c for c in FIELDS if c in field.columns]
    field.select("frame_idx", "y", "x", *[F.col(c).cast("float") for c in has]).write.mode("overwrite").partitionBy("frame_idx").option("compression", "gzip").parquet(f"{path}/field")


def read_session(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """meta, roi and field; absent attributes take defaults, absent fields are NULL."""
    meta = DEFAULTS | json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    field = spark.read.parquet(f"{path}/field")
    full = field.select("frame_idx", "y", "x", *[F.col(c) if c in field.columns else F.lit(None).cast("float").alias(c) for c in FIELDS])
    return meta, spark.read.parquet(f"{path}/roi"), full


def write_mask(mask: DataFrame, path: str, keys: tuple[str, ...] = ()) -> None:
    mask.select(*keys, "y", "x", F.lit(255).alias("val")).write.mode("overwrite").parquet(path)


def csv_rows(field: DataFrame, c: str, frame_idx: int, h: int, w: int) -> DataFrame:
    """y and the comma-separated line of each row of the dense matrix; missing values are nan."""
    rows = field.sparkSession.range(h).select(F.col("id").cast("int").alias("y"))
    cells = rows.select("y", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x")).join(field.where(F.col("frame_idx") == frame_idx).select("y", "x", F.col(c).alias("v")).hint("merge"), ["y", "x"], "left")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", F.coalesce(F.col("v").cast("string"), F.lit("nan")).alias("s")))), lambda s: s["s"]), ",")
    return cells.groupBy("y").agg(line.alias("line"))


def export_csv(field: DataFrame, frame_idx: int, h: int, w: int, base: str) -> None:
    """One folder <base>_<field>.csv for each present field."""
    for c in CSV_FIELDS:
        if c in field.columns:
            csv_rows(field, c, frame_idx, h, w).repartitionByRange("y").sortWithinPartitions("y").select("line").write.mode("overwrite").text(f"{base}_{c}.csv")
