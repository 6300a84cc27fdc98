"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom.runtime import materialise, ship

#: Bytes of text that a kernel holds as Python objects at once.
SLICE_BYTES = 2 << 20
#: A key with more than one in so many rows is hot; so many keys at most can be.
HOT_SHARE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else the table holds."""
    return docs.select(*[docs[c] for c in columns])


def map_arrow(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(kernel, schema)


def slices(batches: Iterator[pa.RecordBatch], text_at: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def record(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def hot_keys(rows: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """The keys that hold more than one in ``share`` of the written ``rows``, so fewer than ``share`` of them; written."""
    total = rows.count()
    return materialise(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") * share > total).where(F.col("_n") > share).select(*keys), "hot")


def look_up(rows: DataFrame, known: DataFrame, keys: list[str], cells: int, share: int = HOT_SHARE) -> DataFrame:
    """The written ``rows`` with what the written ``known`` has for their keys, NULL where it has nothing.

    ``known`` holds each key once. It is broadcast where it is small. Else only
    what it has for hot keys is, which are fewer than ``share`` by definition, and
    all other rows are joined by shuffling; so no key fills a task.
    """
    if known.count() * len(known.columns) <= cells:
        return rows.join(known.hint("broadcast"), keys, "left")
    hot = hot_keys(rows, keys, share).withColumn("_hot", F.lit(True)).hint("broadcast")
    marked = rows.join(hot, keys, "left")
    common = known.join(hot, keys, "left_semi")
    rare = marked.where("_hot is null").drop("_hot").join(known.hint("merge"), keys, "left")
    return rare.unionByName(marked.where("_hot").drop("_hot").join(common.hint("broadcast"), keys, "left"))


def lower_ascii(c: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def long_hash(c: Column) -> Column:
    return F.xxhash64(c)
