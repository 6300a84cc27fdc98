"""Session helpers: where shared files go, and how kernels reach the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: Numbers that may be broadcast (8 bytes each); larger tables are joined by shuffling.
BROADCAST_CELLS = 250_000
#: Bytes of rows that go to a Python worker at once, unless the session says otherwise.
BATCH_BYTES = 4 << 20
#: Rows of a row group where rows hold 100 KB and more. Sizes are looked at from the 100th row on, and a reader unpacks a row group's rows at once.
WIDE = {"parquet.block.row.count.limit": 16}
#: Folders written so far, by context.
_WRITTEN: dict[int, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and
    driver and executors are one process on one machine, as in tests, a new
    local folder is made and set; a cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    top = f"{shared_dir(spark)}/fieldloom-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(id(spark.sparkContext), []).append(top)
    return f"{top}/{name}"


def materialise(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; ``wide`` rows in small row groups (``WIDE``).

    This cuts the lineage, survives lost executors and gives later joins true
    sizes.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**WIDE if wide else {}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fieldloom_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_fieldloom_path", None)
        if path:
            _delete(df.sparkSession, path.rsplit("/", 1)[0])


def clean_up(spark: SparkSession) -> None:
    """Delete every table that this session has written with ``new_path``; call it once results are stored."""
    for path in _WRITTEN.pop(id(spark.sparkContext), []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sized(df: DataFrame, cells: int = BROADCAST_CELLS) -> DataFrame:
    """A table with a join hint: broadcast where a count shows at most ``cells`` values, else merge."""
    return df.hint("broadcast" if df.count() * len(df.columns) <= cells else "merge")


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers, and bound the batches they get.

    Where PYTHONPATH already names the repository, it is importable; else a zip
    of the package is added to the job, once for each context. Batches are cut
    by bytes as well as by rows, so that long rows don't fill a worker's memory.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if str(ROOT) in on_path or getattr(context, "_fieldloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "fieldloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "fieldloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(target))
    context._fieldloom_shipped = True
