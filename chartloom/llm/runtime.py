"""What the operators share: scratch tables on shared storage, Arrow batch bounds, column picking."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_BASE: dict[str, str] = {}
_BATCH_ROWS, _BATCH_BYTES = 1024, 4 << 20
_SHIPPED: set[str] = set()


def shared_base(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or the context's checkpoint folder; where neither is set, a
    temporary one on a local master, and an error on any other, whose executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if (given := context._jsc.sc().getCheckpointDir()).isDefined():
        return str(given.get()).rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _LOCAL_BASE:
        _LOCAL_BASE[app] = "file://" + tempfile.mkdtemp(prefix="chartloom-")
    return _LOCAL_BASE[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below shared_base that is deleted when the session's JVM ends."""
    path = f"{shared_base(spark)}/scratch/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet on shared storage and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no plan still to run reads."""
    for table_ in tables:
        spark, path = table_.sparkSession, table_._scratch_path
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Give the package's modules to the executors' Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="chartloom-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))


def python_stage(spark: SparkSession) -> None:
    """Before a Python stage: ship the code, and bound an Arrow batch by rows and bytes, so that very long texts fit a worker.

    The bounds are the same for all stages, since a lazy plan runs under those that were set last.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))


def release() -> None:
    """In a Python worker, at the start of a stage: give the system back what earlier stages took and freed.

    Workers live on from stage to stage, and their allocators keep freed memory.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # an allocator without it
        pass


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast as given ("doc_id='bigint'"); anything else the table carries is pruned here."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
