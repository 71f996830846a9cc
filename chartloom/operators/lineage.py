"""Cutting the lineage of loops, how tables meet, and giving the package to Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's checkpoint folder, which all executors share.

    Where neither is set, a temporary one is taken on a local master; on any other this is an error.
    """
    context = spark.sparkContext
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if (own := context._jsc.sc().getCheckpointDir()).isDefined():
        return str(own.get()).rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="chartloom-")
    return _LOCAL[context.applicationId]


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below shared_base, as a URI; it stays until its owner deletes it."""
    base = shared_base(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written below shared_base and read from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def merged(df: DataFrame) -> DataFrame:
    """df for a join by sort and merge, where both sides grow with the notes.

    Spark sizes a table by its files and columns: what is packed well, or exploded since, counts for a small part of its rows,
    is taken for a small table, and is broadcast through the driver.
    """
    return df.hint("merge")


def fixed(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of fixed rows, of which Spark knows that it is small: one made from tuples would count as larger than any other,
    and the table that it meets would be broadcast in its place."""
    kind = StructType.fromDDL(schema)
    columns = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(kind)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=kind.names), kind)


def ship(spark: SparkSession) -> None:
    """Give the package's modules to the executors' Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="chartloom-")) / f"{package.name}-operators.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
