"""Recorded value-set expansions as a data source: what a terminology server has answered, page by page, kept as files.

Below the folder lies system=<label>/ for each code system, with JSON Lines files whose lines are pages: payloads with
expansion.contains, an array of {system, code, display}.  A file is a partition of the scan.  Filters on system (= and IN)
are pushed into the source, which then opens no other system's files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "system string, file string, page int, ord int, code string, display string"
_ROWS = 4096


@dataclass
class PageFile(InputPartition):
    system: str
    path: str


class _Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder, self.systems = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (the interface's name)
        """Takes what is asked of system; the rest stays with Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("system",) else set(f.value) if isinstance(f, In) and f.attribute == ("system",) else None
            if wanted is None:
                yield f
            else:
                self.systems = wanted if self.systems is None else self.systems & wanted

    def partitions(self) -> list[PageFile]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        folders = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("system=")]
        kept = [(f.base_name.removeprefix("system="), f.path) for f in folders if self.systems is None or f.base_name.removeprefix("system=") in self.systems]
        return [PageFile(system, f.path) for system, path in sorted(kept) for f in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: PageFile | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, PageFile):  # nothing is left to read
            return
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        name, rows = partition.path.rsplit("/", 1)[-1], []
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        with fs.open_input_stream(partition.path) as source:
            for page, line in enumerate(_lines(source)):
                for ord_, entry in enumerate(_entries(line)):
                    if isinstance(entry, dict) and _said(entry, "code") and _said(entry, "display"):
                        rows.append((partition.system, name, page, ord_, entry["code"], entry["display"]))
                        if len(rows) == _ROWS:
                            yield batch()
                            rows = []
        if rows:
            yield batch()


def _said(entry: dict, key: str) -> bool:
    return isinstance(entry.get(key), str) and entry[key] != ""


def _lines(source) -> Iterator[bytes]:
    rest = b""
    while chunk := source.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _entries(line: bytes) -> list:
    """The entries of a page; a page that is no JSON, or has no expansion, has none."""
    try:
        found = json.loads(line)["expansion"]["contains"]
    except (ValueError, KeyError, TypeError):
        return []
    return found if isinstance(found, list) else []


class RecordedExpansions(DataSource):
    """spark.read.format("recorded-expansions").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "recorded-expansions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_expansions(spark: SparkSession, folder: str) -> DataFrame:
    """(system, file, page, ord, code, display) of a folder of recorded pages (a URI): entries with a code and a display.

    Pages that are no JSON, or hold no expansion, give no rows.  A folder without systems gives none either.
    """
    from chartloom.operators.lineage import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedExpansions)
    return spark.read.format("recorded-expansions").load(folder)


def record_expansions(entries: DataFrame, folder: str, a_page: int = 100) -> None:
    """entries(system, ord, code, display) -> a folder of recorded pages, a_page entries each, in order of ord by system.

    ord counts a system's entries from 0.
    """
    from pyspark.sql import functions as F

    one = F.struct("ord", F.struct("code", "display").alias("e"))
    pages = entries.groupBy("system", F.floor(F.col("ord") / a_page).alias("page")).agg(F.array_sort(F.collect_list(one))["e"].alias("contains"))
    pages.select("system", F.to_json(F.struct(F.struct("contains").alias("expansion"))).alias("value")).write.partitionBy("system").text(folder)
