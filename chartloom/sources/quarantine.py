"""JSON Lines notes with a second output: records that can't be used, with their file, line and reason.

Nothing fails and nothing is lost: each line that is not blank is either a note or a row of the quarantine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from chartloom.operators.sessions import _is, _items, _kind, _text
from chartloom.sources.expansions import PageFile, _lines

_ROWS = 4096
MENTION = "struct<text:string, entity_type:string, start_char:int, end_char:int, assertion:string>"


class _LineReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[PageFile]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return [PageFile(f.path.removeprefix(root).lstrip("/"), f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: PageFile | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, PageFile):
            return
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        names, numbers, raws = [], [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(raws, pa.string())], ["file", "line", "raw"])

        with fs.open_input_stream(partition.path) as source:
            for number, line in enumerate(_lines(source), 1):
                if line.strip():
                    names.append(partition.system)
                    numbers.append(number)
                    raws.append(line.rstrip(b"\r").decode("utf-8", "replace"))
                if len(raws) == _ROWS:
                    yield batch()
                    names, numbers, raws = [], [], []
        if raws:
            yield batch()


class NumberedLines(DataSource):
    """spark.read.format("numbered-lines").load(folder): (file, line, raw) of the lines that are not blank, a file a partition."""

    @classmethod
    def name(cls) -> str:
        return "numbered-lines"

    def schema(self) -> str:
        return "file string, line bigint, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options["path"])


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line, raw) of a folder (a URI), lines counted from 1; bytes that are no UTF-8 are replaced."""
    from chartloom.operators.lineage import ship

    ship(spark)
    spark.dataSource.register(NumberedLines)
    return spark.read.format("numbered-lines").load(folder)


def _mention_fault(text: Column) -> object:
    def of(m: Column, k: Column) -> Column:
        at = F.concat(F.lit("mention "), k.cast("string"))
        start, end = F.try_variant_get(m, "$.start_char", "int"), F.try_variant_get(m, "$.end_char", "int")
        whole = _kind(m, "$.start_char").isin("BIGINT") & _kind(m, "$.end_char").isin("BIGINT")
        said = F.substr(text, start + 1, end - start)
        return (
            F.when(~_is(m, "$", "OBJECT"), F.concat(at, F.lit(" is no object")))
            .when(~(_is(m, "$.text", "STRING") & _is(m, "$.entity_type", "STRING")), F.concat(at, F.lit(" lacks text or entity_type")))
            .when(~F.coalesce(whole & (start >= 0) & (end > start), F.lit(False)), F.concat(at, F.lit(" has no span")))
            .when(~F.coalesce(said == _text(m, "$.text"), F.lit(False)), F.concat(at, F.lit(" has a span that does not reproduce its text")))
        )

    return of


def sorted_out(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records(file, line, raw) -> (notes, quarantine).

    notes(file, line, source_id, text, mentions): what read_gold_notes gives, from records whose mentions all stand in their
    text.  quarantine(file, line, raw, reason): the others, with the first thing that is wrong.  A record without mentions is
    a note with none.
    """
    rows = records.withColumn("_v", F.try_parse_json("raw"))
    v = F.col("_v")
    rows = rows.withColumn("_text", _text(v, "$.text")).withColumn("_mentions", F.coalesce(_items(v, "$.mentions"), F.array().cast("array<variant>")))
    rows = rows.withColumn("_faults", F.array_compact(F.transform("_mentions", _mention_fault(F.col("_text")))))
    reason = (
        F.when(v.isNull(), "the line is not JSON")
        .when(~_is(v, "$", "OBJECT"), "the record is no object")
        .when(~_is(v, "$.source_id", "STRING"), "source_id is missing")
        .when(F.col("_text").isNull(), "text is missing")
        .when(~(_kind(v, "$.mentions").isNull() | _is(v, "$.mentions", "ARRAY")), "mentions is no list")
        .otherwise(F.try_element_at("_faults", F.lit(1)))
    )
    rows = rows.withColumn("reason", reason)
    notes = rows.where("reason IS NULL").select("file", "line", _text(v, "$.source_id").alias("source_id"), F.col("_text").alias("text"), F.transform("_mentions", lambda m: F.try_variant_get(m, "$", MENTION)).alias("mentions"))
    return notes, rows.where("reason IS NOT NULL").select("file", "line", "raw", "reason")
