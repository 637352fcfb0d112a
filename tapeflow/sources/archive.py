"""Session archives: paths, sinks, inventories, symbols, and a Python data source for record files."""

from __future__ import annotations

import csv
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from tapeflow.schema import MBO


def read_sessions(spark: SparkSession, root: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A table partitioned by session_date; the bounds prune partitions. Sessions without files are simply absent."""
    df = spark.read.parquet(root)
    if first:
        df = df.where(F.col("session_date") >= F.lit(first).cast("date"))
    if last:
        df = df.where(F.col("session_date") <= F.lit(last).cast("date"))
    return df


def write_sessions(df: DataFrame, root: str) -> None:
    """One folder for each session; only the sessions of ``df`` are replaced, so an interrupted run resumes."""
    df.write.partitionBy("session_date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)


def missing_sessions(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Sessions still to do: an anti-join against those written."""
    return wanted.select("session_date").distinct().join(done.select("session_date").distinct(), "session_date", "left_anti")


def with_symbols(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds symbol by instrument_id from symbols(id string, symbol); ids that aren't numbers are left out, unknown
    instruments are called ``iid:<id>``."""
    known = symbols.where(F.col("id").rlike("^[0-9]+$")).select(F.col("id").cast("bigint").alias("instrument_id"), F.col("symbol").alias("_symbol")).dropDuplicates(["instrument_id"])
    return rows.join(known, "instrument_id", "left").withColumn("symbol", F.coalesce("_symbol", F.concat(F.lit("iid:"), F.col("instrument_id")))).drop("_symbol")


def inventory(spark: SparkSession, glob: str) -> DataFrame:
    """name, day (from eight digits in the name), bytes and readable flag of every file, from metadata alone."""
    files = spark.read.format("binaryFile").load(glob).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))
    return files.select("name", F.to_date(F.regexp_extract("name", r"(\d{8})", 1), "yyyyMMdd").alias("day"), "bytes", (F.col("bytes") > 0).alias("readable"))


def spot_files(found: DataFrame) -> DataFrame:
    """The first, middle and last file of each year."""
    w = Window.partitionBy(F.year("day")).orderBy("day", "name")
    n = F.count(F.lit(1)).over(Window.partitionBy(F.year("day")))
    k = F.row_number().over(w)
    return found.withColumns({"_k": k, "_n": n}).where((F.col("_k") == 1) | (F.col("_k") == F.col("_n")) | (F.col("_k") == F.floor((F.col("_n") + 1) / 2))).drop("_k", "_n")


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class RecordFiles(DataSource):
    """``spark.read.format("mbo_csv").load(...)``: record files of comma-separated values, one file a partition.

    The shape of a connector for binary feeds: replace ``decode``. Lines that aren't records count nothing.
    Register with ``spark.dataSource.register(RecordFiles)``; paths are given as the option ``paths``, separated by ``;``.
    """

    @classmethod
    def name(cls) -> str:
        return "mbo_csv"

    def schema(self) -> str:
        return MBO

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def decode(lines: Iterator[str]) -> Iterator[tuple]:
    import datetime

    for r in csv.reader(lines):
        if len(r) == 12 and r[1].lstrip("-").isdigit():
            yield (datetime.date.fromisoformat(r[0]), int(r[1]), int(r[2]), r[3], r[4], *(int(x) for x in r[5:12]))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(";") if p]

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path) as f:
            yield from decode(f)
