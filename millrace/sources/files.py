"""File sources and sinks on Spark's own readers and writers."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "orc": "orc", "txt": "text"}
#: Rows of a sheet below its header.
SHEET_ROWS = 1_048_575
_CODECS = (".gz", ".gzip", ".bz2", ".snappy", ".zst", ".lz4", ".deflate")


def format_of(path: str) -> str | None:
    """Format by the name's ending, past that of a codec."""
    name = path.rstrip("/").lower()
    for c in _CODECS:
        name = name.removesuffix(c)
    return next((k for k in FORMATS if name.endswith(f".{k}")), None)


def sniff_delimiter(sample: str) -> str:
    """The separator of the first lines; a comma if in doubt."""
    try:
        return csv.Sniffer().sniff(sample, ",;\t|").delimiter
    except csv.Error:
        first = sample.splitlines()[0] if sample else ""
        return max(",;\t|", key=first.count) if any(first.count(c) for c in ",;\t|") else ","


def read_file(spark: SparkSession, path: str | list[str], format: str | None = None, schema: T.StructType | str | None = None, pattern: str | None = None, delimiter: str | None = None, multiline: bool | None = None, **options: Any) -> DataFrame:
    """A file, folder or glob.  The name's ending decides the format unless one is given; JSON arrays are
    read as well as lines.  Give a schema for large files: inferring one reads them twice."""
    first = path if isinstance(path, str) else path[0]
    kind = format or format_of(first)
    if kind not in FORMATS:
        raise ValueError(f"unknown format of {first!r}")
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if schema is not None:
        reader = reader.schema(schema)
    if FORMATS[kind] == "csv":
        if delimiter is None:
            head = spark.read.option("wholetext", False).text(first).limit(5).collect() if kind == "csv" else []
            delimiter = "\t" if kind == "tsv" else sniff_delimiter("\n".join(r.value for r in head))
        reader = reader.option("header", True).option("sep", delimiter).option("multiLine", bool(multiline))
        if schema is None:
            reader = reader.option("inferSchema", True)
    elif FORMATS[kind] == "json":
        reader = reader.option("multiLine", kind == "json" if multiline is None else multiline)
    return reader.options(**options).format(FORMATS[kind]).load(path)


def chunks(df: DataFrame, size: int = 1000) -> Iterator[list]:
    """Rows in lists, a partition at a time on the driver."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


@dataclass(frozen=True)
class SinkResult:
    success: bool
    records_written: int = 0
    error: str | None = None
    metrics: dict[str, Any] = field(default_factory=dict)


def _hashable(df: DataFrame) -> list[str]:
    """Columns that Spark can hash: all but maps and variants, which it can't group by either."""
    return [f"`{f.name}`" for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


def write_file(df: DataFrame, path: str, format: str | None = None, mode: str = "overwrite", partition_by: list[str] | None = None, compression: str | None = None, max_records: int | None = None, sort_within: list[str] | None = None, **options: Any) -> SinkResult:
    """Writes in Spark's folders, ``col=value`` for partition columns.  Rows of a partition are brought
    together in parts first, so that not each task writes to each folder.  Failures are returned."""
    kind = FORMATS[format or format_of(path) or "parquet"]
    seen = df.sparkSession.sparkContext.accumulator(0) if kind == "text" else None
    from pyspark.sql import Observation

    watch = Observation()
    out = df.observe(watch, F.count(F.lit(1)).alias("rows")) if seen is None else df
    if partition_by:
        out = out.repartition(*partition_by, F.pmod(F.xxhash64(*_hashable(df)), F.lit(8)))  # a hot value is spread over eight tasks, the same ones in a rerun
    if sort_within:
        out = out.sortWithinPartitions(*(partition_by or []), *sort_within)
    writer = out.write.mode(mode).format(kind).options(**options)
    if kind == "csv":
        writer = writer.option("header", True)
    if compression:
        writer = writer.option("compression", compression)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.save(path)
    except Exception as e:
        return SinkResult(False, 0, str(e).split("\n")[0])
    return SinkResult(True, watch.get["rows"] if seen is None else 0, None, {"path": path, "format": kind})


def excel_sheets(path: str) -> list[str]:
    """Names of a workbook's sheets.  Needs openpyxl."""
    import pandas as pd

    return pd.ExcelFile(path).sheet_names


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet, read on the driver: workbooks are small.  Needs openpyxl."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def write_excel(df: DataFrame, path: str, sheet: str = "Sheet1") -> SinkResult:
    """Writes a workbook on the driver.  A table that a sheet can't hold isn't written in part."""
    rows = df.limit(SHEET_ROWS + 1).toPandas()
    if len(rows) > SHEET_ROWS:
        return SinkResult(False, 0, f"more than {SHEET_ROWS} rows, which a sheet can't hold")
    rows.to_excel(path, sheet_name=sheet, index=False)
    return SinkResult(True, len(rows), None, {"path": path})
