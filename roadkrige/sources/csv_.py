"""CSV: a distributed reader and writer, and a single file with a byte-order mark."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession

from .files import bounded_rows, write_bytes


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_csv_file(df: DataFrame, path: str, bom: bool = True) -> None:
    """One small file in UTF-8, with a byte-order mark for spreadsheet programs."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(["" if v is None else v for v in r] for r in bounded_rows(df))
    write_bytes(df.sparkSession, path, out.getvalue().encode("utf-8-sig" if bom else "utf-8"))
