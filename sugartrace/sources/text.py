"""Lines of vendor exports: file order, quoting, numbers and dates as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = "\u0001"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, line): `seq` orders the lines of a file, also when it is read in splits."""
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")
        ).alias("seq"),
        F.col("value").alias("line"),
    )


def cells(line: Column, delimiter: Column) -> Column:
    """Trimmed cells; a quote switches quoting on and off and is dropped, there is no escape."""
    pieces = F.split(line, '"')
    kept = F.transform(
        pieces, lambda piece, i: F.when(i % 2 == 0, F.replace(piece, delimiter, F.lit(_MARK))).otherwise(piece)
    )
    return F.transform(F.split(F.array_join(kept, ""), _MARK), lambda cell: F.trim(cell))


def cell(row: Column, header: Column, name: str) -> Column:
    """Cell under a header name; null when the column or the cell is missing."""
    at = F.array_position(header, name)
    return F.when(at > 0, F.get(row, (at - 1).cast("int")))


def number(text: Column, decimal_comma: bool = False) -> Column:
    if decimal_comma:
        text = F.replace(text, F.lit(","), F.lit("."))
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def timestamp(text: Column, formats: Sequence[str], tz: str = "UTC") -> Column:
    """First format that fits, else ISO; local times of `tz` become UTC."""
    clean = F.nullif(F.trim(text), F.lit(""))
    parsed = F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in formats], clean.try_cast("timestamp"))
    return parsed if tz == "UTC" else F.to_utc_timestamp(parsed, tz)
