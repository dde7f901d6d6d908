"""Archive export: CSV entries for sensor, meter, basal and bolus, with Italian headers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugartrace.operators.joins import lookup_join
from sugartrace.sources import text

# Column names, preamble and date formats of the export (fixed values).
PREAMBLE = r"^(Nome:|Name:)"
DATE = "Data e ora"
CGM_VALUE = "Valore glicemia CGM (mmol/l)"
BG_VALUE = "Valore glucosio (mmol/l)"
BASAL_RATE = "Frequenza"
BOLUS_UNITS = "Insulina erogata (U)"
BOLUS_CARBS = "Consumo di carboidrati (g)"
FORMATS = ("dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd-MM-yyyy HH:mm:ss")

LINES = "file string, entry string, line_no long, line string"
BATCH = 10_000


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for info in archive.infolist():
                    if not info.file_size or not info.filename.lower().endswith(".csv"):
                        continue
                    with archive.open(info) as raw:
                        rows: list[tuple] = []
                        for n, line in enumerate(io.TextIOWrapper(raw, "utf-8-sig", errors="replace")):
                            rows.append((path, info.filename, n, line.rstrip("\r\n")))
                            if len(rows) == BATCH:
                                yield pd.DataFrame(rows, columns=["file", "entry", "line_no", "line"])
                                rows = []
                        if rows:
                            yield pd.DataFrame(rows, columns=["file", "entry", "line_no", "line"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Python only opens the archives; lines leave it in small batches."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_unzip, LINES)


def entry_kind(entry):
    """cgm, bg, basal or bolus by name and folder; null for other entries."""
    unified = F.lower(F.replace(entry, F.lit("\\"), F.lit("/")))
    name = F.element_at(F.split(unified, "/"), -1)
    insulin = unified.contains("insulin data/") | unified.contains("insulin_data/")
    csv = name.endswith(".csv")
    return (
        F.when(csv & name.startswith("cgm_data"), "cgm")
        .when(csv & name.startswith("bg_data"), "bg")
        .when(csv & insulin & name.startswith("basal_data"), "basal")
        .when(csv & insulin & name.startswith("bolus_data"), "bolus")
    )


def parse_lines(lines: DataFrame, tz: str = "UTC") -> DataFrame:
    """(file, entry, line_no, event, source, timestamp, value) of `file, entry, line_no, line` rows.

    The first line is the header unless it is a name preamble, then the second is. Dates are
    local times of `tz`; decimals use a comma; carbs count only above zero.
    """
    rows = lines.withColumn("kind", entry_kind(F.col("entry"))).filter("kind IS NOT NULL")
    heads = rows.filter("line_no < 2").groupBy("file", "entry").agg(
        F.min_by("line", F.struct(F.col("line").rlike(PREAMBLE), "line_no")).alias("_h"),
        F.min(F.when(~F.col("line").rlike(PREAMBLE), F.col("line_no"))).alias("_at"),
    )
    heads = heads.select("file", "entry", text.cells(F.col("_h"), F.lit(",")).alias("names"), "_at")
    body = lookup_join(rows, heads, ["file", "entry"]).filter("line_no > _at AND trim(line) <> ''")
    body = body.withColumn("row", text.cells(F.col("line"), F.lit(",")))
    get = lambda name: text.cell(F.col("row"), F.col("names"), name)
    value = lambda name: text.number(get(name), decimal_comma=True)
    body = body.withColumn("timestamp", text.timestamp(get(DATE), FORMATS, tz)).filter("timestamp IS NOT NULL")
    kind = F.col("kind")
    carbs = value(BOLUS_CARBS)
    found = F.array(
        F.struct(F.lit("glucose").alias("event"), F.lit("glooko_cgm").alias("source"), F.when(kind == "cgm", value(CGM_VALUE)).alias("value")),
        F.struct(F.lit("glucose").alias("event"), F.lit("glooko_manual").alias("source"), F.when(kind == "bg", value(BG_VALUE)).alias("value")),
        F.struct(F.lit("basal").alias("event"), F.lit("glooko").alias("source"),
                 F.when(kind == "basal", F.coalesce(value(BASAL_RATE), F.lit(0.0))).alias("value")),
        F.struct(F.lit("bolus").alias("event"), F.lit("glooko").alias("source"), F.when(kind == "bolus", value(BOLUS_UNITS)).alias("value")),
        F.struct(F.lit("meal").alias("event"), F.lit("glooko").alias("source"), F.when((kind == "bolus") & (carbs > 0), carbs).alias("value")),
    )
    return body.select("file", "entry", "line_no", "timestamp", F.inline(found)).filter("value IS NOT NULL")


def read(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    return parse_lines(read_lines(spark, path), tz)
