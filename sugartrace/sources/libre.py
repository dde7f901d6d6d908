"""Sensor CSV export: one header per file, record types 0 (history), 1 (scan), 5 (food)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugartrace.functions import scalars
from sugartrace.operators.joins import lookup_join
from sugartrace.sources import text

# Column names and date formats of the export (fixed values).
TIMESTAMP = "Device Timestamp"
RECORD_TYPE = "Record Type"
HISTORIC = "Historic Glucose mmol/L"
SCAN = "Scan Glucose mmol/L"
RAPID = "Rapid-Acting Insulin (units)"
LONG = "Long-Acting Insulin Value (units)"
CARBS = "Carbohydrates (grams)"
FORMATS = (
    "dd-MM-yyyy HH:mm",
    "dd-MM-yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy HH:mm:ss",
)


def parse_lines(lines: DataFrame) -> DataFrame:
    """(file, seq, kind, timestamp, value) for glucose, meal, bolus and basal of `file, seq, line` rows.

    The header is the line that names both required columns, so a file may be read in splits;
    files without one give nothing. Malformed rows are skipped.
    """
    useful = lines.filter((F.trim("line") != "") & ~F.col("line").startswith("Glucose Data"))
    is_header = F.col("line").contains(TIMESTAMP) & F.col("line").contains(RECORD_TYPE)
    semicolon = F.col("line").contains(";") & ~F.col("line").contains(",")
    delimiter = F.when(semicolon, ";").otherwise(",")
    headers = useful.filter(is_header).groupBy("file").agg(F.min_by(
        F.struct(text.cells(F.col("line"), delimiter).alias("names"), delimiter.alias("delimiter")), "seq"
    ).alias("h"))
    rows = lookup_join(useful.filter(~is_header), headers, ["file"])
    rows = rows.withColumn("row", text.cells(F.col("line"), F.col("h.delimiter")))
    get = lambda name: text.cell(F.col("row"), F.col("h.names"), name)
    rows = rows.select(
        "file",
        "seq",
        text.timestamp(get(TIMESTAMP), FORMATS).alias("timestamp"),
        get(RECORD_TYPE).try_cast("int").alias("kind"),
        *[text.number(get(c)).alias(a) for c, a in ((HISTORIC, "history"), (SCAN, "scan"), (RAPID, "rapid"), (LONG, "long"), (CARBS, "carbs"))],
    ).filter("timestamp IS NOT NULL AND kind IS NOT NULL")
    glucose = F.when(F.col("kind") == 0, F.col("history")).when(F.col("kind") == 1, F.col("scan"))
    meal = F.when(F.col("kind") == 5, F.col("carbs"))
    found = F.array(
        *[
            F.struct(F.lit(name).alias("event"), value.alias("value"))
            for name, value in (("glucose", glucose), ("meal", meal), ("bolus", F.col("rapid")), ("basal", F.col("long")))
        ]
    )
    return rows.select("file", "seq", "timestamp", F.inline(found)).filter("value IS NOT NULL")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(text.read_lines(spark, path))


def entities(parsed: DataFrame, source: str = "libre") -> dict[str, DataFrame]:
    """Parsed rows as glucoses, meals and insulins; `file` stands for the patient's upload."""
    glucose = parsed.filter("event = 'glucose'").select(
        "file", "seq", "timestamp", F.col("value").alias("glucose_mmoll"), F.lit(source).alias("source"),
        scalars.glucose_status(F.col("value")).alias("status"),
    )
    meals = parsed.filter("event = 'meal'").select(
        "file", "seq", "timestamp", F.col("value").alias("carbs"), F.lit(None).cast("string").alias("meal_type")
    )
    insulins = parsed.filter("event IN ('bolus', 'basal')").select(
        "file", "seq", "timestamp", F.col("value").alias("units"), F.col("event").alias("event_type")
    )
    return {"glucoses": glucose, "meals": meals, "insulins": insulins}
