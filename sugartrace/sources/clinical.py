"""Research cohorts: XML logs, 5-minute CSV, per-stream CSV and tidied sheets, on one minute clock.

Every reader ends in the same four tables: `glucose` (minute, glucose), `basal` (minute, rate in
mU/min, seq), `boluses` (minute, units, carb_g) and `meals` (minute, carb_g), keyed by patient.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.functions import scalars
from sugartrace.operators import joins, series
from sugartrace.sources import text

PID = "patient_id"
XML_TIME = ("dd-MM-yyyy HH:mm:ss",)
DAY_FIRST = ("dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd-MM-yyyy HH:mm:ss")
XML_EVENTS = ("glucose_level", "basal", "temp_basal", "bolus", "meal")
XML_FIELDS = ("ts", "value", "ts_begin", "ts_end", "dose", "bwz_carb_input", "carbs")


def _on_clock(rows: DataFrame, origin: DataFrame, ts: str, name: str = "minute") -> DataFrame:
    """Whole minutes since the patient's first glucose."""
    out = joins.lookup_join(rows, origin, [PID])
    return out.withColumn(name, scalars.minutes_between(F.col(ts), F.col("t0"))).drop("t0")


def _first_per_minute(rows: DataFrame, seq: str = "seq") -> DataFrame:
    return joins.first_by(rows.filter("glucose IS NOT NULL"), [PID, "minute"], [seq], ["glucose"])


def _inside(rows: DataFrame, last: DataFrame) -> DataFrame:
    return joins.lookup_join(rows, last, [PID]).filter((F.col("minute") >= 0) & (F.col("minute") <= F.col("_end"))).drop("_end")


def _ends(glucose: DataFrame) -> DataFrame:
    return glucose.groupBy(PID).agg(F.max("minute").alias("_end"))


# ---- XML logs ------------------------------------------------------------------------------


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Event rows of patient files: (patient_id, file, tag, seq, ts, value, ...), attributes as text."""
    entry = "STRUCT<event: ARRAY<STRUCT<" + ", ".join(f"_{f}: STRING" for f in XML_FIELDS) + ">>>"
    schema = "_id STRING, " + ", ".join(f"{tag} {entry}" for tag in XML_EVENTS)
    files = spark.read.format("xml").option("rowTag", "patient").schema(schema).load(path)
    files = files.withColumn("file", F.col("_metadata.file_path"))
    stem = F.regexp_extract("file", r"([^/]+?)(?:-[^/]*)?\.xml$", 1)
    files = files.withColumn(PID, F.coalesce("_id", stem))
    parts = []
    for tag in XML_EVENTS:
        rows = files.select(PID, "file", F.posexplode(f"{tag}.event").alias("seq", "e"))
        parts.append(rows.select(PID, "file", F.lit(tag).alias("tag"), "seq", *[F.col(f"e._{f}").alias(f) for f in XML_FIELDS]))
    return reduce(DataFrame.unionByName, parts)


def read_xml_cohort(spark: SparkSession, root: str, year: str = "both", split: str = "test") -> DataFrame:
    """All patients of `<root>/<year>/<split>/*.xml`, with year and split taken from the path."""
    years = "{2018,2020}" if year == "both" else year
    return with_path_split(read_xml(spark, f"{root}/{years}/{split}/*.xml"))


def with_path_split(rows: DataFrame) -> DataFrame:
    """Add year and split from the last two folders of `file`."""
    found = lambda i: F.regexp_extract("file", r"/(\d{4})/(\w+)/[^/]+$", i)
    return rows.withColumns({"year": found(1), "split": found(2)})


def assemble_xml(rows: DataFrame) -> dict[str, DataFrame]:
    """XML event rows to the minute tables; glucose mg/dL to mmol/L, basal U/h to mU/min."""
    at = {c: text.timestamp(F.col(c), XML_TIME) for c in ("ts", "ts_begin", "ts_end")}
    rows = rows.withColumns({f"_{c}": e for c, e in at.items()})
    levels = rows.filter("tag = 'glucose_level'")
    origin = levels.groupBy(PID).agg(F.min("_ts").alias("t0"))
    glucose = _first_per_minute(
        _on_clock(levels.select(PID, "seq", "_ts", (text.number(F.col("value")) / K.MGDL_DISPLAY).alias("glucose")), origin, "_ts")
    )
    last = _ends(glucose)
    rate = text.number(F.col("value")) / 60.0 * 1000.0
    basal = _on_clock(rows.filter("tag = 'basal'").select(PID, "seq", "_ts", rate.alias("rate")), origin, "_ts")
    temp = rows.filter("tag = 'temp_basal'").select(PID, "seq", "_ts_begin", "_ts_end", rate.alias("rate"))
    temp = _on_clock(_on_clock(temp, origin, "_ts_begin", "begin"), origin, "_ts_end", "end")
    boluses = _on_clock(
        rows.filter("tag = 'bolus'").select(
            PID, "seq", "_ts_begin", text.number(F.col("dose")).alias("units"),
            F.coalesce(text.number(F.col("bwz_carb_input")), F.lit(0.0)).alias("carb_g"),
        ), origin, "_ts_begin",
    )
    meals = _on_clock(rows.filter("tag = 'meal'").select(PID, "seq", "_ts", text.number(F.col("carbs")).alias("carb_g")), origin, "_ts")
    return {
        "glucose": glucose,
        "basal": basal.select(PID, "minute", "rate", "seq"),
        "temp_basal": temp.select(PID, "begin", "end", "rate", "seq"),
        "boluses": _inside(boluses.select(PID, "seq", "minute", "units", "carb_g"), last),
        "meals": _inside(meals.select(PID, "seq", "minute", "carb_g"), last),
    }


# ---- 5-minute CSV --------------------------------------------------------------------------


def read_five_minute_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    return raw.withColumn(PID, F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))


def announced(boluses: DataFrame, meals: DataFrame) -> DataFrame:
    """Each bolus with the carbs of the nearest meal entry within 15 minutes, else 0."""
    carbs = meals.select(PID, "minute", "seq", "carb_g")
    out = joins.nearest_join(boluses.drop("carb_g"), carbs, PID, "minute", "seq", ["carb_g"], K.ANNOUNCE_PAIR_MIN)
    return out.withColumn("carb_g", F.coalesce("carb_g", F.lit(0.0)))


def assemble_five_minute(raw: DataFrame, exchange_g: float = K.EXCHANGE_G) -> dict[str, DataFrame]:
    """Text columns time, glucose, basal_rate, bolus_volume_delivered, carb_input to the minute tables."""
    num = lambda c: text.number(F.col(c))
    rows = raw.select(
        PID,
        text.timestamp(F.col("time"), ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")).alias("_ts"),
        (num("glucose") / K.MGDL_DISPLAY).alias("glucose"),
        (num("basal_rate") * 1000.0 / K.BASAL_STEP_MIN).alias("rate"),
        num("bolus_volume_delivered").alias("units"),
        (num("carb_input") * exchange_g).alias("carb_g"),
    ).filter("_ts IS NOT NULL")
    origin = rows.groupBy(PID).agg(F.min("_ts").alias("t0"))
    rows = _on_clock(rows, origin, "_ts").withColumn("seq", F.unix_micros("_ts"))
    meals = rows.filter("carb_g > 0").select(PID, "seq", "minute", "carb_g")
    return {
        "glucose": _first_per_minute(rows),
        "basal": rows.filter("rate IS NOT NULL").select(PID, "minute", "rate", "seq"),
        "boluses": announced(rows.filter("units > 0").select(PID, "seq", "minute", "units"), meals),
        "meals": meals,
    }


# ---- one CSV folder per stream -------------------------------------------------------------

# Folder and file prefix of each stream (fixed values).
STREAMS = {
    "glucose": ("Glucose Data", "UoMGlucose"),
    "bolus": ("Insulin Data/Bolus Data", "UoMBolus"),
    "basal": ("Insulin Data/Basal Data", "UoMBasal"),
    "nutrition": ("Nutrition Data", "UoMNutrition"),
}


def read_streams(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    out = {}
    for name, (folder, prefix) in STREAMS.items():
        raw = spark.read.option("header", True).csv(f"{root}/{folder}/{prefix}*.csv")
        out[name] = raw.withColumn(PID, F.regexp_extract(F.col("_metadata.file_name"), rf"^{prefix}(.*)\.csv$", 1))
    return out


def assemble_streams(streams: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Day-first text streams to the minute tables, for patients that have all four."""
    complete = reduce(lambda a, b: a.join(b, PID, "left_semi"), [s.select(PID).distinct() for s in streams.values()])

    def stream(name: str, ts: str, value: str, alias: str) -> DataFrame:
        rows = streams[name].join(complete, PID, "left_semi")
        return rows.select(PID, text.timestamp(F.col(ts), DAY_FIRST).alias("_ts"), text.number(F.col(value)).alias(alias)).filter(
            "_ts IS NOT NULL"
        )

    levels = stream("glucose", "bg_ts", "value", "glucose")
    origin = levels.groupBy(PID).agg(F.min("_ts").alias("t0"))

    def timed(rows: DataFrame) -> DataFrame:
        return _on_clock(rows, origin, "_ts").withColumn("seq", F.unix_micros("_ts"))

    glucose = _first_per_minute(timed(levels))
    last = _ends(glucose)
    basal = timed(stream("basal", "basal_ts", "basal_dose", "rate").filter("rate IS NOT NULL"))
    meals = timed(stream("nutrition", "meal_ts", "carbs_g", "carb_g").filter("carb_g > 0"))
    given = timed(stream("bolus", "bolus_ts", "bolus_dose", "units").filter("units > 0"))
    paired = announced(_inside(given.select(PID, "seq", "minute", "units"), last), meals)
    return {
        "glucose": glucose,
        "basal": basal.select(PID, "minute", (F.col("rate") / 60.0 * 1000.0).alias("rate"), "seq"),
        "boluses": paired,
        "meals": _inside(meals.select(PID, "seq", "minute", "carb_g"), last),
    }


# ---- shared --------------------------------------------------------------------------------


def render(parts: dict[str, DataFrame]) -> DataFrame:
    """Minute series of a cohort: interpolated glucose, validity, basal, insulin and announced carbs."""
    empty = F.lit(None).cast("double")
    rows = parts["glucose"].select(PID, "minute", "glucose", empty.alias("insulin"), empty.alias("carbs"), F.col("minute").alias("id"))
    grid = series.minute_grid(rows).drop("insulin", "carbs")
    grid = series.basal_hold(grid, parts["basal"])
    if "temp_basal" in parts:
        grid = series.temp_basal_override(grid, parts["temp_basal"])
    return series.render_channels(grid, parts["boluses"])


def summary_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """Insulin and carb events per patient, zero where there are none."""
    patients = parts["glucose"].select(PID).distinct()
    insulin = parts["boluses"].filter("units > 0").groupBy(PID).agg(F.count(F.lit(1)).alias("n_insulin"))
    carb = parts["meals"].filter("carb_g > 0").groupBy(PID).agg(F.count(F.lit(1)).alias("n_carb"))
    return patients.join(insulin, PID, "left").join(carb, PID, "left").fillna(0, ["n_insulin", "n_carb"])


def generic(cohorts: dict[str, dict[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Samples (cohort, patient, minute, glucose) and counts of several cohorts, as `compare.pool_stats` reads them."""
    samples = [p["glucose"].select(F.lit(n).alias("cohort"), PID, "minute", "glucose") for n, p in cohorts.items()]
    counts = [summary_counts(p) for p in cohorts.values()]
    return reduce(DataFrame.unionByName, samples), reduce(DataFrame.unionByName, counts)


def tidy_sheet(raw: DataFrame) -> DataFrame:
    """A sheet dump tidied: mmol/L, both bolus columns added, diet text cleaned, in time order.

    `raw`: patient, Date, CGM (mg / dl), Dietary intake, and the insulin columns below; absent ones count as 0.
    """
    def dose(name: str) -> Column:
        return F.coalesce(text.number(F.col(f"`{name}`").cast("string")), F.lit(0.0)) if name in raw.columns else F.lit(0.0)

    diet = F.col("`Dietary intake`") if "Dietary intake" in raw.columns else F.lit("")
    blank = diet.isNull() | (F.trim(diet) == "") | F.lower(diet).contains("nan")
    return raw.select(
        PID,
        text.timestamp(F.col("Date").cast("string"), ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm")).alias("time"),
        F.round(text.number(F.col("`CGM (mg / dl)`").cast("string")) / K.MGDL_DISPLAY, 2).alias("glucose"),
        F.round(dose("Insulin dose - s.c.") + dose("CSII - bolus insulin (Novolin R, IU)"), 3).alias("bolus"),
        F.round(dose("CSII - basal insulin (Novolin R, IU / H)"), 4).alias("basal_rate"),
        F.when(blank, "").otherwise(F.trim(F.regexp_replace(diet, "\n", " "))).alias("dietary_intake"),
    ).orderBy(PID, "time")
