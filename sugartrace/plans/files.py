"""Vendor and research formats: text lines derived from the event table, parsed back to rows.

The parsers take rows of lines or text columns; reading files is `read(spark, path)` of each
source, which the tests cover with real files.
"""

from pyspark.sql import functions as F

from sugartrace.plans.oracle_views import ts
from sugartrace.plans.registry import query
from sugartrace.sources import clinical, glooko, libre

STAMP = "timestamp"


def _text(column):
    return column.cast("string")


def _glucose(t):
    return F.lit(2.5) + F.col("value") % 12.0


EVENT_SQL = """SELECT {file} AS file, {ts} AS timestamp, CASE kind WHEN 'click' THEN 'meal' WHEN 'purchase' THEN 'bolus' WHEN 'signup' THEN 'basal'
      ELSE 'glucose' END AS event, round(CASE kind WHEN 'click' THEN value % 90.0 WHEN 'purchase' THEN value % 10.0 WHEN 'signup' THEN value % 10.0
      ELSE 2.5 + value % 12.0 END, 6) AS value FROM entity {where}"""
USER_FILE = "'u' || patient_id"


@query("read_libre_csv", EVENT_SQL.format(file=USER_FILE, ts=ts(STAMP), where=""))
def _(t):
    kind, value = F.col("event_type"), F.col("value")
    even = F.col("patient_id") % 2 == 0
    joined = lambda *cells: F.when(even, F.concat_ws(";", *cells)).otherwise(F.concat_ws(",", *cells))
    file = F.concat(F.lit("u"), _text(F.col("patient_id")))
    names = ["Device", libre.TIMESTAMP, libre.RECORD_TYPE, libre.HISTORIC, libre.SCAN, libre.RAPID, libre.LONG, libre.CARBS]
    blank = F.lit("")
    code = F.when(kind == "view", "0").when(kind == "error", "1").when(kind == "click", "5").otherwise("4")
    only = lambda k, v: F.when(kind == k, _text(v)).otherwise(blank)
    body = t._entity.select(
        file.alias("file"),
        F.col("id").alias("seq"),
        joined(
            F.lit('"Free Style"'),
            F.date_format(STAMP, "dd-MM-yyyy HH:mm"),
            code,
            only("view", _glucose(t)),
            only("error", _glucose(t)),
            only("purchase", value % 10.0),
            only("signup", value % 10.0),
            only("click", value % 90.0),
        ).alias("line"),
    )
    heads = t._entity.select("patient_id").distinct().select(
        file.alias("file"), F.lit(-1).cast("long").alias("seq"), joined(*map(F.lit, names)).alias("line")
    )
    preamble = heads.select("file", F.lit(-2).cast("long").alias("seq"), F.lit("Glucose Data,export").alias("line"))
    parsed = libre.parse_lines(body.unionByName(heads).unionByName(preamble))
    return parsed.select("file", "timestamp", "event", "value")


@query("read_glooko_zip", EVENT_SQL.format(file=USER_FILE, ts=ts(STAMP), where="WHERE kind <> 'click' OR value % 90.0 > 0"))
def _(t):
    kind, value = F.col("event_type"), F.col("value")
    file = F.concat(F.lit("u"), _text(F.col("patient_id")))
    comma = lambda v: F.concat(F.lit('"'), F.replace(_text(v), F.lit("."), F.lit(",")), F.lit('"'))
    entry = (
        F.when(kind == "view", "cgm_data_1.csv").when(kind == "error", "bg_data_1.csv")
        .when(kind == "signup", "Insulin data/basal_data_1.csv").otherwise("Insulin data/bolus_data_1.csv")
    )
    stamp = F.date_format(STAMP, "dd/MM/yyyy HH:mm")
    line = (
        F.when(kind.isin("view", "error"), F.concat_ws(",", stamp, comma(_glucose(t))))
        .when(kind == "signup", F.concat_ws(",", stamp, comma(value % 10.0)))
        .when(kind == "purchase", F.concat_ws(",", stamp, comma(value % 10.0), F.lit("")))
        .otherwise(F.concat_ws(",", stamp, F.lit(""), comma(value % 90.0)))
    )
    body = t._entity.select(file.alias("file"), entry.alias("entry"), (F.col("id") + 2).alias("line_no"), line.alias("line"))
    second = (
        F.when(F.col("entry").startswith("cgm"), glooko.CGM_VALUE).when(F.col("entry").startswith("bg"), glooko.BG_VALUE)
        .when(F.col("entry").contains("basal"), glooko.BASAL_RATE)
        .otherwise(f"{glooko.BOLUS_UNITS},{glooko.BOLUS_CARBS}")
    )
    entries = body.select("file", "entry").distinct()
    header = entries.select("file", "entry", F.lit(1).cast("long").alias("line_no"), F.concat_ws(",", F.lit(glooko.DATE), second).alias("line"))
    name = entries.select("file", "entry", F.lit(0).cast("long").alias("line_no"), F.lit("Nome:Test").alias("line"))
    parsed = glooko.parse_lines(body.unionByName(header).unionByName(name))
    return parsed.select("file", "timestamp", "event", "value")


def _xml_rows(t):
    kind, value = F.col("event_type"), F.col("value")
    stamp = F.date_format(STAMP, "dd-MM-yyyy HH:mm:ss")
    later = F.date_format(F.col(STAMP) + F.expr("interval 30 minutes"), "dd-MM-yyyy HH:mm:ss")
    tag = (
        F.when(kind == "view", "glucose_level").when(kind == "signup", "basal").when(kind == "error", "temp_basal")
        .when(kind == "purchase", "bolus").otherwise("meal")
    )
    return t._entity.select(
        "patient_id",
        F.concat(
            F.lit("/cohort/"), F.when(F.col("patient_id") % 2 == 0, "2018").otherwise("2020"), F.lit("/"),
            F.when(F.col("patient_id") % 3 == 0, "train").otherwise("test"), F.lit("/"), _text(F.col("patient_id")), F.lit("-ws.xml"),
        ).alias("file"),
        tag.alias("tag"),
        F.col("id").alias("seq"),
        stamp.alias("ts"),
        F.when(kind == "view", _text(_glucose(t) * 18.0)).otherwise(_text(value % 3.0)).alias("value"),
        stamp.alias("ts_begin"),
        later.alias("ts_end"),
        _text(value % 10.0).alias("dose"),
        F.when(F.col("id") % 2 == 0, _text(value % 60.0)).alias("bwz_carb_input"),
        _text(value % 90.0).alias("carbs"),
    )


def _flat(parts):
    """All parts as (patient, kind, minute, amount)."""
    columns = {"glucose": "glucose", "basal": "rate", "temp_basal": "rate", "boluses": "units", "meals": "carb_g"}
    out = None
    for name, df in parts.items():
        at = "begin" if name == "temp_basal" else "minute"
        part = df.select("patient_id", F.lit(name).alias("kind"), F.col(at).alias("minute"), F.col(columns[name]).alias("amount"))
        out = part if out is None else out.unionByName(part)
    return out


XML_SQL = """WITH o AS (SELECT patient_id, min(timestamp) AS t0 FROM entity WHERE kind = 'view' GROUP BY 1),
    x AS (SELECT e.*, (epoch(timestamp) - epoch(t0)) // 60 AS m FROM entity e JOIN o ON o.patient_id = e.patient_id),
    g AS (SELECT patient_id, CAST(m AS BIGINT) AS minute, arg_min((2.5 + value % 12.0) * 18.0 / 18.0182, id) AS v FROM x WHERE kind = 'view' GROUP BY 1, 2),
    n AS (SELECT patient_id, max(minute) AS last FROM g GROUP BY 1)
    SELECT patient_id, 'glucose' AS kind, minute, round(v, 6) AS amount FROM g
    UNION ALL SELECT patient_id, CASE kind WHEN 'signup' THEN 'basal' ELSE 'temp_basal' END, CAST(m AS BIGINT), round(value % 3.0 / 60.0 * 1000.0, 6)
      FROM x WHERE kind IN ('signup', 'error')
    UNION ALL SELECT x.patient_id, CASE kind WHEN 'purchase' THEN 'boluses' ELSE 'meals' END, CAST(m AS BIGINT),
      round(CASE kind WHEN 'purchase' THEN value % 10.0 ELSE value % 90.0 END, 6) FROM x JOIN n ON n.patient_id = x.patient_id
      WHERE kind IN ('purchase', 'click') AND m >= 0 AND m <= last"""


@query("read_ohio_xml", XML_SQL)
def _(t):
    return _flat(clinical.assemble_xml(_xml_rows(t)))


@query(
    "read_ohio_cohort",
    """SELECT CASE WHEN patient_id % 2 = 0 THEN '2018' ELSE '2020' END AS year, CASE WHEN patient_id % 3 = 0 THEN 'train' ELSE 'test' END AS split,
       count(DISTINCT patient_id) AS patients, count(*) AS events FROM entity GROUP BY 1, 2""",
)
def _(t):
    rows = clinical.with_path_split(_xml_rows(t))
    per_patient = rows.groupBy("year", "split", "patient_id").agg(F.count(F.lit(1)).alias("n"))
    return per_patient.groupBy("year", "split").agg(F.count(F.lit(1)).alias("patients"), F.sum("n").alias("events"))


def _five_minute(t):
    kind, value = F.col("event_type"), F.col("value")
    only = lambda k, v: F.when(kind == k, _text(v)).otherwise("0.0")
    return t._entity.select(
        "patient_id",
        F.date_format(STAMP, "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
        _text(_glucose(t) * 18.0).alias("glucose"),
        _text(value % 2.0).alias("basal_rate"),
        only("purchase", value % 10.0).alias("bolus_volume_delivered"),
        only("click", value % 9.0).alias("carb_input"),
    )


@query(
    "read_hupa_csv",
    """WITH o AS (SELECT patient_id, min(timestamp) AS t0 FROM entity GROUP BY 1),
       x AS (SELECT e.*, CAST((epoch(timestamp) - epoch(t0)) // 60 AS BIGINT) AS m FROM entity e JOIN o ON o.patient_id = e.patient_id)
       SELECT patient_id, 'basal' AS kind, m AS minute, round(value % 2.0 * 1000.0 / 5, 6) AS amount FROM x
       UNION ALL SELECT patient_id, 'boluses', m, round(value % 10.0, 6) FROM x WHERE kind = 'purchase' AND value % 10.0 > 0
       UNION ALL SELECT patient_id, 'meals', m, round(value % 9.0 * 10.0, 6) FROM x WHERE kind = 'click' AND value % 9.0 > 0""",
)
def _(t):
    parts = clinical.assemble_five_minute(_five_minute(t))
    return _flat({k: v for k, v in parts.items() if k != "glucose"})


def _streams(t):
    day_first = F.date_format(STAMP, "dd/MM/yyyy HH:mm")
    value = F.col("value")

    def stream(kinds, ts_name, name, amount):
        return t._entity.filter(F.col("event_type").isin(*kinds)).select(
            "patient_id", day_first.alias(ts_name), _text(amount).alias(name)
        )

    return {
        "glucose": stream(("view", "error"), "bg_ts", "value", _glucose(t)),
        "bolus": stream(("purchase",), "bolus_ts", "bolus_dose", value % 10.0),
        "basal": stream(("signup",), "basal_ts", "basal_dose", value % 2.0),
        "nutrition": stream(("click",), "meal_ts", "carbs_g", value % 90.0),
    }


@query(
    "read_manchester_csv",
    """WITH o AS (SELECT patient_id, min(timestamp) AS t0, max(timestamp) AS t1 FROM entity WHERE kind IN ('view', 'error') GROUP BY 1),
       f AS (SELECT patient_id FROM entity GROUP BY 1 HAVING count(DISTINCT CASE WHEN kind = 'error' THEN 'view' ELSE kind END) = 4),
       x AS (SELECT e.*, CAST((epoch(timestamp) - epoch(t0)) // 60 AS BIGINT) AS m, CAST((epoch(t1) - epoch(t0)) // 60 AS BIGINT) AS last
         FROM entity e JOIN o ON o.patient_id = e.patient_id JOIN f ON f.patient_id = e.patient_id)
       SELECT patient_id, 'basal' AS kind, m AS minute, round(value % 2.0 / 60.0 * 1000.0, 6) AS amount FROM x WHERE kind = 'signup'
       UNION ALL SELECT patient_id, 'boluses', m, round(value % 10.0, 6) FROM x WHERE kind = 'purchase' AND value % 10.0 > 0 AND m >= 0 AND m <= last
       UNION ALL SELECT patient_id, 'meals', m, round(value % 90.0, 6) FROM x WHERE kind = 'click' AND value % 90.0 > 0 AND m >= 0 AND m <= last""",
)
def _(t):
    parts = clinical.assemble_streams(_streams(t))
    return _flat({k: v for k, v in parts.items() if k != "glucose"})


@query("read_realdata_generic")
def _(t):
    named = {
        "xml": clinical.assemble_xml(_xml_rows(t)),
        "five_minute": clinical.assemble_five_minute(_five_minute(t)),
        "streams": clinical.assemble_streams(_streams(t)),
    }
    tagged = {
        name: {k: df.withColumn("patient_id", F.concat(F.lit(name + "-"), _text(F.col("patient_id")))) for k, df in parts.items()}
        for name, parts in named.items()
    }
    samples, counts = clinical.generic(tagged)
    sizes = samples.groupBy("cohort", "patient_id").agg(F.count(F.lit(1)).alias("samples"), F.max("minute").alias("last_minute"))
    return sizes.join(counts, "patient_id")


@query(
    "tidy_shanghai",
    f"""SELECT patient_id, {ts(STAMP)} AS time, round((2.5 + value % 12.0) * 18.0 / 18.0182, 2) AS glucose,
        round(CASE WHEN kind = 'purchase' THEN value % 10.0 ELSE 0.0 END + CASE WHEN kind = 'signup' THEN value % 10.0 ELSE 0.0 END, 3) AS bolus,
        0.0::DOUBLE AS basal_rate, CASE WHEN kind = 'click' THEN 'rice tea' ELSE '' END AS dietary_intake FROM entity""",
)
def _(t):
    kind, value = F.col("event_type"), F.col("value")
    raw = t._entity.select(
        "patient_id",
        F.date_format(STAMP, "yyyy-MM-dd HH:mm:ss").alias("Date"),
        (_glucose(t) * 18.0).alias("CGM (mg / dl)"),
        F.when(kind == "purchase", value % 10.0).alias("Insulin dose - s.c."),
        F.when(kind == "signup", value % 10.0).alias("CSII - bolus insulin (Novolin R, IU)"),
        F.when(kind == "click", " rice\ntea ").when(kind == "view", "nan").alias("Dietary intake"),
    )
    return clinical.tidy_sheet(raw)
