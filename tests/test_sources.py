import json
import zipfile

from pyspark.sql import functions as F

from sugartrace.operators import events
from sugartrace.sources import clinical, cohort, glooko, libre, thresholds


def test_libre_csv(spark, tmp_path):
    header = "Device,Device Timestamp,Record Type,Historic Glucose mmol/L,Scan Glucose mmol/L,Rapid-Acting Insulin (units),Long-Acting Insulin Value (units),Carbohydrates (grams)"
    body = ["L,01-05-2024 08:00,0,6.5,,,,", "L,2024-05-01 08:05:00,5,,,,,45", "L,01/05/2024 08:10,1,,7.2,,,", "L,01-05-2024 08:15,4,,,3.5,,",
            'L,"01-05-2024 08:20",4,,,,12,', "L,never,0,6.5,,,,", "L,01-05-2024 08:30,x,6.5,,,,", "short", "L,01-05-2024 08:40,1,9.9,,,,"]
    (tmp_path / "a.csv").write_text("\n".join(["Glucose Data,Generated", "", header, *body]))
    (tmp_path / "b.csv").write_text("\n".join([header.replace(",", ";"), "L;01-05-2024 08:00;0;6.5;;;;"]))
    (tmp_path / "c.csv").write_text("no,header\n1,2")
    rows = libre.read(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
    got = sorted((r.file, r.event, str(r.timestamp)[11:16], r.value) for r in rows.collect())
    assert got == [("a.csv", "basal", "08:20", 12.0), ("a.csv", "bolus", "08:15", 3.5), ("a.csv", "glucose", "08:00", 6.5),
                   ("a.csv", "glucose", "08:10", 7.2), ("a.csv", "meal", "08:05", 45.0), ("b.csv", "glucose", "08:00", 6.5)]
    tables = libre.entities(rows)
    assert [tables[k].count() for k in ("glucoses", "meals", "insulins")] == [3, 1, 2]


def test_glooko_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "export.zip", "w") as z:
        z.writestr("cgm_data_1.csv", "Nome:X\nData e ora,Valore glicemia CGM (mmol/l)\n01/07/2024 10:00,\"6,5\"\nbad,1\n")
        z.writestr("bg_data_1.csv", "Data e ora,Valore glucosio (mmol/l)\n01/07/2024 10:05,7.1\n")
        z.writestr("Insulin data/basal_data_1.csv", "Name:X\nData e ora,Frequenza\n01/07/2024 11:00,\n")
        z.writestr("Insulin data/bolus_data_1.csv",
                   "Nome:X\nData e ora,Consumo di carboidrati (g),Insulina erogata (U)\n01/07/2024 12:00,\"30,5\",\"4,2\"\n01/07/2024 12:30,0,1\n")
        z.writestr("bolus_data_2.csv", "Data e ora,Insulina erogata (U)\n01/07/2024 12:00,9\n")
        z.writestr("empty.csv", "")
    out = glooko.read(spark, str(tmp_path / "*.zip"), tz="Europe/Rome").collect()
    got = sorted((r.event, r.source, str(r.timestamp)[11:16], r.value) for r in out)
    assert got == [("basal", "glooko", "09:00", 0.0), ("bolus", "glooko", "10:00", 4.2), ("bolus", "glooko", "10:30", 1.0),
                   ("glucose", "glooko_cgm", "08:00", 6.5), ("glucose", "glooko_manual", "08:05", 7.1), ("meal", "glooko", "10:00", 30.5)]


XML = """<?xml version="1.0"?><patient id="{id}"><glucose_level>
<event ts="01-01-2021 00:00:00" value="180.182"/><event ts="01-01-2021 00:05:00" value="90.091"/><event ts="01-01-2021 01:00:00" value="90.091"/>
</glucose_level><basal><event ts="01-01-2021 00:02:00" value="1.2"/></basal>
<temp_basal><event ts_begin="01-01-2021 00:10:00" ts_end="01-01-2021 00:12:00" value="0.6"/></temp_basal>
<bolus><event ts_begin="01-01-2021 00:20:30" ts_end="01-01-2021 00:20:30" dose="3.0" bwz_carb_input="40"/><event ts_begin="01-01-2021 09:00:00" ts_end="x" dose="1"/></bolus>
<meal><event ts="01-01-2021 00:21:00" carbs="45"/></meal></patient>"""


def test_ohio_xml(spark, tmp_path):
    for year, split, pid in (("2018", "test", "540"), ("2020", "test", "552"), ("2020", "train", "552")):
        folder = tmp_path / year / split
        folder.mkdir(parents=True)
        (folder / f"{pid}-ws.xml").write_text(XML.format(id=pid))
    rows = clinical.read_xml_cohort(spark, str(tmp_path))
    assert {(r.year, r.split, r.patient_id) for r in rows.collect()} == {("2018", "test", "540"), ("2020", "test", "552")}
    one = clinical.assemble_xml(clinical.read_xml_cohort(spark, str(tmp_path), "2018"))
    out = {r.minute: r for r in clinical.render(one).collect()}
    assert len(out) == 61 and abs(out[0].glucose - 10.0) < 1e-9 and abs(out[5].glucose - 5.0) < 1e-9
    assert out[3].valid and not out[30].valid and out[60].valid
    assert (round(out[0].basal, 6), round(out[2].basal, 6), round(out[11].basal, 6), round(out[13].basal, 6)) == (0.0, 20.0, 10.0, 20.0)
    assert round(out[20].insulin, 6) == 1020.0 and out[20].carbs == 2000.0 and out[40].carbs == 0.0
    assert [(r.minute, r.carb_g) for r in one["meals"].collect()] == [(21, 45.0)] and one["boluses"].count() == 1


def test_five_minute_csv(spark, tmp_path):
    lines = ["time;glucose;calories;heart_rate;steps;basal_rate;bolus_volume_delivered;carb_input"]
    rows = [(0, 0, 0), (5, 2.0, 0), (10, 0, 3.0), (15, 0, 0), (40, 1.0, 0)]
    lines += [f"2021-01-01T00:{m:02d}:00;90.091;1;1;1;0.05;{b};{c}" for m, b, c in rows]
    (tmp_path / "HUPA0001P.csv").write_text("\n".join(lines))
    parts = clinical.assemble_five_minute(clinical.read_five_minute_csv(spark, str(tmp_path / "*.csv")))
    assert sorted((r.patient_id, r.minute, r.units, r.carb_g) for r in parts["boluses"].collect()) == [
        ("HUPA0001P", 5, 2.0, 30.0), ("HUPA0001P", 40, 1.0, 0.0)]
    out = {r.minute: r for r in clinical.render(parts).collect()}
    assert len(out) == 41 and out[0].basal == 10.0 and abs(out[7].glucose - 5.0) < 1e-9 and round(out[5].carbs) == 1500
    counts = clinical.summary_counts(parts).collect()[0]
    assert (counts.n_insulin, counts.n_carb) == (2, 1)


def test_stream_folders_need_all_four(spark, tmp_path):
    files = {
        "Glucose Data/UoMGlucose2301.csv": "bg_ts,value\n01/02/2023 00:00,7.0\n01/02/2023 00:05,8.0\n01/02/2023 01:00,x\n",
        "Glucose Data/UoMGlucose2302.csv": "bg_ts,value\n01/02/2023 00:00,7.0\n",
        "Insulin Data/Bolus Data/UoMBolus2301.csv": "bolus_ts,bolus_dose\n01/02/2023 00:03,2.5\n01/02/2023 00:04,0\n",
        "Insulin Data/Basal Data/UoMBasal2301.csv": "basal_ts,basal_dose\n01/02/2023 00:01,0.6\n",
        "Nutrition Data/UoMNutrition2301.csv": "meal_ts,carbs_g\n01/02/2023 00:05,30\n",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    parts = clinical.assemble_streams(clinical.read_streams(spark, str(tmp_path)))
    assert [(r.patient_id, r.minute, r.units, r.carb_g) for r in parts["boluses"].collect()] == [("2301", 3, 2.5, 30.0)]
    assert {r.patient_id for r in parts["glucose"].collect()} == {"2301"}
    samples, counts = clinical.generic({"streams": parts})
    assert samples.count() == 2 and counts.count() == 1


def test_cohort_parquet_to_events(spark, tmp_path):
    rows = [("7", 35.0, 0, 360, 360, 6.5, 12000.0, 12000.0, 150.0), ("7", 35.0, 0, 361, 361, 6.7, 0.0, 0.0, 50.0)]
    schema = "patient_id string, patient_age_years double, day long, minute long, absolute_minute long, blood_glucose double, cho_mg_min double, cho_mg_announced double, insulin_mU_min double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "c"))
    df = cohort.read(spark, str(tmp_path / "c"))
    meals = events.meal_events(cohort.announced_or_consumed(df)).collect()
    assert [(r.absolute_minute, r.carbs, r.meal_type) for r in meals] == [(360, 12.0, "breakfast")]
    assert [(r.absolute_minute, r.units) for r in events.bolus_events(df).collect()] == [(360, 0.15)]
    assert [(r.absolute_minute, r.units) for r in events.basal_events(df).collect()] == [(360, 0.05)]
    plain = cohort.select_signals(df.drop("cho_mg_announced"))
    assert {r.cho_mg_announced for r in plain.collect()} == {0.0}
    consumed = cohort.announced_or_consumed(df.drop("cho_mg_announced"))
    assert sorted(r.cho_mg for r in consumed.collect()) == [0.0, 12000.0]
    profile = {r.column: r for r in cohort.describe(df).collect()}
    assert profile["blood_glucose"].rows == 2 and profile["minute"].min == "360"


def test_thresholds_file(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"veryLow": 2.8, "high": 11.0}))
    asked = spark.createDataFrame([(1, None, 4.0, None, None)], "patient_id int, very_low double, low double, high double, very_high double")
    row = thresholds.resolve(asked, thresholds.read(spark, str(tmp_path / "t.json"))).collect()[0]
    assert (row.very_low, row.low, row.high, row.very_high) == (2.8, 4.0, 11.0, 13.9)


def test_tidy_sheet(spark):
    raw = spark.createDataFrame(
        [("p", "2021-01-01 00:15:00", 180.0, None, " rice\ntea "), ("p", "2021-01-01 00:00:00", 90.0, 2.0, None)],
        "patient_id string, Date string, `CGM (mg / dl)` double, `Insulin dose - s.c.` double, `Dietary intake` string")
    out = clinical.tidy_sheet(raw).collect()
    assert [(r.glucose, r.bolus, r.basal_rate, r.dietary_intake) for r in out] == [(4.99, 2.0, 0.0, ""), (9.99, 0.0, 0.0, "rice tea")]
