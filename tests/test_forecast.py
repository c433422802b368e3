import math

from quillspan.operators import forecast, models
from quillspan.sources import readers

ROWS = """deviceId,timedate,period,x1,x2,x3,deviceType,t1,t2,t3,t4,t5,t6
a,2024-09-01 00:05,train,1,10,2.5,1,5,,3,1,4,2
a,2024-09-01 12:10,train,3,30,2.5,1,NaN,,5,1,4,2
a,2024-10-02 06:00,valid,2,20,2.5,1,1,2,3,4,5,6
b,2024-10-02 18:00,test,2,,0.5,2,1,2,3,4,5,6
,2024-10-02 18:00,test,2,1,0.5,2,1,2,3,4,5,6
"""
SCHEMA = ", ".join(c for c in readers.TELEMETRY.split(", ") if c.split()[0] in ROWS.split("\n")[0].split(","))


def read(spark, tmp_path):
    (tmp_path / "data.csv").write_text(ROWS)
    rows = readers.csv(spark, str(tmp_path / "data.csv"), SCHEMA)
    return rows, spark.createDataFrame([("a", 52.0, 21.0)], "deviceId string, latitude double, longitude double")


def test_fact_csv_to_inputs(spark, tmp_path):
    found = {(r["deviceId"], r["month_key"]): r for r in forecast.table_of(*read(spark, tmp_path)).collect()}
    assert set(found) == {("a", "2024_9"), ("a", "2024_10"), ("b", "2024_10")}
    r = found["a", "2024_9"]
    assert (r["x1"], r["t1"], r["t2"], r["x2_std"], r["t1_std"]) == (2, 2.5, 0, 10, 2.5)  # nulls count as 0
    assert (r["delta_source"], r["delta_source_std"], r["delta_load"], r["delta_load_std"]) == (3, 1, 2, 0)
    assert abs(r["hour_cos"]) < 1e-12 and abs(r["hour_sin"]) < 1e-12  # midnight and noon cancel out
    assert abs(found["a", "2024_10"]["hour_sin"] - 1) < 1e-12 and abs(found["a", "2024_10"]["month_cos"] - math.cos(2 * math.pi * 10 / 12)) < 1e-12
    assert [found[k]["device_baseline"] for k in sorted(found)] == [20, 20, 0] and found["b", "2024_10"]["latitude"] is None
    assert (r["device_month"], r["curve_month"]) == ("1.0_9", "2.5_9")
    assert len(forecast.INPUTS) == 22 and set(forecast.INPUTS) <= set(r.asDict())


def test_models_are_saved_and_loaded(spark, tmp_path):
    rows = [(str(d), f"2024-0{m}-01 0{m}:00", "valid" if m > 6 else "train", float(m), float(d * m), 1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0) for d in range(8) for m in range(1, 9)]
    devices = spark.createDataFrame([(str(d), 50.0 + d, 20.0) for d in range(8)], "deviceId string, latitude double, longitude double")
    whole = forecast.table_of(spark.createDataFrame(rows, SCHEMA), devices)
    model = forecast.fit(whole, rounds=2, depth=2)
    models.save(model, str(tmp_path / "trees"))
    again = models.load(str(tmp_path / "trees"))
    asked = lambda m: sorted(map(tuple, forecast.predictions(m, whole, "valid").collect()))
    assert asked(again) == asked(model) and len(asked(model)) == 16
    wide = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(20)], "k long, f array<double>, class_1 int")
    boosters = models.gbt_per_class(wide, "f", ["class_1"], rounds=2, depth=2)
    models.save(boosters, str(tmp_path / "classes"))
    loaded = models.load(str(tmp_path / "classes"), ["class_1"])
    pick = lambda m: sorted(map(tuple, models.class_probabilities(m, wide, "f", "k", ["class_1"]).collect()))
    assert pick(loaded) == pick(boosters)


def test_networks_by_batch(spark):
    def make():
        return lambda x: x * 2

    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<float>")
    assert sorted(r[0] for r in df.select(models.batch_predictor(make, [2])("v")).collect()) == [[2.0, 4.0], [6.0, 8.0]]
