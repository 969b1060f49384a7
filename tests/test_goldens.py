"""Hand-computed values of the small fixtures, invariants, stores, streams and sources."""

import datetime
import io
import json
import math
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.frames import exact_quantiles, require, running_totals
from wardline.functions import icd, phi
from wardline.functions.register import register
from wardline.functions.student import two_sided_p
from wardline.operators import calibration, classifier, fairness, models, monitor, privacy, quality, temporal
from wardline.operators import healthcare as H
from wardline.plans.lineage import Run
from wardline.sources import fhir, files, rest, stores, synthetic
from wardline.streaming import streams


def day(m, d):
    return datetime.datetime(2023, m, d)


@pytest.fixture(scope="module")
def encounters(spark):
    rows = [("P001", "E001", day(1, 1), day(1, 5), 0, 0.05, 0, 0, 0.3), ("P001", "E002", day(2, 10), day(2, 15), 0, 0.08, 1, 1, 0.7), ("P002", "E003", day(3, 1), day(3, 8), 0, 0.10, 0, 0, 0.2), ("P003", "E004", day(4, 1), day(4, 10), 1, 0.80, 0, 0, 0.9)]
    return spark.createDataFrame(rows, "patient_id string, encounter_id string, admission_date timestamp_ntz, discharge_date timestamp_ntz, mortality int, expected double, readmission int, complication int, prediction double")


def test_stay_and_readmission(encounters):
    assert [r.los for r in H.with_los(encounters).orderBy("encounter_id").collect()] == [4, 5, 7, 9]
    assert H.readmission_rate(encounters, 30).first().rate == 0
    assert H.readmission_rate(encounters, 40).first().rate == pytest.approx(1 / 3)
    flags = H.with_readmission_flag(encounters.drop("readmission"), 40).orderBy("encounter_id").collect()
    assert [r.readmission for r in flags] == [0, 1, 0, 0]
    with pytest.raises(ValueError, match="missing"):
        require(encounters, ["nothing"])


def test_mortality(encounters):
    assert H.mortality_index(encounters).first().mortality_index == pytest.approx(0.970874, abs=1e-6)
    r = H.standardized_mortality(encounters).first()
    assert r.smr == pytest.approx(1 / 1.03) and r.upper == pytest.approx(math.exp(1.96) / 1.03) and r.lower == pytest.approx(math.exp(-1.96) / 1.03)
    none = H.standardized_mortality(encounters.withColumn("mortality", F.lit(0))).first()
    assert none.smr == 0 and none.lower == 0 and none.upper == pytest.approx(3.69 / 1.03)
    assert H.excess_events(encounters, "mortality", "expected").first().excess == pytest.approx(-0.03)
    assert H.complication_rate(encounters).first().complication_rate == 0.25


def test_classifier(encounters, spark):
    assert classifier.auc(encounters, "prediction", "mortality").first().auc == 1
    assert classifier.brier(encounters, "prediction", "mortality").first().brier == pytest.approx(0.1575)
    assert classifier.auc(encounters.where("mortality = 0"), "prediction", "mortality").first().auc is None
    rng = np.random.default_rng(0)
    rows = [(float(p), int(rng.random() < p)) for p in np.round(rng.random(300), 2)]
    df = spark.createDataFrame(rows, "p double, y int")
    a = classifier.auc(df).first().auc
    assert classifier.auc(df.withColumn("p", 1 - F.col("p"))).first().auc == pytest.approx(1 - a)
    p, y = np.array(rows).T
    won = (p[y == 1][:, None] > p[y == 0]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0]).mean()
    assert a == pytest.approx(won)
    assert {r.bin for r in classifier.calibration_bins(spark.createDataFrame([(0.0, 0), (0.1, 1), (1.0, 1)], "p double, y int")).collect()} == {0, 9}


def test_fairness_and_calibration(spark):
    rows = [("A", 0.9, 1), ("A", 0.4, 0), ("B", 0.6, 0), ("B", 0.2, 1), (None, 0.9, 1)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    r = fairness.disparities(fairness.group_rates(df, "g")).first()
    assert (r.demographic_parity, r.equal_opportunity, r.equalized_odds, r.predictive_parity) == (0, 1, 1, 1)
    one = fairness.disparities(fairness.group_rates(df.where("g = 'A'"), "g")).first()
    assert one.demographic_parity == 0
    rng = np.random.default_rng(1)
    p = rng.random(400)
    y = (rng.random(400) < p**2).astype(float)
    for method in ("isotonic", "platt", "beta"):
        q = calibration.calibrated(p, y, method)
        assert np.mean((q - y) ** 2) < np.mean((p - y) ** 2)
    assert (np.diff(calibration.calibrated(p, y, "isotonic")[np.argsort(p)]) >= 0).all()


def test_temporal(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("a", t0 + datetime.timedelta(days=d), v) for d, v in ((0, 1.0), (1, 2.0), (2, None), (6, 7.0), (7, 8.0))] + [("b", t0, 5.0), (None, t0, 1.0)]
    df = spark.createDataFrame(rows, "patient_id string, ts timestamp_ntz, v double")
    r = {x.patient_id: x for x in temporal.window_features(df, ["patient_id"], "ts", "v", (1, 7), ("mean", "count", "std", "slope"), trend=True).collect()}
    assert set(r) == {"a", "b"} and r["a"].v_1d_mean == 7.5 and r["a"].v_7d_count == 4 and r["a"].v_7d_slope is None and r["b"].v_7d_std is None and r["b"].v_1d_slope == 0
    filled = [x.v for x in temporal.interpolate(df, ["patient_id"], "ts", ["ts"], "v").where("patient_id = 'a'").orderBy("ts").collect()]
    assert filled == [1, 2, 3, 7, 8]
    days = temporal.daily(df.where("patient_id = 'a'"), ["patient_id"], "ts", "v").orderBy("day").collect()
    assert [x.v for x in days] == [1, 2, 3, 4, 5, 6, 7, 8]
    with pytest.raises(ValueError, match="unknown aggregate"):
        temporal.window_features(df, ["patient_id"], "ts", "v", aggregates=("mode",))


def test_running_totals(spark):
    rng = np.random.default_rng(2)
    rows = [(None if g == 3 else int(g), float(i), int(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 4, 400), rng.integers(0, 9, 400)))]
    df = spark.createDataFrame(rows, "g int, x double, v long")
    for by in ([], ["g"]):
        got = {r.x: (r.v_upto, r.v_total) for r in running_totals(df, "x", ["v"], by, bins=7).collect()}
        for g, x, _ in rows:
            mine = [(b, c) for a, b, c in rows if not by or a == g]
            assert got[x] == (sum(c for b, c in mine if b >= x), sum(c for _, c in mine))
    assert running_totals(df.limit(0), "x", ["v"]).count() == 0


def test_student():
    # values of printed tables: two-sided 5 % points
    for df, t in ((1, 12.706), (5, 2.571), (10, 2.228), (30, 2.042), (120, 1.980)):
        assert two_sided_p(np.array([t]), np.array([df]))[0] == pytest.approx(0.05, abs=2e-4)
    assert two_sided_p(np.array([0.0, np.inf]), np.array([4, 4])).tolist() == [1, 0]


def test_spectrum():
    f, p = temporal._welch(np.sin(2 * np.pi * 0.2 * np.arange(40)))
    assert f[p.argmax()] == pytest.approx(0.2)


def test_codes(spark):
    rows = spark.createDataFrame([("i10",), (" E11.9 ",), ("S72.001A",), ("O9A.1",), (None,), ("U07",)], "c string")
    got = [(r.n, r.ch) for r in rows.select(icd.normal(F.col("c")).alias("n"), icd.chapter(icd.normal(F.col("c"))).alias("ch")).collect()]
    assert got == [("I10", "I00-I99"), ("E119", "E00-E89"), ("", None), ("", None), ("", None), ("U07", None)]
    assert register(spark)
    r = spark.sql("SELECT normalize_icd10(' e11.9') AS a, icd_chapter('I10') AS b, risk_band(0.8D) AS c, deid_hash('x', 's') AS d, is_icd10('A01.0') AS e").first()
    assert (r.a, r.b, r.c, r.e) == ("E119", "I00-I99", "high", True) and len(r.d) == 64


def test_privacy(spark):
    df = spark.createDataFrame([(1, 91, "F", "Ann Lee", "2024-01-05", "x"), (2, 91, "F", "Bob Ray", "bad", "y"), (3, 40, "M", None, None, "z")], "patient_id long, age int, gender string, full_name string, birth_date string, note string")
    out = {r.note: r for r in privacy.deidentify(df, "patient_id", privacy.Deidentification("s", k=2), dates=["birth_date"]).collect()}
    assert out["x"].age == "89+" and out["x"].gender == "F" and out["x"].full_name == "[REDACTED]" and len(out["x"].patient_id) == 64
    assert out["y"].birth_date is None and out["z"].age == "40-44" and out["z"].gender == "[REDACTED]" and out["z"].full_name is None
    r = spark.createDataFrame([("call 555-123-4567 or a@b.org, MRN: 123",)], "t string")
    assert [r.select(phi.instances(F.col("t"), k)).first()[0] for k in ("phone", "email", "mrn", "ip_address")] == [1, 1, 1, 0]
    bundles = spark.createDataFrame([("ok", json.dumps({"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": "p", "birthDate": "1960-01-01", "name": [{"family": "X"}]}}, {"resource": {"resourceType": "Condition", "id": "c", "subject": {"reference": "Patient/p"}, "onsetDateTime": "2020-02-03T10:00:00Z"}}]})), ("bad", "{not json"), ("none", None)], "bundle_id string, bundle string")
    got = privacy.deidentify_bundles(bundles, privacy.Deidentification("s")).collect()
    assert sum(r.error is not None for r in got) == 2 and all(r.resource is None for r in got if r.error)
    good = [json.loads(r.resource) for r in got if not r.error]
    patient = next(r for r in good if r["resourceType"] == "Patient")
    assert "name" not in patient and next(r for r in good if r["resourceType"] == "Condition")["subject"]["reference"] == f"Patient/{patient['id']}"


def test_validation(spark):
    df = spark.createDataFrame([(1, "3.0", "M"), (1, "x", "Q"), (2, None, None)], "k int, n string, g string")
    e = quality.schema_errors(df, {"k": {"unique": True}, "n": {"type": "integer", "required": True}, "g": {"categories": ["M", "F"]}, "gone": {"required": True}}, "k").collect()
    assert sorted((r.column, r.rule) for r in e) == [("g", "category"), ("gone", "missing"), ("k", "unique"), ("n", "integer"), ("n", "required")]
    v = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 2, 2, 3, 3, 100])], "k int, v double")
    assert [r.value for r in quality.outliers(v, ["v"], "k").collect()] == [100]
    z = spark.createDataFrame([(i, 10.0 if i < 50 else 1000.0) for i in range(51)], "k int, v double")
    assert [r.value for r in quality.outliers(z, ["v"], "k", "z-score", 2).collect()] == [1000]
    assert quality.outliers(v.withColumn("v", F.lit(1.0)), ["v"], "k", "z-score").count() == 0
    with pytest.raises(ValueError):
        quality.outliers(v, ["v"], "k", "magic")
    with pytest.raises(ValueError):
        quality.consistency(v, {"x": ("k == 1; DROP TABLE x", "v > 0")})


def test_feature_store(spark, tmp_path):
    store = stores.FeatureStore(spark, str(tmp_path / "features"))
    row = lambda p, t, **v: (p, t, *v.values())
    store.upsert(spark.createDataFrame([row("P1", "2024-01-01T08:00:00", age=65.0), row("P2", "2024-01-01T08:00:00", age=50.0)], "patient_id string, feature_timestamp string, age double"))
    store.upsert(spark.createDataFrame([("P1", "2024-01-01T09:00:00", 70.0, 1.2)], "patient_id string, feature_timestamp string, age double, creatinine double"))
    store.upsert(spark.createDataFrame([("P1", "2024-01-02T09:00:00", 71.0)], "patient_id string, feature_timestamp string, age double"))
    assert store.all().count() == 3 and store.get("P1").first().age == 71
    assert {(r.patient_id, r.age) for r in store.all().where("feature_date = '2024-01-01'").collect()} == {("P1", 70.0), ("P2", 50.0)}
    assert [r.patient_id for r in store.recent("2024-01-03T00:00:00", 1).collect()] == ["P1"]
    assert {r.patient_id for r in store.batch(spark.createDataFrame([("P2",), ("P9",)], "patient_id string")).collect()} == {"P2"}
    s = store.stats().first()
    assert (s.patients, s.n_rows, s.features) == (2, 3, 2)
    store.erase("P1")
    assert [(r.patient_id, r.age) for r in stores.FeatureStore(spark, store.path).all().collect()] == [("P2", 50.0)]


def test_registry(spark):
    r = spark.createDataFrame([], "name string, version string, stage string, checksum string, registered_at string, path string")
    for v in ("1", "2"):
        r = stores.promote(stores.register(r, "m", v, "c", "p", f"2024-0{v}"), "m", v, "production")
    assert [(x.version, x.stage) for x in stores.versions(r, "m").collect()] == [("1", "archived"), ("2", "production")]
    assert {x.version for x in stores.delete_version(stores.delete_version(r, "m", "1"), "m", "2").collect()} == {"2"}


def test_fhir(spark):
    o = {"resourceType": "Observation", "id": "o", "code": {"coding": [{"code": "bp", "display": "BP"}]}, "subject": {"reference": "Patient/p"}, "component": [{"code": {"coding": [{"code": "s", "display": "S"}]}, "valueQuantity": {"value": 120, "unit": "mmHg"}}, {"code": {"coding": [{"code": "n"}]}}]}
    empty = {"resourceType": "Patient", "id": "p", "name": [], "address": [], "telecom": [], "identifier": []}
    rows = spark.createDataFrame([(x["resourceType"], x["id"], json.dumps(x)) for x in (o, empty, {"resourceType": "Observation", "id": "e"})], "resource_type string, id string, resource string")
    got = {r.observation_id: r for r in fhir.observations(rows).collect()}
    assert got["o"].code == "bp.s" and got["o"].display == "BP - S" and got["o"].value_num == 120 and got["e"].value is None
    p = fhir.patients(rows).first()
    assert p.patient_id == "p" and all(p[c] == "" for c in p.asDict() if c != "patient_id")
    record = fhir.patient_records(rows).first()
    assert record.clinical_events == [] and record.lab_results == []
    with pytest.raises(Exception, match="Bundle"):
        fhir.resources(spark.createDataFrame([('{"resourceType": "Patient"}',)], "bundle string")).collect()
    made = fhir.resources(synthetic.bundles(spark, 5))
    assert made.where("resource_type = 'Observation'").count() == 35


def test_rest():
    calls = []

    def send(request):
        calls.append(request.full_url)
        if len(calls) == 1:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {"Retry-After": "0"}, None)
        more = [{"relation": "next", "url": "http://x/page2"}] if "page2" not in request.full_url else []
        return io.BytesIO(json.dumps({"entry": [{"resource": {"resourceType": "Patient", "id": str(i)}} for i in range(3)], "link": more}).encode())

    client = rest.Client({"url": "http://x", "retryWait": 0}, send)
    assert len(list(client.search("Patient", {}, 5))) == 5 and len(calls) == 3 and "_count=5" in calls[0]
    reader = rest.FhirSource({"url": "http://x", "types": "Patient,Condition", "patients": "a,b,c", "patientsPerPartition": "2"}).reader(None)
    assert [(p.kind, p.parameters) for p in reader.partitions()] == [("Patient", {"_id": "a,b"}), ("Patient", {"_id": "c"}), ("Condition", {"patient": "a,b"}), ("Condition", {"patient": "c"})]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("p", 1.5), ("q", float("nan"))], "patient_id string, x double")
    for form in ("csv", "parquet", "json"):
        files.save(df, str(tmp_path / f"t.{form}"))
        assert files.load_batch(spark, str(tmp_path / f"t.{form}")).count() == 2
    assert files.find(spark, str(tmp_path), "*.csv").count() >= 1
    assert sorted(r.json for r in files.as_report(df).collect()) == ['{"patient_id":"p","x":1.5}', '{"patient_id":"q"}']
    with pytest.raises(ValueError):
        files.load(spark, "x.txt")


def test_lineage(spark, tmp_path):
    with Run(spark, "job", str(tmp_path / "events")) as run:
        run.watch(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), "t").write.parquet(str(tmp_path / "out"))
    events = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "events")).collect()]
    assert {e["eventType"] for e in events} == {"START", "COMPLETE"}
    assert next(e for e in events if e["eventType"] == "COMPLETE")["datasets"][0]["missing"] == 1


def test_monitoring(spark):
    for age, p, sensitivity, status in ((55.0, 0.35, 0.5, "Stable"), (80.0, 0.35, 0.01, "Age Drift"), (55.0, 0.9, 0.01, "Prediction Drift")):
        assert monitor.drift(spark.createDataFrame([(age, p)] * 20, "age double, prediction double"), sensitivity=sensitivity).first().status == status
    b = spark.createDataFrame([(1, "Stable"), (2, "Age Drift"), (3, "Stable")], "i int, status string")
    assert monitor.sticky(b, "i").first().status == "Age Drift"
    lines = spark.createDataFrame([("2024-01-05 x",), ("01/20/2024 y",), ("none",), ("99/99/2024",)], "l string")
    assert [r[0] for r in lines.select(monitor.in_range(F.col("l"), "2024-01-01", "2024-01-10")).collect()] == [True, False, True, True]


def test_explanations(spark):
    base = np.random.default_rng(1).random((50, 4))
    predict = lambda x: x @ np.array([1.0, 2.0, 0.0, -1.0])
    x, keys = np.ones((3, 4)), np.array([7, 8, -9])
    v = models.permutation_values(predict, x, base, keys, 400)
    assert np.allclose(v, (x - base.mean(axis=0)) * [1, 2, 0, -1], atol=0.15) and not np.allclose(v[0], v[1])
    assert np.allclose(models.permutation_values(predict, x[1:2], base, keys[1:2], 400), v[1])
    w = models.lime_values(predict, x, base, keys, 2000)  # shrunk by the penalty, in proportion
    assert np.allclose(w / w[:, :1], [1, 2, 0, -1], atol=0.25)
    row, c = models.counterfactuals(lambda z: z[:, 0], np.array([[0.4, 0, 0, 0], [0.45, 0, 0, 0]]), base * 3, keys[:2])
    assert row.tolist() == [0, 0, 0, 1, 1, 1] and (c[:, 0] >= 0.5).all()
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, -3.0)], "k string, u double, v double")
    got = {(r.key, r.feature): r.value for r in models.explain(rows, ["u", "v"], predict, base, "k", "attention").collect()}
    assert got == {("a", "u"): 0.5, ("a", "v"): 0.5, ("b", "u"): 0.25, ("b", "v"): 0.75}
    zero = np.zeros((1, 2))
    both = models.interactions(rows, ["u", "v"], lambda z: z[:, 0] * z[:, 1] + 5 * z[:, 0], zero, "k").collect()
    assert {(r.key, r.a, r.b): r.value for r in both} == {("a", "u", "v"): 0.0, ("b", "u", "v"): pytest.approx(-1.5)}

    def fails(x):
        if (x < 0).any():
            raise ValueError("negative")
        return x[:, 0]

    bad = models.batch_score(spark.createDataFrame([("a", 1.0), ("b", -1.0)], "patient_id string, x double"), ["x"], fails)
    assert {(r.key, r.status) for r in bad.collect()} == {("a", "ok"), ("b", "error")}


def test_cox(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    t = rng.exponential(1 / np.exp(x @ [0.8, -0.5]))
    d = t < 1.5
    df = spark.createDataFrame([(float(round(min(a, 1.5), 3)), int(e), float(u), float(v)) for a, e, (u, v) in zip(t, d, x)], "t double, d int, u double, v double")
    b = models.cox(df, "t", "d", ["u", "v"])
    assert b["u"] == pytest.approx(0.8, abs=0.2) and b["v"] == pytest.approx(-0.5, abs=0.2)


def test_streams(spark, tmp_path):
    bundles = synthetic.bundles(spark, 6).withColumn("bundle", F.when(F.col("bundle_id") == "P000001", "broken").otherwise(F.col("bundle")))
    bundles.write.parquet(str(tmp_path / "in"))
    stream = streams.read(spark, str(tmp_path / "in"), "bundle_id string, bundle string")
    streams.deidentified(stream, privacy.Deidentification("s"), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bad")).collect()[0].bundle_id == "P000001"
    assert spark.read.parquet(str(tmp_path / "out")).where("resource_type = 'Observation'").count() == 35
    spark.createDataFrame([("a", 50.0), ("a", 90.0), ("b", 50.0)], "k string, value double").write.parquet(str(tmp_path / "scores"))
    q = streams.drift_states(streams.read(spark, str(tmp_path / "scores"), "k string, value double"), "k", 50.0, 0.1)
    q = q.writeStream.format("memory").queryName("drifting").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k: r.status for r in spark.table("drifting").collect()} == {"a": "Drift", "b": "Stable"}


def test_calibration_by_group_of_many_rows(spark):
    """A large group is fitted on all its rows: 9,000 rare scores count once each, not as the frequent one's share."""
    n = 1_000_000
    i = np.arange(n)
    p, y = np.where(i < 9000, i / 10_000, 0.95), np.where(i < 9000, 1.0, i % 2)
    rows = spark.range(n).selectExpr("'a' AS g", "if(id < 9000, id / 10000D, 0.95D) AS p", "if(id < 9000, 1, id % 2) AS y")
    for method in ("isotonic", "platt", "beta"):
        r = calibration.by_group(rows, "g", method=method).first()
        assert r.n == n and abs(r.brier_after - np.mean((calibration.calibrated(p, y, method) - y) ** 2)) < 1e-9


def test_date_columns_after_nulls(spark):
    rows = spark.createDataFrame([(None, "x", i) for i in range(30)] + [("2020-01-02", "y", 30)], "born string, note string, n int").coalesce(1)
    assert privacy.date_columns(rows) == ["born"]
    assert privacy.date_columns(rows.where("n < 30")) == privacy.date_columns(rows.limit(0)) == []


def test_exact_quantiles(spark):
    """Equal to numpy's, in groups below and above the size that is ordered whole, with a value that most rows share."""
    rng = np.random.default_rng(2)
    x = {"few": rng.normal(size=7), "many": rng.normal(size=3000), "tied": np.where(rng.random(3000) < 0.8, 1.0, rng.random(3000)), None: np.array([4.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in x.items() for v in vs] + [("empty", None)], "g string, v double")
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    for whole in (100, 10_000):
        got = {r.g: r.q for r in exact_quantiles(df, "v", probabilities, ["g"], whole).collect()}
        assert set(got) == set(x) and all(np.allclose(got[g], np.quantile(v, probabilities)) for g, v in x.items())
    assert exact_quantiles(df, "v", [0.5]).first().q == pytest.approx([np.median(np.concatenate(list(x.values())))])


def test_split_by_stratum(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 3) for i in range(1000)] + [(5000, 9), (1, 1)], "k long, s int")
    rows = quality.split(df, "k", 0.3, "s").collect()
    assert len(rows) == 1002
    for s, n in ((0, 300), (1, 301), (2, 300), (None, 100)):
        assert sum(r.part == "test" for r in rows if r.s == s) in range(math.ceil(0.3 * (n - 1)), math.ceil(0.3 * (n - 1)) + 2)
    assert [r.part for r in rows if r.s == 9] == ["test"] and len({r.part for r in rows if r.k == 1}) == 1


def test_codes_by_row(spark):
    df = spark.createDataFrame([(1, ["i10", "E11.9", "bad code"]), (2, None), (3, ["I10", "I11"])], "i int, codes array<string>")
    from wardline.operators import icd as encoder

    got = {r.i: r for r in encoder.encode_rows(df, "codes", "count").collect()}
    assert (got[1].icd_group_hypertension, got[1].icd_group_diabetes, got[2].icd_group_hypertension, got[3].icd_group_hypertension) == (1, 1, 0, 2)
    one = encoder.encode_rows(spark.createDataFrame([("E11.9",), (None,), ("O99",)], "code string"), level="chapter").collect()
    assert [r["icd_chapter_E00-E89"] for r in one] == [1, 0, 0] and [r["icd_chapter_O00-O9A"] for r in one] == [0, 0, 1]
    assert [c for c in encoder.encode_rows(df, "codes", level="category").columns if c.startswith("icd")] == ["icd_category_E11", "icd_category_I10", "icd_category_I11"]


def test_notices_and_patients(spark):
    reads = spark.createDataFrame([("u", "n-1", "t0"), ("w", "n-2", "t0")], "user_id string, notification_id string, read_at string")
    notices = spark.createDataFrame([("n-1",), ("n-2",), ("n-3",)], "notification_id string")
    assert stores.unread(notices, reads, "u").first().unread == 2
    one = stores.mark_read(reads, "u", notices.where("notification_id = 'n-1'"), "t1")
    assert sorted(map(tuple, one.collect())) == [("u", "n-1", "t1"), ("w", "n-2", "t0")]
    every = stores.mark_read(one, "u", notices, "t2")
    assert stores.unread(notices, every, "u").first().unread == 0 and stores.unread(notices, every, "w").first().unread == 2
    p = spark.createDataFrame([("a", "A", 0.9, None), ("b", "B", 0.2, '["x"]')], "patient_id string, name string, risk_score double, medications string")
    a = stores.get_patient(p, "a").first()
    assert (a.id, a.riskBand, a.medications, a.labResults, a.age) == ("a", "high", "[]", "[]", None)
    assert stores.projected(p).columns == list(stores.BASIC.values()) and stores.get_patient(p, "z").count() == 0
    again = {r.patient_id: r for r in stores.recomputed(p, spark.createDataFrame([("b", 0.5)], "patient_id string, score double"), "now").collect()}
    assert (again["b"].risk_score, again["b"].risk_band, again["b"].updated_at) == (0.5, "medium", "now") and again["a"].updated_at is None
    twice = stores.recomputed(p, spark.createDataFrame([("b", 0.5), ("b", 0.8), ("b", None)], "patient_id string, score double"), "now").collect()
    assert len(twice) == 2 and {r.patient_id: r.risk_score for r in twice} == {"a": 0.9, "b": 0.8}
    repeated = stores.overlay(p, spark.createDataFrame([("b", "X"), ("b", "Y"), ("c", None), ("c", "Z")], "patient_id string, name string")).collect()
    assert sorted((r.patient_id, r.name) for r in repeated) == [("a", "A"), ("b", "Y"), ("c", "Z")]
    assert [r.patient_id for r in stores.delete_patients(p, p.where("patient_id = 'a'")).collect()] == ["b"]


def test_registered_models_and_checksums(spark, tmp_path):
    import hashlib

    r = spark.createDataFrame([], "name string, version string, stage string, checksum string, registered_at string, path string")
    for v, at in (("2", "2024-02"), ("10", "2024-01")):
        r = stores.register(r, "m", v, "c", "p", at)
    assert stores.get_version(r, "m").first().version == "2" and stores.get_version(r, "m", "10").first().version == "10" and stores.get_version(r, "x").count() == 0
    assert [tuple(x) for x in stores.listed(r).collect()] == [("m", ["10", "2"], "2")]
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"two")
    want = [("a.bin", hashlib.sha256(b"one").hexdigest()), ("b.bin", "0"), ("c.bin", "0")]
    got = stores.verified(spark, str(tmp_path), spark.createDataFrame(want, "file string, sha256 string"))
    assert {(x.file, x.status) for x in got.collect()} == {("a.bin", "ok"), ("b.bin", "changed"), ("c.bin", "missing")}


def test_store_keeps_what_it_cannot_read(spark, tmp_path):
    store = stores.FeatureStore(spark, str(tmp_path / "f"))
    store.upsert(spark.createDataFrame([("P1", "2024-01-01T08:00:00", 1.0), ("P2", "2024-01-01T08:00:00", 2.0)], "patient_id string, feature_timestamp string, x double").coalesce(1))
    (tmp_path / "f" / "feature_date=2024-01-01" / "part-broken.parquet").write_bytes(b"no parquet")
    assert store.all().count() == 2
    with pytest.raises(Exception):
        store.upsert(spark.createDataFrame([("P3", "2024-01-01T08:00:00", 3.0)], "patient_id string, feature_timestamp string, x double"))
    with pytest.raises(Exception):
        store.erase("P1")
    assert store.all().count() == 2


def test_pushed_filters_and_reading_by_id():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = rest.FhirSource({"url": "http://x", "types": "Patient,Condition"}).reader(None)
    rest_ = list(reader.pushFilters([EqualTo(("id",), "7"), In(("resource_type",), ("Patient", "Device")), GreaterThan(("id",), "1")]))
    assert rest_ == [GreaterThan(("id",), "1")]
    (part,) = reader.partitions()
    assert (part.kind, part.ids) == ("Patient", ["7"])
    asked = []

    def send(request):
        asked.append(request.full_url)
        if request.full_url.endswith("/9"):
            raise urllib.error.HTTPError(request.full_url, 404, "none", {}, None)
        return io.BytesIO(json.dumps({"resourceType": "Patient", "id": "7"}).encode())

    client = rest.Client({"url": "http://x"}, send)
    assert client.get("Patient", "7")["id"] == "7" and client.get("Patient", "9") is None and asked[0] == "http://x/Patient/7"
    reader._client = lambda: client
    assert [r[:2] for r in reader.read(part)] == [("Patient", "7")]
    every = rest.FhirSource({"url": "http://x", "patients": "a,b", "mode": "everything"}).reader(None).partitions()
    assert [p.kind for p in every] == ["Patient/a/$everything", "Patient/b/$everything"]


def test_importance_and_dependence(spark):
    df = spark.range(400).selectExpr("id AS k", "double(id % 20) AS u", "double(id % 7) AS v")
    score = lambda d: d.withColumn("score", F.col("u") * 2)
    metric = lambda d: -d.agg(F.avg(F.abs(F.col("score") - 2 * (F.col("k") % 20)))).first()[0]
    by = dict(models.permutation_importance(df, ["u", "v"], score, metric, "k"))
    assert by["u"] > 1 and by["v"] == 0
    assert {r.u: r.mean_score for r in models.partial_dependence(df, "u", [0.0, 3.0], score).collect()} == {0.0: 0.0, 3.0: 6.0}


def test_stream_retry_repeats_nothing(spark, tmp_path):
    synthetic.bundles(spark, 4).write.parquet(str(tmp_path / "in"))
    stream = streams.read(spark, str(tmp_path / "in"), "bundle_id string, bundle string")
    for checkpoint in ("c1", "c2"):  # the second start repeats batch 0, as a retry would
        streams.deidentified(stream, privacy.Deidentification("s"), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / checkpoint)).awaitTermination()
        n = spark.read.parquet(str(tmp_path / "out")).count()
        assert n == spark.read.parquet(str(tmp_path / "out")).dropDuplicates(["resource_type", "patient", "resource"]).count()
