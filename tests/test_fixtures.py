"""Small tables with exact expectations."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tabloom.operators import charts, context, drift, eda, profile, recipe
from tabloom.sources import registries, tables, versions


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        ("c1", 34.0, "2024-01-01", "true", "Monthly", "likes the service", "No"),
        ("c2", None, "2024-01-02", "false", "Yearly", "called twice", "Yes"),
        ("c3", 45.0, "2024-01-03", "true", "Monthly", None, "No"),
        ("c4", 29.0, "2024-01-04", "false", "Monthly", "moved away", "Yes"),
    ]
    return spark.createDataFrame(
        rows,
        "customer_id string, age double, signup_date string, is_active string, contract_type string, "
        "notes string, churn string",
    )


@pytest.fixture(scope="module")
def charges(spark):
    rows = [
        ("c1", 20.0, 100, 1, "No"), ("c1", 20.0, 100, 1, "No"), ("c2", None, 120, 5, "Yes"),
        ("c3", None, 110, 9, "No"), ("c4", 50.0, 5000, 24, "Yes"),
    ]
    return spark.createDataFrame(
        rows, "customer_id string, age double, monthly_charges bigint, tenure_months bigint, churn string"
    )


def test_types_roles_and_missing_cells(people):
    kinds = {r["column"]: r for r in profile.base_profile(people).collect()}
    assert {c: r["inferred_type"] for c, r in kinds.items()} == {
        "customer_id": "categorical", "age": "numeric", "signup_date": "datetime", "is_active": "boolean",
        "contract_type": "categorical", "notes": "categorical", "churn": "boolean",
    }
    assert kinds["customer_id"]["semantic_role"] == "identifier"
    assert kinds["churn"]["semantic_role"] == "target_candidate"
    summary = profile.schema_summary(people).first()
    assert (summary["column_count"], summary["missing_cell_count"]) == (7, 2)
    assert summary["target_candidates"] == "churn"


def test_sketched_profile_decides_alike(people):
    exact = profile.base_profile(people).select("column", "inferred_type", "missing_count", "unique_count")
    sketched = profile.base_profile(people, approximate=True).select(*exact.columns)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, sketched.collect()))


def test_eda_expectations(charges):
    missing = {r["column"]: r for r in eda.missing_analysis(charges).collect()}
    assert missing[eda.TOTAL]["missing_count"] == 2
    assert missing["age"]["missing_ratio"] == 0.4
    assert eda.duplicate_analysis(charges).first()["duplicate_row_count"] == 1
    stats = {r["column"]: r for r in eda.numeric_statistics(charges).collect()}
    assert stats["monthly_charges"]["max"] == 5000
    out = {r["column"]: r for r in eda.outlier_analysis(charges).collect()}
    assert out["monthly_charges"]["outlier_count"] >= 1
    assert out["age"]["outlier_count"] == 0 and out["age"]["lower_bound"] is None  # three values


def test_empty_and_all_missing(spark):
    none = spark.createDataFrame([(None, None)], "a double, b string")
    assert {r["inferred_type"] for r in profile.base_profile(none).collect()} == {"unknown"}
    empty = spark.createDataFrame([], "a double, b string")
    assert eda.duplicate_analysis(empty).first()["duplicate_row_count"] == 0
    assert profile.base_profile(empty).count() == 2
    with pytest.raises(tables.TableError):
        tables.validate(empty)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "a double")
    assert profile.missing_by_column(df).first()["missing_count"] == 2
    assert eda.duplicate_analysis(df).first()["duplicate_row_count"] == 1


def test_recipe_rules_and_warnings(people):
    rules = recipe.Recipe(
        drop=("customer_id", "nope"), rename=(("gone", "x"),), fill=(recipe.Fill("age", "median"),),
        date_parts=(recipe.DateParts("signup_date", ("year", "month", "century")),),
    )
    done = recipe.apply_recipe(people, rules)
    assert len(done.warnings) == 3
    diff = recipe.profile_diff(people, done.table).first()
    assert (diff["column_delta"], diff["missing_delta"]) == (1, -1)
    assert done.table.where("age = 34.0").count() == 2
    with pytest.raises(recipe.RecipeError):
        recipe.rename_columns(people, [("age", "churn")])
    with pytest.raises(recipe.RecipeError):
        recipe.apply_recipe(people, recipe.Recipe(cast=(("nope", "numeric"),)))


def test_clip_skips_columns_without_spread(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 5 + [(100.0, 1.0)], "a double, b double")
    clipped = recipe.iqr_clip(df, [recipe.Clip("a"), recipe.Clip("b")])
    assert clipped.agg(F.max("a")).first()[0] == 100.0  # quartiles are equal


def test_versions_round_trip(spark, people, tmp_path):
    root = str(tmp_path / "store")
    first = versions.save_version(people, root, "d")
    rules = recipe.Recipe(drop=("notes",), fill=(recipe.Fill("age", "constant", 99.0),))
    second = versions.apply_and_save(spark, root, "d", rules)
    meta = versions.list_versions(versions.versions(spark, root), "d").collect()
    assert [r["version_index"] for r in meta] == [1, 2]
    assert {r["latest_version_id"] for r in meta} == {second}
    assert "notes" in versions.load_version(spark, root, "d", first).columns
    assert "notes" not in versions.load_version(spark, root, "d").columns
    with pytest.raises(tables.TableError):
        versions.load_version(spark, root, "other")


def test_export_and_import_give_new_ids(spark, people, tmp_path):
    root, bundle = str(tmp_path / "a"), str(tmp_path / "b")
    old = versions.save_version(people, root, "d")
    models = spark.createDataFrame([("m1", "d", old, "production")], "model_id string, dataset_id string, version_id string, status string")
    versions.export_dataset(spark, root, "d", bundle, models)
    mapping, fresh = versions.import_dataset(spark, bundle, root, "copy")
    row = fresh.first()
    assert row["status"] == "candidate" and row["dataset_id"] == "copy"
    assert row["model_id"] != "m1" and row["version_id"] != old
    assert mapping.count() == 3
    assert versions.load_version(spark, root, "copy").count() == 4


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "big5", "latin1"])
def test_csv_encodings_and_null_tokens(spark, tmp_path, encoding):
    word = "café" if encoding == "latin1" else "中文"
    path = tmp_path / f"{encoding}.csv"
    path.write_bytes(f"id,name,score,flag\n1,{word},1.5,True\n2,N/A,NA,False\n3,x,2,True\n".encode(encoding))
    df = tables.read_csv(spark, str(path))
    rows = df.orderBy("id").collect()
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double"), ("flag", "boolean")]
    assert rows[0]["name"] == word and rows[1]["name"] is None and rows[1]["score"] is None


def test_run_logs_with_a_corrupt_file(spark, tmp_path):
    good = {
        "run_id": "r1", "created_at": "2024-01-02T00:00:00Z", "suite": "s", "status": "failed",
        "steps": [{"name": "a", "status": "passed"}, {"name": "b", "status": "failed"}],
        "assertions": [{"name": "x", "status": "failed"}],
    }
    (tmp_path / "r1.json").write_text(json.dumps(good))
    (tmp_path / "r2.json").write_text("{broken")
    rows = {r["run_id"]: r for r in registries.run_summaries(spark, str(tmp_path / "*.json")).collect()}
    assert (rows["r1"]["step_count"], rows["r1"]["failed_steps"], rows["r1"]["failed_assertions"]) == (2, 1, 1)
    assert rows["r2"]["status"] == "invalid"
    with pytest.raises(ValueError):
        registries.run_summaries(spark, str(tmp_path), 0)


def test_upsert_is_idempotent_with_composite_keys(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, n int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 1, "w")], "k string, n int, v string")
    once = registries.upsert(old, new, ["k", "n"])
    twice = registries.upsert(once, new, ["k", "n"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [
        ("a", 1, "x"), ("a", 2, "z"), ("b", 1, "w"),
    ]


def test_missing_artifacts(spark, tmp_path):
    (tmp_path / "m1.bin").write_bytes(b"1")
    listing = registries.file_listing(spark, str(tmp_path / "*"))
    found = listing.first()["path"]
    refs = spark.createDataFrame([(found,), ("file:/gone",)], "path string")
    assert [r["path"] for r in registries.missing_artifacts(refs, listing).collect()] == ["file:/gone"]


def test_drift_bands_and_kinds(spark):
    reference = spark.createDataFrame([(float(i % 100), "a" if i % 2 else "b", i % 2) for i in range(400)], "x double, g string, f int")
    current = spark.createDataFrame([(float(i % 100) + 60, "a", i % 2) for i in range(400)], "x double, g string, f int")
    rows = {r["column"]: r for r in drift.column_drift(reference, current).collect()}
    assert rows["x"]["kind"] == "numeric" and rows["x"]["status"] == "drift"
    assert rows["g"]["kind"] == "categorical" and rows["g"]["status"] == "drift"
    assert rows["f"]["kind"] == "categorical" and rows["f"]["psi"] == 0.0
    assert rows["x"]["ks_statistic"] == pytest.approx(0.6)
    same = drift.drift_report(reference, reference).first()
    assert same["status"] == "stable" and same["retrain_score"] == 0
    for pieces in (None, 3):
        assert drift.ks(reference, current, ["x"], pieces).first()["ks_statistic"] == pytest.approx(0.6)


def test_constant_column_has_no_psi(spark):
    df = spark.createDataFrame([(5.0,)] * 20, "x double")
    assert drift.psi_numeric(df, df, ["x"]).first()["psi"] is None
    assert drift.column_drift(df, df).first()["status"] == "warning"


def test_target_and_findings(charges):
    row = context.target_classification(charges, "churn").first()
    assert row["majority_class"] == "No" and row["imbalance_ratio"] == 1.5
    found = {r["id"]: r["severity"] for r in context.findings(charges, "churn").collect()}
    assert found["missing-value-risk"] == "critical"  # two of five ages
    assert {"small-sample-size", "duplicate-row-risk", "model-not-trained"} <= set(found)
    assert context.findings(charges).where("id = 'target-not-confirmed'").count() == 1


def test_chart_requests_are_checked(charges):
    with pytest.raises(charts.ChartError):
        charts.chart(charges, charts.ChartSpec("histogram", x="churn"))
    with pytest.raises(charts.ChartError):
        charts.chart(charges, charts.ChartSpec("line", x="churn", y="age"))
    bar = charts.chart(charges, charts.ChartSpec("category_bar", x="churn", max_categories=1)).collect()
    assert [(r["label"], r["count"]) for r in bar] == [("No", 3), ("Other", 2)]


def test_date_layouts(spark):
    from tabloom.functions.dates import parse_timestamp

    texts = ["2024-03-01", "2024/3/1", "3/1/2024", "31/1/2024", "2024-03-01T00:00:00Z", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_timestamp(F.col("t"))).collect()]
    day = dt.datetime(2024, 3, 1)
    assert got == [day, day, day, dt.datetime(2024, 1, 31), day, None, None]
