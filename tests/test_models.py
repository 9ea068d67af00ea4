"""Models, explanations, neighbours and streams against closed forms and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabloom.functions.values import NULL_TOKENS
from tabloom.operators import explain, features, lifecycle, neighbours, scoring, split, supervised, unsupervised
from tabloom.operators.features import FeatureConfig
from tabloom.plans.graphs import connected_components
from tabloom.sources import csvrecords, tables
from tabloom.streaming import events


@pytest.fixture(scope="module")
def revenue(spark):
    rows = []
    for i in range(1, 81):
        age, tenure, tickets = 18 + i % 50, 1 + i % 36, i % 6
        rows.append((f"r{i}", age, tenure, tickets, 400 + 7 * age + 12 * tenure - 15 * tickets))
    return spark.createDataFrame(
        rows, "record_id string, age bigint, tenure bigint, support_tickets bigint, monthly_revenue bigint"
    )


@pytest.fixture(scope="module")
def churn(spark):
    rows = [
        (f"c{i}", 20 + i % 45, 500 + 22 * i, "Monthly" if i % 2 == 0 else "Yearly",
         f"note number {i % 4}", f"2024-01-{(i - 1) % 28 + 1:02d}", "Yes" if i % 3 == 0 else "No")
        for i in range(1, 61)
    ]
    return spark.createDataFrame(
        rows,
        "customer_id string, age bigint, monthly_charges bigint, contract_type string, notes string, "
        "signup_date string, churn string",
    )


NUMBERS = FeatureConfig(numeric=("age", "tenure", "support_tickets"), scaler="none")


def fitted(df, name, config=NUMBERS):
    rows = supervised.labelled_rows(df, "monthly_revenue", "regression")
    prepared = supervised.prepare(rows, config, "regression")
    return prepared, supervised.fit_model(prepared, name, "regression")


def test_linear_regression_recovers_the_formula(revenue):
    _, model = fitted(revenue, "linear_regression")
    linear = model.stages[1]
    assert np.allclose(linear.coefficients.toArray(), [7, 12, -15], atol=1e-6)
    assert linear.intercept == pytest.approx(400, abs=1e-4)


def test_ridge_matches_the_closed_form(revenue):
    _, model = fitted(revenue, "ridge_regression")
    frame = revenue.toPandas()
    x = frame[["age", "tenure", "support_tickets"]].to_numpy(float)
    y = frame["monthly_revenue"].to_numpy(float)
    centred = x - x.mean(axis=0)
    expected = np.linalg.solve(centred.T @ centred + np.eye(3), centred.T @ (y - y.mean()))
    assert np.allclose(model.stages[1].coefficients.toArray(), expected, atol=1e-6)


def test_logistic_matches_newton(churn):
    config = FeatureConfig(numeric=("age", "monthly_charges"))
    rows = supervised.labelled_rows(churn, "churn", "classification")
    prepared = supervised.prepare(rows, config, "classification")
    model = supervised.fit_model(prepared, "logistic_regression", "classification").stages[1]
    table = prepared.rows.toPandas()
    x = np.column_stack([np.ones(len(table)), np.stack(table["features"].map(lambda v: v.toArray()))])
    y, w = table["label"].to_numpy(), np.zeros(3)
    for _ in range(50):  # summed log loss + ½‖w‖², intercept free
        p = 1 / (1 + np.exp(-x @ w))
        ridge = np.diag([0.0, 1.0, 1.0])
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    assert np.allclose(model.coefficients.toArray(), w[1:], atol=1e-5)


def test_split_is_stratified_and_partition_free(churn):
    one = split.split(churn.repartition(1), ["customer_id"], "churn", 0.25)
    many = split.split(churn.repartition(7), ["customer_id"], "churn", 0.25)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    counts = {(r["churn"], r["is_test"]): r["count"] for r in one.groupBy("churn", "is_test").count().collect()}
    assert counts == {("Yes", True): 5, ("Yes", False): 15, ("No", True): 10, ("No", False): 30}


def test_folds_shrink_to_the_smallest_class(spark):
    df = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(23)], "id int, y string")
    placed = split.assign_folds(df, ["id"], 5, "y")
    assert {r["fold"] for r in placed.collect()} == {0, 1, 2}


def test_training_isolates_failures_and_saves(churn, spark, tmp_path):
    config = FeatureConfig(
        numeric=("age", "monthly_charges"), categorical=("contract_type",), datetime=("signup_date",),
        text=("notes",), text_features=10,
    )
    run = supervised.train(churn, "churn", "classification", ["logistic_regression", "nope"], config, ["customer_id"])
    rows = {r["model"]: r for r in run.results.collect()}
    assert rows["nope"]["status"] == "failed" and run.best == "logistic_regression"
    assert rows["logistic_regression"]["f1_macro"] >= 0.3
    assert len(run.names) == 2 + 2 + 6 + 3  # two words and their pair
    path = str(tmp_path / "model")
    run.pipelines["logistic_regression"].write().save(path)
    again = PipelineModel.load(path)
    before = supervised.predict(run.pipelines["logistic_regression"], churn).select("customer_id", "predicted")
    after = supervised.predict(again, churn).select("customer_id", "predicted")
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))
    unseen = churn.limit(1).withColumn("contract_type", F.lit("Other"))
    proba = scoring.predict_proba(again, unseen).first()["probabilities"]
    assert sum(proba.values()) == pytest.approx(1.0, abs=1e-3)
    with pytest.raises(supervised.TrainingError):
        supervised.train(churn.limit(5), "churn", "classification", ["logistic_regression"], config, ["customer_id"])


def test_cross_validation_reports_every_metric(revenue):
    rows = supervised.cross_validate(
        revenue, "monthly_revenue", "regression", "linear_regression", NUMBERS, ["record_id"], 3
    ).collect()
    values = {r["metric"]: r for r in rows}
    assert values["rmse"]["folds"] == 3 and values["rmse"]["mean"] < 1e-3
    assert values["r2"]["mean"] == pytest.approx(1.0)


def test_contributions_add_up(revenue):
    prepared, model = fitted(revenue, "linear_regression")
    parts = explain.linear_shap(model, revenue, revenue, ["record_id"], prepared.names)
    total = parts.groupBy("record_id").agg((F.sum("contribution") + F.max("base_value")).alias("t"))
    both = supervised.predict(model, revenue).join(total, "record_id").select("predicted", "t").collect()
    assert all(abs(r["predicted"] - r["t"]) < 1e-4 for r in both)
    columns = ["age", "tenure", "support_tickets"]
    sampled = explain.sampled_shapley(model, revenue.limit(6), revenue, columns, ["record_id"], 12)
    total = sampled.groupBy("record_id").agg((F.sum("contribution") + F.max("base_value")).alias("t"))
    both = supervised.predict(model, revenue).join(total, "record_id").select("predicted", "t").collect()
    assert len(both) == 6 and all(abs(r["predicted"] - r["t"]) < 1e-4 for r in both)


def test_permutation_importance_finds_the_used_columns(revenue):
    _, model = fitted(revenue, "linear_regression")
    df = revenue.withColumn("noise", F.rand(1))
    rows = explain.permutation_importance(
        model, df, ["age", "tenure", "support_tickets"], "monthly_revenue", "regression", ["record_id"], 3
    ).collect()
    by = {r["feature"]: r["importance_mean"] for r in rows}
    assert by["tenure"] > by["support_tickets"] > 0


def cloud(n, d, seed=0):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, d))
    rows[: n // 3] = rows[0]  # a third are copies
    rows[n // 3 : n // 2] *= 0.2
    return rows


def to_frame(spark, rows, **extra):
    frame = pd.DataFrame({"id": range(len(rows)), "vec": list(map(list, rows)), **extra})
    return spark.createDataFrame(frame).repartition(5)


@pytest.mark.parametrize("block_rows,pivots", [(4096, None), (50, 7)])
def test_knn_join_matches_brute_force_with_copies(spark, block_rows, pivots):
    rows = cloud(240, 3)
    df = to_frame(spark, rows)
    got = neighbours.knn_join(df, df, 4, exclude_self=True, block_rows=block_rows, pivots=pivots)
    gaps = np.round(np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2)), 6)
    np.fill_diagonal(gaps, np.inf)
    expected = np.argsort(gaps, axis=1, kind="stable")[:, :4]
    found = got.orderBy("query_id", "rank").toPandas()["neighbour_id"].to_numpy().reshape(240, 4)
    assert (found == expected).all()


@pytest.mark.parametrize("block_rows,pivots", [(4096, None), (40, 6)])
def test_dbscan_matches_brute_force(spark, block_rows, pivots):
    rows, eps, least = cloud(180, 2, 5), 0.25, 4
    near = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    labels, current = np.full(180, -1), 0
    for i in range(180):
        if not core[i] or labels[i] != -1:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if labels[j] == -1:
                labels[j] = current
                if core[j]:
                    stack.extend(np.nonzero(near[j] & (labels == -1))[0])
        current += 1
    got = unsupervised.dbscan(to_frame(spark, rows), eps, least, block_rows, pivots).orderBy("id").toPandas()
    assert got["label"].tolist() == labels.tolist()


def test_isolation_forest_flags_far_points(spark):
    rows = np.vstack([np.random.default_rng(1).normal(size=(300, 2)), [[9, 9], [-8, 9], [10, -9]]])
    got = unsupervised.isolation_forest(to_frame(spark, rows), 0.02, trees=40).toPandas()
    assert set(got.nlargest(3, "score")["id"]) == {300, 301, 302}
    assert got["is_outlier"].sum() == pytest.approx(0.02 * 303, abs=2)


def test_pca_matches_numpy(spark):
    rows = np.random.default_rng(2).normal(size=(80, 4)) * [5, 2, 1, 0.5]
    got = unsupervised.pca_2d(to_frame(spark, rows)).orderBy("id").toPandas()
    centred = rows - rows.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    for j, name in enumerate(["x", "y"]):
        axis = axes[j] * np.sign(axes[j][np.abs(axes[j]).argmax()])
        assert np.allclose(got[name], centred @ axis, atol=1e-4)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    more = spark.createDataFrame([(500, 501)], "u bigint, v bigint")
    got = connected_components(edges.unionByName(more))
    assert {(r["component"], r["count"]) for r in got.groupBy("component").count().collect()} == {(0, 201), (500, 2)}


def test_scaling_and_unseen_levels(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (6.0, "a")], "x double, g string")
    scaled = [r["x"] for r in features.scale(df, ["x"]).orderBy("x").collect()]
    assert np.allclose(scaled, (np.array([1, 2, 6]) - 3) / np.std([1, 2, 6]))
    assert features.one_hot(df.where("g = 'a'"), df, "g", ["x"]).count() == 2


def test_stream_passes_each_event_once_over_batches(spark, tmp_path):
    """Three batches: re-sent ids, a late row, and rows after a job has ended."""
    schema = "event_id string, job_id string, event_type string, status string, message string, created_at string"

    def batch(*rows):
        made = spark.createDataFrame([(e, j, k, s, f"m {e}", f"2024-01-01 {t}:00") for e, j, k, s, t in rows], schema)
        made.withColumn("created_at", F.col("created_at").cast("timestamp")).write.mode("append").parquet(folder)
        return made.withColumn("created_at", F.col("created_at").cast("timestamp"))

    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = batch(("e1", "j1", "running", "running", "09:00"), ("e1", "j1", "running", "running", "09:00"),
                  ("e2", "j2", "running", "running", "09:05"))
    once = events.follow_events(events.read_events(spark, folder, schema=first.schema))
    assert sorted(r["event_id"] for r in events.drain(once, out, state).collect()) == ["e1", "e2"]
    batch(("e1", "j1", "running", "running", "18:00"), ("e0", "j1", "running", "running", "08:00"),
          ("e3", "j1", "step", "failed", "09:06"), ("e4", "j1", "finished", "completed", "09:07"))
    got = events.drain(once, out, state)
    assert sorted(r["event_id"] for r in got.collect()) == ["e0", "e1", "e2", "e3", "e4"]
    assert [r["event_id"] for r in got.where("is_terminal").collect()] == ["e4"]
    batch(("e5", "j1", "running", "running", "09:08"), ("e6", "j2", "finished", "failed", "09:09"))
    assert sorted(r["event_id"] for r in events.drain(once, out, state).collect()) == ["e0", "e1", "e2", "e3", "e4", "e6"]
    states = events.follow_job_state(events.read_events(spark, folder, schema=first.schema))
    latest = events.drain_updates(states, "job_id", str(tmp_path / "s"), str(tmp_path / "c"))
    whole = lifecycle.job_state(spark.read.parquet(folder))
    assert sorted(map(str, latest.collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("parts", [1, 32])
def test_a_job_with_a_third_of_all_events(spark, tmp_path, parts):
    """Against plain Python: sent twice, over three batches, one hot job that ends in the second."""
    rng = np.random.default_rng(4)
    folder, kept, closed, ids = str(tmp_path / "in"), [], set(), set()
    schema = "event_id string, job_id string, event_type string, status string, created_at timestamp"
    stream, number = None, 0
    for batch in range(3):
        rows = []
        for _ in range(1500):
            job = "hot" if rng.random() < 0.34 else f"j{rng.integers(0, 300)}"
            end = batch == 1 and number % 400 == 7 or rng.random() < 0.01 and job != "hot"
            rows.append((f"e{number % 4000}", job, "step" if number % 9 == 0 else "move", "completed" if end else "running",
                         (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=int(rng.integers(0, 5000)))).to_pydatetime()))
            number += 1
        if batch == 1:
            rows.append(("last", "hot", "move", "completed", pd.Timestamp("2024-01-03").to_pydatetime()))
        spark.createDataFrame([*rows, *rows], schema).repartition(3).write.mode("append").parquet(folder)
        stream = events.follow_events(events.read_events(spark, folder, schema=spark.read.parquet(folder).schema), parts=parts)
        got = events.drain(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect()
        by = {}
        for row in rows:
            if (row[1], row[0]) not in ids:
                ids.add((row[1], row[0]))
                by.setdefault(row[1], []).append(row)
        for job, found in by.items():
            for row in sorted(found, key=lambda r: (r[4], r[0])) if job not in closed else ():
                ends = row[3] == "completed" and row[2] != "step"
                kept.append((row[0], job, ends))
                if ends:
                    closed.add(job)
                    break
        assert sorted((r.event_id, r.job_id, r.is_terminal) for r in got) == sorted(kept)
    assert "hot" in closed


def test_csv_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"two\nlines"\n')
    (tmp_path / "b.csv").write_text("name,id\nx,2\n")
    (tmp_path / "c.csv").write_bytes("id,name,more\n3,中文,y\n".encode("big5"))
    rows = {r["id"]: (r["name"], r["more"]) for r in tables.read_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert rows == {1: ("two\nlines", None), 2: ("x", None), 3: ("中文", "y")}


def _csv_cell(rng):
    plain = ["", "x", "5 o\" clock", "it's", "NA", "ünï", "1.5", " pad "]
    quoted = ['"a, b"', '"say ""hi"""', '"two\nlines"', '"three\n\n"",lines"', '""', '"\r\n"']
    return str(rng.choice(plain + quoted))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_with_line_breaks_is_split(spark, tmp_path, end):
    """Against the csv module, in splits of a few hundred bytes."""
    import csv
    import io

    rng, want = np.random.default_rng(5), []
    for f in range(3):
        lines = ['id,"na\nme",note'] if f < 2 else ["note,id"]
        for i in range(400):
            cells = [f"{f}-{i}", _csv_cell(rng), _csv_cell(rng)] if f < 2 else [_csv_cell(rng), f"{f}-{i}"]
            lines.append(",".join(cells))
        body = end.join(lines) + end * (f % 2)
        (tmp_path / f"{f}.csv").write_bytes(body.encode())
        rows = list(csv.reader(io.StringIO(body, newline="")))
        want += [dict(zip(rows[0], r)) for r in rows[1:] if r]
    settings = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "100"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        files = csvrecords.file_facts(spark, str(tmp_path), csvrecords.ENCODINGS)
        table = tables.read_csv(spark, str(tmp_path), promote=False)
        lines = csvrecords._lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 20 and sum(len(f.inside) for f in files) > 3
        got = {r["id"]: (r["na\nme"], r["note"]) for r in table.collect()}
    finally:
        for key in settings:
            spark.conf.unset(key)

    def cell(text):
        return None if text is None or text in NULL_TOKENS else text

    assert got == {r["id"]: (cell(r.get("na\nme")), cell(r["note"])) for r in want} and len(got) == 1200


def test_csv_quotes_only_open_cells_at_their_start():
    ends = csvrecords.ends_inside
    assert not ends(b'1,5" pipe,x', False) and not ends(b'"a""b",c', False) and ends(b'"a""', False) and ends(b'x,"y', False)
    assert not ends(b'y",z', True) and ends(b'y"",z', True) and ends(b'y","z', True) and ends(b"no quote", True)


def test_csv_written_is_read_again(spark, tmp_path):
    rows = [(1, 'say "hi"'), (2, "back\\slash"), (3, "a,b\nc"), (4, 'end"')]
    tables.write_table(spark.createDataFrame(rows, "id int, name string"), str(tmp_path / "t"), "csv")
    assert sorted((r["id"], r["name"]) for r in tables.read_csv(spark, str(tmp_path / "t")).collect()) == rows


def test_training_run_with_neighbours_area_and_records(churn, spark, tmp_path):
    config = FeatureConfig(numeric=("age", "monthly_charges"), categorical=("contract_type",))
    models = ["logistic_regression", "knn_classifier"]
    run = supervised.experiment(churn, "churn", "classification", models, config, ["customer_id"])
    rows = {r["model"]: r for r in run.results.collect()}
    assert set(rows) == set(models) and all(r["status"] == "trained" and r["cv_mean"] is not None for r in rows.values())
    assert 0 <= rows["logistic_regression"]["roc_auc"] <= 1
    supervised.save_run(run, str(tmp_path), "run1", "d1")
    kept = {r["model"]: r["path"] for r in spark.read.parquet(str(tmp_path / "models")).collect()}
    assert kept["knn_classifier"] is None and PipelineModel.load(kept["logistic_regression"]).stages
    assert spark.read.parquet(str(tmp_path / "experiments")).first()["best_model"] == run.best


def test_grouping_run_over_prepared_columns(spark):
    rows = [(i, float(i % 3 * 10), "a" if i % 2 else "b") for i in range(60)] + [(60, 500.0, "a")]
    df = spark.createDataFrame(rows, "id bigint, x double, g string")
    config = FeatureConfig(numeric=("x",), categorical=("g",))
    run = unsupervised.grouping_run(df, ["kmeans", "dbscan", "isolation_forest", "nope"], config, "id", n_clusters=2)
    status = {r["model"]: r["status"] for r in run.results.collect()}
    assert status == {"kmeans": "trained", "dbscan": "trained", "isolation_forest": "trained", "nope": "failed"}
    assert run.projection.count() == 61 and run.labels["kmeans"].count() == 61
    assert run.labels["isolation_forest"].orderBy(F.desc("score")).first()["id"] == 60


def test_sampled_contributions_meet_without_walks_being_sorted(revenue):
    _, model = fitted(revenue, "linear_regression")
    columns = ["age", "tenure", "support_tickets"]
    found = explain.sampled_shapley(model, revenue.limit(6), revenue, columns, ["record_id"], 12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # all steps of all walks were shuffled and sorted
    by = {(r["record_id"], r["feature"]): r for r in found.collect()}
    assert len(by) == 18 and all(r["source_column"] == f for (_, f), r in by.items())
    # Linear: a feature's gain is its weight times its distance from the drawn background, within the column's range.
    ages = [r["age"] for r in revenue.collect()]
    own = {r["record_id"]: r["age"] for r in revenue.limit(6).collect()}
    for key, age in own.items():
        assert 7 * (age - max(ages)) - 1e-4 <= by[key, "age"]["contribution"] <= 7 * (age - min(ages)) + 1e-4
