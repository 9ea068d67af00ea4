"""Queries for splits, models, scoring and explanations."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tabloom.operators import explain as X
from tabloom.operators import linear_folds as LF
from tabloom.operators import scoring as SC
from tabloom.operators import split as SP
from tabloom.operators import supervised as SU
from tabloom.operators.features import FeatureConfig
from tabloom.session import cut_lineage
from tabloom.workload.inputs import (
    DOCUMENT_LABELS_SQL,
    document_labels,
    labelled_documents,
    table,
)
from tabloom.workload.metrics import (
    LABELLED_LINES_SQL,
    PRICED_SQL,
    RANKED_SQL,
    classification_sql,
    labelled,
    priced,
    ranked,
    regression_sql,
)
from tabloom.workload.registry import query

DOCS = FeatureConfig(numeric=("n_chars",), categorical=("lang", "source"))
PRICE = FeatureConfig(numeric=("l_quantity",), scaler="none")
LINE = FeatureConfig(numeric=("l_quantity", "l_discount"), categorical=("l_linestatus",))
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


# --- task, split, folds -------------------------------------------------------


@query(
    "su01_detect_task",
    """SELECT 'l_extendedprice' AS target, t AS task, t AS detail FROM (
      SELECT CASE WHEN count(DISTINCT l_extendedprice) > greatest(10.0, count(*) / 10) THEN 'regression'
        ELSE 'classification' END AS t FROM lineitem)""",
)
def detect_task(spark, folder):
    return SU.detect_task(table(spark, folder, "lineitem"), "l_extendedprice")


@query(
    "su01_detect_task_workbench",
    """SELECT 'o_orderpriority' AS target, 'classification' AS task,
    CASE WHEN count(DISTINCT o_orderpriority) <= 2 THEN 'binary_classification' ELSE 'multiclass_classification' END AS detail
    FROM orders""",
)
def detect_task_workbench(spark, folder):
    return SU.detect_task(table(spark, folder, "orders"), "o_orderpriority", "workbench")


@query(
    "su02_split",
    """WITH c AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1),
    t AS (SELECT label, n, least(n - 1, greatest(1, round(n * 0.2)::BIGINT)) AS q FROM c)
    SELECT label, TRUE AS is_test, q AS count FROM t UNION ALL SELECT label, FALSE, n - q FROM t""",
)
def split(spark, folder):
    done = SP.split(table(spark, folder, "orders"), ["o_orderkey"], "o_orderstatus", 0.2)
    return done.groupBy(F.col("o_orderstatus").alias("label"), "is_test").agg(F.count("*").alias("count"))


@query(
    "su03_assign_folds",
    """WITH c AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1)
    SELECT label, f::INTEGER AS fold, ((n - f + 4) // 5)::BIGINT AS count FROM c, range(5) r(f)""",
)
def folds(spark, folder):
    done = SP.assign_folds(table(spark, folder, "orders"), ["o_orderkey"], 5, "o_orderstatus")
    return done.groupBy(F.col("o_orderstatus").alias("label"), "fold").agg(F.count("*").alias("count"))


@query("su04_cross_validate")
def cross_validate(spark, folder):
    rows = table(spark, folder, "lineitem")
    return SU.cross_validate(rows, "l_extendedprice", "regression", "linear_regression", LINE, KEY, 3)


def by_order(spark, folder):
    """Line items with the lines of an order in one fold."""
    return table(spark, folder, "lineitem").withColumn("fold", F.pmod("l_orderkey", F.lit(5)))


def fold_models_sql(penalty: float) -> str:
    return f"""d AS (SELECT (l_orderkey % 5)::INTEGER AS fold, l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS x FROM lineitem),
    s AS (SELECT f.fold, regr_sxy(y, x) / (regr_sxx(y, x) + {penalty}) AS slope, avg(y) AS my, avg(x) AS mx
      FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY f.fold),
    e AS (SELECT d.fold, y, y - (my - slope * mx) - slope * x AS gap, slope, my - slope * mx AS intercept FROM d JOIN s ON s.fold = d.fold),
    m AS (SELECT fold, count(*) AS n, any_value(slope) AS slope, any_value(intercept) AS intercept, avg(abs(gap)) AS mae,
      sqrt(avg(gap * gap)) AS rmse, 1 - avg(gap * gap) / var_pop(y) AS r2 FROM e GROUP BY fold)"""


@query(
    "su04_linear_folds",
    f"""WITH {fold_models_sql(0.0)} SELECT fold, n AS rows, round(slope, 3) AS slope, round(intercept, 2) AS intercept,
    round(rmse, 2) AS rmse, round(r2, 6) AS r2 FROM m""",
)
def linear_folds(spark, folder):
    found = LF.linear_folds(by_order(spark, folder), ["l_quantity"], "l_extendedprice")
    return found.select(
        "fold", "rows", F.round(F.col("coefficients")[0], 3).alias("slope"), F.round("intercept", 2).alias("intercept"),
        F.round("rmse", 2).alias("rmse"), F.round("r2", 6).alias("r2"),
    )


def _folds_sql(penalty: float) -> str:
    parts = [
        f"""SELECT '{m}' AS metric, round(avg({m}), 2) AS mean, round(stddev_pop({m}), 2) AS std, count(*) AS folds,
        {'TRUE' if m == 'r2' else 'FALSE'} AS higher_is_better FROM m"""
        for m in ("mae", "rmse", "r2")
    ]
    return f"WITH {fold_models_sql(penalty)} " + " UNION ALL ".join(parts)


def _cross_validated(spark, folder, penalty):
    found = LF.cross_validate_linear(by_order(spark, folder), ["l_quantity"], "l_extendedprice", penalty=penalty)
    return found.withColumn("mean", F.round("mean", 2)).withColumn("std", F.round("std", 2))


query("su04_cross_validate_linear", _folds_sql(0.0))(partial(_cross_validated, penalty=0.0))
query("su04_cross_validate_ridge", _folds_sql(1.0))(partial(_cross_validated, penalty=1.0))


# --- models -------------------------------------------------------------------


def _fit(spark, folder, name, task, config, target, source, params=None):
    rows = SU.labelled_rows(source(spark, folder), target, task)
    return SU.fit_model(SU.prepare(rows, config, task), name, task, params=params)


def fitted_price_model(spark, folder):
    source = partial(table, name="lineitem")
    return _fit(spark, folder, "linear_regression", "regression", PRICE, "l_extendedprice", source)


def _document_metrics(spark, folder, name, params=None):
    """Metrics of a classifier on documents it has not seen."""
    rows = SU.labelled_rows(labelled_documents(spark, folder), "quality", "classification")
    placed = cut_lineage(SP.split(rows, ["doc_id"], "_y"))
    learned = SU.prepare(placed.where("NOT is_test"), DOCS, "classification", "auto")
    model = SU.fit_model(learned, name, "classification", params=params)
    return SU._metrics(SU.predict(model, placed.where("is_test")), "classification")


for _name, _params in [
    ("su05_logistic_regression", None),
    ("su06_random_forest_classifier", None),
    ("su07_gbt_classifier", None),
    ("su08_linear_svm", None),
]:
    query(_name)(partial(_document_metrics, name=_name.split("_", 1)[1], params=_params))


@query("su07_gbt_multiclass")
def gbt_multiclass(spark, folder):
    """One-versus-rest trees on the three return flags, judged on line items they have not seen."""
    rows = SU.labelled_rows(table(spark, folder, "lineitem"), "l_returnflag", "classification")
    placed = cut_lineage(SP.split(rows, KEY, "_y"))
    learned = SU.prepare(placed.where("NOT is_test"), LINE, "classification")
    model = SU.fit_model(learned, "gbt_classifier", "classification")
    return SU._metrics(SU.predict(model, placed.where("is_test")), "classification")


def _coefficients(spark, folder, name):
    source = partial(table, name="lineitem")
    model = _fit(spark, folder, name, "regression", PRICE, "l_extendedprice", source).stages[1]
    row = (round(float(model.coefficients[0]), 3), round(float(model.intercept), 2))
    return spark.createDataFrame([row], "slope double, intercept double")


_SLOPES = {
    "su10_linear_regression": "regr_slope(y, x)",
    "su11_ridge_regression": "regr_sxy(y, x) / (regr_sxx(y, x) + 1.0)",
    "su12_lasso_regression": "(regr_sxy(y, x) / n - 0.01) / (regr_sxx(y, x) / n)",
}
for _name, _slope in _SLOPES.items():
    query(
        _name,
        f"""SELECT round(s, 3) AS slope, round(my - s * mx, 2) AS intercept FROM (
        SELECT {_slope} AS s, avg(y) AS my, avg(x) AS mx FROM (
          SELECT l_extendedprice AS y, l_quantity AS x, count(*) OVER () AS n FROM lineitem) {"GROUP BY n" if "lasso" in _name else ""})""",
    )(partial(_coefficients, name=_name.split("_", 1)[1]))


def _price_metrics(spark, folder, name, params=None):
    rows = SU.labelled_rows(table(spark, folder, "lineitem"), "l_extendedprice", "regression")
    placed = cut_lineage(SP.split(rows, KEY))
    model = SU.fit_model(SU.prepare(placed.where("NOT is_test"), LINE, "regression"), name, "regression", params=params)
    return SU._metrics(SU.predict(model, placed.where("is_test")), "regression")


for _name, _params in [
    ("su13_random_forest_regressor", None),
    ("su14_gbt_regressor", None),
    ("su15_robust_regression", None),
]:
    query(_name)(partial(_price_metrics, name=_name.split("_", 1)[1], params=_params))


@query("su22_feature_importance")
def feature_importance(spark, folder):
    rows = SU.labelled_rows(labelled_documents(spark, folder), "quality", "classification")
    prepared = SU.prepare(rows, DOCS, "classification")
    model = SU.fit_model(prepared, "random_forest_classifier", "classification")
    return SU.feature_importance(model, prepared.names)


@query("su26_train")
def train(spark, folder):
    run = SU.train(
        labelled_documents(spark, folder), "quality", "classification",
        ["logistic_regression", "random_forest_classifier", "no_such_model"], DOCS, ["doc_id"], weights="auto",
    )
    return run.results.select("model", "status", "accuracy", "f1_macro", "rank", "is_best")


@query("su26_experiment")
def experiment(spark, folder):
    run = SU.experiment(
        labelled_documents(spark, folder), "quality", "classification", ["logistic_regression"], DOCS, ["doc_id"],
    )
    return run.results.select("model", "status", "f1_macro", "cv_mean", "cv_std", "rank")


# --- scoring ------------------------------------------------------------------


@query(
    "sc01_predict",
    """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(s * l_quantity + i, 2) AS predicted FROM lineitem, m""",
)
def predict(spark, folder):
    model = fitted_price_model(spark, folder)
    scored = SU.predict(model, table(spark, folder, "lineitem"))
    return scored.select(*KEY, F.round("predicted", 2).alias("predicted"))


def _document_model(spark, folder):
    return _fit(
        spark, folder, "logistic_regression", "classification", DOCS, "quality", labelled_documents
    )


@query("sc02_predict_proba")
def predict_proba(spark, folder):
    scored = SC.predict_proba(_document_model(spark, folder), document_labels(spark, folder))
    return scored.select("doc_id", "predicted", F.element_at("probabilities", "1").alias("probability"))


SCENARIOS = [
    {"scenario": "double", "l_quantity": 50.0},
    {"scenario": "discounted", "l_discount": 0.1, "l_tax": 0.0},
]


@query(
    "sc03_scenarios",
    """SELECT scenario, l_orderkey, l_linenumber, coalesce(q, l_quantity)::DOUBLE AS l_quantity,
      coalesce(d, l_discount)::DOUBLE AS l_discount, coalesce(t, l_tax)::DOUBLE AS l_tax
    FROM lineitem, (VALUES ('double', 50.0, NULL, NULL), ('discounted', NULL, 0.1, 0.0)) s(scenario, q, d, t)""",
)
def scenarios(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return SC.scenario_rows(rows, SCENARIOS)


@query(
    "sc03_what_if",
    """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)
    SELECT scenario, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(s * coalesce(q, l_quantity) + i, 2) AS predicted
    FROM lineitem, m, (VALUES ('double', 50.0), ('discounted', NULL)) c(scenario, q)""",
)
def what_if(spark, folder):
    rows = table(spark, folder, "lineitem").select(*KEY, "l_quantity", "l_discount", "l_tax")
    scored = SC.what_if(fitted_price_model(spark, folder), rows, SCENARIOS)
    return scored.select("scenario", *KEY, F.round("predicted", 2).alias("predicted"))


@query(
    "sc05_segment_metrics",
    classification_sql(f"(SELECT *, l_linestatus AS segment FROM {LABELLED_LINES_SQL})", "segment"),
)
def segment_metrics(spark, folder):
    return SC.segment_metrics(labelled(spark, folder), "l_linestatus", "classification")


BINNED_SQL = f"""(SELECT actual, predicted, 'bin-' || (1 + least(len(e) - 2, len(list_filter(e[2:], lambda x: x < actual)))) AS segment
    FROM {PRICED_SQL}, (SELECT list_sort(list_distinct(quantile_cont(actual, [0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM {PRICED_SQL}))"""


@query("sc05_segment_bins", regression_sql(BINNED_SQL, "segment"))
def segment_bins(spark, folder):
    return SC.segment_metrics(priced(spark, folder), "actual", "regression", 4)


@query(
    "sc06_labelled",
    f"""SELECT n_chars, lang, CAST(NULL AS VARCHAR) AS author, quality FROM {DOCUMENT_LABELS_SQL} WHERE quality IS NOT NULL""",
)
def labelled_frame(spark, folder):
    return SC.labelled(document_labels(spark, folder), ["n_chars", "lang", "author"], "quality")


@query(
    "sc07_contract_check",
    """SELECT 'required_columns' AS "check", count(*) < 0 AS passed, 'author' AS detail FROM documents
    UNION ALL SELECT 'empty_row_scores', TRUE, '' """,
)
def contract_check(spark, folder):
    model = _document_model(spark, folder)
    schema = {"n_chars": "bigint", "lang": "string", "source": "string"}
    return SC.contract_check(
        table(spark, folder, "documents"), ["n_chars", "lang", "source", "author"], model, schema
    )


# --- explanations -------------------------------------------------------------


@query(
    "ex01_holdout",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def holdout(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    poor = table(spark, folder, "customer").where("c_acctbal < 0")
    saved = orders.join(poor, orders.o_custkey == poor.c_custkey, "left_semi").select("o_orderkey")
    return SP.holdout(orders, ["o_orderkey"], saved).drop("o_custkey")


@query(
    "ex05_calibration",
    f"""WITH e AS (SELECT quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM {RANKED_SQL})
    SELECT len(list_filter(q[2:10], lambda x: x < score))::INTEGER AS bin, round(avg(score), 6) AS mean_predicted,
      round(avg(positive::INTEGER), 6) AS fraction_positive, count(*) AS count FROM {RANKED_SQL}, e GROUP BY 1""",
)
def calibration(spark, folder):
    return X.calibration(ranked(spark, folder), "score", F.col("positive"), 10)


@query("ex06_confidence")
def confidence(spark, folder):
    scored = SC.predict_proba(_document_model(spark, folder), labelled_documents(spark, folder))
    return SC.confidence(scored).select("doc_id", "predicted", "confidence")


@query(
    "ex07_misclassified",
    f"""SELECT l_orderkey, l_linenumber, actual, predicted, 0.5::DOUBLE AS confidence,
      '{{"l_linestatus":"' || l_linestatus || '"}}' AS record FROM {LABELLED_LINES_SQL} WHERE actual <> predicted
    ORDER BY l_orderkey, l_linenumber, actual, predicted, l_linestatus LIMIT 25""",
)
def misclassified(spark, folder):
    order = ["l_orderkey", "l_linenumber", "actual", "predicted", "l_linestatus"]
    found = SC.misclassified(labelled(spark, folder), order, ["l_linestatus"], 25, score=F.lit(0.5))
    return found.select("l_orderkey", "l_linenumber", "actual", "predicted", "confidence", "record")


@query(
    "ex08_residual_diagnostics",
    f"""SELECT count(*) AS rows, round(avg(r), 6)::DOUBLE AS residual_mean, round(stddev_pop(r), 6)::DOUBLE AS residual_std,
    round(max(abs(r)), 6)::DOUBLE AS max_absolute_error, round(quantile_cont(r, 0.5), 6)::DOUBLE AS residual_median
    FROM (SELECT (actual - predicted)::DOUBLE AS r FROM {PRICED_SQL})""",
)
def residual_diagnostics(spark, folder):
    return X.residual_diagnostics(priced(spark, folder))


@query("ex09_permutation_importance")
def permutation_importance(spark, folder):
    rows = table(spark, folder, "lineitem")
    source = partial(table, name="lineitem")
    model = _fit(spark, folder, "linear_regression", "regression", LINE, "l_extendedprice", source)
    columns = ["l_quantity", "l_discount", "l_linestatus"]
    return X.permutation_importance(model, rows, columns, "l_extendedprice", "regression", KEY, 5)


@query(
    "ex09_permuted_replicas",
    """SELECT f, r, count(*) AS rows, round(sum(l_quantity), 2)::DOUBLE AS quantity, round(sum(l_discount), 2)::DOUBLE AS discount,
      round(sum(l_quantity * l_quantity), 2)::DOUBLE AS quantity_squares, round(avg(l_extendedprice), 2)::DOUBLE AS mean_prediction,
      TRUE AS shuffled
    FROM lineitem, (SELECT unnest(range(2))::INTEGER AS f), (SELECT unnest(range(3))::INTEGER AS r) GROUP BY f, r""",
)
def permuted_replicas(spark, folder):
    """Shuffling keeps a column's sums, and with them the mean prediction of a linear model."""
    lines = table(spark, folder, "lineitem").select(
        *KEY, "l_quantity", "l_discount", (F.col("l_quantity") * 1000 + F.col("l_discount")).alias("before")
    )
    source = partial(table, name="lineitem")
    config = FeatureConfig(numeric=("l_quantity", "l_discount"), scaler="none")
    model = _fit(spark, folder, "linear_regression", "regression", config, "l_extendedprice", source)
    found = X.permuted_replicas(lines, ["l_quantity", "l_discount"], KEY, 3, 42)
    moved = F.col("before") != F.col("l_quantity") * 1000 + F.col("l_discount")
    return SU.predict(model, found).groupBy("f", "r").agg(
        F.count("*").alias("rows"), F.round(F.sum("l_quantity"), 2).cast("double").alias("quantity"),
        F.round(F.sum("l_discount"), 2).cast("double").alias("discount"),
        F.round(F.sum(F.col("l_quantity") * F.col("l_quantity")), 2).cast("double").alias("quantity_squares"),
        F.round(F.avg("predicted"), 2).alias("mean_prediction"), (F.avg(moved.cast("int")) > 0.8).alias("shuffled"),
    )


WEIGHTS = {"l_quantity": 1900.0, "l_discount": -250.0, "l_tax": 40.0}


def _contributions(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        *KEY, F.array(*[F.col(c) for c in WEIGHTS]).alias("features")
    )
    return X.linear_contributions(rows, rows, KEY, list(WEIGHTS), list(WEIGHTS.values()), 100.0)


CONTRIBUTIONS_SQL = f"""
  m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem),
  c AS ({" UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{c}' AS feature, {w} * ({c} - m.{c[2]}) AS contribution, "
    "1900.0 * q - 250.0 * d + 40.0 * t + 100.0 AS base_value FROM lineitem, m" for c, w in WEIGHTS.items())})"""


@query(
    "ex10_linear_contributions",
    f"""WITH {CONTRIBUTIONS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, feature, feature AS source_column,
    round(contribution, 4)::DOUBLE AS contribution, round(base_value, 4)::DOUBLE AS base_value FROM c""",
)
def linear_contributions(spark, folder):
    return _contributions(spark, folder).withColumns(
        {c: F.round(c, 4) for c in ("contribution", "base_value")}
    )


@query(
    "ex10_linear_shap_adds_up",
    "SELECT count(*) AS rows, TRUE AS adds_up FROM lineitem",
)
def linear_shap(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("row", F.xxhash64(*KEY, "l_extendedprice", "l_shipdate"))
    labelled_lines = SU.labelled_rows(rows, "l_extendedprice", "regression")
    prepared = SU.prepare(labelled_lines, LINE, "regression")
    model = SU.fit_model(prepared, "linear_regression", "regression")
    parts = X.linear_shap(model, rows, rows, ["row"], prepared.names)
    total = parts.groupBy("row").agg((F.sum("contribution") + F.max("base_value")).alias("total"))
    both = SU.predict(model, rows).select("row", "predicted").join(total, "row")
    return both.agg(
        F.count("*").alias("rows"), F.bool_and(F.abs(F.col("total") - F.col("predicted")) < 1e-4).alias("adds_up")
    )


def _sample_contributions(spark, folder):
    source = partial(table, name="lineitem")
    model = _fit(spark, folder, "linear_regression", "regression", LINE, "l_extendedprice", source)
    rows = table(spark, folder, "lineitem").withColumn("row", F.xxhash64(*KEY, "l_extendedprice", "l_shipdate"))
    return model, rows, X.sampled_shapley(
        model, rows, rows, ["l_quantity", "l_discount", "l_linestatus"], ["row"], 10
    )


@query("ex11_sampled_shapley")
def sampled_shapley(spark, folder):
    return _sample_contributions(spark, folder)[2]


@query(
    "ex12_importance",
    f"""WITH {CONTRIBUTIONS_SQL} SELECT feature AS name, round(avg(abs(contribution)), 4)::DOUBLE AS mean_absolute
    FROM c GROUP BY feature""",
)
def importance(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("row", F.xxhash64(*KEY, "l_extendedprice", "l_shipdate"))
    vectors = rows.select("row", F.array(*[F.col(c) for c in WEIGHTS]).alias("features"))
    parts = X.linear_contributions(vectors, vectors, ["row"], list(WEIGHTS), list(WEIGHTS.values()), 100.0)
    return X.importance(parts, ["row"]).withColumn("mean_absolute", F.round("mean_absolute", 4))


@query(
    "ex13_beeswarm",
    f"""WITH {CONTRIBUTIONS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, feature,
    round(contribution, 4)::DOUBLE AS contribution FROM c WHERE feature IN (
      SELECT feature FROM c GROUP BY feature ORDER BY avg(abs(contribution)) DESC LIMIT 2)""",
)
def beeswarm(spark, folder):
    return X.beeswarm(_contributions(spark, folder), KEY, 2).withColumn(
        "contribution", F.round("contribution", 4)
    )


@query(
    "ex14_explain_row",
    f"""WITH {CONTRIBUTIONS_SQL}, r AS (SELECT min(l_partkey) AS p FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)),
    own AS (SELECT c.* FROM c, r WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) AND l_partkey = p)
    SELECT feature, round(contribution, 4)::DOUBLE AS contribution, round(base_value, 4)::DOUBLE AS base_value,
      round((SELECT sum(contribution) + max(base_value) FROM own), 4)::DOUBLE AS prediction FROM own""",
)
def explain_row(spark, folder):
    lines = table(spark, folder, "lineitem")
    first = lines.select(F.min(F.struct("l_orderkey", "l_partkey")).alias("k")).first()["k"]
    row = (F.col("l_orderkey") == first["l_orderkey"]) & (F.col("l_partkey") == first["l_partkey"])
    shown = X.explain_row(_contributions(spark, folder), row)
    return shown.withColumns({c: F.round(c, 4) for c in ("contribution", "base_value", "prediction")})


@query(
    "ex08_residual_points",
    f"""WITH s AS (SELECT o_orderkey, o_totalprice AS actual, 100000.0::DOUBLE AS predicted, count(*) OVER () AS size,
      row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders),
    k AS (SELECT DISTINCT CASE WHEN i = 249 THEN size - 1 ELSE CAST(floor(i * ((size - 1)::DOUBLE / 249.0::DOUBLE)) AS BIGINT) END AS pos
      FROM range(250) g(i), (SELECT count(*) AS size FROM orders))
    SELECT o_orderkey, actual, predicted, round(actual - predicted, 6)::DOUBLE AS residual FROM s WHERE pos IN (FROM k)""",
)
def residual_points(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("actual"), F.lit(100000.0).alias("predicted")
    )
    return X.residual_points(rows, ["o_orderkey"])


@query(
    "ex08_worst_residuals",
    f"""SELECT * FROM (SELECT l_orderkey, l_linenumber, l_linestatus, actual, predicted::DOUBLE AS predicted,
      abs(actual - predicted)::DOUBLE AS absolute_error FROM {PRICED_SQL})
    ORDER BY absolute_error DESC, l_orderkey, l_linenumber LIMIT 25""",
)
def worst_residuals(spark, folder):
    return X.worst_residuals(priced(spark, folder), ["l_orderkey", "l_linenumber"])
