"""Laws that fitted models obey exactly, so that SQL over the tables alone can tell their results."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.operators import drift as D
from tabloom.operators import scoring as SC
from tabloom.operators import split as SP
from tabloom.operators import supervised as SU
from tabloom.operators import unsupervised as U
from tabloom.operators.features import FeatureConfig
from tabloom.session import shared_folder
from tabloom.workload.drift import CUT, KS_SQL, PSI_SQL, STATUS
from tabloom.workload.inputs import LABELLED_SQL, labelled_documents, table
from tabloom.workload.registry import query
from tabloom.workload.supervised import DOCS, KEY, LINE, _document_model, fitted_price_model
from tabloom.workload.unsupervised import VECTORS_SQL, vectors

# A logistic model with a free intercept gives each class as much probability as it has rows.
CLASS_TOTALS_SQL = f"SELECT quality::VARCHAR AS label, count(*)::DOUBLE AS total FROM {LABELLED_SQL} WHERE quality IS NOT NULL GROUP BY 1"


def _class_totals(scored):
    labels = F.explode("probabilities").alias("label", "p")
    return scored.select(labels).groupBy("label").agg(F.round(F.sum("p"), 0).alias("total"))


@query("su05_logistic_class_totals", CLASS_TOTALS_SQL)
def logistic_class_totals(spark, folder):
    model = _document_model(spark, folder)
    p = vector_to_array("probability")
    labels = SC.class_labels(model)
    found = F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*[p[i] for i in range(len(labels))]))
    rows = SU.labelled_rows(labelled_documents(spark, folder), "quality", "classification")
    return _class_totals(SU.predict(model, rows).withColumn("probabilities", found))


@query("sc02_probability_totals", CLASS_TOTALS_SQL)
def probability_totals(spark, folder):
    rows = SU.labelled_rows(labelled_documents(spark, folder), "quality", "classification")
    return _class_totals(SC.predict_proba(_document_model(spark, folder), rows))


@query("ex06_confidence_totals", CLASS_TOTALS_SQL)
def confidence_totals(spark, folder):
    """Of two classes the other one has what the confidence leaves."""
    rows = SU.labelled_rows(labelled_documents(spark, folder), "quality", "classification")
    model = _document_model(spark, folder)
    labels = F.array(*map(F.lit, SC.class_labels(model)))
    scored = SC.confidence(SC.predict_proba(model, rows))
    share = lambda label: F.when(label == F.col("predicted"), F.col("confidence")).otherwise(1 - F.col("confidence"))
    return _class_totals(scored.withColumn("probabilities", F.map_from_arrays(labels, F.transform(labels, share))))


@query(
    "su26_saved_run",
    f"""SELECT quality::VARCHAR AS label, (n - least(n - 1, greatest(1, round(n * 0.2))))::DOUBLE AS total
    FROM (SELECT quality, count(*) AS n FROM {LABELLED_SQL} WHERE quality IS NOT NULL GROUP BY quality)""",
)
def saved_run(spark, folder):
    """A run is saved, its best model found in the stored tables, loaded and applied to the rows it learned from."""
    root, rows = shared_folder(spark), labelled_documents(spark, folder)
    run = SU.train(rows, "quality", "classification", ["logistic_regression"], DOCS, ["doc_id"])
    SU.save_run(run, root, "run-1", "documents")
    best = spark.read.parquet(f"{root}/experiments").select("experiment_id", F.col("best_model").alias("model"))
    stored = spark.read.parquet(f"{root}/models").join(best, ["experiment_id", "model"])
    loaded = PipelineModel.load(stored.first()["path"])
    placed = SP.split(SU.labelled_rows(rows, "quality", "classification"), ["doc_id"], "_y")
    return _class_totals(SC.predict_proba(loaded, placed.where("NOT is_test")))


@query(
    "su14_gbt_mean",
    "SELECT count(*) AS rows, round(avg(l_extendedprice), 0)::DOUBLE AS mean_prediction FROM lineitem",
)
def gbt_mean(spark, folder):
    """Leaves are means of what is left to explain, so the mean of all predictions is the target's."""
    rows = SU.labelled_rows(table(spark, folder, "lineitem"), "l_extendedprice", "regression")
    model = SU.fit_model(SU.prepare(rows, LINE, "regression"), "gbt_regressor", "regression")
    return SU.predict(model, rows).agg(F.count("*").alias("rows"), F.round(F.avg("predicted"), 0).alias("mean_prediction"))


@query(
    "dr10_linear_prediction_drift",
    f"""SELECT 'prediction' AS "column", psi, {STATUS} AS status, ks_statistic
    FROM ({PSI_SQL}) JOIN ({KS_SQL}) USING ("column") WHERE "column" = 'l_quantity'""",
)
def linear_prediction_drift(spark, folder):
    """A rising line keeps order and deciles: its predictions drift as its feature does."""
    scored = fitted_price_model(spark, folder).transform(table(spark, folder, "lineitem"))
    before = F.col("l_shipdate") < F.expr(CUT.replace("TIMESTAMP", "TIMESTAMP_NTZ"))
    found = D.prediction_drift(scored.where(before), scored.where(~before), "prediction")
    return found.select("column", "psi", "status", "ks_statistic")


@query(
    "un01_kmeans_scatter",
    f"""WITH {VECTORS_SQL}, d AS (SELECT d, var_pop(vec[d]) * count(*) AS s FROM v, range(1, 65) r(d) GROUP BY d)
    SELECT (SELECT count(*) FROM v) AS rows, round(sum(s), 2) AS scatter FROM d""",
)
def kmeans_scatter(spark, folder):
    """Scatter inside the clusters and between their means is the scatter of the table."""
    points = vectors(spark, folder).select("id", "vec")
    labels, _ = U.kmeans(points, 10)
    cells = points.join(labels, "id").select("label", F.posexplode("vec").alias("d", "x"))
    inside = cells.groupBy("label", "d").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("s"))
    between = inside.groupBy("d").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("s")).alias("w"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("m")).alias("t"),
    )
    return between.agg(
        F.max("rows").alias("rows"), F.round(F.sum(F.col("w") + F.col("q") - F.col("t") * F.col("t") / F.col("rows")), 2).alias("scatter")
    )


@query(
    "un07_isolation_forest_share",
    """SELECT count(*) AS rows, count(*) - 1 - floor(0.9 * (count(*) - 1))::BIGINT AS anomalies,
    count(*) AS scored FROM embeddings""",
)
def isolation_forest_share(spark, folder):
    """Scores lie between 0 and 1; a tenth, by the interpolated quantile, is flagged."""
    found = U.isolation_forest(vectors(spark, folder))
    return found.agg(
        F.count("*").alias("rows"), F.count_if("is_outlier").alias("anomalies"),
        F.count_if((F.col("score") > 0) & (F.col("score") < 1)).alias("scored"),
    )


@query(
    "un09_pca_variances",
    """WITH m AS (SELECT var_pop(l_quantity::DOUBLE) AS a, covar_pop(l_quantity::DOUBLE, l_extendedprice / 2000.0) AS b,
      var_pop(l_extendedprice / 2000.0) AS c FROM lineitem),
    r AS (SELECT (a + c) / 2 AS h, sqrt((a - c) * (a - c) / 4 + b * b) AS g FROM m)
    SELECT round(h + g, 3) AS first, round(h - g, 3) AS second, 0.0::DOUBLE AS together FROM r""",
)
def pca_variances(spark, folder):
    """Two columns: the variances of the components are the roots of a quadratic, and they do not correlate."""
    pair = F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 2000.0)
    rows = table(spark, folder, "lineitem").select(F.xxhash64(*KEY).alias("id"), pair.alias("vec"))
    return U.pca_2d(rows).agg(
        F.round(F.var_pop("x"), 3).alias("first"), F.round(F.var_pop("y"), 3).alias("second"),
        F.abs(F.round(F.covar_pop("x", "y"), 3)).alias("together"),
    )


@query(
    "un10_projection_sample",
    """WITH p AS (SELECT vec_id AS id, label, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings),
    w AS (SELECT DISTINCT CASE WHEN i = 99 THEN n - 1 ELSE floor(i * ((n - 1) / 99.0))::BIGINT END AS pos
      FROM range(100) r(i), (SELECT count(*) AS n FROM embeddings))
    SELECT id, label, NOT (n <= 100) AS sampled FROM p WHERE n <= 100 OR pos IN (SELECT pos FROM w)""",
)
def projection_sample(spark, folder):
    """Which points of the projection are shown; all of them if they are few."""
    points = vectors(spark, folder)
    shown = U.projection_points(points, 100).where("x IS NOT NULL AND y IS NOT NULL")
    return shown.select("id", "label", F.lit(points.count() > 100).alias("sampled"))


@query(
    "un05_grouping_run",
    """WITH n AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents))
    SELECT 'isolation_forest' AS model, 'rows' AS metric, n::DOUBLE AS value FROM n
    UNION ALL SELECT 'kmeans', 'cluster_count', 3.0 FROM n UNION ALL SELECT 'kmeans', 'count', n::DOUBLE FROM n
    UNION ALL SELECT 'no_such_model', 'failed', 1.0 FROM n""",
)
def grouping_run(spark, folder):
    """Clusters and anomalies of one prepared table; a failing model is a row."""
    run = U.grouping_run(
        table(spark, folder, "documents"), ["kmeans", "isolation_forest", "no_such_model"],
        FeatureConfig(numeric=("n_chars",), categorical=("lang",)), "doc_id",
    )
    sizes = run.labels["kmeans"].agg(F.count("*").cast("double").alias("value"))
    kept = run.results.where(
        "(model = 'isolation_forest' AND metric = 'rows') OR (model = 'kmeans' AND metric = 'cluster_count') OR status = 'failed'"
    ).select("model", F.coalesce("metric", "status").alias("metric"), F.coalesce("value", F.lit(1.0)).alias("value"))
    return kept.unionByName(sizes.select(F.lit("kmeans").alias("model"), F.lit("count").alias("metric"), "value"))
