"""Queries for metrics of scored frames with a deterministic score."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import metrics as M
from tabloom.workload.inputs import table
from tabloom.workload.registry import query

# A score built from the row, with many ties.
SCORE = "(l_quantity / 50 + l_discount * 3) / 2"


def ranked(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_returnflag") == "R").alias("positive"),
        F.expr(SCORE).alias("score"),
    )


RANKED_SQL = f"""(SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS positive, {SCORE} AS score FROM lineitem)"""


def labelled(spark, folder):
    """Three classes and a rule that predicts them from the quantity."""
    q = F.col("l_quantity")
    guess = F.when(q < 15, "A").when(q < 30, "N").when(q < 48, "R").otherwise("X")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_linestatus",
        F.col("l_returnflag").alias("actual"), guess.alias("predicted"),
    )


LABELLED_LINES_SQL = """(SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag AS actual,
    CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 30 THEN 'N' WHEN l_quantity < 48 THEN 'R' ELSE 'X' END AS predicted
    FROM lineitem)"""


def priced(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_linestatus",
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * 2000.0 + 500.0).alias("predicted"),
    )


PRICED_SQL = """(SELECT l_orderkey, l_linenumber, l_linestatus, l_extendedprice AS actual,
    l_quantity * 2000.0 + 500.0 AS predicted FROM lineitem)"""


@query(
    "su17_class_weights",
    """WITH c AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1)
    SELECT label, n AS count, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c""",
)
def class_weights(spark, folder):
    return M.class_weights(table(spark, folder, "orders"), "o_orderstatus", "balanced")


@query(
    "su18_confusion",
    f"""WITH l AS (SELECT DISTINCT unnest([actual, predicted]) AS label FROM {LABELLED_LINES_SQL}),
    c AS (SELECT actual, predicted, count(*) AS n FROM {LABELLED_LINES_SQL} GROUP BY ALL)
    SELECT a.label AS actual, p.label AS predicted, coalesce(n, 0) AS count
    FROM l a CROSS JOIN l p LEFT JOIN c ON c.actual = a.label AND c.predicted = p.label""",
)
def confusion(spark, folder):
    return M.confusion(labelled(spark, folder))


def classification_sql(source: str, group: str = "") -> str:
    key = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    on = f"AND s.{group} = l.{group}" if group else ""
    return f"""
  WITH s AS (SELECT * FROM {source}),
  l AS (SELECT DISTINCT {key} unnest([actual, predicted]) AS label FROM s),
  m AS (SELECT {'l.' + group + ' AS ' + group + ',' if group else ''} label, count_if(actual = label AND predicted = label) AS hits,
      count_if(actual = label) AS support, count_if(predicted = label) AS seen
    FROM l JOIN s ON (actual = label OR predicted = label) {on} GROUP BY {'l.' + group + ',' if group else ''} label)
  SELECT {key} sum(support)::BIGINT AS rows, round(sum(hits) / sum(support), 4) AS accuracy,
    round(avg(hits / support) FILTER (support > 0), 4) AS balanced_accuracy,
    round(avg(CASE WHEN seen > 0 THEN hits / seen ELSE 0 END), 4) AS precision_macro,
    round(avg(CASE WHEN support > 0 THEN hits / support ELSE 0 END), 4) AS recall_macro,
    round(avg(CASE WHEN support + seen > 0 THEN 2 * hits / (support + seen) ELSE 0 END), 4) AS f1_macro
  FROM m {by}"""


@query("su19_classification_metrics", classification_sql(LABELLED_LINES_SQL))
def classification_metrics(spark, folder):
    return M.classification_metrics(labelled(spark, folder))


CUMULATED_SQL = f"""
  c AS (SELECT score, count_if(positive) AS pos, count_if(NOT positive) AS neg FROM {RANKED_SQL} GROUP BY score),
  w AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c)"""


@query(
    "su20_roc_auc",
    f"""WITH {CUMULATED_SQL}
    SELECT any_value(p)::BIGINT AS positives, any_value(n)::BIGINT AS negatives,
      round(sum(pos * ((n - fp) + neg / 2)) / (any_value(p)::DOUBLE * any_value(n)::DOUBLE), 4) AS roc_auc FROM w""",
)
def roc_auc(spark, folder):
    return M.roc_auc(ranked(spark, folder), "score", F.col("positive"))


@query(
    "su20_roc_auc_weighted",
    """WITH s AS (SELECT l_returnflag AS y, l, CASE l WHEN 'A' THEN l_quantity WHEN 'N' THEN l_discount ELSE l_tax END AS score
      FROM lineitem, (SELECT unnest(['A', 'N', 'R']) AS l)),
    c AS (SELECT l, score, count_if(y = l) AS pos, count_if(y <> l) AS neg FROM s GROUP BY ALL),
    w AS (SELECT *, sum(neg) OVER (PARTITION BY l ORDER BY score) AS upto,
      sum(pos) OVER (PARTITION BY l) AS p, sum(neg) OVER (PARTITION BY l) AS n FROM c),
    a AS (SELECT l, any_value(p) AS p, round(sum(pos * (upto - neg + neg / 2)) / (any_value(p)::DOUBLE * any_value(n)::DOUBLE), 4) AS auc
      FROM w GROUP BY l)
    SELECT round(sum(auc * p) / sum(p), 4) AS roc_auc FROM a""",
)
def roc_auc_weighted(spark, folder):
    rows = table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "actual")
    return M.roc_auc_weighted(rows, [("A", "l_quantity"), ("N", "l_discount"), ("R", "l_tax")])


def regression_sql(source: str, group: str = "") -> str:
    key, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    return f"""SELECT {key} count(*) AS rows, round(avg(abs(actual - predicted)), 4)::DOUBLE AS mae,
    round(sqrt(avg((actual - predicted) * (actual - predicted))), 4)::DOUBLE AS rmse,
    round(1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)), 4)::DOUBLE AS r2
    FROM {source} {by}"""


@query("su21_regression_metrics", regression_sql(PRICED_SQL))
def regression_metrics(spark, folder):
    return M.regression_metrics(priced(spark, folder))


@query(
    "su23_error_samples",
    f"""SELECT * FROM {LABELLED_LINES_SQL} WHERE actual <> predicted
    ORDER BY l_orderkey, l_linenumber, actual, predicted, l_linestatus LIMIT 20""",
)
def error_samples(spark, folder):
    key = ["l_orderkey", "l_linenumber", "actual", "predicted", "l_linestatus"]
    return M.error_samples(labelled(spark, folder), key, "classification")


@query(
    "su23_largest_errors",
    f"""SELECT *, abs(actual - predicted)::DOUBLE AS absolute_error FROM (SELECT l_orderkey, l_linenumber, l_linestatus,
      actual, predicted::DOUBLE AS predicted FROM {PRICED_SQL})
    ORDER BY absolute_error DESC, l_orderkey, l_linenumber LIMIT 20""",
)
def largest_errors(spark, folder):
    return M.error_samples(priced(spark, folder), ["l_orderkey", "l_linenumber"], "regression")


@query(
    "su24_residuals",
    f"""SELECT l_orderkey, l_linenumber, actual, predicted::DOUBLE AS predicted,
    round(actual - predicted, 4)::DOUBLE AS residual FROM {PRICED_SQL}
    ORDER BY l_orderkey, l_linenumber, actual, predicted LIMIT 50""",
)
def residuals(spark, folder):
    rows = priced(spark, folder)
    shown = rows.orderBy("l_orderkey", "l_linenumber", "actual", "predicted").limit(50)
    return M.residuals(shown, ["l_orderkey", "l_linenumber"])


@query(
    "su25_select_best",
    """WITH m AS (SELECT o_orderpriority AS model, round(avg(o_totalprice) / 1000000, 6) AS f1_macro,
      CASE WHEN o_orderpriority < '3' THEN round(avg(o_totalprice) / 900000, 6) END AS cv_mean FROM orders GROUP BY 1)
    SELECT *, CAST(row_number() OVER (ORDER BY coalesce(cv_mean, f1_macro) DESC NULLS LAST, model) AS INTEGER) AS rank,
      row_number() OVER (ORDER BY coalesce(cv_mean, f1_macro) DESC NULLS LAST, model) = 1 AS is_best FROM m""",
)
def select_best(spark, folder):
    results = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.round(F.avg("o_totalprice") / 1000000, 6).alias("f1_macro"),
        F.round(F.avg(F.when(F.col("o_orderpriority") < "3", F.col("o_totalprice"))) / 900000, 6).alias("cv_mean"),
    )
    return M.select_best(results, "classification")


@query(
    "sc04_threshold_analysis",
    f"""WITH t AS (SELECT unnest([0.3, 0.4, 0.5, 0.6]) AS threshold),
    k AS (SELECT threshold::DOUBLE AS threshold, count_if(positive AND score >= threshold)::BIGINT AS tp,
      count_if(NOT positive AND score >= threshold)::BIGINT AS fp, count_if(NOT positive AND score < threshold)::BIGINT AS tn,
      count_if(positive AND score < threshold)::BIGINT AS fn FROM t, {RANKED_SQL} GROUP BY threshold)
    SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision,
      round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
      round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1 FROM k""",
)
def threshold_analysis(spark, folder):
    return M.threshold_analysis(ranked(spark, folder), "score", F.col("positive"), [0.3, 0.4, 0.5, 0.6])


@query(
    "ex02_roc_curve",
    f"""WITH {CUMULATED_SQL} SELECT score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM w
    UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""",
)
def roc_curve(spark, folder):
    return M.roc_curve(ranked(spark, folder), "score", F.col("positive"))


@query(
    "ex03_pr_curve",
    f"""WITH {CUMULATED_SQL} SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision,
    round(tp / p, 6) AS recall FROM w""",
)
def pr_curve(spark, folder):
    return M.pr_curve(ranked(spark, folder), "score", F.col("positive"))


@query(
    "ex03_average_precision",
    f"""WITH {CUMULATED_SQL} SELECT round(sum(tp / (tp + fp) * pos / p), 4) AS average_precision FROM w""",
)
def average_precision(spark, folder):
    return M.average_precision(ranked(spark, folder), "score", F.col("positive"))


@query(
    "ex04_auc",
    f"""WITH {CUMULATED_SQL} SELECT round(sum((x - coalesce(x0, 0)) * (y + coalesce(y0, 0)) / 2), 4) AS auc FROM (
      SELECT fp / n AS x, tp / p AS y, lag(fp / n) OVER (ORDER BY score DESC) AS x0,
        lag(tp / p) OVER (ORDER BY score DESC) AS y0 FROM w)""",
)
def auc(spark, folder):
    return M.auc(ranked(spark, folder), "score", F.col("positive"))


@query(
    "ex15_thin_curve",
    f"""WITH {CUMULATED_SQL},
    r AS (SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall,
      row_number() OVER (ORDER BY score) - 1 AS pos, count(*) OVER () AS size FROM w),
    k AS (SELECT DISTINCT CASE WHEN i = 24 THEN size - 1 ELSE CAST(floor(i * ((size - 1)::DOUBLE / 24.0::DOUBLE)) AS BIGINT) END AS pos
      FROM range(25) g(i), (SELECT count(*) AS size FROM w))
    SELECT threshold, precision, recall FROM r WHERE pos IN (FROM k)""",
)
def thin(spark, folder):
    curve = M.pr_curve(ranked(spark, folder), "score", F.col("positive"))
    return M.thin(curve, 25, ["threshold"])
