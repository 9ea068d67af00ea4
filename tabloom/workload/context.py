"""Queries for the analysis context."""

from __future__ import annotations

from tabloom.operators import context as X
from tabloom.workload.eda import (
    QUALITY_COLUMNS,
    QUALITY_LONG,
    QUALITY_NUMBERS,
    QUALITY_SQL,
    outliers_sql,
    pairs_sql,
)
from tabloom.workload.inputs import (
    DOCUMENT_LABELS_SQL,
    document_labels,
    long_sql,
    table,
)
from tabloom.workload.profile import types_sql
from tabloom.workload.registry import query

PHYSICAL = {"n_chars": "numeric", "quality": "numeric", "toxic": "numeric", "doc_id": "numeric"}
QUALITY_TYPES = types_sql(DOCUMENT_LABELS_SQL, QUALITY_COLUMNS, PHYSICAL)

SUMMARIES_SQL = f"""{QUALITY_TYPES},
outs AS ({outliers_sql(QUALITY_LONG)}),
summaries AS (
  SELECT "column", CAST(position AS INTEGER) AS position, inferred_type, semantic_role,
    CASE WHEN semantic_role IN ('identifier', 'target_candidate') THEN 0.98
      WHEN semantic_role = 'datetime' THEN 0.95 WHEN inferred_type = 'numeric' THEN 0.9
      WHEN inferred_type IN ('categorical', 'boolean') THEN 0.82
      WHEN inferred_type = 'text' THEN 0.75 ELSE 0.3 END::DOUBLE AS role_confidence,
    missing_ratio, unique_count, unique_ratio,
    CASE WHEN unique_count <= 2 THEN 'binary' WHEN unique_count <= 10 THEN 'low'
      WHEN unique_count <= 50 OR unique_ratio <= 0.5 THEN 'medium' ELSE 'high' END AS cardinality,
    coalesce(outlier_ratio, 0.0) AS outlier_ratio,
    CASE WHEN semantic_role = 'identifier' THEN 'exclude_from_model'
      WHEN semantic_role = 'target_candidate' THEN 'exclude_from_features,validate_target_encoding'
      WHEN inferred_type = 'numeric' THEN 'median_imputer,standard_scaler' ||
        CASE WHEN coalesce(outlier_ratio, 0) >= 0.05 THEN ',robust_scaler_candidate' ELSE '' END
      WHEN inferred_type IN ('categorical', 'boolean') THEN 'most_frequent_imputer,one_hot_encoder'
      WHEN inferred_type = 'datetime' THEN 'datetime_feature_extractor'
      WHEN inferred_type = 'text' THEN 'text_vectorizer' ELSE 'manual_type_review' END AS preprocessing,
    concat_ws('; ',
      CASE WHEN missing_ratio >= 0.4 THEN 'high missing ratio' WHEN missing_ratio >= 0.1 THEN 'moderate missing ratio' END,
      CASE WHEN inferred_type IN ('categorical', 'boolean') AND unique_count > 50 THEN 'high cardinality' END,
      CASE WHEN inferred_type = 'unknown' THEN 'type needs review' END,
      CASE WHEN coalesce(outlier_ratio, 0) >= 0.05 THEN 'notable outliers' END) AS warnings
  FROM roles LEFT JOIN outs USING ("column"))
"""


@query("ax01_column_summaries", f"{SUMMARIES_SQL} SELECT * FROM summaries")
def summaries(spark, folder):
    return X.column_summaries(document_labels(spark, folder), QUALITY_COLUMNS, QUALITY_NUMBERS)


@query(
    "ax02_quality_dimensions",
    f"""{QUALITY_SQL},
    d AS (SELECT round(100 * (1 - missing_cell_ratio), 2) AS a, round(100 * (1 - duplicate_row_ratio), 2) AS b,
      100.0 AS c, round(100 * (1 - mean_out), 2) AS e FROM signals),
    o AS (SELECT *, round(a * 0.4 + b * 0.2 + c * 0.2 + e * 0.2, 2) AS overall FROM d),
    r AS (SELECT 'completeness' AS dimension, 0.4 AS weight, a AS score, overall FROM o
      UNION ALL SELECT 'consistency', 0.2, b, overall FROM o
      UNION ALL SELECT 'type_stability', 0.2, c, overall FROM o
      UNION ALL SELECT 'outlier_stability', 0.2, e, overall FROM o)
    SELECT dimension, weight::DOUBLE AS weight, score::DOUBLE AS score,
      CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair'
        ELSE 'poor' END AS status, score < 75 AS is_risk, overall::DOUBLE AS overall_score,
      CASE WHEN overall >= 90 THEN 'Excellent' WHEN overall >= 75 THEN 'Good' WHEN overall >= 60 THEN 'Fair'
        ELSE 'Needs Attention' END AS grade FROM r""",
)
def dimensions(spark, folder):
    return X.quality_dimensions(document_labels(spark, folder), QUALITY_COLUMNS, QUALITY_NUMBERS)


@query(
    "ax03_infer_task",
    """SELECT 'o_totalprice' AS target, 'numeric' AS inferred_type, count(o_totalprice) AS non_null_count,
    count(DISTINCT o_totalprice) AS unique_count,
    CASE WHEN count(DISTINCT o_totalprice) > greatest(10, floor(count(o_totalprice) * 0.05))
      THEN 'regression' ELSE 'classification' END AS task FROM orders""",
)
def infer_task(spark, folder):
    return X.infer_task(table(spark, folder, "orders"), "o_totalprice")


CLASSES_SQL = f"""SELECT quality::VARCHAR AS label, count(*) AS count,
    round(count(*) / sum(count(*)) OVER (), 4) AS ratio FROM {DOCUMENT_LABELS_SQL}
    WHERE quality IS NOT NULL GROUP BY quality"""


@query("ax04_target_classes", CLASSES_SQL)
def classes(spark, folder):
    return X.target_classes(document_labels(spark, folder), "quality")


TARGET_SQL = f"""
  SELECT 'quality' AS target, sum(n) FILTER (label IS NOT NULL)::BIGINT AS non_null_count,
    round(coalesce(sum(n) FILTER (label IS NULL), 0) / sum(n), 4) AS missing_ratio,
    count(label) AS classes, arg_min(label, -n * 1000 + label) FILTER (label IS NOT NULL)::VARCHAR AS majority_class,
    round(max(n) FILTER (label IS NOT NULL) / sum(n) FILTER (label IS NOT NULL), 4) AS majority_ratio,
    round(max(n) FILTER (label IS NOT NULL) / min(n) FILTER (label IS NOT NULL), 4) AS imbalance_ratio,
    sum(n) AS total, min(n) FILTER (label IS NOT NULL) AS least
  FROM (SELECT quality AS label, count(*) AS n FROM {DOCUMENT_LABELS_SQL} GROUP BY quality)"""


@query(
    "ax04_target_classification",
    f"""SELECT target, non_null_count, missing_ratio, classes, majority_class, majority_ratio, imbalance_ratio,
    round(greatest(0, least(100, 100 - missing_ratio * 40
      - CASE WHEN total < 50 THEN 25 WHEN total < 200 THEN 10 ELSE 0 END
      - CASE WHEN majority_ratio >= 0.8 THEN 25 WHEN majority_ratio >= 0.65 THEN 10 ELSE 0 END
      - CASE WHEN least < 5 THEN 20 ELSE 0 END - CASE WHEN classes > 20 THEN 15 ELSE 0 END)), 2)::DOUBLE AS readiness_score,
    concat_ws('; ', CASE WHEN total < 50 THEN 'fewer than 50 rows' WHEN total < 200 THEN 'small table' END,
      CASE WHEN majority_ratio >= 0.8 THEN 'severe class imbalance' WHEN majority_ratio >= 0.65 THEN 'moderate class imbalance' END,
      CASE WHEN least < 5 THEN 'a class has fewer than five rows' END,
      CASE WHEN classes > 20 THEN 'many classes' END) AS warnings
    FROM ({TARGET_SQL})""",
)
def classification(spark, folder):
    return X.target_classification(document_labels(spark, folder), "quality")


@query(
    "ax05_target_regression",
    """WITH s AS (SELECT count(*) AS n, count(DISTINCT n_chars) AS u, avg(n_chars) AS mean, stddev_samp(n_chars) AS std,
      min(n_chars)::DOUBLE AS min, quantile_cont(n_chars, 0.5) AS median, max(n_chars)::DOUBLE AS max,
      round(skewness(n_chars), 4) AS skewness FROM documents)
    SELECT 'n_chars' AS target, n AS non_null_count, 0.0::DOUBLE AS missing_ratio, u AS unique_count,
      round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min, round(median, 4) AS median,
      round(max, 4) AS max, skewness,
      round(100.0 - CASE WHEN n < 50 THEN 25 WHEN n < 200 THEN 10 ELSE 0 END
        - CASE WHEN abs(skewness) >= 2 THEN 10 ELSE 0 END - CASE WHEN u < 20 THEN 20 ELSE 0 END, 2)::DOUBLE AS readiness_score,
      concat_ws('; ', CASE WHEN n < 50 THEN 'fewer than 50 rows' WHEN n < 200 THEN 'small table' END,
        CASE WHEN abs(skewness) >= 2 THEN 'strongly skewed' END,
        CASE WHEN u < 20 THEN 'few distinct values' END) AS warnings FROM s""",
)
def regression(spark, folder):
    return X.target_regression(table(spark, folder, "documents"), "n_chars")


FINDINGS_SQL = f"""{SUMMARIES_SQL},
copies AS (SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS dup FROM (
    SELECT {", ".join(QUALITY_COLUMNS)}, count(*) AS n FROM {DOCUMENT_LABELS_SQL} GROUP BY ALL)),
strong AS (SELECT count_if(abs(correlation) >= 0.85)::BIGINT AS pairs
    FROM ({pairs_sql(DOCUMENT_LABELS_SQL, QUALITY_NUMBERS)})),
target AS ({TARGET_SQL}),
found AS (
  SELECT 'small-sample-size' AS id, 'modeling' AS category, 'warning' AS severity, row_count::VARCHAR AS evidence
    FROM copies WHERE row_count < 100
  UNION ALL SELECT 'missing-value-risk', 'data_quality',
    CASE WHEN max(missing_ratio) >= 0.4 THEN 'critical' ELSE 'warning' END,
    string_agg("column", ',' ORDER BY "column") FROM summaries WHERE missing_ratio >= 0.1 HAVING count(*) > 0
  UNION ALL SELECT 'duplicate-row-risk', 'data_quality', 'warning', dup::VARCHAR FROM copies WHERE dup > 0
  UNION ALL SELECT 'outlier-risk', 'data_quality', 'warning', string_agg("column", ',' ORDER BY "column")
    FROM summaries WHERE outlier_ratio >= 0.05 HAVING count(*) > 0
  UNION ALL SELECT 'high-cardinality-categories', 'schema', 'warning', string_agg("column", ',' ORDER BY "column")
    FROM summaries WHERE cardinality = 'high' AND inferred_type IN ('categorical', 'boolean') HAVING count(*) > 0
  UNION ALL SELECT 'strong-feature-correlation', 'relationship', 'warning', pairs::VARCHAR FROM strong WHERE pairs > 0
  UNION ALL SELECT 'target-readiness-risk', 'target', 'warning', concat_ws('; ',
      CASE WHEN total < 50 THEN 'fewer than 50 rows' WHEN total < 200 THEN 'small table' END,
      CASE WHEN majority_ratio >= 0.8 THEN 'severe class imbalance' WHEN majority_ratio >= 0.65 THEN 'moderate class imbalance' END,
      CASE WHEN least < 5 THEN 'a class has fewer than five rows' END) AS w FROM target WHERE w <> ''
  UNION ALL SELECT 'model-not-trained', 'modeling', 'info', 'quality'),
ranked AS (SELECT *, CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END::INTEGER AS severity_rank FROM found)
"""


def _findings(spark, folder):
    return X.findings(
        document_labels(spark, folder), "quality", "classification", 0, QUALITY_COLUMNS, QUALITY_NUMBERS
    )


@query("ax06_findings", f"{FINDINGS_SQL} SELECT * FROM ranked")
def findings(spark, folder):
    return _findings(spark, folder)


@query(
    "ax06_next_actions",
    f"""{FINDINGS_SQL},
    actions(id, action) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in X.ACTIONS.items())}),
    rows AS (SELECT severity_rank AS a, id AS b, action FROM ranked JOIN actions USING (id) WHERE severity <> 'info'
      UNION ALL SELECT 9, '0', 'train baseline models with cross-validation'
      UNION ALL SELECT 9, '1', 'review the recommended charts'
      UNION ALL SELECT 9, '2', 'use this context as input of later steps')
    SELECT CAST(row_number() OVER (ORDER BY a, b) AS INTEGER) AS rank, action FROM rows ORDER BY 1 LIMIT 8""",
)
def actions(spark, folder):
    return X.next_actions(_findings(spark, folder), True, False, 5)


@query(
    "ax07_top_issues",
    f"""WITH outs AS ({outliers_sql(QUALITY_LONG)}),
    rows AS (
      SELECT 'missing' AS issue, "column" AS name, round((count(*) - count(value)) / count(*), 4) AS value
        FROM ({long_sql(DOCUMENT_LABELS_SQL, QUALITY_COLUMNS)}) GROUP BY "column" HAVING count(*) > count(value)
      UNION ALL SELECT 'outliers', "column", outlier_ratio FROM outs WHERE outlier_count > 0
      UNION ALL SELECT 'correlation', column_a || ' ~ ' || column_b, correlation
        FROM ({pairs_sql(DOCUMENT_LABELS_SQL, QUALITY_NUMBERS)}) WHERE correlation IS NOT NULL)
    SELECT issue, CAST(row_number() OVER (PARTITION BY issue ORDER BY abs(value) DESC, name) AS INTEGER) AS rank,
      name, value FROM rows QUALIFY rank <= 10""",
)
def issues(spark, folder):
    return X.top_issues(document_labels(spark, folder), QUALITY_COLUMNS, QUALITY_NUMBERS)
