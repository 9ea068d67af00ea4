"""Queries for feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import features as FE
from tabloom.operators.profile import base_profile
from tabloom.workload.inputs import (
    DIRTY_SQL,
    DOCUMENT_LABELS_SQL,
    dirty_documents,
    document_labels,
    labelled_documents,
    table,
)
from tabloom.workload.profile import DIRTY_TYPES
from tabloom.workload.registry import query


@query(
    "fe01_select_features",
    f"""{DIRTY_TYPES}, r AS (SELECT *, CASE WHEN "column" = 'good' THEN 'target' WHEN "column" = 'lang' THEN 'excluded'
      WHEN semantic_role = 'identifier' THEN 'identifier' WHEN semantic_role = 'target_candidate' THEN 'other target'
      WHEN inferred_type = 'unknown' THEN 'unknown type' END AS why FROM roles)
    SELECT "column", position::INTEGER AS position, why IS NULL AS included, coalesce(why, '') AS reason FROM r""",
)
def select_features(spark, folder):
    return FE.select_features(base_profile(dirty_documents(spark, folder)), "good", excluded=["lang"])


GROUPS_SQL = f"""{DIRTY_TYPES}, g AS (SELECT *, CASE WHEN inferred_type = 'numeric' THEN 'numeric'
      WHEN inferred_type IN ('categorical', 'boolean') AND ("column" IN ('text', 'notes') OR mean_length >= 20) THEN 'text'
      WHEN inferred_type = 'text' THEN 'text' WHEN inferred_type IN ('categorical', 'boolean') THEN 'categorical'
      WHEN inferred_type = 'datetime' THEN 'datetime' ELSE 'excluded' END AS grp FROM roles)"""


@query(
    "fe02_feature_groups",
    f"""{GROUPS_SQL} SELECT "column", position::INTEGER AS position, grp AS "group" FROM g""",
)
def feature_groups(spark, folder):
    return FE.feature_groups(base_profile(dirty_documents(spark, folder)))


@query(
    "fe03_estimate_features",
    f"""{GROUPS_SQL} SELECT sum(w)::BIGINT AS estimated_features, sum(w) > 5000 AS is_wide FROM (
      SELECT CASE grp WHEN 'numeric' THEN 1 WHEN 'datetime' THEN 6 WHEN 'categorical' THEN greatest(1, unique_count)
        WHEN 'text' THEN 100 ELSE 0 END AS w FROM g)""",
)
def estimate(spark, folder):
    return FE.estimate_features(base_profile(dirty_documents(spark, folder)))


@query(
    "fe04_impute_numeric",
    f"""SELECT doc_id, coalesce(quality, (SELECT quantile_cont(quality, 0.5) FROM {DOCUMENT_LABELS_SQL}))::DOUBLE AS quality,
    coalesce(toxic, (SELECT quantile_cont(toxic, 0.5) FROM {DOCUMENT_LABELS_SQL}))::DOUBLE AS toxic
    FROM {DOCUMENT_LABELS_SQL}""",
)
def impute_numeric(spark, folder):
    rows = document_labels(spark, folder).select("doc_id", "quality", "toxic")
    return FE.impute_numeric(rows, ["quality", "toxic"])


def _mode_sql(c: str) -> str:
    return f"""(SELECT {c} FROM {DIRTY_SQL} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""


@query(
    "fe05_impute_mode",
    f"""SELECT doc_id, coalesce(good, {_mode_sql('good')}) AS good, coalesce(source, {_mode_sql('source')}) AS source
    FROM {DIRTY_SQL}""",
)
def impute_mode(spark, folder):
    rows = dirty_documents(spark, folder).select("doc_id", "good", "source")
    return FE.impute_mode(rows, ["good", "source"])


SCALED = ["o_totalprice", "o_custkey"]


def _scaled(spark, folder, kind):
    rows = table(spark, folder, "orders").select("o_orderkey", *SCALED)
    done = FE.scale(rows, SCALED, kind)
    return done.select("o_orderkey", *[F.round(c, 4).alias(c) for c in SCALED])


def _scale_sql(centre: str, spread: str) -> str:
    cells = ", ".join(
        f"round(({c} - (SELECT {centre.format(c=c)} FROM orders)) / (SELECT {spread.format(c=c)} FROM orders), 4) AS {c}"
        for c in SCALED
    )
    return f"SELECT o_orderkey, {cells} FROM orders"


@query("fe06_scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def standard(spark, folder):
    return _scaled(spark, folder, "standard")


@query(
    "fe07_scale_robust",
    _scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
)
def robust(spark, folder):
    return _scaled(spark, folder, "robust")


@query("fe08_scale_minmax", _scale_sql("min({c})", "max({c}) - min({c})"))
def minmax(spark, folder):
    return _scaled(spark, folder, "minmax")


@query(
    "fe09_one_hot",
    """WITH l AS (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT doc_id, 'source=' || CASE WHEN n >= 20 THEN d.source ELSE '(infrequent)' END AS feature, 1.0::DOUBLE AS value
    FROM documents d JOIN l ON l.source = d.source""",
)
def one_hot(spark, folder):
    labelled = labelled_documents(spark, folder)
    return FE.one_hot(labelled, table(spark, folder, "documents"), "source", ["doc_id"], 20)


@query(
    "fe10_datetime_features",
    """SELECT o_orderkey, o_orderdate, year(o_orderdate)::INTEGER AS o_orderdate_year,
    month(o_orderdate)::INTEGER AS o_orderdate_month, day(o_orderdate)::INTEGER AS o_orderdate_day,
    (isodow(o_orderdate) - 1)::INTEGER AS o_orderdate_dayofweek, quarter(o_orderdate)::INTEGER AS o_orderdate_quarter,
    (CAST(o_orderdate AS DATE) = last_day(o_orderdate))::INTEGER AS o_orderdate_is_month_end FROM orders""",
)
def datetime_features(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return FE.datetime_features(rows, "o_orderdate")


TERMS_SQL = """
  w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS words FROM documents),
  t AS (SELECT doc_id, unnest(words) AS term FROM w
    UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM w),
  vocab AS (SELECT term, count(*) AS total FROM t GROUP BY term ORDER BY total DESC, term LIMIT 60)"""


@query("fe11_vocabulary", f"WITH {TERMS_SQL} SELECT * FROM vocab")
def vocabulary(spark, folder):
    return FE.vocabulary(table(spark, folder, "documents"), "text", 60)


@query(
    "fe11_tfidf",
    f"""WITH {TERMS_SQL},
    c AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM vocab) GROUP BY ALL),
    i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term)
    SELECT doc_id, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)), 6) AS weight
    FROM c JOIN i USING (term)""",
)
def tfidf(spark, folder):
    return FE.tfidf(table(spark, folder, "documents"), "doc_id", "text", 60)


@query("fe12_preprocessor")
def preprocessor(spark, folder):
    """Size and non-zero count of every prepared row of the dirty documents."""
    from pyspark.ml.functions import vector_to_array

    rows = dirty_documents(spark, folder).withColumn(
        "day", F.try_to_timestamp("day_text").cast("timestamp_ntz")
    )
    config = FE.FeatureConfig(
        numeric=("size_text",), categorical=("lang", "source"), datetime=("day",), min_frequency=20
    )
    prepared = FE.build_preprocessor(config).fit(rows).transform(rows)
    values = vector_to_array("features")
    return prepared.select(
        "doc_id", F.size(values).alias("width"),
        F.size(F.filter(values, lambda x: x != 0)).alias("non_zero"),
    )
