"""Queries for neighbours, clusters and anomalies on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import neighbour_index as NI
from tabloom.operators import neighbours as N
from tabloom.operators import unsupervised as U
from tabloom.workload.inputs import table
from tabloom.workload.registry import query

VECTORS_SQL = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"


def vectors(spark, folder):
    return N.points(table(spark, folder, "embeddings"), "vec_id", "embedding", ["label"])


def near_sql(queries: str, base: str, k: int, extra: str = "TRUE") -> str:
    return f"""SELECT q.id AS query_id, b.id AS neighbour_id, round(list_distance(q.vec, b.vec), 6) AS distance,
      CAST(row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(q.vec, b.vec), 6), b.id) AS INTEGER) AS rank
    FROM (SELECT * FROM v WHERE {queries}) q, (SELECT * FROM v WHERE {base}) b WHERE {extra} QUALIFY rank <= {k}"""


@query("un06_knn_join", f"WITH {VECTORS_SQL} {near_sql('TRUE', 'TRUE', 5, 'q.id <> b.id')}")
def knn(spark, folder):
    points = vectors(spark, folder)
    return N.knn_join(points, points, 5, exclude_self=True)


@query("un06_knn_join_pivots", f"WITH {VECTORS_SQL} {near_sql('TRUE', 'TRUE', 4)}")
def knn_pivots(spark, folder):
    """The same join in many small blocks; a point is its own first neighbour."""
    points = vectors(spark, folder)
    return N.knn_join(points, points, 4, block_rows=200, pivots=8)


@query("un06_knn_index")
def knn_index(spark, folder):
    """Every twentieth vector against all, from inverted lists; the tests measure its recall."""
    points = vectors(spark, folder)
    return NI.knn_indexed(points.where("id % 20 = 0"), points, 5, exclude_self=True)


@query(
    "su09_knn_classify",
    f"""WITH {VECTORS_SQL}, near AS ({near_sql('TRUE', 'TRUE', 5, 'q.id <> b.id')}),
    votes AS (SELECT query_id, label, count(*) AS n FROM near JOIN v ON v.id = neighbour_id GROUP BY ALL)
    SELECT query_id, label AS predicted FROM votes
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1""",
)
def knn_classify(spark, folder):
    """Every point from the other points."""
    points = vectors(spark, folder)
    return N.knn_classify(points, points, 5, exclude_self=True)


@query(
    "su16_knn_regress",
    f"""WITH {VECTORS_SQL}, near AS ({near_sql('TRUE', 'TRUE', 5, 'q.id <> b.id')})
    SELECT query_id, round(avg(label), 4) AS predicted FROM near JOIN v ON v.id = neighbour_id GROUP BY query_id""",
)
def knn_regress(spark, folder):
    points = vectors(spark, folder).withColumn("target", F.col("label").cast("double"))
    scored = N.knn_regress(points, points, 5, exclude_self=True)
    return scored.withColumn("predicted", F.round("predicted", 4))


@query(
    "un08_local_outlier_factor",
    f"""WITH {VECTORS_SQL}, near AS MATERIALIZED ({near_sql('TRUE', 'TRUE', 20, 'q.id <> b.id')}),
    kd AS (SELECT query_id AS id, max(distance) AS kd FROM near GROUP BY 1),
    lrd AS (SELECT query_id AS id, 1 / (avg(greatest(distance, kd)) + 1e-10) AS lrd
      FROM near JOIN kd ON kd.id = neighbour_id GROUP BY 1),
    f AS (SELECT query_id AS id, avg(o.lrd) / any_value(p.lrd) AS lof FROM near JOIN lrd o ON o.id = neighbour_id
      JOIN lrd p ON p.id = query_id GROUP BY 1)
    SELECT id, round(lof, 4) AS lof, lof > (SELECT quantile_cont(lof, 0.9) FROM f) AS is_outlier FROM f""",
)
def lof(spark, folder):
    return N.local_outlier_factor(vectors(spark, folder)).withColumn("lof", F.round("lof", 4))


@query("un01_kmeans")
def kmeans(spark, folder):
    labels, inertia = U.kmeans(vectors(spark, folder), 10)
    return U.cluster_profile(labels).crossJoin(F.broadcast(inertia))


EPS, MIN_SAMPLES = 1.18, 5
DBSCAN_SQL = f"""WITH RECURSIVE {VECTORS_SQL},
    near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a, v b WHERE list_distance(a.vec, b.vec) <= {EPS}),
    core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
    links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
    reach(id, root) AS (SELECT id, id FROM core UNION SELECT links.b, root FROM reach JOIN links ON links.a = reach.id),
    comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id),
    named AS (SELECT id, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS label FROM comp),
    border AS (SELECT near.a AS id, min(label) AS label FROM near JOIN named ON named.id = near.b
      WHERE near.a NOT IN (FROM core) GROUP BY near.a),
    labelled AS (SELECT v.id, coalesce(named.label, border.label, -1)::INTEGER AS label
      FROM v LEFT JOIN named ON named.id = v.id LEFT JOIN border ON border.id = v.id)
"""


@query("un02_dbscan", f"{DBSCAN_SQL} SELECT * FROM labelled")
def dbscan(spark, folder):
    return U.dbscan(vectors(spark, folder), EPS, MIN_SAMPLES)


@query(
    "un02_dbscan_profile",
    f"""{DBSCAN_SQL} SELECT label, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 4) AS ratio,
    (count(*) FILTER (label <> -1) OVER ())::BIGINT AS cluster_count,
    round(coalesce(sum(count(*)) FILTER (label = -1) OVER (), 0) / sum(count(*)) OVER (), 4) AS noise_ratio
    FROM labelled GROUP BY label""",
)
def dbscan_profile(spark, folder):
    return U.cluster_profile(U.dbscan(vectors(spark, folder), EPS, MIN_SAMPLES, block_rows=200, pivots=6))


@query(
    "un03_silhouette",
    f"""WITH {VECTORS_SQL}, sizes AS (SELECT label, count(*) AS n FROM v GROUP BY label),
    s AS (SELECT q.id, q.label AS own, b.label AS other, sum(list_distance(q.vec, b.vec)) AS s
      FROM v q, v b GROUP BY ALL),
    p AS (SELECT id, max(s / nullif(n - 1, 0)) FILTER (own = other) AS a, min(s / n) FILTER (own <> other) AS b
      FROM s JOIN sizes ON sizes.label = other GROUP BY id)
    SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 4) AS silhouette FROM p""",
)
def silhouette(spark, folder):
    return U.silhouette(vectors(spark, folder))


@query(
    "un03_silhouette_squared",
    f"""WITH {VECTORS_SQL}, sizes AS (SELECT label, count(*) AS n FROM v GROUP BY label),
    s AS (SELECT q.id, q.label AS own, b.label AS other, sum(list_distance(q.vec, b.vec) ** 2) AS s
      FROM v q, v b GROUP BY ALL),
    p AS (SELECT id, max(s / nullif(n - 1, 0)) FILTER (own = other) AS a, min(s / n) FILTER (own <> other) AS b
      FROM s JOIN sizes ON sizes.label = other GROUP BY id)
    SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 4) AS silhouette_squared FROM p""",
)
def silhouette_squared(spark, folder):
    return U.silhouette_squared(vectors(spark, folder))


@query(
    "un04_davies_bouldin",
    f"""WITH {VECTORS_SQL}, dims AS (SELECT label, d, avg(vec[d]) AS m FROM v, range(1, 65) r(d) GROUP BY ALL),
    c AS (SELECT label, list(m ORDER BY d) AS centre FROM dims GROUP BY label),
    s AS (SELECT v.label, any_value(centre) AS centre, avg(list_distance(vec, centre)) AS scatter
      FROM v JOIN c ON c.label = v.label GROUP BY v.label)
    SELECT round(avg(w), 4) AS davies_bouldin FROM (
      SELECT max((a.scatter + b.scatter) / list_distance(a.centre, b.centre)) AS w
      FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label)""",
)
def davies_bouldin(spark, folder):
    return U.davies_bouldin(vectors(spark, folder))


@query(
    "un05_cluster_profile",
    """WITH c AS (SELECT CASE WHEN label >= 8 THEN -1 ELSE label END AS label, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT label::INTEGER AS label, n AS count, round(n / sum(n) OVER (), 4) AS ratio,
      (count(*) FILTER (label <> -1) OVER ())::BIGINT AS cluster_count,
      round(coalesce(sum(n) FILTER (label = -1) OVER (), 0) / sum(n) OVER (), 4) AS noise_ratio FROM c""",
)
def cluster_profile(spark, folder):
    rows = vectors(spark, folder).withColumn(
        "label", F.when(F.col("label") >= 8, -1).otherwise(F.col("label")).cast("int")
    )
    return U.cluster_profile(rows)


@query("un07_isolation_forest")
def isolation_forest(spark, folder):
    return U.isolation_forest(vectors(spark, folder))


@query("un09_pca_2d")
def pca(spark, folder):
    return U.pca_2d(vectors(spark, folder))


@query("un10_projection_points")
def projection(spark, folder):
    return U.projection_points(vectors(spark, folder))


@query(
    "un11_anomaly_summary",
    """SELECT count(*) AS rows, count_if(l_extendedprice > 80000)::BIGINT AS anomalies,
    round(avg(CASE WHEN l_extendedprice > 80000 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS anomaly_ratio FROM lineitem""",
)
def anomaly_summary(spark, folder):
    rows = table(spark, folder, "lineitem")
    return U.anomaly_summary(rows.select((F.col("l_extendedprice") > 80000).alias("is_outlier")))
