"""Queries for chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.dates import parse_timestamp
from tabloom.operators import charts as C
from tabloom.operators.profile import base_profile
from tabloom.workload.eda import pairs_sql
from tabloom.workload.inputs import (
    DIRTY_SQL,
    DOCUMENT_LABELS_SQL,
    LABELLED_SQL,
    dirty_documents,
    document_labels,
    labelled_documents,
    long_sql,
    numeric_sql,
    table,
)
from tabloom.workload.profile import DIRTY_TYPES, DOC_COLUMNS, LINE_NUMBERS
from tabloom.workload.registry import query


@query(
    "ch01_missing_bar",
    f"""SELECT "column", count(*) - count(value) AS missing_count,
    round((count(*) - count(value)) / count(*), 4) AS missing_ratio
    FROM ({long_sql(DOCUMENT_LABELS_SQL, DOC_COLUMNS)}) GROUP BY "column" HAVING count(*) > count(value)""",
)
def missing_bar(spark, folder):
    return C.missing_bar(document_labels(spark, folder))


def spaced_sql(source: str, n: int, key: str) -> str:
    """Rows of a source at n evenly spaced positions of its key."""
    return f"""
  numbered AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS pos, count(*) OVER () AS size FROM {source}),
  wanted AS (SELECT DISTINCT CASE WHEN size <= {n} THEN i WHEN i = {n} - 1 THEN size - 1
      ELSE CAST(floor(i * ((size - 1)::DOUBLE / ({n} - 1)::DOUBLE)) AS BIGINT) END AS pos
    FROM range({n}) r(i), (SELECT count(*) AS size FROM {source})),
  spaced AS (SELECT * FROM numbered WHERE pos IN (SELECT pos FROM wanted))"""


@query(
    "ch02_missing_heatmap",
    f"""WITH {spaced_sql(DOCUMENT_LABELS_SQL, 80, 'doc_id')},
    rows AS (SELECT *, CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER) AS row_index FROM spaced)
    SELECT row_index, 'quality' AS "column", (quality IS NULL)::INTEGER AS is_missing FROM rows
    UNION ALL SELECT row_index, 'toxic', (toxic IS NULL)::INTEGER FROM rows""",
)
def missing_heatmap(spark, folder):
    return C.missing_heatmap(document_labels(spark, folder), ["doc_id"], 80)


@query(
    "ch03_correlation_cells",
    f"""WITH p AS ({pairs_sql("lineitem", LINE_NUMBERS)}),
    best AS (SELECT i AS bi, j AS bj FROM p ORDER BY abs(correlation) DESC, i, j LIMIT 1),
    cells AS (SELECT i AS x, j AS y, column_a AS column_x, column_b AS column_y, correlation FROM p
      UNION ALL SELECT j, i, column_b, column_a, correlation FROM p
      UNION ALL SELECT k, k, {LINE_NUMBERS}[k + 1], {LINE_NUMBERS}[k + 1], 1.0 FROM range({len(LINE_NUMBERS)}) r(k))
    SELECT x::INTEGER AS x_index, y::INTEGER AS y_index, column_x, column_y, correlation::DOUBLE AS correlation,
      (x = bi AND y = bj) OR (x = bj AND y = bi) AS is_strongest FROM cells, best""",
)
def correlation_cells(spark, folder):
    return C.correlation_cells(table(spark, folder, "lineitem"), LINE_NUMBERS)


def boxes_sql(long: str, by: str) -> str:
    return f"""
  WITH v AS ({long}),
  b AS (SELECT {by}, q1, med, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
    SELECT {by}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
      quantile_cont(value, 0.75) AS q3 FROM v GROUP BY {by}))
  SELECT {by}, count(*) AS count, round(min(value) FILTER (value BETWEEN lo AND hi), 4) AS whisker_low,
    round(any_value(q1), 4) AS q25, round(any_value(med), 4) AS median, round(any_value(q3), 4) AS q75,
    round(max(value) FILTER (value BETWEEN lo AND hi), 4) AS whisker_high,
    count_if(value < lo OR value > hi)::BIGINT AS outlier_count
  FROM v JOIN b USING ({by}) GROUP BY {by} HAVING count(*) >= 4"""


BOX_COLUMNS = ["o_totalprice", "o_custkey"]


@query("ch04_box_stats", boxes_sql(numeric_sql("orders", BOX_COLUMNS), '"column"'))
def box_stats(spark, folder):
    return C.box_stats(table(spark, folder, "orders"), BOX_COLUMNS)


@query(
    "ch04_box_outliers",
    f"""WITH b AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents)
    SELECT 'n_chars' AS "column", doc_id, n_chars::DOUBLE AS value FROM documents, b
    WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1) ORDER BY doc_id LIMIT 300""",
)
def box_outliers(spark, folder):
    return C.box_outliers(table(spark, folder, "documents"), ["n_chars"], ["doc_id"], 300)


@query(
    "ch05_box_stats_by",
    boxes_sql(
        """SELECT lang AS "group", n_chars::DOUBLE AS value FROM documents WHERE lang IN (
        SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 3)""",
        '"group"',
    ),
)
def box_stats_by(spark, folder):
    return C.box_stats_by(table(spark, folder, "documents"), "n_chars", "lang", 3)


def bins_sql(values: str, shape: str) -> str:
    """Counts per bin for one shape row (lo, hi, bins)."""
    return f"""
  WITH vals AS ({values}), shape AS ({shape}),
  edged AS (SELECT b AS bin, lo + b * ((hi - lo) / bins) AS lower,
      CASE WHEN b + 1 = bins THEN hi ELSE lo + (b + 1) * ((hi - lo) / bins) END AS upper, b + 1 = bins AS last
    FROM shape, range(1000) r(b) WHERE b < bins)
  SELECT bin::INTEGER AS bin, round(lower, 4) AS lower_bound, round(upper, 4) AS upper_bound,
    count(v) AS count
  FROM edged LEFT JOIN vals ON v >= lower AND (v < upper OR (last AND v <= upper)) GROUP BY bin, lower, upper"""


AUTO_SHAPE = """SELECT lo, hi, CASE WHEN k > 20 THEN 12 ELSE k END AS bins FROM (
    SELECT lo, hi, ceil((hi - lo) / greatest({floor}, CASE WHEN fd > 0 THEN least(fd, st) ELSE st END)) AS k FROM (
      SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / (log2(count(*)) + 1) AS st,
        2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / pow(count(*), 1.0 / 3.0) AS fd FROM vals))"""


@query(
    "ch06_histogram_auto",
    bins_sql("SELECT o_totalprice AS v FROM orders", AUTO_SHAPE.format(floor="0.0")),
)
def histogram_auto(spark, folder):
    return C.histogram_auto(table(spark, folder, "orders"), "o_totalprice", 20)


@query(
    "ch06_histogram_auto_integers",
    bins_sql("SELECT p_size::DOUBLE AS v FROM part", AUTO_SHAPE.format(floor="1.0")),
)
def histogram_integers(spark, folder):
    return C.histogram_auto(table(spark, folder, "part"), "p_size", 20)


@query(
    "ch06_skew_note",
    """SELECT round(skewness(n_chars), 4) AS skewness,
    CASE WHEN abs(round(skewness(n_chars), 4)) >= 1 THEN 'strongly skewed' ELSE 'limited skew' END AS note
    FROM documents""",
)
def skew_note(spark, folder):
    return C.skew_note(table(spark, folder, "documents"), "n_chars")


@query(
    "ch07_histogram",
    bins_sql(
        "SELECT l_quantity AS v FROM lineitem",
        "SELECT min(v) AS lo, max(v) AS hi, least(10, count(DISTINCT v)) AS bins FROM vals",
    ),
)
def histogram(spark, folder):
    return C.histogram(table(spark, folder, "lineitem"), "l_quantity")


@query(
    "ch08_category_bar",
    f"""WITH c AS (SELECT coalesce(source, 'Missing') AS label, count(*) AS n FROM {DIRTY_SQL} GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rank, sum(n) OVER () AS t FROM c)
    SELECT rank::INTEGER AS rank, label, n AS count, round(n / t, 4) AS ratio FROM r WHERE rank <= 6
    UNION ALL SELECT 7, 'Other', sum(n)::BIGINT, round(sum(n) / any_value(t), 4) FROM r WHERE rank > 6""",
)
def category_bar(spark, folder):
    return C.category_bar(dirty_documents(spark, folder), "source", 6)


@query(
    "ch09_top_categories",
    """SELECT source AS label, count(*) AS count FROM documents GROUP BY source
    ORDER BY count(*) DESC, source LIMIT 10""",
)
def top_categories(spark, folder):
    return C.top_categories(table(spark, folder, "documents"), "source", most_unique=20)


@query(
    "ch10_target_distribution",
    f"""SELECT quality::VARCHAR AS label, count(*) AS count,
    round(count(*) / sum(count(*)) OVER (), 4) AS ratio FROM {DOCUMENT_LABELS_SQL}
    WHERE quality IS NOT NULL GROUP BY quality""",
)
def target_distribution(spark, folder):
    return C.target_distribution(document_labels(spark, folder), "quality", "classification")


@query(
    "ch11_composition",
    f"""WITH tops AS (SELECT source FROM {LABELLED_SQL} GROUP BY source ORDER BY count(*) DESC, source LIMIT 5),
    cells AS (SELECT quality, source, count(*) AS n FROM {LABELLED_SQL}
      WHERE source IN (FROM tops) GROUP BY ALL),
    totals AS (SELECT quality, sum(n) AS t FROM cells GROUP BY quality)
    SELECT totals.quality::VARCHAR AS target, tops.source AS feature, coalesce(n, 0) AS count,
      round(coalesce(n, 0) / t, 4) AS share
    FROM totals CROSS JOIN tops LEFT JOIN cells ON cells.quality = totals.quality AND cells.source = tops.source""",
)
def composition(spark, folder):
    return C.composition(labelled_documents(spark, folder), "source", "quality", 5)


@query(
    "ch12_scatter_sample",
    f"""WITH {spaced_sql('orders', 120, 'o_orderkey')}
    SELECT o_orderkey, o_custkey::DOUBLE AS x, round(o_totalprice, 4) AS y,
      (SELECT round(corr(o_custkey, o_totalprice), 4) FROM spaced) AS correlation FROM spaced""",
)
def scatter_sample(spark, folder):
    return C.scatter_sample(
        table(spark, folder, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"], 120
    )


@query(
    "ch13_daily_mean",
    "SELECT CAST(ts AS DATE) AS day, round(avg(value), 4) AS value FROM events GROUP BY 1",
)
def daily_mean(spark, folder):
    return C.daily_mean(table(spark, folder, "events"), "ts", "value")


@query(
    "ch14_mean_by_group",
    """SELECT o_orderpriority AS "group", count(*) AS count, round(avg(o_totalprice), 4) AS mean
    FROM orders GROUP BY 1""",
)
def mean_by_group(spark, folder):
    return C.mean_by_group(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice")


@query(
    "ch15_linspace_sample",
    f"""WITH {spaced_sql('events', 200, 'event_id')}
    SELECT event_id, user_id, event_type, value FROM spaced""",
)
def linspace_sample(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return C.linspace_sample(rows, 200, ["event_id"])


@query(
    "ch16_rank_features",
    f"""SELECT "column", round((max(m) - min(m)) / any_value(s), 4) AS score FROM (
      SELECT "column", l_returnflag, avg(value) AS m, any_value(sd) AS s FROM (
        {" UNION ALL ".join(
          f"SELECT '{c}' AS col, l_returnflag, {c} AS value FROM lineitem" for c in LINE_NUMBERS)}
      ) t(\"column\", l_returnflag, value) JOIN (
        {" UNION ALL ".join(f"SELECT '{c}' AS \"column\", stddev_samp({c}) AS sd FROM lineitem" for c in LINE_NUMBERS)}
      ) d USING ("column") GROUP BY "column", l_returnflag) GROUP BY "column" """,
)
def rank_features(spark, folder):
    return C.rank_features(table(spark, folder, "lineitem"), "l_returnflag", LINE_NUMBERS, "classification")


@query(
    "ch16_rank_features_regression",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(abs(corr({c}, l_extendedprice)), 4) AS score FROM lineitem"""
        for c in ["l_quantity", "l_discount", "l_tax"]
    ),
)
def rank_regression(spark, folder):
    return C.rank_features(table(spark, folder, "lineitem"), "l_extendedprice", LINE_NUMBERS, "regression")


@query(
    "ch17_parse_date",
    """SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS parsed FROM orders""",
)
def parse_date(spark, folder):
    layouts = ["yyyy-MM-dd", "yyyy/M/d", "M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss"]
    day = F.date_trunc("day", "o_orderdate")
    text = F.lit(None).cast("string")
    for i, layout in enumerate(layouts):
        text = F.when(F.col("o_orderkey") % len(layouts) == i, F.date_format(day, layout)).otherwise(text)
    text = F.when(text.contains("T"), F.concat(text, F.lit("Z"))).otherwise(text)
    return table(spark, folder, "orders").select("o_orderkey", parse_timestamp(text).alias("parsed"))


@query(
    "ch18_recommend_charts",
    f"""{DIRTY_TYPES},
    usable AS (SELECT * FROM roles WHERE semantic_role <> 'identifier'),
    nums AS (SELECT *, row_number() OVER (ORDER BY position) AS r FROM usable WHERE inferred_type = 'numeric'),
    cats AS (SELECT *, row_number() OVER (ORDER BY position) AS r FROM usable
      WHERE inferred_type IN ('categorical', 'boolean')),
    gaps AS (SELECT * FROM usable WHERE missing_count > 0)
    SELECT 'missing_bar' AS chart, 'quality' AS family, 10::INTEGER AS priority,
      string_agg("column", ',' ORDER BY position) AS columns FROM gaps HAVING count(*) > 0
    UNION ALL SELECT 'missing_heatmap', 'quality', 11, string_agg("column", ',' ORDER BY position) FROM gaps HAVING count(*) > 0
    UNION ALL SELECT 'correlation_heatmap', 'relationship', 20, string_agg("column", ',' ORDER BY position) FROM nums HAVING count(*) > 1
    UNION ALL SELECT 'box_overview', 'distribution', 30, string_agg("column", ',' ORDER BY position) FROM nums HAVING count(*) > 0
    UNION ALL SELECT 'histogram', 'distribution', (39 + r)::INTEGER, "column" FROM nums WHERE r <= 3
    UNION ALL SELECT 'category_bar', 'category', (49 + r)::INTEGER, "column" FROM cats WHERE r <= 3
    UNION ALL SELECT 'line', 'trend', 80,
      (SELECT min_by("column", position) FROM usable WHERE inferred_type = 'datetime') || ',' || "column"
      FROM nums WHERE r = 1""",
)
def recommend(spark, folder):
    return C.recommend_charts(base_profile(dirty_documents(spark, folder)), 3, 18, 12, 6)


@query(
    "ch18_chart_request",
    """SELECT CAST(ts AS DATE) AS day, round(avg(value), 4) AS value FROM events GROUP BY 1""",
)
def chart_request(spark, folder):
    return C.chart(table(spark, folder, "events"), C.ChartSpec("line", x="ts", y="value"))
